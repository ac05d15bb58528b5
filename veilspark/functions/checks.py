"""Validators of matched values, each as a Spark expression and as its Python twin for the Arrow path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits, separators ignored, mod-10."""
    return F.length(digits(value)).between(12, 19) & F.call_function("luhn_check", digits(value))


def iban(value: Column) -> Column:
    """ISO 7064 mod-97: the first four characters go last, letters count as 10 to 35."""
    v = F.upper(F.regexp_replace(value, r"\s+", ""))
    moved = F.split(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4)), "")
    number = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(
        F.filter(moved, lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97
    )
    return v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (rest == 1)


def aba_routing(value: Column) -> Column:
    """Nine digits, weights 3, 7, 1, a non-zero multiple of ten."""
    d = digits(value)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), start=F.lit(0))
    return (F.length(d) == 9) & F.coalesce((total % 10 == 0) & (total != 0), F.lit(False))


def ssn(value: Column) -> Column:
    """Area not 000, 666 or 900 and above; group not 00; serial not 0000."""
    d = digits(value)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


_DATE = "([0-9]{1,4})[/-]([0-9]{1,2})[/-]([0-9]{2,4})"


def plausible_date(value: Column) -> Column:
    """Some two of the three numbers, in order, are a month and a day."""
    a, b, c = (F.regexp_extract(value, _DATE, i).try_cast("int") for i in (1, 2, 3))
    pair = lambda m, d: m.between(1, 12) & d.between(1, 31)
    return F.coalesce(pair(a, b) | pair(b, c) | pair(a, c), F.lit(False))


def phone_length(value: Column) -> Column:
    return F.length(digits(value)).between(8, 15)


def _only_digits(v: str) -> str:
    return re.sub("[^0-9]", "", v)


def py_luhn(v: str) -> bool:
    d = [int(c) for c in reversed(_only_digits(v))]
    return 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def py_iban(v: str) -> bool:
    v = re.sub(r"\s+", "", v).upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def py_aba_routing(v: str) -> bool:
    total = sum(int(c) * w for c, w in zip(_only_digits(v), (3, 7, 1) * 3, strict=False))
    return len(_only_digits(v)) == 9 and total > 0 and total % 10 == 0


def py_ssn(v: str) -> bool:
    d = _only_digits(v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[:3] < "900" and d[3:5] != "00" and d[5:] != "0000"


def py_plausible_date(v: str) -> bool:
    m = re.search(_DATE, v)
    if not m:
        return False
    a, b, c = map(int, m.groups())
    return any(1 <= x <= 12 and 1 <= y <= 31 for x, y in ((a, b), (b, c), (a, c)))


def py_phone_length(v: str) -> bool:
    return 8 <= len(_only_digits(v)) <= 15


#: name -> (Spark expression, Python twin)
CHECKS = {
    "luhn": (luhn, py_luhn),
    "iban": (iban, py_iban),
    "aba_routing": (aba_routing, py_aba_routing),
    "ssn": (ssn, py_ssn),
    "plausible_date": (plausible_date, py_plausible_date),
    "phone_length": (phone_length, py_phone_length),
}
