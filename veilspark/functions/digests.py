"""HMAC, canonical JSON, set parsing and other scalar functions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SETS = ("pii", "phi", "pci", "secrets")
MODES = ("reversible", "strip", "off")


def hmac_sha256(secret: str, value: Column) -> Column:
    """HMAC-SHA256 in hex, composed of ``sha2``.

    Only the two padded keys stand in the plan; whoever can read plans can still forge tags, so keep plans
    and event logs as secret as the key.
    """
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def parse_sets(csv: Column, fallback: Column | None = None) -> Column:
    """Known set names of a comma-separated text, trimmed and in lower case; none left: the fallback."""
    names = F.filter(F.transform(F.split(csv, ","), lambda x: F.lower(F.trim(x))), lambda x: x.isin(*SETS))
    return F.when(F.size(names) > 0, names).otherwise(fallback) if fallback is not None else names


def unknown_sets(csv: Column) -> Column:
    """Distinct names that are no sets, in order; these make a request invalid."""
    names = F.filter(F.transform(F.split(csv, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.array_except(names, F.array(*map(F.lit, SETS))))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def canonical_json(fields: dict[str, Column], maps: Sequence[str] = ()) -> Column:
    """JSON of a record with its keys, and those of its maps, in order; nulls are written."""
    ordered = [(sorted_map(fields[k]) if k in maps else fields[k]).alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def now_ms() -> Column:
    """Milliseconds since 1970; one value for a whole query, so a task that is run again gives the same."""
    return F.unix_millis(F.current_timestamp())


def bare_path(path: Column) -> Column:
    return F.split_part(path, F.lit("?"), F.lit(1))


def lower_keys(headers: Column) -> Column:
    """Names in lower case, in order; the values of one name in several spellings are joined by commas."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = lambda name: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"])
    joined = F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(values(n), ", ")))
    return F.when(F.size(names) == F.size(headers), F.transform_keys(headers, lambda k, _: F.lower(k))).otherwise(joined)
