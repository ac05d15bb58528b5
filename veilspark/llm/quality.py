"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of characters other than space and the ASCII controls 9 to 13.  Everything is measured
within the row, so the plan has no shuffle and reads only the text column besides what it returns.

Defined results: a null text is an empty one and has no words, so it fails the base rule; a text of white
space likewise; rows that repeat are judged one by one; an empty table gives an empty table; columns of the
input that share a name with a measure are replaced by the measure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was be with as by this are an from at or not have has "
    "der die das und den von zu mit sich des ist im dem nicht ein eine als auch es an werden aus er hat "
    "de la le les et un une que qui dans par pour au sur pas plus avec ce il sont est du "
    "el los las en y con por para se del al lo como su una"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low <= numerator / denominator <= high``; without a denominator, the plain number."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def holds(self, of: Callable[[str], Column]) -> Column:
        value = of(self.numerator).cast("double")
        if self.denominator:
            value = value / F.greatest(of(self.denominator), F.lit(1))
        checks = [value >= self.low] if self.low is not None else []
        checks += [value <= self.high] if self.high is not None else []
        out = checks[0]
        for more in checks[1:]:
            out = out & more
        return out


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("length", "n_words", None, low=50),
    Rule("word_length", "word_chars", "n_words", low=3.0, high=10.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


VERDICTS = ("base_failed", "failed_rules", "kept")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A name given by a projection would not do: a filter pushed below
    it would hold a copy of the value for each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """The three-word windows' hashes with their positions, sorted."""
    n = F.size(words) - 2
    keyed = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n > 0, F.sort_array(keyed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _covered(keyed: Column) -> Column:
    """Words that lie in windows found at least twice: equal neighbours are repeats, and the union of their
    three-word spans is summed in order of position.  Linear in memory, n log n in time."""
    m = F.size(keyed)
    same = lambda a, b: F.get(keyed, a)["h"] == F.get(keyed, b)["h"]
    repeated = F.filter(
        F.sequence(F.lit(0), m - 1),
        lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)),
    )
    spots = F.sort_array(F.transform(repeated, lambda j: F.get(keyed, j)["i"]))
    total = F.aggregate(
        spots,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(m > 1, total).otherwise(F.lit(0))


def _counts(text: Column, words: Column, lines: Column) -> Column:
    stop = list(dict.fromkeys(STOP_WORDS))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_stop_words": F.size(F.filter(words, lambda x: x.isin(stop))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _bind(_windows(words), _covered),
    }
    return F.struct(*[counts[c].cast("long").alias(c) for c in MEASURES])


def _verdict(counts: Column, rules: tuple[Rule, ...]) -> Column:
    base = (counts["n_words"] < 50) | (counts["n_repeat_words"] * 100 > counts["n_words"] * 50)
    failed = F.filter(F.array(*[F.when(~r.holds(lambda n: counts[n]), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return _bind(
        failed,
        lambda f: F.struct(*[counts[c].alias(c) for c in MEASURES], base.alias("base_failed"), f.alias("failed_rules"), (~base & (F.size(f) == 0)).alias("kept")),
    )


def verdict(text: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """One expression: a struct of ``MEASURES`` (long) and ``VERDICTS``."""
    words = lambda t: F.filter(F.split(t, SPACES), lambda x: x != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda t: _bind(words(t), lambda w: _bind(lines(t), lambda l: _counts(t, w, l)))
    return _bind(F.coalesce(F.col(text), F.lit("")), lambda t: _bind(counted(t), lambda c: _verdict(c, rules)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed``, ``failed_rules`` (names, in the table's order) and ``kept``."""
    rest = docs.drop(*MEASURES, *VERDICTS)
    return rest.withColumn("__verdict", verdict(text, rules)).select(*rest.columns, "__verdict.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the columns of the input."""
    return docs.filter(verdict("text", rules)["kept"])
