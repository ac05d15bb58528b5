"""URL filter: explicit host and path rules, else an empirical-Bayes reputation of the host.

Labelled page outcomes (n seen, k bad) are summed per host, registered domain and suffix.  Each level is a
beta-binomial whose mean is the posterior mean of the level above and whose concentration is the moment
estimate from the between-group variance (one-way analysis of variance of the children within their
parents).  A host's own outcomes are left out of its prior.  A host is blocked when the lower bound of its
posterior bad rate (mean minus ``z`` standard deviations of the beta) exceeds ``max_bad``.

Outcomes are pre-aggregated before every shuffle.  The reputation goes back to the pages by a join salted
over ``salts`` values, so a host with a third of all pages is dealt over that many tasks.

Defined results: a null url or one without ``://`` has empty host and path and the reputation of the empty
host; every input row gives one output row, repeated rows too; outcomes whose page is not in the table are
ignored; no outcomes at all give the neutral prior, which blocks nothing; input columns that share a name
with an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.store import cut

#: Suffixes of more than one label below which registered domains lie; a parameter, extended by the caller.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "com.cn")
ADDED = ("host", "path", "rule", "verdict", "bad_bound", "n_outcomes")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(last) if suffixes else last


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more."""
    labels = F.when(F.instr(suffix, ".") > 0, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return labels


def matching_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule string and verdict of the longest fitting rule, both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def concentration(children: DataFrame, parent: str) -> float:
    """Prior strength from the variance of the children's rates within their parents; one row is collected."""
    c = children.filter("n > 0").select(parent, "n", "k")
    per_parent = c.groupBy(parent).agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    )
    r = per_parent.agg(
        F.sum("c").alias("c"), F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("nn") / F.col("n")).alias("nn"),
        F.sum(F.col("kk") - F.col("k") * F.col("k") / F.col("n")).alias("between"), F.sum(F.col("k") - F.col("kk")).alias("within"),
    ).first()
    if not r["n"] or r["c"] <= r["g"] or r["n"] <= r["c"]:
        return 10.0
    between, within = max(r["between"], 0.0) / (r["c"] - r["g"]), max(r["within"], 0.0) / (r["n"] - r["c"])
    size = (r["n"] - r["nn"]) / (r["c"] - r["g"])
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return round(1 / min(max(rho, 0.001), 0.9) - 1, 6)


def host_reputation(hosts: DataFrame, z: float, suffixes: Sequence[str]) -> DataFrame:
    """``hosts``: host, n, k. Adds ``bad_bound``, the lower bound of the posterior bad rate."""
    h = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    h = cut(h.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(0))
    top = s.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    of_host, of_domain, of_suffix = concentration(h, "domain"), concentration(d, "suffix"), concentration(s, "root")
    base = ((top["k"] or 0) + 0.5) / ((top["n"] or 0) + 1.0)
    s = s.select("suffix", ((F.col("k") + of_suffix * base) / (F.col("n") + of_suffix)).alias("s_mean"))
    d = d.join(s, "suffix").select("domain", F.col("n").alias("dn"), F.col("k").alias("dk"), "s_mean")
    prior = (F.col("dk") - F.col("k") + of_domain * F.col("s_mean")) / (F.col("dn") - F.col("n") + of_domain)
    a, b = F.col("k") + of_host * F.col("prior"), F.col("n") - F.col("k") + of_host * (1 - F.col("prior"))
    spread = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return (
        h.join(d, "domain").withColumn("prior", prior).withColumns({"a": a, "b": b})
        .select("host", "n", (F.col("a") / (F.col("a") + F.col("b")) - z * spread).alias("bad_bound"))
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), max_bad: float = 0.3, z: float = 1.64,
    suffixes: Sequence[str] = SUFFIXES, salts: int = 8,
) -> DataFrame:
    """``pages`` (page_id, url, ...) with ``ADDED``; ``outcomes``: page_id, bad (0 or 1), any number per page."""
    p = pages.drop(*[c for c in ADDED if c in pages.columns])
    p = p.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    seen = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id")
    seen = seen.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    per_page = p.select("page_id", "host").join(seen, "page_id", "left")
    hosts = per_page.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    rated = host_reputation(hosts, z, suffixes)
    rated = rated.select("host", F.col("n").alias("n_outcomes"), "bad_bound", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    p = p.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    name, by_rule = matching_rule(rules, F.col("host"), F.col("path"))
    by_host = F.when(F.col("bad_bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rated, ["host", "__salt"], "left").drop("__salt").withColumns({"rule": name, "verdict": F.coalesce(by_rule, by_host)})
