"""Verdicts on URLs by a list of rules (host, path, verdict).

A rule fits its host and all subdomains, for paths that start with the rule's path.  Each
URL is expanded into expressions, a suffix of its host (whole labels) with a prefix of its
path; each expression is hashed, the first digits of its hash are equi-joined with those of
the rules' hashes, and a rule is taken only if the full digests agree.  Of the rules that
fit, the longest wins; without one the URL is allowed.

Only expressions of shapes that some rule has (labels of the host, characters of the path)
are made.  The shapes alone are brought to the driver: there are no more of them than labels
of the longest rule's host times characters of the longest rule's path.

Rows: a null address, or one without ``://``, has an empty host and path and is allowed, as
no rule fits an empty host.  A host keeps user names and ports; only A-Z are lower-cased.
Rules: hosts are compared in lower case; a null or empty host, a host with a slash, or a null
verdict makes a rule void; a null path is empty.  If rules of one length fit, the one with
the longer host wins, and a block wins over an allow of the same rule.  Without rules every
URL is allowed.  Repeated rows stay, each with its own verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.cluster import ready
from folio.session import settle

#: Hexadecimal digits of the hash prefix that is joined on.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased in A-Z, and the path of an address; both empty where it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # a host holds no slash, so the first one ends it
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Valid rules, one per host and path, with hash prefix, digest and shape."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    valid = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict")).filter(
        "host <> '' and verdict is not null and not contains(host, '/')"
    )
    strict = valid.groupBy("host", "path").agg(F.max("verdict").alias("_last"), F.bool_or(F.col("verdict") == "block").alias("_block"))
    digest = _digest(F.col("host"), F.col("path"))
    return strict.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("digest"),
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        F.when(F.col("_block"), "block").otherwise(F.col("_last")).alias("rule_verdict"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("characters"),
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The digests of the expressions of one address that have one of the shapes."""
    parts = F.split(host, r"\.")
    made = []
    for labels in sorted({s[0] for s in shapes}):
        suffix = F.when(F.size(parts) >= labels, F.substring_index(host, ".", -labels))
        lengths = F.array(*[F.lit(n) for n in sorted(c for own, c in shapes if own == labels)])
        fit = F.filter(lengths, lambda n: (n <= F.length(path)) & suffix.isNotNull())
        made.append(F.transform(fit, lambda n: _digest(suffix, F.substr(path, F.lit(1), n))))
    return F.concat(*made) if made else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of every row."""
    ready(pages.sparkSession)
    rules = settle(hashed_rules(rules), "rules")
    shapes = [tuple(r) for r in rules.select("labels", "characters").distinct().collect()]
    host, path = host_and_path(F.col(url).cast("string"))
    # written, so that a row keeps its number when a task is run again
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    rows = settle(rows, "urls")
    made = rows.withColumn("digest", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes)))
    made = made.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    found = rules.select("prefix", F.col("digest").alias("rule_digest"), "rule", "host_length", "rule_verdict")
    met = made.join(found, "prefix", "left")
    # equal prefixes only suggest a rule: the digests decide
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), "host_length", "rule", "rule_verdict"))
    # the expressions of a row leave one task, which hands on one row for them
    best = met.groupBy("_row", key, "host", "path").agg(F.max(fits).alias("best"))
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(DEFAULT)).alias("verdict"))
