"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` and the literal tokens that every address it
fits must hold. Each rule is filed under the one of its tokens that fewest addresses hold; an
address fetches rules by its own tokens, and only those run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import lower_ascii

TOKEN = r"[0-9a-z]+"
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``name`` is None for rules of the method; among fitting rules the highest rank decides."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    name: str | None = None


def prefix_rule(verdict: str, name: str) -> Rule:
    """A rule written as host and path start: fits the host and its subdomains.

    The last run of letters and digits may go on in the address unless a sign ends it, so only runs
    that are closed on both sides are literal tokens.
    """
    host, slash, path = name.partition("/")
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path)
    closed = tuple(m[1] for m in re.finditer(r"([0-9a-z]+)(?![0-9a-z])(?=.)", name))
    return Rule(verdict, pattern, closed, 1000 + len(name), name)


# The address rules of the contract.
CONTRACT = [
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
]

# Words that, joined by a hyphen to another or alone as a host label, mark hosts without content.
BLOCKED_LABELS = ["spam", "pills", "casino", "viagra", "porn", "xxx", "betting", "warez", "clickbait"]
METHOD = [Rule("block", r"^[^/]*(?<![0-9a-z])" + w + r"(?![0-9a-z])[^/]*(?:/|$)", (w,), i)
          for i, w in enumerate(BLOCKED_LABELS)]


def host_and_path(url):
    """Columns for the lower-case host and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(address):
    return F.array_distinct(F.regexp_extract_all(lower_ascii(address), F.lit(TOKEN), F.lit(0)))


def filed(addresses: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; the counts are one row per token that a rule names."""
    named = sorted({t for r in rules for t in r.tokens})
    counts = {
        r["token"]: r["n"]
        for r in addresses.select(F.explode(tokens_of(F.col("address"))).alias("token"))
        .where(F.col("token").isin(named)).groupBy("token").agg(F.count("*").alias("n")).collect()
    }
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(rarest, []).append(i)
    return index


def judge(
    pages: DataFrame, rules: list[Rule] = CONTRACT + METHOD, otherwise: str = "allow",
    page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Every rule names at least one literal token. A null address, one without ``://`` and an empty one
    have empty host and path, fit no rule and get ``otherwise``. Repeated rows and repeated addresses
    each give their row; addresses are judged once and joined back. Rules are a list the caller holds;
    beyond BROADCAST_RULES their table is joined by shuffle. Other columns are ignored.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token cannot be filed")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("address", F.concat("host", "path"))
    addresses = rows.select("address").distinct()
    index = filed(addresses, rules) if rules else {}
    table = spark.createDataFrame(
        [(t, r.pattern, r.rank, r.name, r.verdict) for t, numbers in index.items() for r in map(rules.__getitem__, numbers)],
        "token string, pattern string, rank int, rule string, verdict string",
    )
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    fetched = (
        addresses.select("address", F.explode(tokens_of(F.col("address"))).alias("token"))
        .join(table, "token")
        .where(F.expr("rlike(address, pattern)"))
        .groupBy("address")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    )
    return rows.join(fetched, "address", "left").select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"),
    )


def _case(rule: Rule) -> str:
    host, _, path = rule.name.partition("/")
    return (
        f"SELECT '{rule.name}' AS rule, '{rule.verdict}' AS verdict, '{host}' AS rule_host, '/{path}' AS rule_path"
    )


SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (
  SELECT page_id,
         coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM h),
k AS (SELECT row_number() OVER () AS n, * FROM p),
rules AS ({" UNION ALL ".join(_case(r) for r in CONTRACT)}),
fits AS (
  SELECT k.n, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM k JOIN rules r ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host))
                     AND starts_with(k.path, r.rule_path)
  GROUP BY k.n)
SELECT k.page_id, k.host, k.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(k.host,
         '(^|[^0-9a-z])({"|".join(BLOCKED_LABELS)})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fits f ON k.n = f.n
"""
