"""URL filters: rules, then trust and distrust over the host graph (operator 10).

All DataFrame operations.  A page whose url fits a rule gets the rule's
verdict.  Other pages get their host's: trust is personalised PageRank from
hosts with allowed pages along the links between hosts, distrust the same
from hosts with blocked pages against the links (who links to a blocked host
is distrusted).  Both use equal scales, so a host is blocked when its
distrust reaches ``min_distrust`` and exceeds its trust.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm.common import materialise, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules as (verdict, host and path).
CONTRACT_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Absolute and protocol-relative link targets; the host is the group.
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 400               # an error is raised if that many do not settle the scores
    settled: float = 1e-6           # of min_distrust: what all steps to come may still add to a score
    min_distrust: float = 0.01


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=CONTRACT_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls if none fits.  Rules
    of equal length: the first in alphabetical order."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last written wins
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed per pair.

    Links are counted with map-side combine before the shuffle, so neither a
    host with a third of all pages nor a much-linked host gathers its links
    in one task."""
    targets = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1),
                          lambda x: F.translate(x, _UPPER, _LOWER))
    links = pages.select(F.col(host_col).alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, p: Propagation = Propagation()) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, seed) along
    ``edges`` (src, dst, n).  A host hands its score on in proportion to its
    links; scores of hosts without links go nowhere.

    A step hands on only what the step before brought.  What it brings in all
    (one number a step) bounds what is still to come, and the steps end when
    that cannot change a verdict."""
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = materialise(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "url-steps")
    start = seeds.select("host", ((1 - p.damping) * F.col("seed")).alias("score"))
    if steps.isEmpty():
        return start
    brought, parts = start, [start]

    def summed(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, parts).groupBy("host").agg(F.sum("score").alias("score"))

    for _ in range(p.rounds):
        handed = brought.join(steps, brought["host"] == steps["src"]).select(F.col("dst").alias("host"), (p.damping * F.col("score") * F.col("share")).alias("score"))
        brought = materialise(handed.groupBy("host").agg(F.sum("score").alias("score")), "url-step")
        parts.append(brought)
        if len(parts) > 8:
            parts = [materialise(summed(parts), "url-score")]
        mass = brought.agg(F.sum("score")).first()[0] or 0.0
        if mass * p.damping / (1 - p.damping) <= p.settled * p.min_distrust:
            return summed(parts)
    raise RuntimeError(f"scores did not settle in {p.rounds} steps")


def url_filter(pages: DataFrame, rules=CONTRACT_RULES, p: Propagation = Propagation(),
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row per page.

    Null or malformed urls have empty host and path: no rule fits and no
    score exists, so they are allowed by the method.  Null html has no links;
    html of any length is searched in its row.  A host whose distrust equals
    its trust is allowed.
    Repeated rows are judged alike (and weigh on their host as often as they
    occur); an empty table gives an empty result.  Other columns are ignored.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    hosts = materialise(judged.where("host <> ''").groupBy("host").agg(
        F.avg((F.col("rule_verdict") == "allow").eqNullSafe(F.lit(True)).cast("int")).alias("allowed"),
        F.avg((F.col("rule_verdict") == "block").eqNullSafe(F.lit(True)).cast("int")).alias("blocked")), "url-hosts")
    edges = materialise(host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html"))), "url-edges")
    trust = propagate(hosts.where("allowed > 0").select("host", F.col("allowed").alias("seed")), edges, p)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")), against, p)
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left") \
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left") \
        .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.coalesce("distrust", F.lit(0.0)) >= p.min_distrust) & (F.col("distrust") > F.col("trust"))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "trust", "distrust")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(p: Propagation = Propagation()) -> str:
    """DuckDB SQL of the same verdicts, the steps as a recursion."""
    def scores(kind: str, src: str, dst: str, seed: str) -> str:
        return f"""{kind}s AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM edges),
{kind}c(host, score, k) AS (
  SELECT host, {1 - p.damping} * {seed}, 0 FROM hosts WHERE {seed} > 0
  UNION ALL
  SELECT dst, sum({p.damping} * score * share), max(k) + 1 FROM {kind}c JOIN {kind}s ON src = host WHERE k < {p.rounds} AND score > 1e-15 GROUP BY dst),
{kind} AS (SELECT host, sum(score) AS score FROM {kind}c GROUP BY host)"""

    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(html, '') AS html, position('://' IN coalesce(url, '')) AS cut, coalesce(url, '') AS url FROM pages),
hp AS (
  SELECT page_id, html,
         CASE WHEN cut = 0 THEN '' ELSE translate(regexp_extract(substr(url, cut + 3), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') END AS host,
         CASE WHEN cut = 0 THEN '' ELSE regexp_extract(substr(url, cut + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(kind, rhost, rpath)),
pages_n AS (SELECT *, row_number() OVER () AS rid FROM hp),
fit AS (
  SELECT rid, rhost || rpath AS rule, kind,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM pages_n JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
j AS (SELECT p.*, f.rule, f.kind FROM pages_n p LEFT JOIN fit f ON f.rid = p.rid AND f.k = 1),
hosts AS (
  SELECT host, avg(CASE WHEN kind = 'allow' THEN 1 ELSE 0 END) AS allowed, avg(CASE WHEN kind = 'block' THEN 1 ELSE 0 END) AS blocked
  FROM j WHERE host <> '' GROUP BY host),
edges AS (
  SELECT host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst, count(*) AS n
  FROM (SELECT host, unnest(regexp_extract_all(html, '\bhref\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1, 'i')) AS dst FROM hp)
  WHERE host <> '' AND translate(dst, '{_UPPER}', '{_LOWER}') NOT IN ('', host) GROUP BY 1, 2),
{scores("t", "src", "dst", "allowed")},
{scores("b", "dst", "src", "blocked")}
SELECT page_id, j.host, path, rule,
       coalesce(kind, CASE WHEN coalesce(b.score, 0) >= {p.min_distrust} AND coalesce(b.score, 0) > coalesce(t.score, 0)
                           THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t ON t.host = j.host LEFT JOIN b ON b.host = j.host"""
