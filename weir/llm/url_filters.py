"""Url rules by hash prefixes, in DataFrame operations only.

Each url expands into the expressions (host suffix, path prefix) that a rule could have:
as many host labels as the deepest rule, path prefixes of the lengths that rules have.
Expressions meet rules by an equi-join on the first bytes of their SHA-256 digests; the
full digest then confirms, and the longest rule that is left decides.

A null url, or one without "://", has an empty host and path. Repeated pages each get
their row. An empty table gives an empty result; without rules every url gets the
default. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import materialize, read_table

PREFIX_HEX = 8
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url, by the first "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_frame(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(r.verdict).alias("rule_verdict"), F.lit(r.host).alias("rule_host"), F.lit(r.path).alias("rule_path")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "rule_verdict string, rule_host string, rule_path string")


def digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict, in place of columns of those names. rules: rule_verdict, rule_host, rule_path.

    Rules are joined by broadcast while there are at most BROADCAST_RULES, and else by a
    shuffled equi-join on the prefix. Each distinct (host, path) is expanded once.
    """
    spec = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", "[.]"))), F.sort_array(F.collect_set(F.length("rule_path")))).first()
    n_rules, depth, lengths = spec[0], spec[1] or 0, list(spec[2] or [])
    host, path = split_url(F.col(url_col))
    parts = pages.drop("_best").withColumns({"host": host, "path": path})
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit("")]), lambda x: x.isNotNull())
    expressions = (
        parts.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("try_host"), prefixes.alias("tries"))
        .select("host", "path", "try_host", F.explode("tries").alias("try_path"))
        .withColumn("full", digest(F.col("try_host"), F.col("try_path")))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    keyed = rules.withColumn("rule_full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_full", 1, PREFIX_HEX))
    hits = expressions.join(F.broadcast(keyed) if n_rules <= BROADCAST_RULES else keyed, "short").where(F.col("full") == F.col("rule_full"))
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("_best"))
    # Stored, so that a (host, path) of many pages can be split in the join; merged, because
    # the matches grow with the pages and are no side to broadcast.
    best = materialize(best, "best-rules").hint("merge")
    out = parts.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT p.host, p.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
"""
