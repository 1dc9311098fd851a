"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host with a path prefix. Every distinct URL is expanded into the expressions that a rule could have: suffixes of its host
and prefixes of its path, in the sizes that occur among the rules. Expressions meet rules by a short prefix of their digests, the full
digests confirm, and of the rules that fit the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.registry import table

#: The rules of the query: host, path prefix, verdict. Fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rules of a second layer, asked only where none of the first fits: hosts that sell links or goods by spam. An example to be replaced.
OWN_RULES = [("spam-farm.example.org", "", "block"), ("cheap-pills.example.com", "", "block"), ("cheap-pills.example.net", "", "block")]
#: Hexadecimal digits of a digest that expressions and rules are joined on; what a URL gets that no rule fits.
SHORT, DEFAULT = 8, "allow"
#: Rules are broadcast if they are proven to be no larger than so many bytes, else both sides are shuffled by the short hash.
BROADCAST_BYTES = 32_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or a URL."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(spark: SparkSession, *layers: list[tuple[str, str, str]]) -> DataFrame:
    """``layer, host, path, verdict``: a rule of an earlier layer goes before those of later ones."""
    return spark.createDataFrame([(k, *r) for k, rules in enumerate(layers) for r in rules], "layer int, host string, path string, verdict string")


def hashed_rules(rules: DataFrame, short: int = SHORT) -> DataFrame:
    """One row per expression that has a rule: ``short, digest, best``. Of rules with one expression the earlier layer counts, and
    within it a block. Rules without a host, or whose path neither is empty nor begins with ``/``, fit no URL and are left out."""
    clean = rules.select("layer", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.filter("host <> '' AND (path = '' OR path LIKE '/%') AND verdict IN ('allow', 'block')")
    text = F.concat("host", "path")
    best = F.struct((-F.col("layer")).alias("first"), F.length(text).alias("chars"), F.length("host").alias("host_chars"),
                    (F.col("verdict") == "block").alias("blocks"), text.alias("rule"), "layer", "verdict")
    labels, chars = F.size(F.split("host", r"\.")), F.length("path")
    rows = clean.select(F.sha2(text, 256).alias("digest"), best.alias("best"), labels.alias("labels"), chars.alias("chars"))
    rows = rows.groupBy("digest").agg(F.max("best").alias("best"), F.first("labels").alias("labels"), F.first("chars").alias("chars"))
    return rows.withColumn("short", F.substring("digest", 1, short))


def expanded(urls: DataFrame, rules: DataFrame, short: int = SHORT) -> DataFrame:
    """``host, path, digest, short``: the expressions of each row of ``urls`` (``host, path``), in the sizes of the rules' expressions."""
    sizes = sorted((r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect())  # as many as the rules have shapes
    if not sizes:
        return urls.select("host", "path", F.lit("").alias("digest"), F.lit("").alias("short")).limit(0)
    shapes = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(k).alias("chars")) for n, k in sizes))
    rows = urls.select("host", "path", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), shapes.alias("shapes"))
    made = F.expr("transform(filter(shapes, s -> s.labels <= labels AND s.chars <= chars), "
                  "s -> sha2(concat(substring_index(host, '.', -s.labels), substr(path, 1, s.chars)), 256))")
    return rows.select("host", "path", F.explode(made).alias("digest")).withColumn("short", F.substring("digest", 1, short))


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", short: int = SHORT, default: str = DEFAULT) -> DataFrame:
    """``given`` (a struct of all columns of ``urls``), ``host, path, rule, layer, verdict`` for every row of ``urls``.

    A rule fits its host and all subdomains of it if the path begins with the rule's. Earlier layers go first, then the longest rule
    (host and path together), then the longer host, then a block. Where none fits, ``rule`` and ``layer`` are null and the verdict is
    ``default``. A null URL or one without ``://`` has an empty host and path and fits no rule. Rows that repeat get a verdict each; no
    rows give none. Equal URLs are judged once, so a page linked a million times costs one expansion.
    """
    rows = urls.select(F.struct(*(urls[c] for c in urls.columns)).alias("given"), host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    known = hashed_rules(rules, short)
    size = known.agg(F.coalesce(F.sum(F.length("best.rule") * 4 + 200), F.lit(0))).first()[0]
    listed = known.select("short", F.col("digest").alias("rule_digest"), "best")
    listed = F.broadcast(listed) if size <= BROADCAST_BYTES else listed
    distinct = rows.select("host", "path").filter("host <> ''").distinct()
    hits = expanded(distinct, known, short).join(listed, "short").filter("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max("best").alias("best"))
    return rows.join(best, ["host", "path"], "left").select("given", "host", "path", "best.rule", "best.layer", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; ``rule`` names the base rule, and ``own_rule`` the one of the second layer."""
    out = judged(table(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark, RULES, OWN_RULES))
    of = lambda layer: F.when(F.col("layer") == layer, F.col("rule"))
    return out.select("given.page_id", "host", "path", of(0).alias("rule"), of(1).alias("own_rule"), "verdict")


def _values(rules: list[tuple[str, str, str]], layer: int) -> str:
    return ", ".join(f"({layer}, '{h}', '{p}', '{v}')" for h, p, v in rules)


_ORACLE = f"""WITH rules(layer, rh, rp, v) AS (VALUES {_values(RULES, 0)}, {_values(OWN_RULES, 1)}),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT n, layer, rh || rp AS rule, v FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY layer, length(rh || rp) DESC, length(rh) DESC, v DESC) = 1)
SELECT page_id, host, path, CASE WHEN layer = 0 THEN rule END AS rule, CASE WHEN layer = 1 THEN rule END AS own_rule, coalesce(v, '{DEFAULT}') AS verdict
FROM u LEFT JOIN fit USING (n)"""

QUERIES = {"op11_url_filters": op11_url_filters}
ORACLES = {"op11_url_filters": _ORACLE}
