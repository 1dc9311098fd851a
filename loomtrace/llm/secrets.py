"""Secret scans with an incremental blob ledger, by DataFrame functions only.

Every version of every path is addressed by the digest of its content. The ledger holds what each rule version has found in each blob;
only pairs of blob and rule version that it lacks are scanned, once however many paths share the blob. Findings are joined back
to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm.registry import table


@dataclass(frozen=True)
class Kind:
    """A pattern, and the least length of its group ``group`` (0: the whole match) for a match to count. Java and RE2 read it alike."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
KINDS = (
    Kind("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]+", 0, 24, True),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 16),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
VERSION = "secrets-1"
#: The same places found with the least length in the pattern, which skips runs that are too short without listing them.
_TIGHT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "forge": r"gh[pousr]_[A-Za-z0-9]{36,}"}


def blob_id(text: Column) -> Column:
    """Address of a content; a missing text has the content of an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """``blob, text`` of every content that the ledger has no row of this rule version for, each once."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.first("text").alias("text"))


def scanned(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS, version: str = VERSION) -> DataFrame:
    """Ledger rows of ``blobs``: ``blob, rule_version, found`` (array of ``start, kind_no, end`` in order; empty without findings).

    Matches are leftmost and do not overlap within a kind; places are code points. A place is the length of all text between the
    matches before it and of those matches.
    """
    tight = {k.name: _TIGHT.get(k.name, k.pattern) for k in kinds}
    some = F.lit(False)
    for k in kinds:
        some = some | F.col("text").rlike(tight[k.name])
    marked = blobs.withColumn("some", some)
    per_kind = F.array(*(F.when(F.col("text").rlike(tight[k.name]), F.struct(
        F.lit(i).alias("kind_no"), F.regexp_extract_all("text", F.lit(tight[k.name]), F.lit(0)).alias("match"),
        F.regexp_extract_all("text", F.lit(tight[k.name]), F.lit(k.group)).alias("value"),
        F.split("text", tight[k.name], -1).alias("gap"))) for i, k in enumerate(kinds)))
    each = marked.filter("some").select("blob", F.explode(per_kind).alias("k")).filter("k IS NOT NULL")
    places = each.select("blob", "k.kind_no", F.posexplode(F.transform(
        F.arrays_zip("k.match", "k.value", F.slice("k.gap", 1, F.size("k.match")).alias("gap")),
        lambda x: F.struct(F.length(x["match"]).alias("match"), F.length(x["value"]).alias("value"), F.length(x["gap"]).alias("gap")))).alias("i", "x"))
    before = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = places.select("blob", "kind_no", "x.match", "x.value", F.sum(F.col("x.match") + F.col("x.gap")).over(before).alias("end"))
    least = F.element_at(F.array(*(F.lit(k.least) for k in kinds)), F.col("kind_no") + 1)
    spans = ends.filter(F.col("value") >= least).select(
        "blob", F.struct((F.col("end") - F.col("match")).cast("bigint").alias("start"), "kind_no", F.col("end").cast("bigint").alias("end")).alias("s"))
    found = spans.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    return blobs.select("blob").join(found, "blob", "left").select(
        "blob", F.lit(version).alias("rule_version"), F.coalesce("found", empty).alias("found"))


def by_path(versions: DataFrame, ledger: DataFrame, version: str = VERSION) -> DataFrame:
    """All given columns but the text, with the findings in the row's content."""
    paths = versions.withColumn("blob", blob_id(F.col("text"))).drop("text")
    return paths.join(ledger.filter(F.col("rule_version") == version).select("blob", "found"), "blob", "left")


def described(found: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")


def findings(versions: DataFrame, ledger: DataFrame | None = None, kinds: tuple[Kind, ...] = KINDS, version: str = VERSION) -> DataFrame:
    """``doc_id``, base counts, digest of the base spans, and all spans, for every row of ``versions`` (``doc_id, text``).

    With a ``ledger`` of earlier runs only contents it lacks are scanned. Missing and empty texts have no findings. Rows that repeat
    give the same findings each. An empty table gives no rows.
    """
    rows = versions.select("doc_id", F.col("text").cast("string").alias("text"))
    new = scanned(unseen(rows, ledger, version), kinds, version)
    known = new if ledger is None else new.union(ledger.select(new.columns))
    out = by_path(rows, known, version)
    base = F.filter("found", lambda s: F.element_at(F.array(*(F.lit(k.base) for k in kinds)), s["kind_no"] + 1))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("bigint")
    return out.select("doc_id", *(count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base),
                      F.sha2(described(base, kinds), 256).alias("base_sha256"), described(F.col("found"), kinds).alias("spans"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return findings(table(spark, sf_dir, "documents", "doc_id", "text"))


def _oracle_kind(i: int, k: Kind) -> str:
    p = k.pattern.replace("'", "''")
    return f"""SELECT rid, {i} AS kind_no, '{k.name}' AS kind, m, v, length(m)::BIGINT AS ml,
      sum(length(m) + length(g)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e
      FROM (SELECT rid, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
        FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {k.group}) AS vs,
                     string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))
      QUALIFY length(v) >= {k.least}"""


_ORACLE = "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(
    _oracle_kind(i, k) for i, k in enumerate(KINDS)) + """), s AS (SELECT *, kind || ':' || (e - ml) || ':' || e AS span FROM f)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY e - ml, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY e - ml, kind_no) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""

QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLES = {"op5_secret_scans": _ORACLE}
