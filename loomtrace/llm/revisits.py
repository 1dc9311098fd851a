"""Resolution of not-modified revisit records of a web archive.

A revisit says that a page had not changed. It is joined as of its time with the latest earlier full response of the same canonical URL; the
validators of both are checked, and the headers that a not-modified answer may update replace those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm.registry import table

# Header fields that a 304 response may update, and query parameters that name a visit and not a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"

#: Rows of one URL are cut into spans of this many seconds; only one row per span is carried on to later spans.
SPAN_SECONDS = 86_400
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, sorted query without tracking parameters.

    Scheme and fragment do not count. What is no absolute URL (or null) has none.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def same_etag(a: Column, b: Column) -> Column:
    """Weak comparison."""
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts, kind: response or revisit, status, headers: map with names in lower case).

    ``payload_record_id`` is the response whose body holds, ``headers`` are merged, ``validator`` is what agreed. ``outcome`` is
    ``resolved``, ``no_response`` (none earlier, or no URL), ``mismatch`` (the latest earlier response has another validator) or
    ``no_validator`` (nothing to compare); only resolved rows have a payload and headers. Earlier means smaller (ts, record_id). Full responses
    have status 200. A null time never matches. Repeated rows are resolved each; an empty table gives no rows. Other columns are ignored.

    A URL with any share of all rows is cut into time spans: windows run inside (url, span), and the last response of each span is carried to
    later spans by a second window over one row per span.
    """
    r = records.select("record_id", "ts", "kind", "status", "headers", canonical_url(F.col("url")).alias("curl"))
    r = r.withColumn("span", F.floor(F.col("ts") / span_seconds))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("curl").isNotNull() & F.col("ts").isNotNull()
    body = F.when(full, F.struct("ts", "record_id", "headers"))
    known = r.filter(full | (F.col("kind") == "revisit")).withColumn("body", body)
    inside = Window.partitionBy("curl", "span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    visits = known.withColumn("near", F.last("body", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    ends = known.filter("body IS NOT NULL").groupBy("curl", "span").agg(
        F.max_by("body", F.struct("ts", "record_id")).alias("end"))
    spans = known.select("curl", "span").distinct().join(ends, ["curl", "span"], "left")
    across = Window.partitionBy("curl").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("end", ignorenulls=True).over(across)).filter("far IS NOT NULL").select("curl", "span", "far")
    found = visits.join(carried, ["curl", "span"], "left").withColumn("hit", F.when(F.col("curl").isNotNull(), F.coalesce("near", "far")))

    old, new = F.col("hit.headers"), F.col("headers")
    by_tag = new["etag"].isNotNull()
    agrees = F.when(by_tag, same_etag(new["etag"], old["etag"])).when(new["last-modified"].isNotNull(), new["last-modified"] == old["last-modified"])
    outcome = F.when(F.col("hit").isNull(), "no_response").when(agrees, "resolved").when(
        by_tag | new["last-modified"].isNotNull(), "mismatch").otherwise("no_validator")
    updates = F.map_filter(new, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    good = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", "outcome", F.when(good, F.col("hit.record_id")).alias("payload_record_id"),
        F.when(good, F.when(by_tag, "etag").otherwise("last-modified")).alias("validator"), F.when(good, merged).alias("headers"))


def with_payload(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds the body (``record_id, payload``) that a resolved revisit stands for."""
    bodies = responses.select(F.col("record_id").alias("payload_record_id"), "payload")
    return resolved.join(bodies, "payload_record_id", "left")


def capture_records(pages: DataFrame) -> DataFrame:
    """A crawl log from the table of pages: a response for each page, and three days later a revisit of the same page.

    Some responses are no full ones, and revisits differ in how they spell the URL and in which validators they send.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    tag, modified = F.concat(F.lit('"'), F.col("digest"), F.lit('"')), (at - 86_400).cast("string")
    pair = lambda *kv: F.create_map(*(F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)))
    responses = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 11 == 10, 404).otherwise(200).alias("status"),
        pair("date", at.cast("string"), "etag", tag, "last-modified", modified, "content-length", F.col("n").cast("string"),
             "cache-control", F.lit("max-age=60")).alias("headers"))
    way, later = F.col("page_id") % 8, at + 3 * 86_400
    spelled = F.when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://", "https://www.")).when(
        F.col("page_id") % 3 == 2, F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_campaign=again"))).otherwise(F.col("url"))
    validator = F.when(way == 4, pair("etag", F.concat(F.lit("W/"), tag))).when(way == 5, pair("etag", F.lit('"changed"'))).when(
        way == 6, pair("last-modified", modified)).when(way == 7, F.create_map().cast("map<string,string>")).otherwise(pair("etag", tag))
    revisits = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(validator, pair("date", later.cast("string"), "cache-control", F.lit("max-age=600"), "content-length", F.lit("0"))).alias("headers"))
    return responses.union(revisits)


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl log that is derived from the pages."""
    out = resolve(capture_records(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return out.withColumn("headers", shown)


_ORACLE = rf"""
WITH p AS (SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, length(coalesce(html, '')) AS n, 1700000000 + page_id * 60 AS t0 FROM pages),
resp AS (SELECT page_id * 2 AS rid, url, t0 AS ts, tag, (t0 - 86400)::VARCHAR AS lm, n FROM p WHERE page_id % 11 <> 10),
visit AS (SELECT page_id * 2 + 1 AS rid, CASE WHEN page_id % 3 = 1 THEN regexp_replace(url, '^https?://', 'https://www.')
    WHEN page_id % 3 = 2 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=again' ELSE url END AS url, t0 + 259200 AS ts,
    CASE page_id % 8 WHEN 4 THEN 'W/' || tag WHEN 5 THEN '"changed"' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE tag END AS tag,
    CASE WHEN page_id % 8 = 6 THEN (t0 - 86400)::VARCHAR END AS lm FROM p),
u AS (SELECT rid, url, lower(regexp_extract(url, '{_URL}', 2)) AS h, regexp_replace(regexp_extract(url, '{_URL}', 3), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS q
    FROM (SELECT rid, url FROM resp UNION ALL SELECT rid, url FROM visit)),
c AS (SELECT rid, CASE WHEN h <> '' THEN regexp_replace(h, '^www\.|:(80|443)$', '', 'g') || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS curl FROM u),
m AS (SELECT v.rid, v.ts, v.tag, v.lm, cv.curl, r.rid AS hit, r.tag AS rtag, r.lm AS rlm, r.n FROM visit v JOIN c cv ON cv.rid = v.rid
    LEFT JOIN (SELECT resp.*, c.curl FROM resp JOIN c USING (rid)) r ON r.curl = cv.curl AND (r.ts < v.ts OR r.ts = v.ts AND r.rid < v.rid)
    QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY r.ts DESC NULLS LAST, r.rid DESC) = 1),
o AS (SELECT *, CASE WHEN hit IS NULL THEN 'no_response' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = rtag THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = rlm THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome FROM m)
SELECT rid AS record_id, curl AS canonical_url, ts, outcome, CASE WHEN outcome = 'resolved' THEN hit END AS payload_record_id,
  CASE WHEN outcome = 'resolved' THEN CASE WHEN tag IS NOT NULL THEN 'etag' ELSE 'last-modified' END END AS validator,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=600; content-length=' || n || '; date=' || ts || '; etag=' || coalesce(tag, rtag) || '; last-modified=' || rlm END AS headers
FROM o"""

QUERIES = {"op8_revisit_resolution": op8_revisit_resolution}
ORACLES = {"op8_revisit_resolution": _ORACLE}
