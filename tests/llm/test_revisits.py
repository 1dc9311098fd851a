import random

from pyspark.sql import functions as F

from loomtrace.llm import revisits

SCHEMA = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, body string"


def plain(rows):
    out = {}
    for r in (x for x in rows if x[3] == "revisit"):
        old = [x for x in rows if x[3] == "response" and x[4] == 200 and x[1] and x[1] == r[1] and x[2] is not None and r[2] is not None and (x[2], x[0]) < (r[2], r[0])]
        if not old:
            out[r[0]] = ("no_response", None)
            continue
        o = max(old, key=lambda x: (x[2], x[0]))
        new = r[5] or {}
        tag, changed = new.get("etag"), new.get("last-modified")
        if tag is not None:
            ok = (o[5].get("etag") or "?").removeprefix("W/") == tag.removeprefix("W/")
        elif changed is not None:
            ok = o[5].get("last-modified") == changed
        else:
            out[r[0]] = ("no_validator", None)
            continue
        out[r[0]] = ("resolved", o[0]) if ok else ("mismatch", None)
    return out


def test_equals_plain_search(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        url = rng.choice(["hot", "hot", "hot", "a", "b", None])
        headers = rng.choice([{}, {"etag": rng.choice('xyz')}, {"etag": "W/x"}, {"last-modified": rng.choice("12")}, {"etag": "x", "last-modified": "1", "date": "d"}])
        rows.append((i, f"http://{url}/" if url else None, rng.choice([None, *range(90)]) if rng.random() < 0.9 else 7, rng.choice(["response", "revisit"]),
                     rng.choice([200, 200, 404]), headers, "b"))
    want = plain(rows)
    for span in (1, 10, 1000):
        out = revisits.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), span).collect()
        assert {r.record_id: (r.outcome, r.payload_record_id) for r in out} == want and len(out) == len(want)


def test_merged_headers_and_payload(spark):
    rows = [(1, "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 5, "response", 200, {"etag": "t", "date": "1", "content-length": "9"}, "body"),
            (2, "https://a.com/x?a=1&b=2", 6, "revisit", 304, {"etag": "W/t", "date": "2", "content-length": "0", "server": "s"}, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = revisits.resolve(df)
    row = revisits.with_payload(out, df.filter("kind = 'response'").select("record_id", F.col("body").alias("payload"))).first()
    assert row.headers == {"etag": "W/t", "date": "2", "content-length": "9"} and row.payload == "body" and row.canonical_url == "a.com/x?a=1&b=2"
    assert revisits.resolve(df.limit(0)).collect() == []
