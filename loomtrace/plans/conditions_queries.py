"""The three conditions of a history, over the labelled human messages of the trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import conditions, evaluate, signals
from loomtrace.plans.oracle import TRACE
from loomtrace.plans.registry import Section
from loomtrace.session import durable
from loomtrace.sources import drivers

SECTION = Section()

_ROWS = f"""{TRACE}, p AS (SELECT trajectory_id, event_id, actor_type, primitive, text, last_value(CASE WHEN actor_type IN ('human', 'agent') AND text <> '' THEN text END IGNORE NULLS)
    OVER (PARTITION BY trajectory_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM te),
  r AS (SELECT *, substr(sha256(trajectory_id), 1, 2) < '40' AS is_test FROM p WHERE actor_type = 'human' AND primitive IS NOT NULL AND previous IS NOT NULL)"""


def rows(spark, sf):
    e = drivers.trace_events(spark, sf)
    said = signals.previous_text(e).filter("previous_text <> ''")
    label = e.select("event_id", signals.primitive().alias("label")).filter("label IS NOT NULL")
    return said.join(label, "event_id").select("trajectory_id", "event_id", "text", F.col("previous_text").alias("previous"), "label")


@SECTION.add("k11_condition_inputs", f"""WITH {_ROWS}, c AS (SELECT is_test, primitive AS label, count(*) AS n, count(DISTINCT trajectory_id) AS trajectories FROM r GROUP BY 1, 2),
  t AS (SELECT is_test, sum(n) AS rows, count(*) AS classes FROM c GROUP BY 1)
  SELECT c.is_test, label, n, trajectories, round(rows / (classes * n), 6) AS weight FROM c JOIN t USING (is_test)""")
def _(spark, sf):
    """What the classifiers of the three conditions see: rows, trajectories and weight of every class on both sides of the grouped split."""
    r = durable(rows(spark, sf).withColumn("is_test", conditions.in_test(F.col("trajectory_id"))))
    sides = [conditions.balanced_weights(r.filter(F.col("is_test") == side), "label").withColumn("is_test", F.lit(side)) for side in (False, True)]
    counts = r.groupBy("is_test", "label").agg(F.count_distinct("trajectory_id").alias("trajectories"))
    return counts.join(sides[0].unionByName(sides[1]), ["is_test", "label"]).select("is_test", "label", "n", "trajectories", F.round("weight", 6).alias("weight"))


@SECTION.add("k11_wrong_histories", f"""WITH {_ROWS}, h AS (SELECT event_id, is_test, previous, sha256(event_id) AS h FROM r)
  SELECT event_id, is_test, coalesce(lead(previous) OVER w, first_value(previous) OVER w) AS wrong_previous FROM h WINDOW w AS (PARTITION BY is_test ORDER BY h)""")
def _(spark, sf):
    """Every message with the history of another message of its side."""
    r = rows(spark, sf).withColumn("is_test", conditions.in_test(F.col("trajectory_id")))
    return conditions.with_wrong_history(r, "event_id", "previous").select("event_id", "is_test", "wrong_previous")


@SECTION.add("k12_three_conditions")
def _(spark, sf):
    """Accuracy, balanced accuracy and macro F1 on the test side under each condition; tests compare the classifier with a plain one."""
    p = durable(conditions.compared(durable(rows(spark, sf)), "event_id", "trajectory_id", "previous", "text", "label"))
    out = None
    for condition in conditions.CONDITIONS:
        own = evaluate.macro_scores(evaluate.class_report(p.filter(F.col("condition") == condition), "label", "predicted")).withColumn("condition", F.lit(condition))
        out = own if out is None else out.unionByName(own)
    return out
