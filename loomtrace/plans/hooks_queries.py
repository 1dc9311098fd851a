"""Models as vectorised functions, run over whole tables. The models here are simple and exact, so that SQL can state what they give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window, functions as F

from loomtrace.operators import hooks, signals
from loomtrace.plans.oracle import TRACE
from loomtrace.plans.registry import Section
from loomtrace.sources import drivers

SECTION = Section()


def _words(texts: pd.Series) -> Iterator[set[str]]:
    """The words of one text after the other; the sets of a whole batch would take many times its size."""
    return (set(t.split(" ")) for t in texts)


def echo_model(previous: pd.Series, current: pd.Series) -> pd.DataFrame:
    """A message that repeats half of its words continues, one that repeats some refines, else the topic is new."""
    match = pd.Series([len(a & b) / len(b) for a, b in zip(_words(previous), _words(current), strict=True)], dtype="float64")
    kind = match.map(lambda m: "continue" if m >= 0.5 else "refine" if m > 0 else "new_topic")
    return pd.DataFrame({"primitive": kind, "confidence": match, "history_conditioned": True, "history_match": match, "model_version": "echo-1"})


def overlap_model(candidate: pd.Series, incoming: pd.Series) -> pd.Series:
    """Share of common words among all words of a pair."""
    return pd.Series([len(a & b) / len(a | b) for a, b in zip(_words(candidate), _words(incoming), strict=True)], dtype="float64")


@SECTION.add("m1_perception_model", f"""WITH {TRACE}, p AS (SELECT trajectory_id, event_id, actor_type, text, last_value(CASE WHEN actor_type IN ('human', 'agent') AND text <> ''
      THEN text END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM te),
  m AS (SELECT *, CASE WHEN previous IS NOT NULL THEN len(list_intersect(list_distinct(string_split(text, ' ')), list_distinct(string_split(previous, ' ')))) / len(list_distinct(string_split(text, ' '))) END AS match
    FROM p WHERE actor_type = 'human')
  SELECT trajectory_id, event_id, CASE WHEN match >= 0.5 THEN 'continue' WHEN match > 0 THEN 'refine' WHEN match IS NOT NULL THEN 'new_topic' END AS primitive,
    round(match, 6) AS confidence, CASE WHEN match IS NOT NULL THEN 'echo-1' END AS model_version FROM m""")
def _(spark, sf):
    said = signals.previous_text(drivers.trace_events(spark, sf))
    b = "behavior"
    return hooks.perceive(said, echo_model).select("trajectory_id", "event_id", F.col(f"{b}.primitive").alias("primitive"),
                                                   F.round(f"{b}.confidence", 6).alias("confidence"), F.col(f"{b}.model_version").alias("model_version"))


@SECTION.add("m3_pair_scores", """WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
  w AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(previous, ' ')) AS b FROM p WHERE previous IS NOT NULL AND text IS NOT NULL)
  SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS score FROM w""")
def _(spark, sf):
    """Each turn scored against the one before it."""
    turns = drivers.table(spark, sf, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("incoming_text"), F.lag("text").over(before).alias("candidate_text"))
    scored = hooks.score_pairs(pairs.filter("candidate_text IS NOT NULL AND incoming_text IS NOT NULL"), overlap_model)
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))
