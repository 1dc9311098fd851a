"""Candidate retrieval: same person, and anchors that widen it to other persons of the workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCOPE = ["organization_id", "workspace_id"]


def person_candidates(events: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(event, trajectory) pairs of one workspace and person, for a bounded set of events."""
    keys = [*SCOPE, "person_id"]
    return events.select(*keys, "event_id").join(trajectories.select(*keys, "trajectory_id"), keys)


def person_counts(events: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Number of trajectories of the event's own person, per event, without listing pairs."""
    keys = [*SCOPE, "person_id"]
    counts = trajectories.groupBy(*keys).agg(F.count("*").alias("person_candidates"))
    return events.select(*keys, "event_id").join(counts, keys, "left").withColumn(
        "person_candidates", F.coalesce("person_candidates", F.lit(0)))


def _signature(anchors: Column, strength: str) -> Column:
    own = F.filter(anchors, lambda a: a["strength"] == strength)
    value = (lambda a: F.concat(a["type"], F.lit(":"), F.lower(a["value"]))) if strength == "strong" else (lambda a: a["type"])
    return F.sort_array(F.array_distinct(F.transform(own, value)))


#: Events with more strong anchors than this are matched with the signatures that share one, in place of listing the subsets.
MOST_KEYS = 6


def _signed_subsets(wanted: DataFrame) -> DataFrame:
    """``wanted`` with a row for each non-empty ``subset`` of ``strong`` and its ``sign`` in the sum."""
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), MOST_KEYS) - 1)
    rows = wanted.select("*", F.explode(masks).alias("mask")).filter(F.expr("mask < shiftleft(1, size(strong))"))
    subset = F.expr("filter(strong, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    return rows.withColumn("subset", subset).withColumn("sign", F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)).drop("mask")


def _containing(wanted: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``subset, t_boundary, n``: of each asked subset the trajectories that have all its anchors, per set of boundary types."""
    single = other.groupBy(*keys, F.array("key").alias("subset"), "t_boundary").agg(F.sum("n").alias("n"))
    more = _signed_subsets(wanted.filter(F.size("strong") <= MOST_KEYS)).filter(F.size("subset") > 1).select(*keys, "subset").distinct()
    often = other.groupBy(*keys, "key").agg(F.count("*").alias("often"))
    # A subset with an anchor that no trajectory has is contained in none.
    rarest = more.select("*", F.explode("subset").alias("key")).join(often, [*keys, "key"]).groupBy(*keys, "subset").agg(
        F.min_by("key", "often").alias("key"), F.count("*").alias("found")).filter(F.col("found") == F.size("subset"))
    both = rarest.join(other, [*keys, "key"]).filter(F.size(F.array_except("subset", "t_strong")) == 0)
    return single.unionByName(both.groupBy(*keys, "subset", "t_boundary").agg(F.sum("n").alias("n")))


def rescue_counts(events: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Per event the number of other persons' trajectories of its workspace that its anchors recall.

    A trajectory is recalled by a boundary type on both sides or by a shared strong anchor. Pairs are never listed. Boundary
    recall only depends on the sets of boundary types, of which a workspace has at most eight, so it is a sum of counts per
    set. Strong recall is the number of trajectories with any of an event's strong anchors: by inclusion and exclusion, the signed sum
    over the subsets of its anchors of the trajectories that have all of a subset. A single anchor's number is a plain count, so N events
    and trajectories that share one ticket cost N rows; larger subsets look at the trajectories with their rarest anchor. Trajectories that
    the boundary types recall already are left out.
    """
    person = [*SCOPE, "person_id"]

    def collapsed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*person, *more, _signature(F.col("anchors"), "strong").alias("strong"),
                           _signature(F.col("anchors"), "boundary").alias("boundary"))

    asked = collapsed(events, "event_id")
    theirs = collapsed(trajectories).groupBy(*person, "strong", "boundary").agg(F.count("*").alias("n"))
    overlap = F.arrays_overlap("boundary", "t_boundary")

    def by_boundary(keys: list[str], name: str) -> DataFrame:
        sets = theirs.groupBy(*keys, F.col("boundary").alias("t_boundary")).agg(F.sum("n").alias("n"))
        wanted = asked.select(*keys, "boundary").distinct()
        return wanted.join(sets, keys).filter(overlap).groupBy(*keys, "boundary").agg(F.sum("n").alias(name))

    def by_strong(keys: list[str], name: str) -> DataFrame:
        sets = theirs.groupBy(*keys, "strong", "boundary").agg(F.sum("n").alias("n")).withColumnsRenamed({"boundary": "t_boundary", "strong": "t_strong"})
        other = sets.select("*", F.explode("t_strong").alias("key"))
        wanted = asked.filter(F.size("strong") > 0).select(*keys, "strong", "boundary").distinct()
        large = wanted.filter(F.size("strong") > MOST_KEYS)
        matched = large.select("*", F.explode("strong").alias("key")).join(other, [*keys, "key"]).filter(~overlap).select(
            *keys, "strong", "boundary", "t_strong", "t_boundary", "n").distinct()
        signed = _signed_subsets(wanted.filter(F.size("strong") <= MOST_KEYS)).join(_containing(wanted, other, keys), [*keys, "subset"]).filter(~overlap)
        return signed.select(*keys, "strong", "boundary", (F.col("n") * F.col("sign")).alias("n")).union(
            matched.select(*keys, "strong", "boundary", "n")).groupBy(*keys, "strong", "boundary").agg(F.sum("n").alias(name))

    rows = asked
    for keys, tag in ((SCOPE, "all"), (person, "own")):
        rows = rows.join(by_boundary(keys, f"b_{tag}"), [*keys, "boundary"], "left").join(
            by_strong(keys, f"s_{tag}"), [*keys, "strong", "boundary"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*person, "event_id", (n("b_all") + n("s_all") - n("b_own") - n("s_own")).cast("long").alias("rescue_candidates"))


def rescue_candidates(events: DataFrame, trajectories: DataFrame) -> DataFrame:
    """The recalled (event, trajectory) pairs themselves, for a bounded set of events."""
    def keys(rows: DataFrame, *cols: str) -> DataFrame:
        return rows.select(*SCOPE, "person_id", *cols, F.explode(F.concat(
            F.transform(_signature(F.col("anchors"), "strong"), lambda s: F.concat(F.lit("s:"), s)),
            F.transform(_signature(F.col("anchors"), "boundary"), lambda b: F.concat(F.lit("b:"), b)))).alias("key"))

    left = keys(events, "event_id").withColumnRenamed("person_id", "asker")
    right = keys(trajectories, "trajectory_id")
    return left.join(right, [*SCOPE, "key"]).filter("asker <> person_id").select(*SCOPE, "event_id", "trajectory_id").distinct()


def union_candidates(own: DataFrame, rescue: DataFrame) -> DataFrame:
    """Own candidates before rescued ones, each trajectory once per event."""
    tagged = own.withColumn("source_rank", F.lit(0)).unionByName(rescue.withColumn("source_rank", F.lit(1)))
    return tagged.groupBy("event_id", "trajectory_id").agg(F.min("source_rank").alias("source_rank"))


def looked_up(rows: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``rows`` with the stored ``score`` of their keys and whether there is one. Of keys stored more than once the highest counts."""
    stored = scores.groupBy(*keys).agg(F.max(score).alias(score)).withColumn("found", F.lit(True))
    return rows.join(stored, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
