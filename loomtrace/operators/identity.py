"""Identity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.canonical import short_id

KEYS = ["organization_id", "workspace_id", "surface", "external_user_id"]


def anonymous_id(workspace: Column, surface: Column, user: Column) -> Column:
    return short_id("surface_", 16, workspace, surface, user)


def resolve(events: DataFrame, identities: DataFrame) -> DataFrame:
    """Add ``person_id``: the linked person, else a stable generated one.

    A plain equi join: Spark broadcasts the identity table only while it is under its size threshold.
    """
    generated = short_id("person_", 16, *[F.col(k) for k in KEYS])
    return events.join(identities.select(*KEYS, "person_id"), KEYS, "left").withColumn(
        "person_id", F.coalesce("person_id", generated))


def link(existing: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """Outcome of link requests: linked, unchanged, or conflict when the key belongs to another person.

    Within the requests the first one for a key wins.
    """
    firsts = requests.groupBy(*KEYS).agg(F.min_by("person_id", F.col(order)).alias("first_person"))
    owner = firsts.join(existing.select(*KEYS, F.col("person_id").alias("owner")), KEYS, "left").select(
        *KEYS, F.coalesce("owner", "first_person").alias("holder"), F.col("owner").isNotNull().alias("known"))
    asked = requests.groupBy(*KEYS, "person_id").agg(F.min(order).alias(order))
    return asked.join(owner, KEYS).withColumn(
        "outcome", F.when(F.col("person_id") != F.col("holder"), "conflict").when(F.col("known"), "unchanged")
        .otherwise("linked"))
