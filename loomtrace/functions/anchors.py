"""Typed work anchors: extraction from text and comparison of two anchor sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.text import let
from loomtrace.schemas import ANCHOR

# Anchor types by strength.
STRENGTH = {
    "customer": "boundary", "tenant": "boundary", "account": "boundary",
    "ticket": "strong", "incident": "strong", "pr": "strong", "slack_thread": "strong", "email_thread": "strong",
    "trace_id": "strong",
    "error_sig": "medium", "file": "medium", "env_var": "medium", "git_sha": "medium", "url": "medium",
    "repo": "scope", "project": "scope",
}
BOUNDARY_TYPES = ["account", "customer", "tenant"]

# Patterns of the anchors.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
INCIDENT = r"(?i)\b(?:INC|INCIDENT)[-_ ]?(\d+)\b"
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
PR = r"(?i)\b(?:PR|pull request|pull)\s*#?\s*(\d+)\b"
GIT_SHA = r"\b[0-9a-fA-F]{7,40}\b"
FILE = r"(?i)\b[\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|yaml|yml|json|toml|sql|sh)\b"
ENV_VAR = r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b"
URL = r"(?i)https?://[^\s<>\"]+"
CUSTOMER = r"(?i)\bcustomer[_\s:-]+([A-Za-z0-9_-]+)\b"
TENANT = r"(?i)\btenant[_\s:-]+([A-Za-z0-9_-]+)\b"
ACCOUNT = r"(?i)\baccount[_\s:-]+([A-Za-z0-9_-]+)\b"
REPO = r"(?i)\b(?:repo|repository)[_\s:=]+([A-Za-z0-9_.-]+)\b"
PROJECT = r"(?i)\bproject[_\s:=]+([A-Za-z0-9_.-]+)\b"

# type -> (pattern, group, case rule, whether spans of uuids and incidents are blanked first, needles); the pattern can only
# match when the lower-cased text holds one of the needles, which is far cheaper to look for
_EXTRACT = [
    ("ticket", TICKET, 1, F.upper, True, ["-"]),
    ("pr", PR, 1, None, False, ["pr", "pull"]),
    ("incident", INCIDENT, 1, None, False, ["inc"]),
    ("trace_id", UUID, 0, F.lower, False, ["-"]),
    ("file", FILE, 0, None, False, ["."]),
    ("env_var", ENV_VAR, 0, None, False, ["_"]),
    ("url", URL, 0, None, False, ["://"]),
    ("customer", CUSTOMER, 1, F.lower, False, ["tomer"]),
    ("tenant", TENANT, 1, F.lower, False, ["tenant"]),
    ("account", ACCOUNT, 1, F.lower, False, ["account"]),
    ("repo", REPO, 1, F.lower, False, ["repo"]),
    ("project", PROJECT, 1, F.lower, False, ["project"]),
    ("git_sha", GIT_SHA, 0, F.lower, True, []),
]
#: A run of letters that a git_sha needs; looked for without the word borders of Unicode, which cost most.
_HEX_RUN = "[0-9a-fA-F]{7}"
_MIXED_CASE = {"file", "url"}


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _last_spelling(values: Column) -> Column:
    """Unique ignoring case; of several spellings the last one stays."""
    return F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda kept, v: F.concat(F.filter(kept, lambda o: F.lower(o) != F.lower(v)), F.array(v)),
    )


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(
        F.lit(kind).alias("type"), F.lower(v).alias("key"), v.alias("value"), F.lit(STRENGTH[kind]).alias("strength")))


def anchors_of(text: Column) -> Column:
    """All anchors of a text, unique by (type, lower-cased value) and sorted by it."""
    source = F.coalesce(text, F.lit(""))
    return let(F.struct(source.alias("source"), F.lower(source).alias("lower")), _anchors)


def _anchors(given: Column) -> Column:
    source, lower = given["source"], given["lower"]
    no_uuid = F.when(lower.contains("-"), F.regexp_replace(source, _unicode(UUID), " ")).otherwise(source)
    blanked = F.when(lower.contains("inc"), F.regexp_replace(no_uuid, _unicode(INCIDENT), " ")).otherwise(no_uuid)
    empty = F.array().cast("array<struct<type:string,key:string,value:string,strength:string>>")
    groups = []
    for kind, pattern, group, case, protect, needles in _EXTRACT:
        found = F.regexp_extract_all(blanked if protect else source, F.lit(_unicode(pattern)), F.lit(group))
        values = F.transform(found, case) if case else found
        unique = _last_spelling(values) if kind in _MIXED_CASE else F.array_distinct(values)
        possible = F.regexp_like(source, F.lit(_HEX_RUN)) if not needles else lower.contains(needles[0])
        for needle in needles[1:]:
            possible = possible | lower.contains(needle)
        groups.append(F.when(possible, _typed(unique, kind)).otherwise(empty))
    ordered = F.sort_array(F.flatten(F.array(*groups)))
    return F.transform(ordered, lambda a: F.struct(a["type"].alias("type"), a["value"].alias("value"),
                                                   a["strength"].alias("strength"))).cast(f"array<{ANCHOR}>")


def merge_anchors(first: Column, second: Column) -> Column:
    """``first`` and the anchors of ``second`` that are not in it by (type, lower-cased value)."""
    added = F.filter(second, lambda b: ~F.exists(first, lambda a: (a["type"] == b["type"]) & (
        F.lower(a["value"]) == F.lower(b["value"]))))
    return F.concat(first, added)


def anchor_keys(anchors: Column) -> Column:
    """``strength|type:value`` keys of all anchors, values lower-cased."""
    return F.array_distinct(F.transform(anchors, lambda a: F.concat(
        a["strength"], F.lit("|"), a["type"], F.lit(":"), F.lower(F.trim(a["value"])))))


def boundary_types(anchors: Column) -> Column:
    own = F.filter(anchors, lambda a: a["strength"] == "boundary")
    return F.array_distinct(F.transform(own, lambda a: a["type"]))


def _types(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda k: F.substring_index(k, ":", 1)))


def compare_anchors(df: DataFrame, existing: str, incoming: str) -> DataFrame:
    """Add the evidence two anchor sets give about being the same work.

    ``hard_new``: a boundary type is on both sides without a common value. ``strong_attach``: a strong anchor is shared and
    there is no hard_new. The match lists and the rules (sorted by type) are added too.
    """
    empty = F.array().cast("array<string>")
    keyed = df.withColumns({
        "_shared": F.sort_array(F.array_intersect(anchor_keys(F.col(existing)), anchor_keys(F.col(incoming)))),
        "_common": F.array_intersect(boundary_types(F.col(existing)), boundary_types(F.col(incoming))),
    })
    any_shared = F.size("_shared") > 0

    def of(strength: str) -> Column:
        own = F.filter("_shared", lambda k: k.startswith(strength + "|"))
        return F.when(any_shared, F.transform(own, lambda k: F.substr(k, F.lit(len(strength) + 2)))).otherwise(empty)

    keyed = keyed.withColumns({f"{s}_matches": of(s) for s in ("boundary", "strong", "medium", "scope")})
    keyed = keyed.withColumn("boundary_mismatches", F.when(F.size("_common") > 0, F.sort_array(
        F.array_except("_common", _types(F.col("boundary_matches"))))).otherwise(empty))
    hard = F.size("boundary_mismatches") > 0

    def rules(types: Column, name: str, effect: str) -> Column:
        return F.transform(types, lambda t: F.struct(t.alias("type"), F.lit(name).alias("rule"), F.lit(effect).alias("effect")))

    traces = F.sort_array(F.concat(
        rules(_types(F.col("boundary_matches")), "boundary_match", "support"),
        rules(F.col("boundary_mismatches"), "boundary_mismatch", "new"),
        rules(_types(F.col("strong_matches")), "strong_anchor_match", "attach"),
        rules(_types(F.col("medium_matches")), "medium_anchor_match", "support"),
        rules(_types(F.col("scope_matches")), "scope_anchor_match", "candidate_only"),
    ))
    return keyed.withColumns({
        "hard_new": hard,
        "strong_attach": (F.size("strong_matches") > 0) & ~hard,
        "anchor_relevant": (F.size("strong_matches") > 0) | (F.size("_common") > 0),
        "anchor_rules": traces,
    }).drop("_shared", "_common")
