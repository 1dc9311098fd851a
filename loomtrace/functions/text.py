"""Scalar text operators as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Personal-data patterns, applied in this order.
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?<!\w)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\w)"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"

# Intent keyword sets, in tie-break order.
INTENT_WORDS = {
    "debug": ["fail", "fails", "failing", "failed", "error", "crash", "crashes", "broken", "debug", "fix", "issue",
              "problem"],
    "research": ["compare", "research", "program", "programs", "school", "schools", "master", "masters",
                 "university"],
    "evaluate": ["benchmark", "evaluate", "evaluation", "test", "testing", "score", "metric", "history",
                 "trajectory"],
}
# Words of five or more letters that are no entities.
GOAL_STOP = ["should", "still", "does"]
LOCAL_STOP = ["should", "about", "after"]

# Substring rules of the local goal, in order.
GOAL_RULES = [
    (["deploy", "production", "container", "environment variable", "startup"],
     "software deployment", "restore production service", "debug"),
    (["robotics", "autonomous systems", "master's", "masters", "graduate program"],
     "graduate education", "find suitable robotics graduate program", "research"),
    (["benchmark", "evaluation", "shuffled history", "trajectory"],
     "AI evaluation", "evaluate trajectory understanding", "evaluate"),
]

BEHAVIOUR_LABELS = ["continue", "new_topic", "clarify", "repair", "correct", "disagree", "resist", "refine"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often it is used; inside of array functions Spark makes each use anew."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, ends trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def unique_ignoring_case(values: Column) -> Column:
    """Collapsed, non-empty strings, the first of each case-insensitive spelling, in order."""
    cleaned = F.filter(F.transform(values, collapse), lambda v: v != "")
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda kept, v: F.when(F.exists(kept, lambda o: F.lower(o) == F.lower(v)), kept).otherwise(
            F.concat(kept, F.array(v))
        ),
    )


def unique_union(*arrays: Column) -> Column:
    """Concatenation without nulls, empties and repeats, order kept."""
    joined = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(joined, lambda v: v.isNotNull() & (v != "")))


def redact(text: Column) -> dict[str, Column]:
    """Redacted text, sorted categories and flag. Each step sees the text left by the one before."""
    start = F.coalesce(text, F.lit(""))
    no_mail = F.regexp_replace(start, EMAIL, "[REDACTED_EMAIL]")
    no_phone = F.regexp_replace(no_mail, PHONE, "[REDACTED_PHONE]")
    clean = F.regexp_replace(no_phone, IPV4, "[REDACTED_IP]")
    found = F.array(
        F.when(no_mail != start, F.lit("email")),
        F.when(clean != no_phone, F.lit("ip")),
        F.when(no_phone != no_mail, F.lit("phone")),
    )
    categories = F.array_compact(found)
    return {"text": clean, "categories": categories, "redacted": F.size(categories) > 0}


def redact_text(text: Column) -> Column:
    return redact(text)["text"]


def work_goal(text: Column, supplied: Column) -> Column:
    """The supplied goal, or the first twelve tokens of the text."""
    words = F.regexp_extract_all(collapse(text), F.lit(r"[A-Za-z0-9_#.-]+"), F.lit(0))
    given = collapse(supplied)
    return F.when(given != "", given).otherwise(F.array_join(F.slice(words, 1, 12), " "))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(collapse(text)), F.lit(r"[A-Za-z0-9_.-]+"), F.lit(0))


def intent(text: Column) -> Column:
    """The first keyword set with the greatest overlap, ``general`` when nothing overlaps."""
    tokens = _tokens(text)
    hits = {n: F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in ws]))) for n, ws in INTENT_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, F.lit("general"))
    for name, hit in hits.items():
        out = out.when(hit == best, F.lit(name))
    return out


def entities(text: Column, stop: list[str], limit: int) -> Column:
    long = F.filter(_tokens(text), lambda t: (F.length(t) >= 5) & ~t.isin(*stop))
    return F.slice(F.array_distinct(long), 1, limit)


def router_goal(text: Column) -> dict[str, Column]:
    return {"summary": collapse(text), "intent": intent(text), "entities": entities(text, GOAL_STOP, 12)}


def local_goal(text: Column) -> dict[str, Column]:
    """Domain, goal and intent by substring rules; the general case keeps the first 160 characters."""
    clean = collapse(text)
    lower = F.lower(clean)
    head = F.substring(clean, 1, 160)

    def by_rule(index: int, default: Column) -> Column:
        out = None
        for rule in GOAL_RULES:
            hit = lower.contains(rule[0][0])
            for needle in rule[0][1:]:
                hit = hit | lower.contains(needle)
            out = F.when(hit, F.lit(rule[index])) if out is None else out.when(hit, F.lit(rule[index]))
        return out.otherwise(default)

    return {
        "domain": by_rule(1, F.lit("general")),
        "goal": by_rule(2, head),
        "intent": by_rule(3, F.lit("other")),
        "entities": entities(text, LOCAL_STOP, 10),
        "issue": head,
        "stage": F.lit("unknown"),
    }


def routing_text(goal: dict[str, Column]) -> Column:
    parts = [goal["domain"], goal["goal"], goal["intent"], goal["issue"], goal["stage"],
             F.array_join(goal["entities"], " ")]
    return join_nonblank(*parts)


def join_nonblank(*parts: Column) -> Column:
    trimmed = F.array(*[F.trim(p) for p in parts])
    return F.array_join(F.filter(trimmed, lambda p: p.isNotNull() & (p != "")), " ")


def join_values(*groups: Column) -> Column:
    """Blank-joined text of scalars and arrays (each cast to an array by the caller), blanks left out."""
    flat = F.flatten(F.array(*groups))
    return F.array_join(F.filter(F.transform(flat, lambda v: F.trim(v)), lambda p: p.isNotNull() & (p != "")), " ")


def work_text(goal: Column, problem: Column, entity_list: Column, artifact_list: Column) -> Column:
    """Goal, state, entities and artifacts joined by blanks, empty ones left out."""
    flat = F.concat(F.array(goal, problem), entity_list, artifact_list)
    return F.array_join(F.filter(flat, lambda p: p.isNotNull() & (p != "")), " ")


def strip_fence(text: Column) -> Column:
    """Remove a surrounding code fence from a model answer."""
    opened = F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def parse_goal_answer(text: Column) -> Column:
    """Parsed goal answer; null when it is no JSON object."""
    schema = "domain STRING, goal STRING, intent STRING, entities ARRAY<STRING>, issue STRING, stage STRING"
    return F.from_json(strip_fence(text), schema, {"mode": "PERMISSIVE"})


def normalize_label(text: Column) -> Column:
    """Behaviour label from an answer such as ``Label: "repair".``; null when it is no known label."""
    lower = F.lower(F.trim(text))
    bare = F.regexp_replace(lower, r"^label:\s*", "")
    bare = F.regexp_replace(bare, r"^[\s\"'`.]+|[\s\"'`.]+$", "")
    return F.when(bare.isin(*BEHAVIOUR_LABELS), bare)


def event_line(surface: Column, source_type: Column, source_id: Column, target_type: Column, target_id: Column,
               text: Column) -> Column:
    return F.concat(
        F.lit("["), F.upper(surface), F.lit("] "), F.upper(source_type), F.lit("("), source_id, F.lit(") -> "),
        F.upper(target_type), F.lit("("), target_id, F.lit("): "), text,
    )


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of the lower-cased white-space tokens, 0 when one side has none."""
    a, b = token_set(left), token_set(right)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))


def token_set(text: Column) -> Column:
    parts = F.split(F.lower(text), r"(?U)\s+")
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def fixed3(value: Column) -> Column:
    """``%.3f`` of a value in 0..1 already rounded to four digits, by its exact binary value (ties to even)."""
    n = F.round(value * 10000).cast("long")
    scaled = (value * F.lit(float(2**62))).cast("long").cast("decimal(19,0)") * F.lit(10000).cast("decimal(5,0)")
    exact = n.cast("decimal(5,0)") * F.lit(2**62).cast("decimal(19,0)")
    down = F.floor(n / 10).cast("long")
    rest = n % 10
    up = (
        F.when(rest != 5, (rest > 5).cast("long"))
        .when((n < 20) | (scaled > exact), F.lit(1).cast("long"))  # 0.0005 and 0.0015 lie above the tie
        .when(scaled < exact, F.lit(0).cast("long"))
        .otherwise(down % 2)
    )
    mills = down + up
    return F.concat(F.floor(mills / 1000).cast("string"), F.lit("."), F.lpad((mills % 1000).cast("string"), 3, "0"))
