"""Language evidence about linkage and recurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomtrace.functions.text import let

# Continuation, branch and recurrence patterns.
CONTINUATION = [
    r"\bstill\b", r"\bagain\b", r"\bafter that\b", r"\bafter the change\b", r"\bnow\b.*\bbut\b", r"\bwe found\b",
    r"\bturns out\b", r"\bthe same\b.*\bis back\b",
]
BRANCH = [
    r"\bthis showed\b", r"\bthis incident showed\b", r"\bthis revealed\b", r"\bbecause of this\b",
    r"\bnow design\b", r"\bnow let's\b", r"\blet's redesign\b",
]
REOPEN = [
    r"\bthe same\b.*\bis back\b", r"\bis back\b", r"\brecurr(?:ed|ing|ence)\b", r"\bhappening again\b",
    r"\bfailing again\b", r"\bbroke again\b", r"\breturned\b", r"\breappeared\b",
]
# Identifiers compared between two texts (first match on each side).
IDENTITY = {
    "customer": r"(?i)\bcustomer\s+([a-z0-9_-]+)\b",
    "repository": r"(?i)\b(?:repo|repository)\s*[:=#]?\s*([a-zA-Z0-9_.-]+)",
    "PR": r"(?i)\bPR\s*#?\s*(\d+)\b",
    "ticket": r"\b([A-Z][A-Z0-9]+-\d+)\b",
}
# What the lower-cased text holds wherever the identifier occurs (no letter that has more than two cases).
_IDENTITY_NEEDLES = {"customer": "tomer", "repository": "repo", "PR": "pr", "ticket": "-"}


def needles(pattern: str) -> list[str]:
    """Strings that every text has in which one of the patterns above occurs: its fixed words up to the first choice of endings."""
    fixed = pattern.split("(?:")[0].replace(r"\b", "")
    return [part for part in fixed.split(".*") if part]


def _hits(text: Column, patterns: list[str]) -> Column:
    """The patterns found in the text, in list order. A pattern is only tried where its needles are, which is far cheaper to see."""
    held = lambda t, p: reduce(lambda all_, n: all_ & t.contains(n), needles(p)[1:], t.contains(needles(p)[0]))
    hit = lambda t, p: F.when(held(t, p), F.when(F.regexp_like(t, F.lit("(?U)" + p)), F.lit(p)))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.array_compact(F.array(*[hit(t, p) for p in patterns])))


def continuation_signals(text: Column) -> Column:
    return _hits(text, CONTINUATION)


def branch_signals(text: Column) -> Column:
    return _hits(text, BRANCH)


def _first(text: Column, pattern: str, needle: str) -> Column:
    found = F.nullif(F.lower(F.regexp_extract(text, "(?U)" + pattern, 1)), F.lit(""))
    return F.when(F.lower(text).contains(needle), found)


def identity_matches(candidate_text: Column, new_text: Column) -> dict[str, Column]:
    """``same name: value`` and ``different name: a vs b`` lists, both sides present."""
    same, different = [], []
    for name, pattern in IDENTITY.items():
        needle = _IDENTITY_NEEDLES[name]
        left, right = _first(candidate_text, pattern, needle), _first(new_text, pattern, needle)
        same.append(F.when(left == right, F.concat(F.lit(f"same {name}: "), left)))
        different.append(F.when(left != right, F.concat(F.lit(f"different {name}: "), left, F.lit(" vs "), right)))
    return {"positive": F.array_compact(F.array(*same)), "contradictions": F.array_compact(F.array(*different))}


def reopen_terms(lifecycle: Column, text: Column) -> Column:
    """Recurrence patterns found, only for resolved work."""
    return F.when(lifecycle == "resolved", _hits(text, REOPEN)).otherwise(F.array().cast("array<string>"))
