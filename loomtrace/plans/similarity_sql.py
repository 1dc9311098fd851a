"""Oracle SQL of the TF-IDF operators."""

from __future__ import annotations

from loomtrace.operators.similarity import STOP_WORDS
from loomtrace.plans.oracle import words

_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({words(STOP_WORDS)}, t))"


def terms_cte(name: str, source: str, keys: list[str]) -> str:
    """CTEs ``<name>_t`` (token lists) and ``<name>`` (keys, term, tf)."""
    k = ", ".join(keys)
    return f"""{name}_t AS (SELECT {k}, {_TOKENS} AS t FROM {source}),
  {name} AS (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(list_concat(t, list_transform(
    range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_t) GROUP BY ALL)"""


def weights_cte(name: str, counts: str, documents: str, group: list[str], doc: str) -> str:
    """CTE ``<name>``: group, doc, term, normalized weight w."""
    g = ", ".join(group)
    return f"""{name}_n AS (SELECT {g}, count(*) AS nd FROM {documents} GROUP BY {g}),
  {name}_d AS (SELECT {g}, term, count(*) AS df FROM {counts} GROUP BY {g}, term),
  {name}_w AS (SELECT {counts}.*, tf * (ln((1 + nd) / (1 + df)) + 1) AS raw FROM {counts}
    JOIN {name}_d USING ({g}, term) JOIN {name}_n USING ({g})),
  {name} AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {g}, {doc})) AS w FROM {name}_w)"""


def continuity_ctes(source: str, group: list[str]) -> str:
    """CTE ``cont``: continuity and evolution per group; ``source`` has group, n (ordinal), text."""
    g = ", ".join(group)
    same = " AND ".join(f"a.{x} = b.{x}" for x in group)
    keep = ", ".join(f"a.{x} AS {x}" for x in group)
    return f"""{terms_cte('jt', source, [*group, 'n'])}, {weights_cte('jw', 'jt', source, group, 'n')},
  jd AS (SELECT {keep}, sum(a.w * b.w) AS s FROM jw a JOIN jw b ON {same} AND b.n = a.n + 1 AND a.term = b.term GROUP BY ALL),
  jv AS (SELECT DISTINCT {g}, true AS has_terms FROM jt),
  jm AS (SELECT {g}, count(*) AS m FROM {source} GROUP BY {g}),
  cont AS (SELECT {g},
    CASE WHEN m > 1 AND has_terms THEN round(coalesce(s, 0) / (m - 1), 4) ELSE 0.0 END AS continuity,
    CASE WHEN m > 1 AND has_terms THEN round(1 - coalesce(s, 0) / (m - 1), 4) + 0.0 ELSE 0.0 END AS evolution
    FROM jm LEFT JOIN jd USING ({g}) LEFT JOIN jv USING ({g}))"""
