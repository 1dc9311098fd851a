"""License scans by an exact set-similarity join of text blocks with templates.

Templates and blocks are sets of words in order of how frequent a word is in the whole corpus, rarest first. A block contains enough of a
template only if it has one of the template's rarest words (prefix filter); its size (length filter) and what can still follow the
shared word (positional filter) drop most others before the sets are compared.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_rows, utf8
from loomtrace.llm.registry import table
from loomtrace.llm.totals import total

#: Labels and notices that are looked for. A block has to contain this percentage of a notice's distinct words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2.0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 80
#: Phrases that are reported wherever their words follow each other.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_BLANK_LINE = re.compile(rb"\n[\x20\x09-\x0D]*\n")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_TABLE).split()


def blocks_of(text: bytes) -> set[frozenset[bytes]]:
    """The word sets of every line and of every paragraph."""
    return {frozenset(words_of(b)) for b in (*text.split(b"\n"), *_BLANK_LINE.split(text))}


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words follow each other."""
    out, have = [], set(words)
    for phrase, label in phrases:
        p = phrase.encode().split()
        if have.issuperset(p):
            out += [(i, label) for i, w in enumerate(words) if w == p[0] and words[i:i + len(p)] == p]
    return sorted(out)


class Index:
    """Templates as sets in global order with the inverted index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], percent: int):
        self.rank = {w: (n, w) for w, n in frequency.items()}
        self.templates = []
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            ordered = sorted(set(words_of(text.encode())), key=self.rank.__getitem__)
            need = -(-percent * len(ordered) // 100)
            for pos, w in enumerate(ordered[:len(ordered) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.templates), pos))
            self.templates.append((label, frozenset(ordered), need))
        self.tokens = frozenset(self.prefixes)

    def matches(self, block: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, contained share) of every template of which the block contains enough."""
        shared = self.tokens.intersection(block)
        if not shared:
            return []
        tried, out = set(), []
        inner = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)  # words of no template cannot be shared
        place = {w: i for i, w in enumerate(inner)}
        for w in sorted(shared, key=self.rank.__getitem__):
            for t, pos in self.prefixes[w]:
                label, template, need = self.templates[t]
                if t not in tried and len(inner) >= need and min(len(template) - pos, len(inner) - place[w]) >= need:
                    common = len(template & block)
                    if common >= need:
                        out.append((label, common / len(template)))
                if min(len(template) - pos, len(inner) - place[w]) >= need:
                    tried.add(t)
        return out


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of a template occurs, over all documents. The list is as long as the templates."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t.encode())})

    def fill():
        number = {w: i for i, w in enumerate(vocabulary)}
        known = frozenset(vocabulary)

        def step(batch, counts):
            for text in utf8(batch):
                if text:
                    for w in known.intersection(words_of(text)):
                        counts[number[w]] += 1
        return step

    return dict(zip(vocabulary, total(docs.select("text"), len(vocabulary), np.int64, fill, blocks=1).tolist(), strict=True))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = CONTAINMENT, phrases=PHRASES) -> DataFrame:
    """Labels of every document's whole text (columns ``doc_id, text``), one row per given row.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the phrases; ``labels`` of phrases and templates; ``score``:
    the largest contained share of a template that reaches the threshold, 1 with a phrase, else 0. Missing and empty texts have no words,
    empty labels and null places. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequency = frequencies(docs, templates)

    def make():
        index = Index(templates, frequency, percent)

        def one(text: bytes | None):
            words = words_of(text or b"")
            places = phrase_places(words, phrases)
            found = []
            if not index.tokens.isdisjoint(words):
                found = [m for b in blocks_of(text) for m in index.matches(b)]
            base = sorted({label for _, label in places})
            return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
                    ",".join(sorted({*base, *(label for label, _ in found)})), 1.0 if places else max((s for _, s in found), default=0.0))

        def step(batch):
            rows = [one(t) for t in utf8(batch)]
            return {n: [r[i] for r in rows] for i, n in enumerate(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))}
        return step

    return map_rows(docs, ["doc_id", "text"], "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                                              "labels string, score double", make).drop("text")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT rid, regexp_extract_all(t, '{_WORDS}') AS ws FROM d)),
l AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
p AS (SELECT rid, i, CASE WHEN w = 'cc' AND w1 = 'by' THEN 'cc-by' WHEN w = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl'
      WHEN w = 'all' AND w1 = 'rights' AND w2 = 'reserved' THEN 'reserved' END AS label FROM l),
base AS (SELECT rid, count(*) AS n_words, count(label) AS n_base, min(i) FILTER (label IS NOT NULL) AS first_word,
         max(i) FILTER (label IS NOT NULL) AS last_word, list(DISTINCT label) FILTER (label IS NOT NULL) AS bl FROM p GROUP BY rid),
b AS (SELECT DISTINCT rid, list_distinct(regexp_extract_all(x, '{_WORDS}')) AS ws FROM (
      SELECT rid, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\n[\\x20\\x09-\\x0D]*\n'))) AS x FROM d)),
tpl AS (SELECT label, list_distinct(regexp_extract_all(txt, '{_WORDS}')) AS tw FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)}) v(label, txt)),
m AS (SELECT rid, label, len(list_intersect(ws, tw)) AS c, len(tw) AS n FROM b, tpl WHERE 100 * len(list_intersect(ws, tw)) >= {CONTAINMENT} * len(tw)),
g AS (SELECT rid, list(DISTINCT label) AS ml, max(c / n) AS s FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(bl, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN g USING (rid)"""

QUERIES = {"op6_license_scans": op6_license_scans}
ORACLES = {"op6_license_scans": _ORACLE}
