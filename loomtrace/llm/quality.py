"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are masks over
those bits, so a new policy version, or the effect of leaving one rule out, never reads the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_rows, utf8
from loomtrace.llm.registry import table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks",
            "n_distinct_words"]

#: What a byte counts as: 0 continuation of a code point, 1 other, 2 white space, 3 symbol, 4 upper case, 5 lower case or not ASCII,
#: 6 exclamation or question mark.
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[0xC0:] = 5
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[ord("A"):ord("Z") + 1] = 4
_CLASS[ord("a"):ord("z") + 1] = 5
_CLASS[list(b"!?")] = 6


def measure(text: bytes | None) -> tuple[int, ...]:
    """All measurements of one text, in the order of MEASURES. A missing text counts as an empty one."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    return (len(words), int(kinds.sum() - kinds[0] - kinds[2]), int(kinds[3]), dup, repeated_words(ids, len(numbers)), lines,
            int(kinds[4]), int(kinds[4] + kinds[5]), int(kinds[6]), len(numbers))


def repeated_words(ids: list[int], n_distinct: int) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    if n_distinct == len(ids) or len(ids) < 4:
        return 0
    a = np.asarray(ids, dtype=np.int64)
    pairs = a[:-2] * n_distinct + a[1:-1]
    if n_distinct > 2_000_000:  # the product of three would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * n_distinct + a[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(len(a), dtype=bool)
    for shift in range(3):
        inside[shift:len(a) - 2 + shift] |= twice
    return int(inside.sum())


def measurements(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The measurements of every document's whole text beside ``row``, a struct of all its columns; no shuffle."""
    def make():
        def step(batch):
            rows = [measure(t) for t in utf8(batch, "__text")]
            return {name: [r[i] for r in rows] for i, name in enumerate(MEASURES)}
        return step

    given = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("__text"))
    return map_rows(given, ["row"], ", ".join(f"{m} bigint" for m in MEASURES), make)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds. ``bit`` is its place in the ledger and never changes its meaning."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "upper_case", "100 * n_upper > 60 * n_letters"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(6, "marks", "10 * n_marks > 3 * n_words"),
    Rule(7, "few_distinct_words", "n_words >= 50 AND 100 * n_distinct_words < 10 * least(n_words, 1000)"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Reject where one of ``any_of`` fails, or ``at_least`` of ``some_of`` fail."""

    version: str
    any_of: tuple[str, ...]
    some_of: tuple[str, ...] = ()
    at_least: int = 2

    def mask(self, names: tuple[str, ...], rules: tuple[Rule, ...], without: str | None = None) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in names if n != without)

    def rejects(self, bits: Column, rules: tuple[Rule, ...] = RULES, without: str | None = None) -> Column:
        hard = bits.bitwiseAND(F.lit(self.mask(self.any_of, rules, without))) != 0
        soft = F.bit_count(bits.bitwiseAND(F.lit(self.mask(self.some_of, rules, without)))) >= self.at_least
        return hard | soft if self.some_of else hard


POLICIES = (
    Policy("v1-base", BASE),
    Policy("v2-surface", (*BASE, "symbols", "upper_case", "word_length"), ("duplicate_lines", "marks", "few_distinct_words"), 2),
)
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``row`` (all given columns), measurements and ``failed_bits``: the text is read once, every rule is evaluated once.

    A missing or empty text has only zero measurements and fails ``few_words``. Repeated rows give repeated ledger rows; an empty
    table gives an empty ledger. Given columns cannot clash with the ledger's, because they stay inside ``row``.
    """
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measurements(docs, text_col).withColumn("failed_bits", bits)


def apply_policy(ledger_rows: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``policy_version`` and ``kept``; reads bits only."""
    return ledger_rows.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", ~policy.rejects(F.col("failed_bits"), rules))


def ablations(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that the policy rejects, and that only this rule rejects.

    The ledger is first reduced to counts per bit pattern (at most two to the number of rules rows, whatever its size); every
    policy and ablation is then arithmetic over those few rows. An empty ledger gives no rows.
    """
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    bits, out = F.col("failed_bits"), None
    cases = []
    for policy in policies:
        for rule in rules:
            full, less = policy.rejects(bits, rules), policy.rejects(bits, rules, rule.name)
            cases.append(F.struct(F.lit(policy.version).alias("policy_version"), F.lit(rule.name).alias("rule"),
                                  (bits.bitwiseAND(F.lit(1 << rule.bit)) != 0).alias("fails"), full.alias("rejected"),
                                  (full & ~less).alias("only_this")))
    out = patterns.select("n", F.explode(F.array(*cases)).alias("c")).select("n", "c.*")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}")
    return out.groupBy("policy_version", "rule").agg(count("fails"), count("rejected"), count("only_this"))


def failure_profile(ledger_rows: DataFrame, *keys: str) -> DataFrame:
    """Bits that some, and bits that all, documents of a key fail."""
    return ledger_rows.groupBy(*keys).agg(F.bit_or("failed_bits").alias("some_fail"), F.bit_and("failed_bits").alias("all_fail"),
                                          F.count("*").alias("n_docs"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents under the current policy."""
    base = sum(1 << r.bit for r in RULES if r.name in BASE)
    rows = apply_policy(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed_bits", "n_lines",
                       "n_upper", "n_letters", "n_marks", "n_distinct_words", "policy_version")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, in the columns they came with."""
    return apply_policy(ledger(docs)).filter("kept").select("row.*")


_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
          FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
windows AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT *, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 THEN 1 ELSE 0 END AS hit FROM windows),
covered AS (SELECT *, max(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM twice),
wordly AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c) AS n_repeat_words, count(DISTINCT w) AS n_distinct_words
           FROM covered GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
liney AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::BIGINT AS n_letters,
  length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks, coalesce(n_distinct_words, 0)::BIGINT AS n_distinct_words
  FROM d LEFT JOIN wordly USING (rid) LEFT JOIN liney USING (rid)),
f AS (SELECT *, """ + " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES) + r""" AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (failed_bits & HARD <> 0 OR bit_count((failed_bits & SOFT)::BIGINT) >= AT_LEAST) AS kept, failed_bits::BIGINT AS failed_bits,
  n_lines, n_upper, n_letters, n_marks, n_distinct_words, 'VERSION' AS policy_version FROM f
""".replace("HARD", str(CURRENT.mask(CURRENT.any_of, RULES))).replace("SOFT", str(CURRENT.mask(CURRENT.some_of, RULES))).replace(
    "AT_LEAST", str(CURRENT.at_least)).replace("VERSION", CURRENT.version)

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _ORACLE}
