"""Pair decisions, candidate-set gates and gates over model opinions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import audit, evaluate, gates, linkage, ordered, retrieval
from loomtrace.plans.oracle import words
from loomtrace.plans.registry import Section
from loomtrace.session import new_folder
from loomtrace.sources import drivers

SECTION = Section()
KEY = ["case_id"]

# the adapter's facts as numbers: no text is parsed on the oracle side
PAIRS = f"""cp AS (SELECT o AS case_id, 'c' || lpad(CAST(l AS VARCHAR), 3, '0') || '_' || p || '_' || u AS candidate_id,
    {words(drivers.CATEGORIES)}[o % 5 + 1] AS category,
    CASE WHEN o % 3 = 0 THEN o % 4 END AS it, CASE WHEN o % 5 = 0 THEN o % 2 END AS ic, CASE WHEN o % 7 = 0 THEN o % 3 END AS ir,
    o % 11 = 0 AS br, o % 4 = 1 AS co, o % 6 = 1 AS ba, CASE WHEN o % 9 = 0 THEN o % 5 END AS ig,
    CASE WHEN o % 8 = 0 THEN o % 3 END AS ie, CASE WHEN o % 13 = 0 THEN o % 2 END AS ia,
    CASE WHEN p % 3 = 0 THEN u % 4 END AS ct, CASE WHEN p % 4 = 0 THEN u % 2 END AS cc, CASE WHEN p % 5 = 0 THEN u % 3 END AS cr,
    u % 5 AS cg, {words(drivers.LIFECYCLES)}[p % 4 + 1] AS lifecycle,
    CASE WHEN u % 2 = 0 THEN u % 3 END AS ce, CASE WHEN u % 3 = 0 THEN u % 2 END AS ca,
    ((p * 37 + u * 11) % 101) / 100.0::DOUBLE AS score, CAST(l AS BIGINT) * 1000000000 + p * 10000 + u AS created,
    u % 4 = 3 AS other_person, p % 2 = 0 AS unresolved,
    ['attach', 'new', 'branch', 'attach', 'new'][o % 5 + 1] AS expected_decision
  FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS u, l_linenumber AS l FROM lineitem))"""

LINKED = f"""{PAIRS}, ev AS (SELECT *, coalesce(ic <> cc, false) AS hard_new,
    coalesce(it = ct, false) AND NOT coalesce(ic <> cc, false) AS strong_attach, coalesce(ir = cr, false) AS scope_match,
    coalesce(it = ct, false) OR (ic IS NOT NULL AND cc IS NOT NULL) AS anchor_relevant,
    lifecycle <> 'resolved' AS live FROM cp),
  ru AS (SELECT *, CASE WHEN hard_new THEN 1 WHEN strong_attach THEN 2 WHEN ie <> ce THEN 3 WHEN ia <> ca THEN 4 WHEN br THEN 5
    WHEN ig = cg AND live THEN 6 WHEN ie = ce OR ia = ca THEN 7 WHEN co AND live THEN 8 WHEN NOT live THEN 9
    WHEN score >= 0.72 THEN 10 WHEN score < 0.20 AND live THEN 11 WHEN score < 0.20 THEN 12 ELSE 13 END AS r FROM ev),
  lk AS (SELECT *, ['new', 'attach', 'new', 'new', 'branch', 'attach', 'uncertain', 'attach', 'uncertain', 'uncertain',
      'uncertain', 'new', 'uncertain'][r] AS linker_decision,
    list_extract([0.99, 0.99, 0.99, 0.99, 0.90, 0.95, 0.55, 0.90, 0.50, 0.65, 0.45, 0.80, 0.40]::DOUBLE[], r) AS linker_confidence FROM ru)"""

# ranked candidates of a case by window functions, gates by CASE over window results
ROUTED = f"""{LINKED}, rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, created) AS pos FROM lk),
  tops AS (SELECT case_id, max(candidate_id) FILTER (pos = 1) AS top_candidate, max(score) FILTER (pos = 1) AS top_score,
    max(score) FILTER (pos = 2) AS second_score, max(lifecycle) FILTER (pos = 1) AS top_lifecycle,
    bool_or(pos = 1 AND other_person) AS top_other, bool_or(ba) AS ba, count(*) AS candidates,
    max(linker_decision) FILTER (pos = 1) AS top_linker, bool_or(pos = 1 AND anchor_relevant) AS top_relevant,
    bool_or(anchor_relevant) AS recall, max(category) AS category, max(expected_decision) AS expected_decision,
    count(*) FILTER (linker_decision = 'attach') AS attaches, count(*) FILTER (linker_decision = 'branch') AS branches,
    count(*) FILTER (linker_decision = 'new') AS rejected, count(*) FILTER (linker_decision = 'uncertain') AS open_n,
    max(candidate_id) FILTER (linker_decision = 'uncertain') AS some_open, min(linker_confidence) AS min_confidence,
    bool_and(linker_decision = 'new') FILTER (score >= 0.12) AS plausible_rejected,
    min(linker_confidence) FILTER (score >= 0.12) AS plausible_confidence FROM rk GROUP BY 1),
  bs AS (SELECT case_id, kind, candidate_id, score, linker_confidence AS confidence, other_person FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY linker_confidence DESC, score DESC, created) AS n FROM (
      SELECT *, 'strong' AS kind FROM lk WHERE linker_decision = 'attach' AND strong_attach
      UNION ALL SELECT *, linker_decision AS kind FROM lk WHERE linker_decision IN ('attach', 'branch'))) WHERE n = 1),
  ga AS (SELECT t.*, s.candidate_id AS sc, s.confidence AS sf, s.other_person AS so, b.candidate_id AS bc, b.confidence AS bf,
    b.score AS bsc, b.other_person AS bo, a.candidate_id AS ac, a.confidence AS af, a.score AS asc_, a.other_person AS ao,
    top_score - second_score AS margin,
    CASE WHEN attaches + branches > 0 THEN 'uncertain' WHEN rejected = candidates THEN 'new' ELSE 'uncertain' END AS set_decision
    FROM tops t LEFT JOIN bs s ON s.case_id = t.case_id AND s.kind = 'strong'
    LEFT JOIN bs b ON b.case_id = t.case_id AND b.kind = 'branch' LEFT JOIN bs a ON a.case_id = t.case_id AND a.kind = 'attach'),
  gb AS (SELECT *, CASE WHEN sc IS NOT NULL THEN 1 WHEN bc IS NOT NULL AND NOT bsc < top_score - 0.15 THEN 2
      WHEN bc IS NOT NULL THEN 6 WHEN ac IS NOT NULL AND NOT asc_ < top_score - 0.15 THEN 3 WHEN ac IS NOT NULL THEN 6
      WHEN rejected = candidates THEN 4 ELSE 6 END AS g,
    top_lifecycle = 'resolved' AND ba AS re_signal FROM ga),
  gd AS (SELECT *, ['attach', 'branch', 'attach', 'new', '', 'uncertain'][g] AS gate_decision,
    CASE g WHEN 1 THEN sc WHEN 2 THEN bc WHEN 3 THEN ac WHEN 6 THEN top_candidate END AS gate_candidate,
    CASE g WHEN 1 THEN sf WHEN 2 THEN bf WHEN 3 THEN af WHEN 4 THEN min_confidence ELSE 0.50 END::DOUBLE AS gate_confidence,
    re_signal AND top_score >= 0.25 AND coalesce(margin, top_score) >= 0.15 AS re_ok,
    CASE WHEN top_score < 0.12 THEN 0.90 WHEN coalesce(plausible_rejected, false) THEN plausible_confidence END AS nm_conf
    FROM gb),
  fin AS (SELECT *, CASE WHEN set_decision = 'new' THEN 'new' WHEN attaches + branches > 0 THEN gate_decision
      ELSE 'uncertain' END AS a0,
    CASE WHEN set_decision = 'new' THEN NULL WHEN attaches + branches > 0 THEN gate_candidate
      WHEN open_n = 1 THEN some_open END AS c0,
    CASE WHEN set_decision = 'new' THEN min_confidence WHEN attaches + branches > 0 THEN gate_confidence ELSE 0.50 END AS f0
    FROM gd),
  routed AS (SELECT *, CASE WHEN a0 <> 'uncertain' THEN a0 WHEN re_ok THEN 'attach' WHEN nm_conf IS NOT NULL THEN 'new'
      ELSE 'uncertain' END AS decision,
    CASE WHEN a0 <> 'uncertain' THEN c0 WHEN re_ok THEN top_candidate WHEN nm_conf IS NOT NULL THEN NULL ELSE c0 END AS chosen,
    CASE WHEN a0 <> 'uncertain' THEN f0 WHEN re_ok THEN 0.92 WHEN nm_conf IS NOT NULL THEN nm_conf ELSE f0 END::DOUBLE
      AS confidence,
    CASE WHEN a0 <> 'uncertain' THEN 'local' WHEN re_ok THEN 'reopen_gate' WHEN nm_conf IS NOT NULL THEN 'no_match_gate'
      ELSE 'local' END AS source FROM fin)"""


def linked_pairs(spark, sf):
    return linkage.structured(linkage.with_anchors(drivers.candidate_pairs(spark, sf)))


def case_texts(spark, sf):
    return drivers.candidate_pairs(spark, sf).groupBy("case_id").agg(
        F.max("incoming_text").alias("incoming_text"), F.max("category").alias("category"),
        F.max("expected_decision").alias("expected_decision"))


def routed_cases(spark, sf, runtime=False):
    return gates.route_cases(linked_pairs(spark, sf), KEY, case_texts(spark, sf), runtime)


def _facts(spark, sf):
    p = linked_pairs(spark, sf)
    return gates.set_facts(p, KEY).join(gates.top_two(p, KEY), KEY)


@SECTION.add("e14_anchor_evidence", f"""WITH {LINKED} SELECT case_id, candidate_id, hard_new, strong_attach, anchor_relevant,
  CASE WHEN ic = cc THEN 'customer:acme' || ic ELSE '' END AS boundary_matches,
  CASE WHEN ic <> cc THEN 'customer' ELSE '' END AS boundary_mismatches,
  CASE WHEN it = ct THEN 'ticket:ops-' || it ELSE '' END AS strong_matches,
  CASE WHEN scope_match THEN 'repo:svc' || ir ELSE '' END AS scope_matches,
  concat_ws('|', CASE WHEN ic = cc THEN 'boundary_match' WHEN ic <> cc THEN 'boundary_mismatch' END,
    CASE WHEN scope_match THEN 'scope_anchor_match' END, CASE WHEN it = ct THEN 'strong_anchor_match' END) AS rules FROM lk""")
def _(spark, sf):
    e = linkage.compare_anchors(linkage.with_anchors(drivers.candidate_pairs(spark, sf)), "candidate_anchors", "incoming_anchors")
    lists = ["boundary_matches", "boundary_mismatches", "strong_matches", "scope_matches"]
    return e.select("case_id", "candidate_id", "hard_new", "strong_attach", "anchor_relevant",
                    *[F.array_join(c, "|").alias(c) for c in lists],
                    F.array_join(F.transform("anchor_rules", lambda r: r["rule"]), "|").alias("rules"))


@SECTION.add("h03_hybrid_linker", f"""WITH {PAIRS}, r AS (SELECT *, CASE WHEN coalesce(ic <> cc, false) OR coalesce(ir <> cr, false)
      OR coalesce(it <> ct, false) THEN 1 WHEN br THEN 2 WHEN co AND unresolved THEN 3 WHEN co THEN 4 WHEN score >= 0.72 THEN 5
      WHEN score >= 0.40 THEN 6 WHEN score < 0.20 THEN 7 ELSE 8 END AS r FROM cp)
  SELECT case_id, candidate_id, ['new', 'branch', 'attach', 'uncertain', 'attach', 'uncertain', 'new', 'uncertain'][r] AS decision,
    list_extract([0.99, 0.90, 0.90, 0.55, 0.80, 0.50, 0.80, 0.40]::DOUBLE[], r) AS confidence FROM r""")
def _(spark, sf):
    return linkage.hybrid(drivers.candidate_pairs(spark, sf)).select("case_id", "candidate_id", "decision", "confidence")


@SECTION.add("h04_structured_linker", f"""WITH {LINKED} SELECT case_id, candidate_id, linker_decision, linker_confidence,
  strong_attach AS strong_identity FROM lk""")
def _(spark, sf):
    return linked_pairs(spark, sf).select("case_id", "candidate_id", "linker_decision", "linker_confidence", "strong_identity")


_OPINION = """op AS (SELECT case_id, arg_min(action, rk) AS opinion, arg_min(confidence, rk) AS opinion_confidence,
    arg_min(provider, rk) AS opinion_provider FROM (SELECT *, CASE provider WHEN 'verifier' THEN 0 ELSE 10 END - run AS rk FROM asm)
    GROUP BY 1)"""
ASSESS = """asm AS (SELECT o AS case_id, provider, i, run, action, CASE WHEN action IN ('attach', 'branch') THEN
      't' || (o % 7 + CASE WHEN o % 17 = 0 THEN i ELSE 0 END) END AS candidate_id,
    ((o * 7 + i * 13) % 41) / 100.0::DOUBLE + 0.6::DOUBLE AS confidence, CASE WHEN o % 50 = 0 THEN 'L1' ELSE 'L2' END AS maturity
  FROM (SELECT o_orderkey AS o, provider, i, run, ['new', 'attach', 'branch', 'abstain'][(o_orderkey + i * (o_custkey % 3) +
      CASE WHEN o_orderkey % 10 = 0 THEN run ELSE 0 END) % 4 + 1] AS action
    FROM orders, (VALUES ('primary', 0), ('verifier', 1)) r(provider, i), range(1, 4) x(run))
  WHERE NOT (i = 1 AND o % 9 = 4))"""


@SECTION.add("h05_cascade_linker", f"""WITH {LINKED}, {ASSESS}, {_OPINION} SELECT lk.case_id, candidate_id,
    CASE WHEN linker_decision <> 'uncertain' THEN linker_decision WHEN opinion IN ('attach', 'branch', 'new') AND
      opinion_confidence >= 0.80 THEN opinion ELSE 'clarify' END AS decision,
    CASE WHEN linker_decision <> 'uncertain' OR opinion IS NULL THEN linker_confidence ELSE opinion_confidence END AS confidence,
    CASE WHEN linker_decision <> 'uncertain' THEN 'local' WHEN opinion IN ('attach', 'branch', 'new') AND
      opinion_confidence >= 0.80 THEN 'frontier_judge:' || opinion_provider ELSE 'user_clarification' END AS source
  FROM lk LEFT JOIN op ON op.case_id = lk.case_id""")
def _(spark, sf):
    a = drivers.assessments(spark, sf)
    rank = a.select("provider").distinct().withColumn("rank", F.when(F.col("provider") == "verifier", 1).otherwise(2))
    first = linkage.first_available(a, rank, KEY).select(
        "case_id", F.col("action").alias("opinion"), F.col("confidence").alias("opinion_confidence"),
        F.col("provider").alias("opinion_provider"))
    return linkage.cascade(linked_pairs(spark, sf), first, KEY).select(
        "case_id", "candidate_id", "decision", "confidence", "source")


@SECTION.add("h06_candidate_set", f"""WITH {ROUTED} SELECT case_id, candidates, rejected, open_n AS unresolved_candidates,
    set_decision, CASE WHEN set_decision = 'new' THEN min_confidence ELSE 0.50 END::DOUBLE AS set_confidence,
    CASE WHEN attaches + branches = 0 AND set_decision <> 'new' AND open_n = 1 THEN some_open END AS set_candidate FROM fin""")
def _(spark, sf):
    f = gates.resolve_set(gates.set_facts(linked_pairs(spark, sf), KEY))
    return f.select("case_id", "candidates", "rejected", "unresolved_candidates", "set_decision", "set_confidence", "set_candidate")


@SECTION.add("h07_candidate_gate", f"""WITH {ROUTED} SELECT case_id, gate_decision, gate_candidate, gate_confidence, top_score,
    second_score, round(margin, 6) AS margin FROM gd""")
def _(spark, sf):
    return gates.candidate_gate(_facts(spark, sf)).select(
        "case_id", "gate_decision", "gate_candidate", "gate_confidence", "top_score", "second_score",
        F.round("margin", 6).alias("margin"))


@SECTION.add("h08_reopen_gate", f"""WITH {ROUTED} SELECT case_id, CASE WHEN re_ok THEN 'attach' ELSE 'uncertain' END AS decision,
    top_candidate AS candidate_id, CASE WHEN re_ok THEN 0.92 ELSE 0.50 END::DOUBLE AS confidence FROM gd""")
def _(spark, sf):
    f = gates.top_two(drivers.candidate_pairs(spark, sf), KEY).join(case_texts(spark, sf), KEY)
    return gates.reopen_gate(f).select("case_id", F.col("reopen_decision").alias("decision"),
                                       F.col("top_candidate").alias("candidate_id"), F.col("reopen_confidence").alias("confidence"))


@SECTION.add("h09_no_match_gate", f"""WITH {ROUTED} SELECT case_id, CASE WHEN nm_conf IS NULL THEN 'uncertain' ELSE 'new' END
    AS decision, coalesce(nm_conf, 0.50)::DOUBLE AS confidence FROM gd""")
def _(spark, sf):
    return gates.no_match_gate(_facts(spark, sf)).select(
        "case_id", F.col("no_match_decision").alias("decision"), F.col("no_match_confidence").alias("confidence"))


_SAFE = """sf AS (SELECT rk.case_id, candidate_id, pos, score, second_score, category, expected_decision, opinion, opinion_confidence,
    CASE WHEN coalesce(opinion NOT IN ('attach', 'branch', 'new'), true) OR opinion_confidence < 0.80 THEN 'insufficient'
    WHEN hard_new AND opinion = 'new' THEN 'new_agrees_with_boundary' WHEN hard_new THEN 'conflicts_with_boundary'
    WHEN strong_attach AND opinion = 'attach' THEN 'confirmed_by_strong_anchor'
    WHEN strong_attach AND opinion = 'new' THEN 'conflicts_with_strong_anchor'
    WHEN opinion = 'attach' AND pos > 1 THEN 'not_top_candidate'
    WHEN opinion = 'attach' AND ig = cg THEN 'exact_goal'
    WHEN opinion = 'attach' AND lifecycle = 'resolved' AND rk.ba AND score >= 0.20 AND score - coalesce(second_score, 0) >= 0.12
      THEN 'separated_recurrence'
    WHEN opinion = 'attach' AND score >= 0.20 AND score - coalesce(second_score, 0) >= 0.12 AND NOT scope_match
      THEN 'separated_top_candidate'
    WHEN opinion = 'attach' THEN 'attach_lacks_evidence'
    WHEN opinion = 'branch' AND pos = 1 AND score >= 0.20 THEN 'plausible_branch_parent' WHEN opinion = 'branch' THEN
      'branch_parent_implausible' ELSE 'no_contradicting_anchor' END AS reason
  FROM rk JOIN (SELECT case_id, second_score FROM tops) t USING (case_id) JOIN op USING (case_id) WHERE pos <= 2),
  sg AS (SELECT *, reason IN ('new_agrees_with_boundary', 'confirmed_by_strong_anchor', 'exact_goal', 'separated_recurrence',
    'separated_top_candidate', 'plausible_branch_parent', 'no_contradicting_anchor') AS ok FROM sf)"""
SAFE = f"{ROUTED}, {ASSESS}, {_OPINION}, {_SAFE}"


def safe_rows(spark, sf):
    """The two best candidates of every case with the opinion of the first available provider, gated. Only the best is the top one."""
    pairs = drivers.candidate_pairs(spark, sf)
    slim = pairs.select(*KEY, "candidate_id", "score", "created")
    two = ordered.top_rows(slim, KEY, [F.desc("score"), F.col("created")], 2, "pos").select(*KEY, "candidate_id", "pos")
    second = gates.top_two(pairs, KEY).select(*KEY, "second_score")
    best = linkage.with_anchors(pairs.join(two, ["case_id", "candidate_id"]).join(second, KEY))
    a = drivers.assessments(spark, sf)
    rank = a.select("provider").distinct().withColumn("rank", F.when(F.col("provider") == "verifier", 1).otherwise(2))
    op = linkage.first_available(a, rank, KEY).select(
        "case_id", F.col("action").alias("opinion"), F.col("confidence").alias("opinion_confidence"))
    rows = linkage.compare_anchors(best, "candidate_anchors", "incoming_anchors").join(op, "case_id")
    return gates.safety_gate(rows.withColumn("is_top", F.col("pos") == 1))


@SECTION.add("h10_semantic_safety_gate", f"""WITH {SAFE} SELECT case_id, candidate_id, reason AS safety_reason, ok AS safe_accepted,
    CASE WHEN ok THEN opinion ELSE 'uncertain' END AS safe_decision,
    CASE WHEN NOT (ok AND opinion = 'new') THEN candidate_id END AS safe_candidate FROM sg""")
def _(spark, sf):
    return safe_rows(spark, sf).select("case_id", "candidate_id", "safety_reason", "safe_accepted", "safe_decision", "safe_candidate")


#: The opinion of a provider over all runs of a case.
MODAL = """mc AS (SELECT case_id, provider, i, action, candidate_id, count(*) AS n, min(run) AS f, min(confidence) AS confidence FROM asm GROUP BY ALL),
  mo AS (SELECT case_id, provider, i, o.action, o.candidate_id, o.confidence, stable FROM (SELECT case_id, provider, i, count(*) = 1 AS stable,
    arg_max(struct_pack(action := action, candidate_id := candidate_id, confidence := confidence), (n, -f)) AS o FROM mc GROUP BY 1, 2, 3))"""

_GATED = """li AS (SELECT DISTINCT l_orderkey AS case_id, 't' || (l_partkey % 7) AS candidate_id,
    l_suppkey % 5 AS tick FROM lineitem),
  known AS (SELECT case_id, candidate_id, bool_or(tick = case_id % 5) AS exact FROM li GROUP BY 1, 2),
  hg AS (SELECT a.*, k.case_id IS NOT NULL AS known, coalesce(k.exact, false) AS exact FROM {table} a LEFT JOIN known k
    ON k.case_id = a.case_id AND k.candidate_id = a.candidate_id),
  hr AS (SELECT *, CASE action WHEN 'abstain' THEN 'model_abstained'
    WHEN 'new' THEN CASE WHEN confidence >= 0.80 THEN 'high_confidence_new' ELSE 'low_confidence_new' END
    ELSE CASE WHEN NOT known THEN 'candidate_missing' WHEN action = 'attach' THEN CASE WHEN exact AND confidence >= 0.75 THEN
      'exact_anchor_support' ELSE 'attach_lacks_structural_support' END WHEN exact AND confidence >= 0.80 THEN
      'branch_anchor_support' ELSE 'branch_lacks_structural_support' END END AS gate_reason FROM hg),
  hgr AS (SELECT *, gate_reason IN ('high_confidence_new', 'exact_anchor_support', 'branch_anchor_support') AS ok FROM hr)"""
GATED = f"{ASSESS}, {_GATED.replace('{table}', 'asm')}"
GATED_MODAL = f"{ASSESS}, {MODAL}, {_GATED.replace('{table}', 'mo')}"


def gated_rows(spark, sf, modal: bool = False):
    """Opinions with candidate and anchor support, per run or over all runs: candidates and their tickets come from the order's lines."""
    a = evaluate.modal_opinions(drivers.assessments(spark, sf), KEY) if modal else drivers.assessments(spark, sf)
    li = drivers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")).alias("candidate_id"),
        F.concat(F.lit("ops-"), (F.col("l_suppkey") % 5).cast("string")).alias("anchor"))
    text = F.concat(F.lit("Look at (OPS-"), (F.col("case_id") % 5).cast("string"), F.lit(")!, please."))
    hit = F.array_contains(gates.event_anchor_tokens(text), F.col("anchor"))
    known = li.groupBy("case_id", "candidate_id").agg(F.max(hit).alias("exact_anchor"), F.lit(True).alias("candidate_known"))
    return gates.hybrid_gate(a.join(known, ["case_id", "candidate_id"], "left"))


@SECTION.add("h11_hybrid_gate", f"""WITH {GATED} SELECT case_id, provider, run, gate_reason, ok AS accepted_model,
    CASE WHEN ok THEN action ELSE 'clarify' END AS gated_action,
    CASE WHEN ok AND action <> 'new' THEN candidate_id END AS gated_candidate FROM hgr""")
def _(spark, sf):
    return gated_rows(spark, sf).select("case_id", "provider", "run", "gate_reason", "accepted_model", "gated_action", "gated_candidate")


PAIRED = f"""{ASSESS}, {MODAL}, pa AS (SELECT case_id, max(action) FILTER (i = 0) AS pa, max(candidate_id) FILTER (i = 0) AS pc,
    max(confidence) FILTER (i = 0) AS pf, max(action) FILTER (i = 1) AS va, max(candidate_id) FILTER (i = 1) AS vc,
    max(confidence) FILTER (i = 1) AS vf FROM mo GROUP BY 1)"""


def paired(spark, sf):
    return gates.pair_up(drivers.assessments(spark, sf), KEY)


@SECTION.add("e8_opinion_pairs", f"WITH {PAIRED} SELECT case_id, pa AS primary_action, va AS verifier_action FROM pa")
def _(spark, sf):
    return paired(spark, sf).select("case_id", F.col("primary.action").alias("primary_action"),
                                    F.col("verifier.action").alias("verifier_action"))


@SECTION.add("h12_two_model_consensus", f"""WITH {PAIRED}, c AS (SELECT *, CASE WHEN pa <> va OR pc IS DISTINCT FROM vc THEN
      'provider_disagreement' WHEN pa = 'abstain' THEN 'providers_abstain' WHEN least(pf, vf) < 0.80 THEN
      'agreement_low_confidence' ELSE 'high_confidence_provider_agreement' END AS reason FROM pa WHERE va IS NOT NULL)
  SELECT case_id, reason, reason <> 'provider_disagreement' AS agreement,
    CASE WHEN reason = 'high_confidence_provider_agreement' THEN pa ELSE 'clarify' END AS action,
    CASE WHEN reason = 'high_confidence_provider_agreement' THEN pc END AS candidate_id FROM c""")
def _(spark, sf):
    return gates.consensus(paired(spark, sf)).select("case_id", "reason", "agreement", "action", "candidate_id")


NEW_REASON = """CASE WHEN pa IS NULL THEN 'primary_unavailable' WHEN pa <> 'new' OR pf < 0.80 THEN 'primary_not_confident_new'
    WHEN va IS NULL THEN 'verifier_required' WHEN va <> 'new' OR vf < 0.80 THEN 'provider_disagreement'
    ELSE 'independent_provider_consensus' END"""


@SECTION.add("h13_consensus_new", f"""WITH {PAIRED} SELECT case_id, {NEW_REASON} AS reason,
    {NEW_REASON} = 'independent_provider_consensus' AS accepted FROM pa""")
def _(spark, sf):
    return gates.consensus_new(paired(spark, sf)).select("case_id", "reason", "accepted")


@SECTION.add("h14_recovery_eligibility", f"""WITH {ROUTED}, d AS (SELECT *, CASE WHEN decision = 'uncertain' THEN 'clarify' ELSE
    decision END AS dd FROM routed) SELECT case_id, CASE WHEN dd <> 'clarify' THEN 'deterministic_not_clarify' WHEN candidates <> 1
    THEN 'requires_exactly_one_candidate' WHEN top_relevant THEN 'structural_path_should_handle_anchor' WHEN top_linker <> 'uncertain'
    THEN 'linker_not_uncertain' ELSE 'single_candidate_anchorless_uncertain' END AS reason FROM d""")
def _(spark, sf):
    r = routed_cases(spark, sf)
    d = F.when(F.col("decision") == "uncertain", "clarify").otherwise(F.col("decision"))
    return r.select("case_id", gates.recovery_eligibility(
        d, F.col("candidates"), F.col("top_pair.relevant"), F.col("top_pair.linker")).alias("reason"))


@SECTION.add("h14_attach_recovery", f"""WITH {PAIRED}, r AS (SELECT case_id, 't' || (case_id % 7) AS want, pa.* EXCLUDE (case_id),
    CASE WHEN pa IS NULL THEN 'primary_unavailable' WHEN pa = 'abstain' THEN 'primary_abstained'
    WHEN pa <> 'attach' OR pc <> 't' || (case_id % 7) THEN 'primary_did_not_attach_candidate' WHEN pf < 0.80 THEN
    'primary_low_confidence' WHEN va IS NULL THEN 'verifier_required' WHEN va <> 'attach' OR vc <> 't' || (case_id % 7) OR vf < 0.80
    THEN 'provider_disagreement' ELSE 'independent_provider_consensus' END AS reason FROM pa)
  SELECT case_id, reason, reason = 'independent_provider_consensus' AS accepted FROM r""")
def _(spark, sf):
    p = paired(spark, sf).withColumn("want", F.concat(F.lit("t"), (F.col("case_id") % 7).cast("string")))
    return gates.attach_recovery(p, "want").select("case_id", "reason", "accepted")


@SECTION.add("h15_cached_recovery", f"""WITH {ASSESS}, {MODAL}, j AS (SELECT case_id, action, confidence FROM mo WHERE i = 0),
  c AS (SELECT case_id, action, confidence FROM mo WHERE i = 1 AND case_id % 3 = 0)
  SELECT o_orderkey AS case_id, CASE WHEN c.action IS NOT NULL THEN c.action WHEN j.action IN ('attach', 'branch', 'new') AND
    j.confidence >= 0.80 THEN j.action ELSE 'uncertain' END AS decision, coalesce(c.confidence, j.confidence, 0.0) AS confidence,
    CASE WHEN c.action IS NOT NULL THEN 'cache' WHEN j.action IS NOT NULL THEN 'judge' ELSE 'none' END AS origin
  FROM orders LEFT JOIN j ON j.case_id = o_orderkey LEFT JOIN c ON c.case_id = o_orderkey""")
def _(spark, sf):
    a = evaluate.modal_opinions(drivers.assessments(spark, sf), KEY).withColumn("decision", F.col("action"))
    cases = drivers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    return gates.cached_recovery(cases, a.filter("provider = 'verifier' and case_id % 3 = 0"),
                                 a.filter("provider = 'primary'"), "case_id")


@SECTION.add("h16_routing_mode", f"""WITH {ROUTED}, m AS (SELECT *, case_id % 3 = 0 AND decision IN ('new', 'attach', 'branch') AS hold
    FROM routed) SELECT case_id, CASE WHEN hold THEN 'clarify' ELSE decision END AS decision,
    CASE WHEN hold THEN decision END AS proposed_decision, hold AS requires_confirmation FROM m""")
def _(spark, sf):
    r = routed_cases(spark, sf).withColumn("routing_mode", F.when(F.col("case_id") % 3 == 0, "clarify_only").otherwise("automatic"))
    return gates.apply_mode(r).select("case_id", "decision", "proposed_decision", "requires_confirmation")


@SECTION.add("h19_route_decision", f"""WITH {ROUTED}, x AS (SELECT *, top_score < 0.12 AND NOT recall AS floor_hit,
    decision = 'uncertain' AS abstain, CASE WHEN a0 = 'uncertain' AND re_ok THEN top_other WHEN gate_decision = 'branch' THEN bo
    WHEN sc IS NOT NULL THEN so ELSE ao END AS other FROM routed),
  y AS (SELECT *, decision IN ('attach', 'branch') AND coalesce(other, false) AS crossed FROM x)
  SELECT case_id, CASE WHEN floor_hit THEN 'new' WHEN abstain OR crossed THEN 'clarify' ELSE decision END AS decision,
    CASE WHEN floor_hit THEN NULL WHEN abstain THEN top_candidate ELSE chosen END AS chosen,
    CASE WHEN floor_hit THEN 0.90 ELSE confidence END::DOUBLE AS confidence, CASE WHEN floor_hit THEN 'candidate_retrieval'
      WHEN abstain THEN 'user_clarification' WHEN crossed THEN 'cross_person_structural_rescue' ELSE source END AS source FROM y""")
def _(spark, sf):
    return routed_cases(spark, sf, runtime=True).select("case_id", "decision", "chosen", "confidence", "source")


@SECTION.add("h20_v1_routing", f"""WITH {LINKED}, s AS (SELECT *, max(score) OVER (PARTITION BY case_id) AS best FROM lk
    WHERE NOT other_person), r AS (SELECT *, CASE WHEN linker_decision = 'uncertain' THEN 'clarify' ELSE linker_decision END AS d,
    row_number() OVER (PARTITION BY case_id ORDER BY linker_confidence DESC, created) AS n FROM s)
  SELECT case_id, CASE WHEN best < 0.15 THEN 'new' ELSE d END AS decision, CASE WHEN best < 0.15 OR d = 'new' THEN NULL
    ELSE candidate_id END AS chosen, CASE WHEN best < 0.15 THEN 0.90 ELSE linker_confidence END::DOUBLE AS confidence
  FROM r WHERE n = 1""")
def _(spark, sf):
    own = linked_pairs(spark, sf).filter(~F.col("other_person"))
    d = F.when(F.col("linker_decision") == "uncertain", "clarify").otherwise(F.col("linker_decision"))
    best = own.groupBy("case_id").agg(
        F.max("score").alias("top"), F.max_by(F.struct(d.alias("d"), "candidate_id", F.col("linker_confidence").alias("c")),
                                              F.struct("linker_confidence", -F.col("created"))).alias("b"))
    floor = F.col("top") < 0.15
    return best.select(
        "case_id", F.when(floor, "new").otherwise(F.col("b.d")).alias("decision"),
        F.when(~floor & (F.col("b.d") != "new"), F.col("b.candidate_id")).alias("chosen"),
        F.when(floor, 0.90).otherwise(F.col("b.c")).alias("confidence"))


@SECTION.add("b19_assessment_validation", f"""WITH {ASSESS}, v AS (SELECT *, CASE WHEN maturity <> 'L2' THEN
      'frontier assessment must remain L2' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence must be 0..1' END AS error FROM asm)
  SELECT coalesce(error, 'valid') AS outcome, action, count(*) AS rows FROM v GROUP BY 1, 2""")
def _(spark, sf):
    a = drivers.assessments(spark, sf)
    error = audit.assessment_error(F.col("action"), F.col("candidate_id"), F.col("confidence"), F.col("maturity"))
    return a.groupBy(F.coalesce(error, F.lit("valid")).alias("outcome"), "action").agg(F.count("*").alias("rows"))


@SECTION.add("g1_ranked_candidates", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC,
    created) AS n FROM cp) SELECT case_id, max(candidate_id) FILTER (n = 1) AS top_candidate, max(score) FILTER (n = 1) AS top_score,
    max(score) FILTER (n = 2) AS second_score, round(max(score) FILTER (n = 1) - max(score) FILTER (n = 2), 6) AS gate_margin,
    round(max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0), 6) AS router_margin FROM r GROUP BY 1""")
def _(spark, sf):
    t = gates.top_two(drivers.candidate_pairs(spark, sf), KEY)
    return t.select("case_id", "top_candidate", "top_score", "second_score", F.round("margin", 6).alias("gate_margin"),
                    F.round(F.col("top_score") - F.coalesce("second_score", F.lit(0.0)), 6).alias("router_margin"))


@SECTION.add("g2_best_per_decision", f"""WITH {LINKED} SELECT case_id, linker_decision, candidate_id, linker_confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, linker_decision ORDER BY linker_confidence DESC, score DESC, created) AS n
    FROM lk) WHERE n = 1""")
def _(spark, sf):
    return linked_pairs(spark, sf).groupBy("case_id", "linker_decision").agg(
        F.max_by(F.struct("candidate_id", "linker_confidence"), F.struct("linker_confidence", "score", -F.col("created"))).alias("b")
    ).select("case_id", "linker_decision", "b.candidate_id", "b.linker_confidence")


@SECTION.add("g3_best_same_work", f"""WITH {PAIRS} SELECT case_id, CASE WHEN max(score) >= 0.5 THEN
    arg_max(candidate_id, (score, -created)) END AS choice FROM cp GROUP BY 1""")
def _(spark, sf):
    return drivers.candidate_pairs(spark, sf).groupBy("case_id").agg(F.when(
        F.max("score") >= 0.5, F.max_by("candidate_id", F.struct(F.col("score"), -F.col("created")))).alias("choice"))


@SECTION.add("e6_pair_scoring", f"""WITH {PAIRS}, txt AS (SELECT case_id, candidate_id,
    concat('Notice', ' OPS-' || it, ' customer acme' || ic, ' repo svc' || ir, CASE WHEN br THEN ' this revealed more work' END,
      CASE WHEN co THEN ' still failing' END, CASE WHEN ba THEN ' it is back' END) AS incoming,
    concat('goal ', cg, ' Handling', ' OPS-' || ct, ' customer acme' || cc, ' repo svc' || cr) AS candidate FROM cp),
  s AS (SELECT case_id, candidate_id, list_distinct(regexp_extract_all(lower(incoming), '[a-z0-9]+')) AS x,
    list_distinct(regexp_extract_all(lower(candidate), '[a-z0-9]+')) AS y FROM txt),
  j AS (SELECT case_id, candidate_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE
    len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS overlap FROM s)
  SELECT *, max(overlap) OVER (PARTITION BY case_id) >= 0.12 AS case_has_match FROM j""")
def _(spark, sf):
    p = drivers.candidate_pairs(spark, sf)
    scored = p.select("case_id", "candidate_id", F.round(gates.word_overlap(F.col("incoming_text"), F.col("candidate_text")), 6).alias("overlap"))
    top = scored.groupBy("case_id").agg((F.max("overlap") >= 0.12).alias("case_has_match"))
    return scored.join(top, "case_id")


@SECTION.add("e7_score_lookup", f"""WITH {PAIRS}, t AS (SELECT * FROM cp WHERE case_id % 3 <> 0)
  SELECT cp.case_id, cp.candidate_id, t.score, t.case_id IS NOT NULL AS found FROM cp LEFT JOIN t ON t.case_id = cp.case_id AND t.candidate_id = cp.candidate_id""")
def _(spark, sf):
    """All pairs against a stored table of scores, which lacks every third case."""
    p, path = drivers.candidate_pairs(spark, sf), new_folder(spark)
    p.filter("case_id % 3 <> 0").select("case_id", "candidate_id", "score").write.parquet(path)
    return retrieval.looked_up(p.select("case_id", "candidate_id"), spark.read.parquet(path), ["case_id", "candidate_id"], "score")
