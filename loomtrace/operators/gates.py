"""Decisions over candidate sets and over stored model opinions.

A candidate set is never gathered: all facts a gate needs are aggregates with partial aggregation before the shuffle, and
the two best scores come from a window that Spark limits per group before the shuffle. A case with very many candidates
therefore reaches its task as a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions import language
from loomtrace.operators.evaluate import modal_opinions
from loomtrace.operators.ordered import top_rows

OVERRIDE_MARGIN = 0.15
FLOOR = 0.12


def top_two(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per case the best candidate and score, the second score and their margin (null when single)."""
    slim = pairs.select(*keys, "candidate_id", "score", "created", "lifecycle")
    best = top_rows(slim, keys, [F.desc("score"), F.col("created")], 2)
    first = F.col("rank") == 1
    return best.groupBy(*keys).agg(
        F.max(F.when(first, F.col("candidate_id"))).alias("top_candidate"),
        F.max(F.when(first, F.col("lifecycle"))).alias("top_lifecycle"),
        F.max(F.when(first, F.col("score"))).alias("top_score"),
        F.max(F.when(~first, F.col("score"))).alias("second_score"),
    ).withColumn("margin", F.col("top_score") - F.col("second_score"))


def set_facts(pairs: DataFrame, keys: list[str], linker: str = "linker_") -> DataFrame:
    """Per case everything the set gates look at, in one aggregation."""
    d, conf = F.col(f"{linker}decision"), F.col(f"{linker}confidence")
    best = lambda cond: F.max_by(
        F.struct("candidate_id", "score", conf.alias("confidence"), F.coalesce("other_person", F.lit(False)).alias("other_person")),
        F.when(cond, F.struct(conf, F.col("score"), -F.col("created"))))
    open_ = ~d.isin("attach", "branch", "new")
    plausible = F.col("score") >= FLOOR
    base = pairs if "other_person" in pairs.columns else pairs.withColumn("other_person", F.lit(False))
    if "anchor_relevant" not in base.columns:
        base = base.withColumn("anchor_relevant", F.lit(False))
    return base.groupBy(*keys).agg(
        F.count("*").alias("candidates"),
        F.count_if(d == "attach").alias("attaches"), F.count_if(d == "branch").alias("branches"),
        F.count_if(d == "new").alias("rejected"), F.count_if(open_).alias("unresolved_candidates"),
        F.max(F.when(open_, F.col("candidate_id"))).alias("some_unresolved"),
        F.min(conf).alias("min_confidence"),
        best((d == "attach") & F.col("strong_identity")).alias("best_strong"),
        best(d == "branch").alias("best_branch"), best(d == "attach").alias("best_attach"),
        F.count_if(plausible).alias("plausible"), F.count_if(plausible & (d == "new")).alias("plausible_rejected"),
        F.min(F.when(plausible, conf)).alias("plausible_confidence"),
        F.max("anchor_relevant").alias("structural_recall"),
        F.max_by("other_person", F.struct(F.col("score"), -F.col("created"))).alias("top_other_person"),
        F.max_by(F.struct(d.alias("linker"), F.col("anchor_relevant").alias("relevant")),
                 F.struct(F.col("score"), -F.col("created"))).alias("top_pair"),
    )


def resolve_set(f: DataFrame) -> DataFrame:
    """Candidate set as a whole: only an all-rejected set decides; a positive candidate goes on to the gate."""
    positive = (F.col("attaches") + F.col("branches")) > 0
    all_new = F.col("rejected") == F.col("candidates")
    return f.withColumns({
        "set_decision": F.when(positive, "uncertain").when(all_new, "new").otherwise("uncertain"),
        "set_confidence": F.when(~positive & all_new, F.col("min_confidence")).otherwise(0.50),
        "set_candidate": F.when(~positive & (F.col("unresolved_candidates") == 1), F.col("some_unresolved")),
    })


def candidate_gate(f: DataFrame) -> DataFrame:
    """Is it safe to choose one candidate over the others? Needs set facts and the two best scores."""
    weaker = lambda b: F.col(f"{b}.score") < F.col("top_score") - OVERRIDE_MARGIN
    strong, branch, attach = (F.col(c).isNotNull() for c in ("best_strong", "best_branch", "best_attach"))
    all_new = F.col("rejected") == F.col("candidates")
    b_weak, a_weak = weaker("best_branch"), weaker("best_attach")

    def pick(on_strong, on_branch, on_attach, on_new, on_abstain) -> Column:
        return (F.when(strong, on_strong).when(branch & ~b_weak, on_branch).when(branch, on_abstain)
                .when(attach & ~a_weak, on_attach).when(attach, on_abstain).when(all_new, on_new).otherwise(on_abstain))

    lit = F.lit
    return f.withColumns({
        "gate_decision": pick(lit("attach"), lit("branch"), lit("attach"), lit("new"), lit("uncertain")),
        "gate_candidate": pick(F.col("best_strong.candidate_id"), F.col("best_branch.candidate_id"),
                               F.col("best_attach.candidate_id"), lit(None).cast("string"), F.col("top_candidate")),
        "gate_confidence": pick(F.col("best_strong.confidence"), F.col("best_branch.confidence"),
                                F.col("best_attach.confidence"), F.col("min_confidence"), lit(0.50)),
        "gate_reason": (
            F.when(strong, "strong deterministic anchor overrides semantic ranking")
            .when(branch & ~b_weak, "branch survives the candidate comparison")
            .when(branch, "branch candidate is materially weaker than the best candidate")
            .when(attach & ~a_weak, "attach candidate remains plausible")
            .when(attach, "attach candidate is materially weaker than the best candidate")
            .when(all_new, "all candidates rejected").otherwise("unresolved competing evidence")),
    })


def reopen_gate(f: DataFrame, incoming_text: str = "incoming_text", min_score: float = 0.25,
                min_margin: float = 0.15) -> DataFrame:
    """Attach to a resolved best candidate on recurrence language, score and separation."""
    margin = F.coalesce(F.col("margin"), F.col("top_score"))
    signal = F.size(language.reopen_terms(F.col("top_lifecycle"), F.col(incoming_text))) > 0
    attach = signal & (F.col("top_score") >= min_score) & (margin >= min_margin)
    return f.withColumns({
        "reopen_decision": F.when(attach, "attach").otherwise("uncertain"),
        "reopen_confidence": F.when(attach, 0.92).otherwise(0.50),
        "reopen_reason": F.when(~signal, "no recurrence evidence on a resolved candidate")
        .when(F.col("top_score") < min_score, "candidate score is too weak")
        .when(margin < min_margin, "several candidates remain plausible").otherwise("recurrence of resolved work"),
    })


def no_match_gate(f: DataFrame) -> DataFrame:
    """New work when nothing is plausible, or when every plausible candidate was rejected."""
    remote = F.col("top_score") < FLOOR
    rejected = (F.col("plausible") > 0) & (F.col("plausible") == F.col("plausible_rejected"))
    return f.withColumns({
        "no_match_decision": F.when(remote | rejected, "new").otherwise("uncertain"),
        "no_match_confidence": F.when(remote, 0.90).when(rejected, F.col("plausible_confidence")).otherwise(0.50),
    })


def route_cases(pairs: DataFrame, keys: list[str], texts: DataFrame, runtime: bool) -> DataFrame:
    """Set, gate, reopen and no-match decisions of every case.

    ``pairs`` carries linker columns; ``texts`` one row per case with ``incoming_text``. With ``runtime`` the retrieval
    floor, clarification and the cross-person guard of live routing apply; without it the benchmark order.
    """
    facts = set_facts(pairs, keys).join(top_two(pairs, keys), keys).join(texts, keys)
    f = no_match_gate(reopen_gate(candidate_gate(resolve_set(facts))))
    positive = (F.col("attaches") + F.col("branches")) > 0
    none = F.lit(None).cast("string")
    action = F.when(F.col("set_decision") == "new", "new").when(positive, F.col("gate_decision")).otherwise("uncertain")
    chosen = F.when(F.col("set_decision") == "new", none).when(positive, F.col("gate_candidate")).otherwise(
        none if runtime else F.col("set_candidate"))
    conf = F.when(F.col("set_decision") == "new", F.col("set_confidence")).when(
        positive, F.col("gate_confidence")).otherwise(0.50)
    f = f.withColumns({"_a": action, "_c": chosen, "_f": conf})
    unsure = F.col("_a") == "uncertain"
    reopen = unsure & (F.col("reopen_decision") == "attach")
    no_match = unsure & ~reopen & (F.col("no_match_decision") == "new")
    out = f.withColumns({
        "decision": F.when(reopen, "attach").when(no_match, "new").otherwise(F.col("_a")),
        "chosen": F.when(reopen, F.col("top_candidate")).when(no_match, none).otherwise(F.col("_c")),
        "confidence": F.when(reopen, 0.92).when(no_match, F.col("no_match_confidence")).otherwise(F.col("_f")),
        "source": F.when(reopen, "reopen_gate").when(no_match, "no_match_gate").otherwise("local"),
    }).drop("_a", "_c", "_f")
    if not runtime:
        return out
    reopened = F.col("source") == "reopen_gate"
    floor = (F.col("top_score") < FLOOR) & ~F.col("structural_recall")
    abstain = F.col("decision") == "uncertain"
    other = (F.when(reopened, F.col("top_other_person"))
             .when(F.col("gate_decision") == "branch", F.col("best_branch.other_person"))
             .when(F.col("best_strong").isNotNull(), F.col("best_strong.other_person"))
             .otherwise(F.col("best_attach.other_person")))
    crossed = F.col("decision").isin("attach", "branch") & F.coalesce(other, F.lit(False))
    return out.withColumns({
        "decision": F.when(floor, "new").when(abstain | crossed, "clarify").otherwise(F.col("decision")),
        "chosen": F.when(floor, none).when(abstain, F.col("top_candidate")).otherwise(F.col("chosen")),
        "confidence": F.when(floor, 0.90).otherwise(F.col("confidence")),
        "source": F.when(floor, "candidate_retrieval").when(abstain, "user_clarification").when(
            crossed, "cross_person_structural_rescue").otherwise(F.col("source")),
    })


# ---- gates over stored model opinions -------------------------------------------------------------------------------

def pair_up(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per case with the opinions of the primary and the verifier, each over all its runs."""
    opinion = F.struct("action", "candidate_id", "confidence")
    of = lambda who: F.max(F.when(F.col("provider") == who, opinion)).alias(who)
    return modal_opinions(assessments, keys).groupBy(*keys).agg(of("primary"), of("verifier"))


def consensus(p: DataFrame, min_confidence: float = 0.80) -> DataFrame:
    """Both providers must agree on action and candidate, not abstain, and be confident."""
    a, b = F.col("primary"), F.col("verifier")
    same = (a["action"] == b["action"]) & a["candidate_id"].eqNullSafe(b["candidate_id"])
    low = F.least(a["confidence"], b["confidence"]) < min_confidence
    good = same & (a["action"] != "abstain") & ~low
    return p.filter(a.isNotNull() & b.isNotNull()).withColumns({
        "action": F.when(good, a["action"]).otherwise("clarify"),
        "candidate_id": F.when(good, a["candidate_id"]),
        "agreement": same,
        "reason": F.when(~same, "provider_disagreement").when(a["action"] == "abstain", "providers_abstain").when(
            low, "agreement_low_confidence").otherwise("high_confidence_provider_agreement"),
    })


def consensus_new(p: DataFrame, min_confidence: float = 0.80) -> DataFrame:
    """New work only when both providers say so with confidence."""
    a, b = F.col("primary"), F.col("verifier")
    sure = lambda x: (x["action"] == "new") & (x["confidence"] >= min_confidence)
    reason = (F.when(a.isNull(), "primary_unavailable").when(~sure(a), "primary_not_confident_new")
              .when(b.isNull(), "verifier_required").when(~sure(b), "provider_disagreement")
              .otherwise("independent_provider_consensus"))
    marked = p.withColumn("reason", reason)
    accepted = F.col("reason") == "independent_provider_consensus"
    return marked.withColumns({"accepted": accepted, "action": F.when(accepted, "new").otherwise("clarify")})


def recovery_eligibility(decision: Column, candidate_count: Column, anchor_relevant: Column, linker: Column) -> Column:
    """Reason code; only ``single_candidate_anchorless_uncertain`` is eligible."""
    return (F.when(decision != "clarify", "deterministic_not_clarify")
            .when(candidate_count != 1, "requires_exactly_one_candidate")
            .when(anchor_relevant, "structural_path_should_handle_anchor")
            .when(linker != "uncertain", "linker_not_uncertain").otherwise("single_candidate_anchorless_uncertain"))


def attach_recovery(p: DataFrame, candidate: str, min_confidence: float = 0.80) -> DataFrame:
    """Anchorless attach: primary and verifier must both attach to the one candidate with confidence."""
    a, b = F.col("primary"), F.col("verifier")
    hits = lambda x: (x["action"] == "attach") & x["candidate_id"].eqNullSafe(F.col(candidate))
    reason = (
        F.when(a.isNull(), "primary_unavailable").when(a["action"] == "abstain", "primary_abstained")
        .when(~hits(a), "primary_did_not_attach_candidate").when(a["confidence"] < min_confidence, "primary_low_confidence")
        .when(b.isNull(), "verifier_required")
        .when(~hits(b) | (b["confidence"] < min_confidence), "provider_disagreement")
        .otherwise("independent_provider_consensus"))
    marked = p.withColumn("reason", reason)
    accepted = F.col("reason") == "independent_provider_consensus"
    return marked.withColumns({
        "accepted": accepted, "action": F.when(accepted, "attach").otherwise("clarify"),
        "accepted_candidate": F.when(accepted, F.col(candidate))})


def cached_recovery(cases: DataFrame, cache: DataFrame, judged: DataFrame, key: str, min_confidence: float = 0.80) -> DataFrame:
    """Cached verdict by signature, else the judge's answer; unknown labels and low confidence become uncertain."""
    c = cache.select(key, F.struct("decision", "confidence").alias("_hit"))
    j = judged.select(key, F.struct("decision", "confidence").alias("_new"))
    rows = cases.join(c, key, "left").join(j, key, "left")
    label = F.lower(F.trim(F.col("_new.decision")))
    good = label.isin("attach", "branch", "new") & (F.col("_new.confidence") >= min_confidence)
    return rows.select(
        *cases.columns,
        F.when(F.col("_hit").isNotNull(), F.col("_hit.decision")).when(F.coalesce(good, F.lit(False)), label)
        .otherwise("uncertain").alias("decision"),
        F.coalesce("_hit.confidence", "_new.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_hit").isNotNull(), "cache").when(F.col("_new").isNotNull(), "judge").otherwise("none").alias("origin"))


def event_anchor_tokens(text: Column) -> Column:
    """Lower-cased tokens with a hyphen and a digit, brackets and end marks stripped."""
    plain = F.translate(F.lower(text), ",.", "  ")
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda t: t.contains("-") & F.regexp_like(t, F.lit(r"(?U)\d")))
    return F.sort_array(F.array_distinct(F.transform(words, lambda t: F.trim(t, F.lit("()[]{}:;!?")))))


def hybrid_gate(rows: DataFrame) -> DataFrame:
    """Gate of one opinion. Needs ``action, candidate_id, confidence``, ``candidate_known`` and ``exact_anchor``."""
    a, c = F.col("action"), F.col("confidence")
    known = F.coalesce(F.col("candidate_known"), F.lit(False))
    exact = F.coalesce(F.col("exact_anchor"), F.lit(False))
    reason = (
        F.when(a == "abstain", "model_abstained")
        .when(a == "new", F.when(c >= 0.80, "high_confidence_new").otherwise("low_confidence_new"))
        .when(~known, "candidate_missing")
        .when(a == "attach", F.when(exact & (c >= 0.75), "exact_anchor_support").otherwise("attach_lacks_structural_support"))
        .when(a == "branch", F.when(exact & (c >= 0.80), "branch_anchor_support").otherwise("branch_lacks_structural_support"))
        .otherwise("unsupported_action"))
    marked = rows.withColumn("gate_reason", reason)
    ok = F.col("gate_reason").isin("high_confidence_new", "exact_anchor_support", "branch_anchor_support")
    return marked.withColumns({
        "accepted_model": ok, "gated_action": F.when(ok, a).otherwise("clarify"),
        "gated_candidate": F.when(ok & (a != "new"), F.col("candidate_id"))})


def safety_gate(rows: DataFrame, min_confidence: float = 0.80, min_score: float = 0.20, min_margin: float = 0.12) -> DataFrame:
    """Gate of one opinion about a candidate, from anchor evidence, rank, goal, recurrence and separation.

    Needs ``opinion, opinion_confidence, candidate_id, score, second_score, is_top``, the anchor evidence columns, goals,
    ``lifecycle`` and ``incoming_text``.
    """
    d = F.lower(F.trim(F.col("opinion")))
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    goal = squeeze(F.col("candidate_goal"))
    exact_goal = (goal != "") & (goal == squeeze(F.col("incoming_goal")))
    margin = F.col("score") - F.coalesce("second_score", F.lit(0.0))
    reopen = F.size(language.reopen_terms(F.col("lifecycle"), F.col("incoming_text"))) > 0
    apart = (F.col("score") >= min_score) & (margin >= min_margin)
    no_scope = F.size("scope_matches") == 0
    known = F.coalesce(d.isin("attach", "branch", "new"), F.lit(False))
    reason = (
        F.when(~known | (F.col("opinion_confidence") < min_confidence), "insufficient")
        .when(F.col("hard_new") & (d == "new"), "new_agrees_with_boundary").when(F.col("hard_new"), "conflicts_with_boundary")
        .when(F.col("strong_attach") & (d == "attach"), "confirmed_by_strong_anchor")
        .when(F.col("strong_attach") & (d == "new"), "conflicts_with_strong_anchor")
        .when((d == "attach") & ~F.col("is_top"), "not_top_candidate")
        .when((d == "attach") & exact_goal, "exact_goal")
        .when((d == "attach") & reopen & apart, "separated_recurrence")
        .when((d == "attach") & apart & no_scope, "separated_top_candidate")
        .when(d == "attach", "attach_lacks_evidence")
        .when((d == "branch") & F.col("is_top") & (F.col("score") >= min_score), "plausible_branch_parent")
        .when(d == "branch", "branch_parent_implausible").otherwise("no_contradicting_anchor"))
    marked = rows.withColumn("safety_reason", reason)
    ok = F.col("safety_reason").isin(
        "new_agrees_with_boundary", "confirmed_by_strong_anchor", "exact_goal", "separated_recurrence",
        "separated_top_candidate", "plausible_branch_parent", "no_contradicting_anchor")
    return marked.withColumns({
        "safe_accepted": ok, "safe_decision": F.when(ok, d).otherwise("uncertain"),
        "safe_candidate": F.when(~(ok & (d == "new")), F.col("candidate_id"))})


def apply_mode(decisions: DataFrame, mode: str = "routing_mode") -> DataFrame:
    """``clarify_only`` turns a routing decision into a proposal to confirm; other modes pass it on."""
    hold = (F.col(mode) == "clarify_only") & F.col("decision").isin("new", "attach", "branch")
    return decisions.withColumns({
        "proposed_decision": F.when(hold, F.col("decision")),
        "requires_confirmation": hold,
        "decision": F.when(hold, "clarify").otherwise(F.col("decision"))})


def word_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of the distinct lower-case words of two texts; 0 where one side has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    common = F.size(F.array_intersect(words(left), words(right)))
    whole = F.size(words(left)) + F.size(words(right)) - common
    return F.when((F.size(words(left)) > 0) & (F.size(words(right)) > 0), common / whole).otherwise(F.lit(0.0))
