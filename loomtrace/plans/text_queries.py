"""Scalar text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import anchors, canonical, language, text
from loomtrace.operators import rollups, signals
from loomtrace.plans.oracle import BASE, ORG, TRACE
from loomtrace.plans.registry import Section
from loomtrace.sources import drivers

SECTION = Section()

_W = r"[^\p{L}\p{N}_]"
_MAIL = r"(?i)(^|[^\p{L}\p{N}_])[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_PHONE = rf"(^|{_W})(?:\+?1[-.\s]?)?(?:\(?[0-9]{{3}}\)?[-.\s]?)[0-9]{{3}}[-.\s]?[0-9]{{4}}($|{_W})"


@SECTION.add("b10_redaction", rf"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b',
    '[REDACTED_EMAIL]', 'g') AS m FROM documents),
  p AS (SELECT *, regexp_replace(regexp_replace(m, '{_PHONE}', '\1[REDACTED_PHONE]\2', 'g'), '{_PHONE}',
    '\1[REDACTED_PHONE]\2', 'g') AS t FROM a),
  i AS (SELECT *, regexp_replace(t, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '[REDACTED_IP]', 'g') AS r FROM p)
  SELECT doc_id, sha256(r) AS redacted_sha, r <> text AS redacted, concat_ws('|', CASE WHEN m <> text THEN 'email' END,
    CASE WHEN r <> t THEN 'ip' END, CASE WHEN t <> m THEN 'phone' END) AS categories FROM i""")
def _(spark, sf):
    r = text.redact(F.col("text"))
    return drivers.table(spark, sf, "documents").select(
        "doc_id", r["text"].alias("t"), r["redacted"].alias("redacted"),
        F.array_join(r["categories"], "|").alias("categories")).select(
        "doc_id", F.sha2("t", 256).alias("redacted_sha"), "redacted", "categories")


@SECTION.add("b11_unique_ignoring_case", r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS part,
    generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
  c AS (SELECT conv_id, turn, i, trim(regexp_replace(part, '\s+', ' ', 'g')) AS part FROM s),
  f AS (SELECT conv_id, turn, min(i) AS i, lower(part) AS lp FROM c WHERE part <> '' GROUP BY conv_id, turn, lower(part))
  SELECT conv_id, turn, count(*) AS parts, sha256(string_agg(c.part, '|' ORDER BY f.i)) AS sha
  FROM f JOIN c USING (conv_id, turn, i) GROUP BY 1, 2""")
def _(spark, sf):
    d = drivers.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.unique_ignoring_case(F.split("text", " ")).alias("u"))
    return d.filter(F.size("u") > 0).select(
        "conv_id", "turn", F.size("u").cast("long").alias("parts"), F.sha2(F.array_join("u", "|"), 256).alias("sha"))


@SECTION.add("b12_work_state_extraction", rf"""WITH {ORG}, c AS (SELECT event_id, trim(regexp_replace(text, '\s+', ' ', 'g'))
    AS problem FROM oe) SELECT event_id, problem, array_to_string(list_slice(regexp_extract_all(problem, '[A-Za-z0-9_#.-]+'),
    1, 12), ' ') AS goal FROM c""")
def _(spark, sf):
    return drivers.org_events(spark, sf).select(
        "event_id", text.collapse(F.col("text")).alias("problem"), text.work_goal(F.col("text"), F.col("goal")).alias("goal"))


def _in(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_HITS = ", ".join(f"len(list_intersect(list_distinct(tok), {_in(ws)})) AS {n}" for n, ws in text.INTENT_WORDS.items())
_FIRST = "list_transform(list_filter(list_transform(range(1, len({0}) + 1), lambda i: struct_pack(i := i, v := {0}[i])), lambda s: s.i = list_position({0}, s.v)), lambda s: s.v)"


@SECTION.add("b13_router_goal", rf"""WITH {TRACE}, c AS (SELECT event_id, text || CASE seq % 4 WHEN 0 THEN ' please Debug the failing test'
      WHEN 1 THEN ' compare schools and programs' WHEN 2 THEN ' evaluate the benchmark score' ELSE '' END AS text
    FROM te WHERE text <> ''),
  t AS (SELECT event_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS summary,
    regexp_extract_all(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[A-Za-z0-9_.-]+') AS tok FROM c),
  h AS (SELECT *, {_HITS}, list_filter(tok, lambda x: length(x) >= 5 AND x NOT IN ('should', 'still', 'does')) AS ent FROM t)
  SELECT event_id, summary, CASE WHEN greatest(debug, research, evaluate) = 0 THEN 'general'
    WHEN debug = greatest(debug, research, evaluate) THEN 'debug'
    WHEN research = greatest(debug, research, evaluate) THEN 'research' ELSE 'evaluate' END AS intent,
    array_to_string(list_slice({_FIRST.format('ent')}, 1, 12), '|') AS entities FROM h""")
def _(spark, sf):
    extra = F.element_at(F.array(*[F.lit(x) for x in (
        " please Debug the failing test", " compare schools and programs", " evaluate the benchmark score", "")]),
        (F.col("seq") % 4 + 1).cast("int"))
    e = drivers.trace_events(spark, sf).filter("text <> ''").select("event_id", F.concat("text", extra).alias("text"))
    g = text.router_goal(F.col("text"))
    return e.select("event_id", g["summary"].alias("summary"), g["intent"].alias("intent"),
                    F.array_join(g["entities"], "|").alias("entities"))


@SECTION.add("b13b_local_goal", rf"""WITH {TRACE}, t AS (SELECT event_id, text AS clean, lower(text) AS low,
    list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_.-]+'),
      lambda x: length(x) >= 5 AND x NOT IN ('should', 'about', 'after')) AS ent FROM te WHERE text <> ''),
  g AS (SELECT *, CASE WHEN low LIKE '%deploy%' OR low LIKE '%production%' OR low LIKE '%container%' OR
      low LIKE '%environment variable%' OR low LIKE '%startup%' THEN 1 WHEN low LIKE '%robotics%' THEN 2
      WHEN low LIKE '%benchmark%' OR low LIKE '%evaluation%' OR low LIKE '%trajectory%' THEN 3 ELSE 0 END AS r,
    array_to_string(list_slice({_FIRST.format('ent')}, 1, 10), ' ') AS entities FROM t),
  f AS (SELECT event_id, ['general', 'software deployment', 'graduate education', 'AI evaluation'][r + 1] AS domain,
    CASE r WHEN 0 THEN substr(clean, 1, 160) WHEN 1 THEN 'restore production service'
      WHEN 2 THEN 'find suitable robotics graduate program' ELSE 'evaluate trajectory understanding' END AS goal,
    ['other', 'debug', 'research', 'evaluate'][r + 1] AS intent, substr(clean, 1, 160) AS issue, entities FROM g)
  SELECT event_id, domain, goal, intent, issue, entities,
    concat_ws(' ', domain, trim(goal), intent, trim(issue), 'unknown', nullif(entities, '')) AS routing_text FROM f""")
def _(spark, sf):
    e = drivers.trace_events(spark, sf).filter("text <> ''")
    g = text.local_goal(F.col("text"))
    return e.select("event_id", *[g[n].alias(n) for n in ("domain", "goal", "intent", "issue")],
                    F.array_join(g["entities"], " ").alias("entities"), text.routing_text(g).alias("routing_text"))


# the texts of org events carry known anchors per template, so the oracle states them directly
_ANCHORS = """CASE k % 8
    WHEN 0 THEN concat_ws('|', 'customer:acme' || (k % 3), 'ticket:OPS-' || (uid * 10 + k % 4))
    WHEN 1 THEN 'ticket:OPS-' || (uid * 10 + k % 4)
    WHEN 2 THEN concat_ws('|', 'file:src/app' || (k % 5) || '.py', 'pr:' || k)
    WHEN 3 THEN 'project:atlas' || (k % 2)
    WHEN 4 THEN ''
    WHEN 5 THEN concat_ws('|', 'env_var:DB_HOST_' || (k % 4), 'incident:' || k,
      'trace_id:123e4567-e89b-12d3-a456-4266141740' || lpad(CAST(k AS VARCHAR), 2, '0'))
    WHEN 6 THEN 'repo:service-' || (k % 6)
    ELSE concat_ws('|', 'git_sha:deadbee' || k, 'tenant:north' || (k % 2), 'url:https://wiki.example.org/p/' || k) END"""


@SECTION.add("b14_anchor_extraction", f"WITH {ORG} SELECT event_id, {_ANCHORS} AS anchors FROM oe")
def _(spark, sf):
    found = anchors.anchors_of(F.col("text"))
    return drivers.org_events(spark, sf).select("event_id", F.array_join(F.transform(
        found, lambda a: F.concat(a["type"], F.lit(":"), a["value"])), "|").alias("anchors"))


@SECTION.add("b14_page_anchor_counts", r"""WITH p AS (SELECT page_id, url || ' ' || html AS text FROM pages),
  u AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>"]+'),
    lambda v: 'url:' || lower(v)))) AS a FROM p
  UNION ALL SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b'),
    lambda v: 'env_var:' || v))) FROM p)
  SELECT split_part(a, ':', 1) AS type, count(*) AS anchors FROM u GROUP BY 1""")
def _(spark, sf):
    p = drivers.table(spark, sf, "pages").select(F.explode_outer(anchors.anchors_of(F.concat_ws(" ", "url", "html"))).alias("a"))
    return p.filter("a.type in ('env_var', 'url')").groupBy(F.col("a.type").alias("type")).agg(F.count("*").alias("anchors"))


def _like(patterns):
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN regexp_matches(low, '{p.replace(chr(39), chr(39) * 2)}') THEN '{p.replace(chr(39), chr(39) * 2)}' END"
        for p in patterns) + ")"


def _pairs(spark, sf):
    """Neighbouring messages of a person as (candidate, new) text pairs."""
    from pyspark.sql import Window
    w = Window.partitionBy("organization_id", "external_user_id", F.floor(F.col("ingest_seq") / 5000)).orderBy("ingest_seq")
    return drivers.org_events(spark, sf).select(
        "event_id", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("candidate_text"))


_PAIRS = f"""{ORG}, pr AS (SELECT event_id, text, coalesce(lag(text) OVER (PARTITION BY organization_id, external_user_id,
    ingest_seq // 5000 ORDER BY ingest_seq), '') AS candidate_text FROM oe)"""
_ID = {n: p.replace("'", "''") for n, p in language.IDENTITY.items()}


def _first(column, name):
    return f"nullif(lower(regexp_extract({column}, '{_ID[name]}', 1)), '')"


_SAME = ", ".join(f"CASE WHEN c_{n} = n_{n} THEN 'same {n}: ' || c_{n} END" for n in _ID)
_DIFF = ", ".join(f"CASE WHEN c_{n} <> n_{n} THEN 'different {n}: ' || c_{n} || ' vs ' || n_{n} END" for n in _ID)
_FIRSTS = ", ".join(f"{_first('candidate_text', n)} AS c_{n}, {_first('text', n)} AS n_{n}" for n in _ID)


@SECTION.add("b15_linkage_language", f"""WITH {_PAIRS}, f AS (SELECT event_id, lower(text) AS low, {_FIRSTS} FROM pr)
  SELECT event_id, {_like(language.CONTINUATION)} AS continuation, {_like(language.BRANCH)} AS branch,
    concat_ws('|', {_SAME}) AS positive, concat_ws('|', {_DIFF}) AS contradictions FROM f""")
def _(spark, sf):
    m = language.identity_matches(F.col("candidate_text"), F.col("text"))
    join = lambda c, n: F.array_join(c, "|").alias(n)
    return _pairs(spark, sf).select(
        "event_id", join(language.continuation_signals(F.col("text")), "continuation"),
        join(language.branch_signals(F.col("text")), "branch"), join(m["positive"], "positive"),
        join(m["contradictions"], "contradictions"))


@SECTION.add("b16_reopen_evidence", f"""WITH {ORG}, f AS (SELECT event_id, lower(text) AS low, k % 3 = 0 AS resolved FROM oe)
  SELECT event_id, CASE WHEN resolved THEN {_like(language.REOPEN)} ELSE '' END AS terms,
    resolved AND {_like(language.REOPEN)} <> '' AS reopen_signal FROM f""")
def _(spark, sf):
    terms = language.reopen_terms(F.when(F.col("k") % 3 == 0, "resolved").otherwise("active"), F.col("text"))
    return drivers.org_events(spark, sf).select("event_id", F.array_join(terms, "|").alias("terms"),
                                                (F.size(terms) > 0).alias("reopen_signal"))


@SECTION.add("b17_label_answers", f"""WITH {BASE} SELECT event_id, CASE k % 5 WHEN 0 THEN 'repair' WHEN 1 THEN 'refine'
    WHEN 2 THEN 'clarify' WHEN 3 THEN NULL ELSE 'new_topic' END AS label FROM b""")
def _(spark, sf):
    answers = F.element_at(F.array(*[F.lit(a) for a in (
        'Label: "repair".', " refine ", "`clarify`", "no idea", "NEW_TOPIC.")]), (F.col("k") % 5 + 1).cast("int"))
    return drivers.events_with_k(spark, sf).select("event_id", text.normalize_label(answers).alias("label"))


@SECTION.add("b17_goal_answers", f"""WITH {BASE} SELECT event_id, CASE WHEN k % 4 <> 3 THEN 'd' || (k % 6) END AS domain,
    CASE WHEN k % 4 <> 3 THEN 'e1|e' || k END AS entities, k % 4 <> 3 AS valid FROM b""")
def _(spark, sf):
    k = F.col("k").cast("string")
    body = F.concat(F.lit('{"domain": "d'), (F.col("k") % 6).cast("string"), F.lit('", "entities": ["e1", "e'), k, F.lit('"]}'))
    answer = (F.when(F.col("k") % 4 == 3, F.lit("not json")).when(
        F.col("k") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body))
    parsed = drivers.events_with_k(spark, sf).select("event_id", text.parse_goal_answer(answer).alias("g"))
    return parsed.select("event_id", "g.domain", F.array_join("g.entities", "|").alias("entities"),
                         F.col("g.domain").isNotNull().alias("valid"))


@SECTION.add("b18_signal_maturity", """WITH m AS (SELECT l_orderkey AS event_id, ['L0', 'L1', 'L2', 'L3'][l_partkey % 4 + 1]
    AS maturity FROM lineitem) SELECT event_id, count(*) AS signals,
    count(*) FILTER (maturity <> 'L2') AS policy_eligible, CASE WHEN bool_or(maturity = 'L2') THEN 'L2'
      WHEN bool_or(maturity = 'L1') THEN 'L1' WHEN bool_or(maturity = 'L0') THEN 'L0' ELSE 'L3' END AS weakest
  FROM m GROUP BY 1""")
def _(spark, sf):
    from loomtrace.operators.audit import policy_eligible, weakest_maturity
    m = drivers.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.element_at(
        F.array(*[F.lit(x) for x in ("L0", "L1", "L2", "L3")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("maturity"))
    return m.groupBy("event_id").agg(
        F.count("*").alias("signals"), F.count_if(policy_eligible(F.col("maturity"))).alias("policy_eligible"),
        weakest_maturity(F.col("maturity")).alias("weakest"))


@SECTION.add("b20_model_signals", """WITH s AS (SELECT l_orderkey AS event_id, l_linenumber AS line,
    ['resistance', 'progress', 'unknown', 'repair'][l_suppkey % 4 + 1] AS name, l_quantity / 40.0 AS v FROM lineitem)
  SELECT event_id, line, name AS signal, round(v, 6) AS value, 'L2' AS maturity FROM s
  WHERE name <> 'unknown' AND v BETWEEN 0 AND 1""")
def _(spark, sf):
    from loomtrace.operators.audit import model_signals
    name = F.element_at(F.array(*[F.lit(x) for x in ("resistance", "progress", "unknown", "repair")]),
                        (F.col("l_suppkey") % 4 + 1).cast("int"))
    answers = drivers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"),
        F.to_json(F.struct(F.array(F.struct(name.alias("name"), (F.col("l_quantity") / 40.0).alias("value"))).alias("signals")))
        .alias("answer"))
    return model_signals(answers, "answer").select("event_id", "line", "signal", F.round("value", 6).alias("value"), "maturity")


@SECTION.add("b22_event_lines", f"""WITH {ORG} SELECT event_id, '[' || upper(surface) || '] HUMAN(' || external_user_id ||
    ') -> AGENT(bot_' || (k % 3) || '): ' || text AS line FROM oe""")
def _(spark, sf):
    return drivers.org_events(spark, sf).select("event_id", text.event_line(
        F.col("surface"), F.lit("human"), F.col("external_user_id"), F.lit("agent"),
        F.concat(F.lit("bot_"), (F.col("k") % 3).cast("string")), F.col("text")).alias("line"))


@SECTION.add("b22_model_input", f"""WITH c AS (SELECT *, upper(role) || ': ' || text AS line FROM conversations),
  l AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1)
  SELECT conv_id, sha256(right(coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (turn < last_turn), ''), 6000))
      AS history_sha, left(max(line) FILTER (turn = last_turn), 3000) AS current_line
  FROM c JOIN l USING (conv_id) GROUP BY 1""")
def _(spark, sf):
    from loomtrace.operators.corpus import model_inputs
    c = drivers.table(spark, sf, "conversations").withColumn(
        "line", F.concat(F.upper("role"), F.lit(": "), F.col("text")))
    return model_inputs(c, "conv_id", "turn", "line", 6000, 3000).select(
        "conv_id", F.sha2("history", 256).alias("history_sha"), F.col("current").alias("current_line"))


@SECTION.add("b23_retrieval_text", f"""WITH {ORG} SELECT event_id, 'goal ' || (k % 4) || ' ' || trim(text) ||
    CASE WHEN k % 2 = 0 THEN ' e' || k ELSE '' END || ' art' AS retrieval_text,
    'goal ' || (k % 4) || ' ' || text || CASE WHEN k % 2 = 0 THEN ' e' || k ELSE '' END || ' art' AS work_text FROM oe""")
def _(spark, sf):
    k = F.col("k").cast("string")
    goal = F.concat(F.lit("goal "), (F.col("k") % 4).cast("string"))
    ents = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("e"), k))).otherwise(F.array(F.lit("")))
    arts = F.array(F.lit("art"))
    return drivers.org_events(spark, sf).select(
        "event_id", text.join_values(F.array(goal, F.col("text"), F.lit("")), ents, arts).alias("retrieval_text"),
        text.work_text(goal, F.col("text"), ents, arts).alias("work_text"))
