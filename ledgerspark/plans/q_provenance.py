"""Queries of provenance, tool log and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import provenance as P
from ..vocab import HIGH_VALUE
from .q_cells import ALTERNATIVES, CELLS
from ..sources.scratch import scratch_path
from ..sources.stored import merge_stored, read_stored
from .registry import query

HV = ", ".join(f"('{f}')" for f in HIGH_VALUE)


@query("prv01_field_grid", "v_ledger", sql=f"SELECT entity_id, field_name FROM v_ledger UNION SELECT entity_id, f FROM v_ledger CROSS JOIN (VALUES {HV}) AS h(f)")
def prv01(ledger):
    return P.field_grid(ledger)


NARR = " ".join(f"WHEN extraction_method = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in P.NARRATIVES.items())


@query("prv02_method_summary", "v_ledger", sql=f"""
SELECT claim_id, CASE WHEN extraction_method LIKE 'projected%' THEN 'Researched in Layer 1 as question ' || substring(extraction_method, 11) || ' and projected onto this field.' {NARR} WHEN extraction_method IS NULL THEN 'None via ' || source_class ELSE extraction_method || ' via ' || source_class END AS summary FROM v_ledger""")
def prv02(ledger):
    return ledger.select("claim_id", P.method_summary(F.col("extraction_method"), F.col("source_class")).alias("summary"))


@query("prv03_checks_for_cell", "v_ledger", sql=f"""
WITH {CELLS}, x AS (SELECT seq AS finding_id, entity_id, CASE WHEN seq % 2 = 0 THEN field_name END AS field, claim_id FROM v_ledger WHERE seq % 3 = 0)
SELECT c.entity_id, c.field_name, finding_id FROM c JOIN x ON c.entity_id = x.entity_id AND c.field_name = x.field UNION SELECT c.entity_id, c.field_name, finding_id FROM c JOIN x ON c.winner_id = x.claim_id""")
def prv03(ledger):
    f = ledger.filter("seq % 3 = 0").select(F.col("seq").alias("finding_id"), "entity_id", F.when(F.col("seq") % 2 == 0, F.col("field_name")).alias("field"), "claim_id")
    return P.checks_for_cell(f, C.resolve_cells(ledger))


# the tools of the fixture are its event types
FIXTURE_TOOLS = [("jsonld", "view"), ("snov_error", "click"), ("snov_error", "signup"), ("derived_13f", "purchase")]


@query("prv04_match_tool_calls", "v_ledger", "v_run", sql="""
WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, seq DESC) AS n FROM v_ledger) WHERE n = 1),
k AS (SELECT *, 'https://site' || CAST(seq % 13 AS STRING) || '.example.com/q' AS result_url FROM v_run), t(extraction_method, tool) AS (VALUES ('jsonld', 'view'), ('snov_error', 'click'), ('snov_error', 'signup'), ('derived_13f', 'purchase')),
m AS (SELECT w.entity_id, w.field_name, k.seq, called_at, CASE WHEN split_part(w.source_url, '/', 3) = split_part(result_url, '/', 3) THEN 'url' ELSE 'method' END AS matched_by FROM w JOIN k ON w.entity_id = k.entity_id
 WHERE split_part(w.source_url, '/', 3) = split_part(result_url, '/', 3) OR EXISTS (SELECT 1 FROM t WHERE t.extraction_method = w.extraction_method AND t.tool = k.tool))
SELECT entity_id, field_name, seq, matched_by FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY called_at DESC, seq DESC) AS place FROM m) WHERE place <= 5""")
def prv04(ledger, runs):
    w = P.latest(ledger, ["entity_id", "field_name"])
    calls = runs.withColumn("result_url", F.concat(F.lit("https://site"), (F.col("seq") % 13).cast("string"), F.lit(".example.com/q")))
    tools = ledger.sparkSession.createDataFrame(FIXTURE_TOOLS, "extraction_method string, tool string")
    return P.match_tool_calls(w.select("entity_id", "field_name", "source_url", "extraction_method"), calls, tools, cap=5)


#: Blank cells: with and without a claim, a call of their own and calls of the lead, and what the release rule took from some of them.
BLANKS = "SELECT entity_id, claim_id AS field_name, CASE WHEN seq % 5 > 0 THEN status END AS status, CASE WHEN seq % 5 > 0 THEN extraction_method END AS extraction_method, CASE WHEN seq % 5 > 0 THEN source_class END AS source_class, CASE WHEN seq % 4 > 0 THEN source_url ELSE '' END AS source_url, seq % 3 = 0 AS has_claim, seq % 7 = 0 AS has_call, seq % 4 AS calls FROM v_ledger WHERE answer IS NULL"
AUDITED = "SELECT seq, entity_id, claim_id AS field_name, CASE WHEN seq % 9 > 0 THEN 'v' || CAST(seq AS STRING) END AS rejected_value, 'V' || CAST(seq % 6 AS STRING) AS reason_code FROM v_ledger WHERE seq % 2 = 0 UNION ALL SELECT seq - 1, entity_id, claim_id, 'older', 'V0' FROM v_ledger WHERE seq % 6 = 0"


@query("prv05_blank_reason", "v_ledger", sql=f"""
WITH b AS ({BLANKS}), a AS (SELECT * FROM ({AUDITED}) QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY seq DESC) = 1),
x AS (SELECT b.*, a.rejected_value AS rv, a.reason_code AS rc, a.entity_id IS NOT NULL AS audited, CASE WHEN status = 'removed_failed_validation' THEN 1 WHEN source_class = 'tool_unavailable' OR coalesce(ends_with(extraction_method, '_error'), false) THEN 2 WHEN has_claim OR has_call THEN 3 WHEN calls > 0 THEN 4 ELSE 5 END AS rule FROM b LEFT JOIN a ON a.entity_id = b.entity_id AND a.field_name = b.field_name)
SELECT entity_id, field_name, CASE rule WHEN 1 THEN 'removed_failed_validation' WHEN 2 THEN 'tool_unavailable' WHEN 5 THEN 'never_attempted' ELSE 'searched_not_found' END AS code,
 CASE rule WHEN 1 THEN CASE WHEN audited THEN 'The value ' || chr(39) || coalesce(rv, 'None') || chr(39) || ' was found but blanked by the release rule (' || rc || ').' ELSE 'The value was found but blanked by the release rule.' END WHEN 2 THEN 'The tool that would have found this value was unavailable (' || coalesce(nullif(source_url, ''), nullif(extraction_method, ''), source_class, '') || ').'
 WHEN 3 THEN 'A search or lookup ran but found no usable value for this field.' WHEN 4 THEN CAST(calls AS STRING) || ' tool call(s) ran for this lead in this run, none of them attributable to this field.' ELSE 'No claim or tool call for this field exists — it was never attempted.' END AS detail, CASE WHEN rule = 1 THEN rv END AS rejected_value, CASE WHEN rule = 1 THEN rc END AS reason_code FROM x""")
def prv05(ledger):
    of = lambda text: ledger.sparkSession.sql(text.replace("v_ledger", "{v}"), v=ledger)
    return P.blank_reason(of(BLANKS), of(AUDITED))


@query("prv06_field_records", "v_ledger", sql=f"""
WITH {CELLS}, {ALTERNATIVES}, g AS (SELECT entity_id, field_name FROM v_ledger WHERE field_name IS NOT NULL UNION SELECT entity_id, f FROM v_ledger CROSS JOIN (VALUES {HV}) AS h(f)),
l AS (SELECT entity_id, field_name, string_agg(claim_id || '=' || why_not_used, ';' ORDER BY claim_id, why_not_used) AS others FROM alternatives GROUP BY 1, 2)
SELECT g.entity_id, g.field_name, value, status, source_class, producer_id, others FROM g LEFT JOIN c ON c.entity_id = g.entity_id AND c.field_name = g.field_name LEFT JOIN l ON l.entity_id = g.entity_id AND l.field_name = g.field_name""")
def prv06(ledger):
    r = P.field_records(P.field_grid(ledger), C.resolve_cells(ledger), C.alternatives(ledger)).select("entity_id", "field_name", "record.*")
    return r.withColumn("others", F.array_join(F.transform("alternatives", lambda x: F.concat_ws("=", x["claim_id"], x["why_not_used"])), ";")).drop("alternatives")


@query("prv07_run_summary", "v_ledger", sql=f"WITH {CELLS} SELECT entity_id, count(*) AS fields, count(value) AS shipped, count(*) - count(value) AS blank FROM c GROUP BY entity_id")
def prv07(ledger):
    return P.run_summary(C.resolve_cells(ledger))


@query("prv08_newest_run_for_lead", "v_run", sql="SELECT entity_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY called_at DESC, seq DESC) AS n FROM v_run) WHERE n = 1")
def prv08(runs):
    return P.newest_run_for_lead(runs)


@query("prv09_run_entities", "v_run", sql="""
SELECT run_id, entity_id FROM v_run WHERE state <> 'skipped' UNION SELECT run_id, entity_id FROM v_run WHERE ok UNION SELECT DISTINCT run_id, -1 FROM v_run WHERE run_id NOT IN (SELECT run_id FROM v_run WHERE state = 'failed')""")
def prv09(runs):
    missing = P.runs_missing_log(runs, runs.filter("state = 'failed'")).withColumn("entity_id", F.lit(-1).cast(runs.schema["entity_id"].dataType))
    return P.run_entities(runs.filter("state <> 'skipped'"), runs.filter("ok")).unionByName(missing)


@query("prv10_runs_list", "v_run", sql="""
WITH r AS (SELECT run_id, min(called_at) AS started_at FROM v_run GROUP BY run_id), l AS (SELECT run_id, count(DISTINCT entity_id) AS leads FROM v_run WHERE state <> 'skipped' GROUP BY run_id)
SELECT run_id, coalesce(leads, 0) AS leads FROM r LEFT JOIN l USING (run_id) ORDER BY started_at DESC, run_id LIMIT 20""")
def prv10(runs):
    r = runs.groupBy("run_id").agg(F.min("called_at").alias("started_at"))
    return P.runs_list(r, runs.filter("state <> 'skipped'"), 20).select("run_id", "leads")


@query("prv11_upsert_provenance", "v_ledger", sql="""
WITH x AS (SELECT seq, 'r' || CAST(seq % 5 AS STRING) AS run_id, entity_id, field_name, answer, CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS d FROM v_ledger)
SELECT run_id, entity_id, field_name, answer, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, entity_id, field_name ORDER BY d DESC, seq DESC) AS n FROM x) WHERE n = 1""")
def prv11(ledger):
    x = ledger.select("seq", F.concat(F.lit("r"), (F.col("seq") % 5).cast("string")).alias("run_id"), "entity_id", "field_name", "answer")
    path = scratch_path(ledger.sparkSession, "provenance")
    for part in (x.filter("seq % 4 <> 0"), x.filter("seq % 4 = 0")):
        merge_stored(path, part.filter("field_name IS NOT NULL"), ["run_id", "entity_id", "field_name"], P.upsert_provenance, buckets=16)
    return read_stored(ledger.sparkSession, path)


@query("prv12_run_status_view", "v_run", sql="""
WITH e AS (SELECT DISTINCT run_id, entity_id FROM v_run), c AS (SELECT entity_id, arg_max(state, seq) AS s, arg_max(duration_ms, seq) / 1000.0 AS cost FROM v_run WHERE tool <> 'view' GROUP BY 1), d AS (SELECT entity_id, arg_max(tool, seq) AS v, 'r' || CAST(max(seq) AS STRING) AS why FROM v_run WHERE tool = 'purchase' AND ok GROUP BY 1), r AS (SELECT entity_id, arg_max(state, seq) AS code FROM v_run WHERE NOT ok GROUP BY 1),
x AS (SELECT e.run_id, e.entity_id, coalesce(s, 'queued') AS status, CASE WHEN d.v IS NOT NULL THEN d.v WHEN r.code IS NOT NULL THEN 'reject' END AS verdict, CASE WHEN d.v IS NOT NULL THEN why ELSE code END AS reason, CAST(coalesce(cost, 0) AS DOUBLE) AS cost_usd FROM e LEFT JOIN c USING (entity_id) LEFT JOIN d USING (entity_id) LEFT JOIN r USING (entity_id))
SELECT *, round(sum(cost_usd) OVER (PARTITION BY run_id), 3) AS total_cost_usd FROM x""")
def prv12(runs):
    checkpoints = runs.filter("tool <> 'view'").select("entity_id", "state", (F.col("duration_ms") / 1000.0).alias("cost_usd"), "seq")
    decisions = runs.filter("tool = 'purchase' AND ok").select("entity_id", F.col("tool").alias("verdict"), F.concat(F.lit("r"), F.col("seq").cast("string")).alias("rationale"), "seq")
    rejected = runs.filter("NOT ok").select("entity_id", F.col("state").alias("reason_code"), "seq")
    return P.run_status_view(runs.select("run_id", "entity_id").distinct(), checkpoints, decisions, rejected).withColumn("total_cost_usd", F.round("total_cost_usd", 3))


@query("tool01_redact_args", "v_ledger", sql="SELECT claim_id, 2 AS kept, coalesce(answer, '') AS q, length(substring(repeat('x', CAST(100 + seq % 200 AS BIGINT)), 1, 200)) AS n FROM v_ledger")
def tool01(ledger):
    args = F.create_map(F.lit("q"), F.coalesce("answer", F.lit("")), F.lit("api_KEY"), F.lit("s"), F.lit("AuthHeader"), F.lit("s"), F.lit("body"), F.expr("repeat('x', CAST(100 + seq % 200 AS INT))"))
    r = P.redact_args(args)
    return ledger.select("claim_id", r.alias("r")).select("claim_id", F.size("r").alias("kept"), F.col("r")["q"].alias("q"), F.length(F.col("r")["body"]).alias("n"))


RESULT = "CASE seq % 5 WHEN 0 THEN '{\"results\": [1, 2, 3]}' WHEN 1 THEN '{\"content\": \"hello\"}' WHEN 2 THEN '{}' WHEN 3 THEN '{\"x\": 1}' END"


@query("tool02_summarize_result", "v_ledger", sql="SELECT claim_id, CASE WHEN seq % 11 = 0 THEN 'error: timeout' ELSE CASE seq % 5 WHEN 0 THEN '3 results' WHEN 1 THEN '5 chars' WHEN 2 THEN 'empty' WHEN 3 THEN 'ok' ELSE 'empty' END END AS summary FROM v_ledger")
def tool02(ledger):
    return ledger.select("claim_id", P.summarize_result(F.expr(RESULT), F.when(F.col("seq") % 11 == 0, "timeout")).alias("summary"))


@query("tool03_cache_lookup", "v_ledger", sql="""
WITH k AS (SELECT claim_id, seq, sha256('{"f":"' || field_name || '","q":"' || source_class || '"}') AS key FROM v_ledger), g AS (SELECT DISTINCT key FROM k WHERE seq % 50 = 0)
SELECT claim_id, k.key, g.key IS NOT NULL AS cache_hit FROM k LEFT JOIN g ON k.key = g.key""")
def tool03(ledger):
    k = ledger.select("claim_id", "seq", P.cache_key(F.create_map(F.lit("q"), F.col("source_class"), F.lit("f"), F.col("field_name"))).alias("key"))
    cache = k.select("key", F.when(F.col("seq") % 50 == 0, "b").otherwise("").alias("body"), F.lit(None).cast("string").alias("error"))
    return P.cache_lookup(k, cache).select("claim_id", "key", "cache_hit")


@query("tool04_recent_calls", "v_run", sql="SELECT seq, tool, duration_ms FROM v_run WHERE run_id = 'r7' ORDER BY called_at DESC, seq DESC LIMIT 25")
def tool04(runs):
    return P.recent_calls(runs, "r7", 25).select("seq", "tool", "duration_ms")


STATUS = "CASE seq % 7 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 402 WHEN 4 THEN 403 WHEN 5 THEN 500 END"
BODY = "CASE seq % 11 " + " ".join(f"WHEN {k} THEN 'X {p.upper()}: ' || tool" for k, p in enumerate(P.SPENT)) + " WHEN 8 THEN 'rate limit' WHEN 9 THEN tool END"
SPENT_SQL = " OR ".join(f"contains(lower(coalesce(b, '')), '{p}')" for p in P.SPENT)


@query("tool05_is_exhausted", "v_run", sql=f"""
WITH x AS (SELECT seq, {STATUS} AS s, {BODY} AS b FROM v_run), y AS (SELECT seq, coalesce(s, 0) AS s, {SPENT_SQL} AS said FROM x) SELECT seq, s = 429 OR (s BETWEEN 400 AND 403 AND said) AS batch_rule, s BETWEEN 400 AND 403 AND said AS watch_rule FROM y""")
def tool05(runs):
    return runs.select("seq", P.is_exhausted(F.expr(STATUS), F.expr(BODY)).alias("batch_rule"), P.is_exhausted(F.expr(STATUS), F.expr(BODY), "watch").alias("watch_rule"))


TIERS = {"fec_employer": 0, "adv_name": 1, "conference_sighting": 5}


def queue_inputs(entities, sources, runs):
    e = entities.select(F.col("record_id").alias("entity_id"), "seq")
    return e, sources, runs.select("entity_id", "state").filter("entity_id % 2 = 0")


@query("que01_unstarted", "v_entity", "v_run", sql="""
SELECT record_id AS entity_id, 'unstarted' AS kind FROM v_entity WHERE record_id NOT IN (SELECT entity_id FROM v_run) UNION ALL SELECT DISTINCT entity_id, 'resumable' FROM v_run WHERE state IN ('running', 'failed', 'retry')""")
def que01(entities, runs):
    new = P.unstarted(entities.select(F.col("record_id").alias("entity_id")), runs).withColumn("kind", F.lit("unstarted"))
    return new.unionByName(P.resumable(runs).withColumn("kind", F.lit("resumable")))


QUEUE = """t AS (SELECT entity_id, min(CASE source_class WHEN 'fec_employer' THEN 0 WHEN 'adv_name' THEN 1 WHEN 'conference_sighting' THEN 5 END) AS tier FROM v_source GROUP BY 1), k AS (SELECT entity_id, state FROM v_run WHERE entity_id % 2 = 0),
q AS (SELECT record_id AS entity_id, 0 AS turn, CAST(NULL AS INT) AS tier, seq FROM v_entity WHERE record_id IN (SELECT entity_id FROM k WHERE state IN ('running', 'failed', 'retry'))
 UNION ALL SELECT record_id, 1, t.tier, seq FROM v_entity JOIN t ON record_id = t.entity_id WHERE t.tier IS NOT NULL AND record_id NOT IN (SELECT entity_id FROM k))"""


@query("que02_priority_queue", "v_entity", "v_source", "v_run", sql=f"WITH {QUEUE} SELECT * FROM q")
def que02(entities, sources, runs):
    return P.priority_queue(*queue_inputs(entities, sources, runs), TIERS)


@query("que03_queue_breakdown", "v_entity", "v_source", "v_run", sql=f"WITH {QUEUE} SELECT CAST(i AS INT) AS tier, count(q.entity_id) AS entities FROM range(7) AS r(i) LEFT JOIN q ON q.tier = i GROUP BY i")
def que03(entities, sources, runs):
    return P.queue_breakdown(P.priority_queue(*queue_inputs(entities, sources, runs), TIERS), 7)


@query("que04_merge_checkpoints", "v_run", sql="""
WITH x AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS d, CASE WHEN seq % 7 > 0 THEN seq % 10 END AS attempts, CASE WHEN seq % 3 > 0 THEN duration_ms END AS cost FROM v_run)
SELECT entity_id, arg_max(state, d * 1000000000 + seq) AS state, arg_max(attempts, d * 1000000000 + seq) FILTER (attempts IS NOT NULL) AS attempts, arg_max(cost, d * 1000000000 + seq) FILTER (cost IS NOT NULL) AS cost FROM x GROUP BY entity_id""")
def que04(runs):
    x = runs.select("entity_id", "seq", "state", F.when(F.col("seq") % 7 > 0, F.col("seq") % 10).alias("attempts"), F.when(F.col("seq") % 3 > 0, F.col("duration_ms")).alias("cost"))
    return P.merge_checkpoints(x.filter("seq % 3 <> 0"), x.filter("seq % 3 = 0"))


@query("que04_validator_checkpoints", "v_run", sql="""
WITH x AS (SELECT entity_id AS record_id, CASE WHEN seq % 2 = 0 THEN 'type' ELSE 'email' END AS mode, state AS status, CASE WHEN ok THEN NULL ELSE tool END AS last_error, seq, CASE WHEN tool = 'view' THEN 1 ELSE 0 END AS d FROM v_run)
SELECT record_id, mode, arg_max(status, (d, seq)) AS status, (list(last_error ORDER BY d DESC, seq DESC))[1] AS last_error, CAST(sum(CASE WHEN d = 1 THEN 1 ELSE seq % 4 END) AS BIGINT) AS attempts FROM x GROUP BY 1, 2""")
def que04_validator(runs):
    x = runs.select(F.col("entity_id").alias("record_id"), F.when(F.col("seq") % 2 == 0, "type").otherwise("email").alias("mode"), F.col("state").alias("status"), F.when(~F.col("ok"), F.col("tool")).alias("last_error"), "seq", "tool")
    return P.merge_validator_checkpoints(x.filter("tool <> 'view'").withColumn("attempts", F.col("seq") % 4).drop("tool"), x.filter("tool = 'view'").drop("tool"))


KINDS = "CASE WHEN seq % 10 = 0 THEN 'enqueue' WHEN seq % 37 = 0 THEN 'done' WHEN seq % 23 = 0 THEN 'stale' ELSE 'pending' END"
QUEUE = f"""e AS (SELECT entity_id, seq, {KINDS} AS kind FROM v_run), s AS (SELECT entity_id, max(seq) AS enqueued FROM e WHERE kind = 'enqueue' GROUP BY 1),
i AS (SELECT entity_id, enqueued, count(*) FILTER (kind <> 'enqueue') AS attempts, coalesce(arg_max(kind, seq) FILTER (kind <> 'enqueue'), 'pending') AS state FROM e JOIN s USING (entity_id) WHERE seq >= enqueued GROUP BY 1, 2)"""


def queue_image(runs):
    return P.rag_queue_image(runs.select("entity_id", "seq", F.expr(KINDS).alias("kind")))


@query("que05_rag_queue_image", "v_run", sql=f"WITH {QUEUE} SELECT * FROM i")
def que05(runs):
    return queue_image(runs)


@query("que05_pending", "v_run", sql=f"""
WITH {QUEUE}, p AS (SELECT entity_id, enqueued FROM i WHERE state = 'pending' AND attempts < 3 ORDER BY enqueued, entity_id LIMIT 50), o AS (SELECT entity_id, arg_max(state, seq) AS outcome FROM v_run GROUP BY 1)
SELECT entity_id, enqueued, outcome NOT IN ('done', 'running') AS stale FROM p JOIN o USING (entity_id)""")
def que05_pending(runs):
    pending = P.pending_entities(queue_image(runs))
    stale = P.stale_entities(pending, runs.select("entity_id", F.col("state").alias("outcome"), "seq"), ["done", "running"])
    return pending.join(stale.withColumn("stale", F.lit(True)), "entity_id", "left").select("entity_id", "enqueued", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("que06_spend_report", "v_run", sql="""
WITH s AS (SELECT run_id, seq, sum(duration_ms) OVER (PARTITION BY run_id ORDER BY seq) AS spent FROM v_run) SELECT run_id, CAST(max(spent) AS BIGINT) AS total, min(seq) FILTER (spent >= 750000) AS warned_at, min(seq) FILTER (spent >= 1000000) AS stopped_at FROM s GROUP BY run_id""")
def que06(runs):
    return P.spend_report(runs.select("run_id", "seq", F.col("duration_ms").alias("cost")), 1_000_000)


@query("que07_progress_metrics", "v_run", sql="""
WITH n AS (SELECT run_id, count(*) AS processed, count(*) FILTER (state = 'done') AS confirmed, count(*) FILTER (state = 'failed') AS failed, CAST(sum(duration_ms) AS BIGINT) AS spend FROM v_run GROUP BY 1)
SELECT n.*, t.target, round(confirmed / t.target, 6) AS fraction FROM n LEFT JOIN (SELECT DISTINCT run_id, 400 AS target FROM v_run WHERE seq % 2 = 0) t USING (run_id)""")
def que07(runs):
    return P.progress_metrics(runs, runs.filter("seq % 2 = 0").select("run_id", F.lit(400).alias("target")).distinct())


@query("tool03_cacheable", "v_ledger", sql="""
SELECT claim_id, NOT (seq % 7 = 0) AND coalesce(answer, '') <> '' AS cacheable FROM v_ledger""")
def tool03_cacheable(ledger):
    return ledger.select("claim_id", P.cacheable(F.col("answer"), F.when(F.col("seq") % 7 == 0, "timeout")).alias("cacheable"))
