"""Queries of the gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators.ledger import select_claim
from ..vocab import QUESTIONS
from .q_ledger import RANK_SQL
from .registry import query

SELECTED = f"""s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, question_id ORDER BY {RANK_SQL}, retrieved_at DESC NULLS LAST, claim_id) AS n FROM v_ledger WHERE question_id IS NOT NULL) WHERE n = 1)"""
Q = "q(question_id, lane, gate, on_unknown) AS (VALUES " + ", ".join(f"('{q}', '{a}', '{b}', '{c}')" for q, (a, b, c) in QUESTIONS.items()) + ")"
GATES = f"""{SELECTED}, {Q}, e AS (SELECT DISTINCT entity_id FROM v_ledger),
g AS (SELECT e.entity_id, q.question_id, on_unknown, CASE WHEN status = 'contradicted' THEN 'contradicted' WHEN status IS NULL OR status = 'could_not_verify' THEN 'unanswered' ELSE 'confirmed' END AS chk
 FROM e CROSS JOIN q LEFT JOIN s ON s.entity_id = e.entity_id AND s.question_id = q.question_id WHERE gate = 'HARD'),
r AS (SELECT entity_id, string_agg(question_id || ':' || chk, ';' ORDER BY question_id || ':' || chk) FILTER (chk = 'contradicted' OR (chk = 'unanswered' AND on_unknown = 'reject')) AS reason_code,
 bool_or(chk = 'unanswered' AND on_unknown = 'deprioritize') AS force_low,
 coalesce(string_agg(question_id || CASE on_unknown WHEN 'deprioritize' THEN ': unanswered, deprioritized per policy' ELSE ': unanswered, shipped with label per policy' END, '|' ORDER BY question_id) FILTER (chk = 'unanswered' AND on_unknown <> 'reject'), '') AS labels,
 string_agg(question_id || '=' || chk, ',' ORDER BY question_id) AS checks FROM g GROUP BY entity_id)"""


def gates_of(ledger):
    return G.hard_gates(select_claim(ledger), ledger.select("entity_id").distinct())


@query("gate01_hard_gates", "v_ledger", sql=f"WITH {GATES} SELECT entity_id, reason_code IS NOT NULL AS reject, reason_code, force_low, labels, checks FROM r")
def gate01(ledger):
    return gates_of(ledger)


@query("gate02_dead_ends", "v_ledger", sql=f"""WITH {SELECTED} SELECT entity_id, string_agg(question_id || ': ' || coalesce(answer, 'None'), '|' ORDER BY question_id || ': ' || coalesce(answer, 'None')) AS dead_ends FROM s WHERE status = 'could_not_verify' GROUP BY entity_id""")
def gate02(ledger):
    return G.dead_ends(select_claim(ledger))


@query("gate03_thin_reason", "v_ledger", sql=f"""WITH {SELECTED} SELECT entity_id, CASE WHEN count(*) FILTER (question_id IN ('G2.Q1', 'G2.Q2', 'G3.Q1') AND status <> 'could_not_verify') = 0 THEN 'structural' ELSE 'fixable' END AS thin_reason FROM s GROUP BY entity_id""")
def gate03(ledger):
    return G.thin_reason(select_claim(ledger))


@query("gate04_retry_not_reject", "v_ledger", sql="""
WITH e AS (SELECT entity_id, count(*) AS n, bool_or(source_class = 'tool_unavailable' AND extraction_method = 'snov_error') AS late, bool_or(status = 'verified' AND confidence = 'high') AS has, bool_and(status <> 'contradicted') FILTER (confidence = 'low') AS open, count(*) FILTER (confidence = 'low') AS low FROM v_ledger GROUP BY 1)
SELECT entity_id, CASE WHEN low = 0 THEN 'pass' WHEN late AND NOT has AND open THEN 'retry' ELSE 'reject' END AS decision FROM e""")
def gate04(ledger):
    reason = F.concat_ws(":", F.coalesce("question_id", F.lit("G9")), F.when(F.col("status") == "contradicted", "contradicted").otherwise("unanswered"))
    low = F.col("confidence") == "low"
    g = ledger.groupBy("entity_id").agg(F.bool_or(low).alias("reject"), F.array_join(F.array_sort(F.collect_set(F.when(low, reason))), ";").alias("reason_code"))
    return G.retry_not_reject(g, ledger.filter("source_class = 'tool_unavailable' AND extraction_method = 'snov_error'"), ledger.filter("status = 'verified' AND confidence = 'high'"))


@query("gate05_cap_verdict", "v_ledger", sql=f"WITH {GATES} SELECT entity_id, CASE WHEN reason_code IS NOT NULL THEN 'reject' WHEN force_low THEN 'pursue_low' WHEN entity_id % 2 = 0 THEN 'pursue' ELSE 'pursue_low' END AS verdict FROM r")
def gate05(ledger):
    judged = ledger.select("entity_id").distinct().withColumn("judged", F.when(F.col("entity_id") % 2 == 0, "pursue").otherwise("pursue_low"))
    return G.cap_verdict(judged, gates_of(ledger))


@query("gate06_lane_summary", "v_ledger", sql=f"""
WITH {SELECTED}, {Q}, e AS (SELECT DISTINCT entity_id FROM s)
SELECT e.entity_id, lane, count(*) FILTER (status <> 'could_not_verify') AS answered, count(*) AS total,
 coalesce(string_agg(q.question_id, ',' ORDER BY q.question_id) FILTER (gate = 'HARD' AND coalesce(status, 'could_not_verify') = 'could_not_verify'), '') AS hard_unanswered, count(status) > 0 AS ran
FROM e CROSS JOIN q LEFT JOIN s ON s.entity_id = e.entity_id AND s.question_id = q.question_id GROUP BY e.entity_id, lane""")
def gate06(ledger):
    return G.lane_summary(select_claim(ledger))


@query("gate07_verdict_distribution", "v_ledger", sql="""
SELECT confidence AS verdict, count(*) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS n FROM v_ledger) WHERE n = 1 GROUP BY confidence""")
def gate07(ledger):
    return G.verdict_distribution(ledger, "confidence")


@query("gate08_explode_trace", "v_ledger", sql="""
SELECT source_class AS phase, status AS event, confidence AS lane, count(*) AS events, count(DISTINCT entity_id) AS entities FROM v_ledger GROUP BY 1, 2, 3""")
def gate08(ledger):
    event = F.struct(F.col("source_class").alias("phase"), F.col("status").alias("event"), F.col("confidence").alias("lane"), F.lit(0.5).alias("cost"))
    return G.trace_tally(ledger.groupBy("entity_id").agg(F.to_json(F.collect_list(event)).alias("trace")))
