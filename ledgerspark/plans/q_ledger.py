"""Queries of the claim ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..vocab import QUESTIONS, STATUS_RANK
from ..sources.scratch import scratch_path
from ..sources.stored import merge_stored, read_stored
from .registry import query

RANK_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS_RANK.items()) + " ELSE 99 END"
LANE_SQL = "CASE question_id " + " ".join(f"WHEN '{q}' THEN '{lane}'" for q, (lane, _, _) in QUESTIONS.items()) + " END"
LAST = "row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, seq DESC)"


MINT = "coalesce(CAST(entity_id AS STRING), 'None') || '|' || coalesce(question_id, 'None') || '|' || coalesce(field_name, 'None') || '|' || coalesce(source_url, 'None') || '|' || coalesce(answer, 'None')"
UUID = "substr(d, 1, 12) || '5' || substr(d, 14, 3) || substr('89ab', ((strpos('0123456789abcdef', substr(d, 17, 1)) - 1) & 3) + 1, 1) || substr(d, 18, 15)"
DIGEST = f"sha1(unhex('{L.URL_NAMESPACE}') || encode({MINT}))"


@query("led01_claim_id", "v_ledger", sql=f"SELECT claim_id, {UUID} AS minted_id FROM (SELECT claim_id, {DIGEST} AS d FROM v_ledger)")
def led01(ledger):
    return L.claim_id(ledger).select("claim_id", "minted_id")


@query("led02_upsert_claims", "v_ledger", sql=f"""
WITH x AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'd' ELSE 'b' END AS kind, 'm' || CAST(seq % 997 AS STRING) AS id FROM v_ledger),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, created_at, seq) AS f, row_number() OVER (PARTITION BY id ORDER BY kind DESC, created_at DESC, seq DESC) AS l FROM x)
SELECT a.id AS claim_id, a.entity_id, a.field_name, a.source_url, a.confidence, b.status, b.answer FROM n a JOIN n b ON a.id = b.id AND a.f = 1 AND b.l = 1""")
def led02(ledger):
    x = ledger.withColumn("claim_id", F.concat(F.lit("m"), (F.col("seq") % 997).cast("string")))
    path = scratch_path(ledger.sparkSession, "claims")
    for part in (x.filter("seq % 3 <> 0"), x.filter("seq % 3 = 0")):
        merge_stored(path, part, ["claim_id"], L.upsert_claims, buckets=16)
    return read_stored(ledger.sparkSession, path).select("claim_id", "entity_id", "field_name", "source_url", "confidence", "status", "answer")


@query("led03_latest_by_field", "v_ledger", sql=f"""
SELECT entity_id, field_key, claim_id, status, answer FROM (SELECT *, coalesce(field_name, question_id) AS field_key, {LAST.format(keys='entity_id, coalesce(field_name, question_id)')} AS n FROM v_ledger) WHERE n = 1""")
def led03(ledger):
    return L.latest_by_field(ledger).select("entity_id", "field_key", "claim_id", "status", "answer")


@query("led04_select_claim", "v_ledger", sql=f"""
SELECT entity_id, question_id, claim_id, status, answer FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, question_id ORDER BY {RANK_SQL}, retrieved_at DESC NULLS LAST, claim_id) AS n
 FROM v_ledger WHERE question_id IS NOT NULL) WHERE n = 1""")
def led04(ledger):
    return L.select_claim(ledger).select("entity_id", "question_id", "claim_id", "status", "answer")


@query("led05_backfill_from_blobs", "v_ledger", sql=f"SELECT * EXCLUDE (d), {UUID} AS minted_id FROM (SELECT entity_id, question_id, field_name, answer, coalesce(status, 'could_not_verify') AS status, source_url, source_class, coalesce(confidence, 'low') AS confidence, {DIGEST} AS d FROM v_ledger)")
def led05(ledger):
    blob = ledger.groupBy("entity_id", (F.col("seq") % 2).alias("side")).agg(F.to_json(F.collect_list(F.struct("question_id", "field_name", "answer", "status", "source_url", "source_class", "confidence"))).alias("ledger"))
    return L.backfill_from_blobs(blob.filter("side = 0"), blob.filter("side = 1"))


@query("led06_latest_decisions", "v_ledger", sql="""
SELECT entity_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS n FROM v_ledger) WHERE n = 1 AND status IN ('confirmed', 'verified')""")
def led06(ledger):
    return L.latest_decisions(ledger, ["confirmed", "verified"]).select("entity_id", "seq", "status")


@query("led07_latest_outcome", "v_run", sql="""
SELECT entity_id, seq, state FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS n FROM v_run) WHERE n = 1 AND state IN ('done', 'skipped')""")
def led07(runs):
    return L.latest_outcome(runs, "state", "seq", ["done", "skipped"]).select("entity_id", "seq", "state")


@query("led08_settled_fields", "v_ledger", sql="""
SELECT entity_id, 'enrichment' AS rule, string_agg(DISTINCT field_name, ',' ORDER BY field_name) AS fields FROM v_ledger WHERE status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded') GROUP BY entity_id
UNION ALL SELECT entity_id, 'completeness', string_agg(DISTINCT field_name, ',' ORDER BY field_name) FROM v_ledger WHERE status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded', 'contradicted') GROUP BY entity_id""")
def led08(ledger):
    parts = [L.settled_fields(ledger, r).withColumn("rule", F.lit(r)) for r in ("enrichment", "completeness")]
    return parts[0].unionByName(parts[1]).select("entity_id", "rule", "fields")


@query("led09_supersede_derived", "v_ledger", sql="SELECT claim_id, CASE WHEN extraction_method LIKE 'derived\\_%' ESCAPE '\\' THEN 'superseded' ELSE status END AS status FROM v_ledger")
def led09(ledger):
    return L.supersede_derived(ledger).select("claim_id", "status")


@query("led10_downgrade_contradictions", "v_ledger", sql="""
SELECT claim_id, status = 'contradicted' AND n < 2 AS downgraded, CASE WHEN status = 'contradicted' AND n < 2 THEN CASE WHEN source_url IS NOT NULL THEN 'confirmed' ELSE 'could_not_verify' END ELSE status END AS status
FROM (SELECT *, len(list_distinct(regexp_extract_all(CASE WHEN seq % 2 = 0 THEN source_url || ' and https://other.example.com/x' ELSE source_url END, 'https?://[^\\s)\\]]+'))) AS n FROM v_ledger)""")
def led10(ledger):
    text = F.when(F.col("seq") % 2 == 0, F.concat("source_url", F.lit(" and https://other.example.com/x"))).otherwise(F.col("source_url"))
    return L.downgrade_contradictions(ledger.withColumn("text", text), "text").select("claim_id", "downgraded", "status")


@query("led11_tag_gaps", "v_ledger", sql=f"""
WITH x AS (SELECT *, {LANE_SQL} AS lane FROM v_ledger), e AS (SELECT DISTINCT lane FROM x WHERE lane <> 'people')
SELECT claim_id, x.lane, CASE WHEN status = 'could_not_verify' AND e.lane IS NOT NULL THEN 'no_evidence_found' WHEN status = 'could_not_verify' THEN 'tool_unavailable' ELSE source_class END AS source_class
FROM x LEFT JOIN e ON x.lane = e.lane""")
def led11(ledger):
    x = with_lane(ledger)
    return L.tag_gaps(x, x.filter("lane <> 'people'").select("lane").distinct()).select("claim_id", "lane", "source_class")


def with_lane(ledger):
    lanes = F.array(*[F.lit(lane) for lane, _, _ in QUESTIONS.values()])
    place = F.array_position(F.array(*[F.lit(q) for q in QUESTIONS]), F.col("question_id"))
    return ledger.withColumn("lane", F.get(lanes, F.when(place > 0, place.cast("int") - 1)))


@query("led12_stamp_method", "v_ledger", sql=f"""
WITH x AS (SELECT *, {LANE_SQL} AS lane FROM v_ledger), t AS (SELECT source_url, min(source_class) AS tool FROM v_ledger WHERE seq % 13 < 9 GROUP BY source_url)
SELECT claim_id, coalesce(extraction_method, tool, 'researcher_' || lane) AS extraction_method FROM x LEFT JOIN t USING (source_url)""")
def led12(ledger):
    tools = ledger.filter("seq % 13 < 9").groupBy("source_url").agg(F.min("source_class").alias("tool"))
    return L.stamp_method(with_lane(ledger), tools).select("claim_id", "extraction_method")


@query("led13_rename_field", "v_ledger", sql="SELECT claim_id, CASE field_name WHEN 'important_insight' THEN 'why_now' WHEN 'recent_news' THEN 'news' ELSE field_name END AS field_name FROM v_ledger")
def led13(ledger):
    return L.rename_field(ledger, {"important_insight": "why_now", "recent_news": "news"}).select("claim_id", "field_name")


@query("led14_chain_steps", "v_ledger", sql="""
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, seq) AS step, claim_id, source_class, source_url FROM v_ledger WHERE status = 'verified'""")
def led14(ledger):
    return L.chain_steps(ledger)
