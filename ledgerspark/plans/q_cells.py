"""Queries of cells, selection and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..vocab import HIGH_VALUE
from .registry import query

TIER = "CASE WHEN extraction_method LIKE 'projected%' THEN 0 WHEN extraction_method LIKE 'derived%' THEN 1 ELSE 2 END"
CELLS = f"""k AS (SELECT *, {TIER} AS tier, field_name IN ('principal_name', 'principal_title') AND status NOT IN ('removed_failed_validation', 'superseded') AND coalesce(answer, '') <> '' AS ok FROM v_ledger WHERE field_name IS NOT NULL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, seq DESC) AS n FROM k) WHERE n = 1),
t AS (SELECT entity_id, field_name, min(tier) AS best FROM k WHERE ok GROUP BY 1, 2),
p AS (SELECT k.*, row_number() OVER (PARTITION BY k.entity_id, k.field_name, answer ORDER BY created_at, seq) AS d FROM k JOIN t ON k.entity_id = t.entity_id AND k.field_name = t.field_name AND k.tier = t.best WHERE ok),
f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at, seq) AS n FROM p WHERE d = 1),
j AS (SELECT entity_id, field_name, string_agg(answer, '; ' ORDER BY created_at, seq) AS joined FROM p WHERE d = 1 GROUP BY 1, 2),
c AS (SELECT w.entity_id, w.field_name, CASE WHEN t.best IS NOT NULL THEN joined WHEN w.status <> 'removed_failed_validation' THEN w.answer END AS value, w.claim_id AS winner_id, coalesce(f.claim_id, w.claim_id) AS producer_id,
 coalesce(f.status, w.status) AS status, coalesce(f.source_class, w.source_class) AS source_class, t.best FROM w LEFT JOIN t USING (entity_id, field_name) LEFT JOIN j USING (entity_id, field_name) LEFT JOIN f ON f.entity_id = w.entity_id AND f.field_name = w.field_name AND f.n = 1)"""


@query("cell01_provenance_rank", "v_ledger", sql=f"SELECT extraction_method, {TIER} AS tier, count(*) AS claims FROM v_ledger GROUP BY 1, 2")
def cell01(ledger):
    return ledger.groupBy("extraction_method", C.provenance_rank(F.col("extraction_method")).alias("tier")).agg(F.count(F.lit(1)).alias("claims"))


@query("cell02_resolve_cells", "v_ledger", sql=f"WITH {CELLS} SELECT entity_id, field_name, value, winner_id, producer_id, status, source_class FROM c")
def cell02(ledger):
    return C.resolve_cells(ledger).drop("best")


ALTERNATIVES = """r AS (SELECT k.*, c.value, c.winner_id, c.best, row_number() OVER (PARTITION BY k.entity_id, k.field_name, k.status IN ('removed_failed_validation', 'superseded'), k.tier, k.answer ORDER BY k.created_at, k.seq) AS nth,
 k.field_name IN ('principal_name', 'principal_title') AND c.best IS NOT NULL AS multi, k.status IN ('removed_failed_validation', 'superseded') AS dead FROM k JOIN c ON k.entity_id = c.entity_id AND k.field_name = c.field_name WHERE coalesce(k.answer, '') <> ''),
alternatives AS (SELECT entity_id, field_name, claim_id, CASE WHEN status = 'superseded' THEN 'superseded' WHEN dead THEN 'failed_validation' WHEN multi AND tier = best THEN 'duplicate_value' WHEN multi AND tier > best THEN 'lower_provenance_tier' WHEN multi THEN 'weaker_status' ELSE 'not_latest_write' END AS why_not_used
FROM r WHERE NOT CASE WHEN multi THEN NOT dead AND tier = best AND nth = 1 ELSE claim_id = winner_id AND value IS NOT NULL END)"""


@query("cell03_alternatives", "v_ledger", sql=f"WITH {CELLS}, {ALTERNATIVES} SELECT * FROM alternatives")
def cell03(ledger):
    return C.alternatives(ledger)


PRESENT = ["principal_name", "principal_title", "aum_usd", "important_insight", "recent_news"]
PIVOT = ", ".join(
    f"max(value) FILTER (field_name = '{f}') AS {f}" + (f", coalesce(max(c.status) FILTER (field_name = '{f}'), 'could_not_verify') AS {f}_status, max(source_class) FILTER (field_name = '{f}') AS {f}_source_class" if f in HIGH_VALUE else "") for f in dict.fromkeys([*PRESENT, *HIGH_VALUE])
)
WHO = "SELECT record_id AS entity_id, trim(name_raw) AS canonical_name, entity_type AS type_final, CASE WHEN record_id % 3 > 0 THEN discovery_class END AS discovery_class_primary, outcome FROM v_entity"


@query("cell04_records_pivot", "v_ledger", "v_entity", sql=f"""
WITH {CELLS}, who AS ({WHO}) SELECT who.entity_id, canonical_name, type_final, coalesce(discovery_class_primary, 'unknown') AS lead_origin_source_class, outcome, {PIVOT} FROM who LEFT JOIN c ON c.entity_id = who.entity_id GROUP BY 1, 2, 3, 4, 5""")
def cell04(ledger, entities):
    who = entities.sparkSession.sql(WHO.replace("v_entity", "{v_entity}"), v_entity=entities)
    return C.records_pivot(ledger, [*PRESENT, "type_final"], who)


def selection(cands):
    return C.select_quota(cands)


RANKS = "actionability_score DESC, type_final = 'SFO' DESC, verified_cell_count DESC, urgency_tier_rank DESC, discovery_class_count DESC, entity_id"
PICK = f"""r AS (SELECT *, row_number() OVER (PARTITION BY discovery_class_primary ORDER BY {RANKS}) AS class_rank, row_number() OVER (ORDER BY {RANKS}) AS place FROM v_cand),
a AS (SELECT *, row_number() OVER (ORDER BY place) AS rank FROM r WHERE class_rank <= 15), s AS (SELECT * FROM a WHERE rank <= 50),
sel AS (SELECT entity_id, discovery_class_primary, CAST(rank AS INT) AS rank, false AS excluded, actionability_score FROM s
 UNION ALL SELECT entity_id, discovery_class_primary, NULL, true, actionability_score FROM r WHERE class_rank > 15 AND ((SELECT count(*) FROM s) < 50 OR place < (SELECT max(place) FROM s)))"""


@query("sel01_score_claims", "v_ledger", sql="""
SELECT entity_id, CAST(sum(CASE status WHEN 'verified' THEN 3 WHEN 'confirmed' THEN 2 WHEN 'single_source' THEN 2 WHEN 'format_only' THEN 1 WHEN 'pattern_inferred' THEN 1 ELSE 0 END) AS BIGINT) AS actionability_score, count(*) FILTER (status = 'verified') AS verified_cell_count,
 max(CASE WHEN field_name IN ('important_insight', 'recent_investments', 'recent_fund_commitments') AND status NOT IN ('could_not_verify', 'removed_failed_validation') THEN CASE WHEN confidence IN ('high', 'medium') THEN 2 ELSE 1 END ELSE 0 END) AS urgency_tier_rank,
 min(CASE WHEN field_name LIKE 'discovery\\_class\\_%' ESCAPE '\\' THEN substring(field_name, 17) END) AS discovery_class_primary, CAST(0 AS BIGINT) AS discovery_class_count FROM v_ledger GROUP BY entity_id""")
def sel01(ledger):
    return C.score_claims(ledger)


@query("sel02_select_quota", "v_cand", sql=f"WITH {PICK} SELECT * FROM sel")
def sel02(cands):
    return selection(cands)


@query("sel03_production_records", "v_cand", sql=f"WITH {PICK} SELECT entity_id, rank, discovery_class_primary AS primary_class, excluded AS excluded_by_quota FROM sel")
def sel03(cands):
    return C.production_records(selection(cands))


@query("sel04_reserve_draw", "v_cand", sql="SELECT entity_id, discovery_class_count FROM v_cand WHERE entity_id % 3 = 0 ORDER BY discovery_class_count DESC, entity_id LIMIT 30")
def sel04(cands):
    pool = cands.withColumn("thin_reason", F.when(F.col("entity_id") % 3 == 0, "fixable").otherwise("structural"))
    return C.reserve_draw(pool, 20).select("entity_id", "discovery_class_count")


CONFIRMED = "CASE WHEN status = 'verified' THEN 'cross_class' END AS verification_method, CASE WHEN status = 'verified' THEN source_url || '#c' END AS confirming_url"


@query("cell05_provenance_rows", "v_ledger", sql=f"""
SELECT entity_id, field_name, answer, status, source_url, source_class, extraction_method, confidence, {CONFIRMED}, CAST(NULL AS STRING) AS confirming_class, CASE WHEN status = 'verified' THEN retrieved_at END AS verified_at
FROM v_ledger WHERE field_name IS NOT NULL""")
def cell05(ledger):
    told = ledger.selectExpr("*", *[c.strip() for c in CONFIRMED.split(", ")], "CASE WHEN status = 'verified' THEN retrieved_at END AS verified_at")
    return C.provenance_rows(told, ledger.select("entity_id").distinct())


@query("cell06_class_report", "v_cand", sql=f"""
WITH {PICK}, g AS (SELECT discovery_class_primary AS discovery_class, count(*) AS entity_count, round(avg(actionability_score), 2) AS m FROM sel WHERE NOT excluded GROUP BY 1)
SELECT 'class' AS section, discovery_class, entity_count, m AS avg_actionability_score FROM g UNION ALL SELECT 'selected', discovery_class, entity_count, NULL FROM g UNION ALL SELECT 'cap', 'quota cap per class', 15, NULL""")
def cell06(cands):
    return C.class_report(selection(cands))


@query("cell07_rejected_rows", "v_cand", sql=f"""
WITH {PICK} SELECT entity_id, 'quota' AS stage, '{C.BY_QUOTA}' AS reason_code, NULL AS created_at FROM sel WHERE excluded UNION ALL SELECT entity_id, 'final', 'V6', '2024-01-0' || CAST(entity_id % 9 + 1 AS STRING) FROM v_cand WHERE entity_id % 7 = 0""")
def cell07(cands):
    rejected = cands.filter("entity_id % 7 = 0").select("entity_id", F.lit("final").alias("stage"), F.lit("V6").alias("reason_code"), F.expr("'2024-01-0' || CAST(entity_id % 9 + 1 AS STRING)").alias("created_at"))
    return C.rejected_rows(rejected, selection(cands))


STATUS_NOTES = ", ".join(f"('{name}', '{meaning}')" for name, meaning in C.STATUS_NOTES)


@query("cell08_data_dictionary", "v_ledger", sql=f"""
SELECT n.status, meaning, count(l.status) AS claims FROM (VALUES {STATUS_NOTES}) AS n(status, meaning) LEFT JOIN v_ledger l ON l.status = n.status GROUP BY 1, 2""")
def cell08(ledger):
    """The notes on statuses, and the claims that have them."""
    notes = C.data_dictionary(ledger.sparkSession).filter("section = 'status'").select(F.col("name").alias("status"), F.col("description").alias("meaning"))
    return notes.join(ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", "meaning", F.coalesce("n", F.lit(0)).alias("claims"))


@query("cell07_audit_rows", "v_ledger", sql="""
SELECT seq, entity_id, field_name AS field, answer AS before, CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(seq AS STRING) WHEN 2 THEN '["a","b"]' ELSE 'was "quoted"' END AS after FROM v_ledger""")
def cell07_audit(ledger):
    as_json = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1), F.lit("null"))
    after = F.expr(r"""CASE seq % 4 WHEN 0 THEN 'null' WHEN 1 THEN CAST(seq AS STRING) WHEN 2 THEN '["a","b"]' ELSE '"was \\"quoted\\""' END""")
    return C.audit_rows(ledger.select("seq", "entity_id", F.col("field_name").alias("field"), as_json(F.col("answer")).alias("before"), after.alias("after")))
