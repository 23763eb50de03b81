"""Queries of the validation layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD
from ..operators import validate as V
from ..vocab import CONFIRMING
from .q_ledger import LAST
from .q_resolve import SQUEEZE
from .registry import query

CONF = "coalesce(source_class IN (" + ", ".join(f"'{c}'" for c in CONFIRMING) + "), false)"


def norm(c):
    return f"trim(lower(coalesce({c}, 'None')))"


def comp(a, b):
    return f"""CASE WHEN {a}.answer_num IS NOT NULL AND {b}.answer_num IS NOT NULL THEN {a}.answer_num = {b}.answer_num
 ELSE {norm(a + '.answer')} <> '' AND {norm(b + '.answer')} <> '' AND (contains({norm(a + '.answer')}, {norm(b + '.answer')}) OR contains({norm(b + '.answer')}, {norm(a + '.answer')})) END"""


@query("val01_is_confirming", "v_ledger", sql=f"SELECT source_class, {CONF} AS confirming, count(*) AS claims FROM v_ledger GROUP BY 1, 2")
def val01(ledger):
    return ledger.groupBy("source_class", V.is_confirming(F.col("source_class")).alias("confirming")).agg(F.count(F.lit(1)).alias("claims"))


@query("val02_answers_compatible", "v_ledger", sql=f"SELECT a.claim_id, {comp('a', 'b')} AS compatible FROM v_ledger a JOIN v_ledger b ON a.seq + 1 = b.seq")
def val02(ledger):
    a = ledger.select("seq", "claim_id", "answer", "answer_num")
    b = ledger.select((F.col("seq") - 1).alias("seq"), F.col("answer").alias("b"), F.col("answer_num").alias("bn"))
    return a.join(b, "seq").select("claim_id", V.compatible(F.col("answer"), F.col("b"), F.col("answer_num"), F.col("bn")).alias("compatible"))


@query("val03_cross_class", "v_ledger", sql=f"""
WITH k AS (SELECT *, coalesce(field_name, question_id) AS field_key FROM v_ledger),
m AS (SELECT a.claim_id, b.source_url, b.source_class, row_number() OVER (PARTITION BY a.claim_id ORDER BY b.created_at, b.seq) AS n FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.field_key = b.field_key AND a.claim_id <> b.claim_id
 AND a.status = 'confirmed' AND b.status IN ('confirmed', 'verified', 'single_source') AND a.source_class <> b.source_class AND {CONF.replace('source_class', 'b.source_class')} AND {comp('a', 'b')})
SELECT k.claim_id, CASE WHEN status <> 'confirmed' THEN status WHEN m.claim_id IS NOT NULL THEN 'verified' ELSE 'single_source' END AS status, m.source_url AS confirming_url, m.source_class AS confirming_class FROM k LEFT JOIN m ON k.claim_id = m.claim_id AND n = 1""")
def val03(ledger):
    return V.cross_class(ledger).select("claim_id", "status", "confirming_url", "confirming_class")


SETTLED = """s AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at, seq) AS pos FROM v_ledger WHERE field_name NOT IN ('principal_name', 'principal_title') AND status NOT IN ('could_not_verify', 'superseded'))"""


@query("val04_contradictions", "v_ledger", sql=f"""
WITH {SETTLED}, b AS (SELECT DISTINCT x.claim_id FROM s x JOIN s y ON x.entity_id = y.entity_id AND x.field_name = y.field_name AND x.claim_id <> y.claim_id AND NOT ({comp('x', 'y')}))
SELECT v.claim_id, CASE WHEN b.claim_id IS NOT NULL THEN 'contradicted' ELSE status END AS status FROM v_ledger v LEFT JOIN b ON v.claim_id = b.claim_id""")
def val04(ledger):
    return V.contradictions(ledger).select("claim_id", "status")


@query("val05_contradiction_findings", "v_ledger", sql=f"""
WITH {SETTLED}, p AS (SELECT x.entity_id, x.field_name, x.claim_id AS a, y.claim_id AS b, x.pos AS i, y.pos AS j, x.status AS si, y.status AS sj FROM s x JOIN s y ON x.entity_id = y.entity_id AND x.field_name = y.field_name AND x.claim_id <> y.claim_id AND NOT ({comp('x', 'y')})),
m AS (SELECT a AS id, min(j) AS least FROM p GROUP BY a)
SELECT entity_id, field_name AS field, a AS claim_id, b AS other_id FROM p JOIN m ma ON ma.id = a JOIN m mb ON mb.id = b WHERE i < j AND NOT ((si = 'contradicted' OR ma.least < j) AND (sj = 'contradicted' OR mb.least < i))""")
def val05(ledger):
    return V.contradiction_findings(ledger)


NOW = "2024-12-31 12:00:00"


@query("val06_staleness", "v_ledger", sql=f"""
SELECT claim_id, 'V5_staleness' AS check_id, 'warn' AS severity, coalesce(field_name, question_id) AS field, age_days FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(retrieved_at)) / 86400000000) AS BIGINT) AS age_days FROM v_ledger)
WHERE status IN ('confirmed', 'verified', 'single_source') AND age_days > 180""")
def val06(ledger):
    return V.staleness(ledger, NOW)


POLAR = "CASE seq % 11 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate([
    "'No, there is none.'", "'Yes, it does.'", "'Noble family wealth ' || coalesce(answer, '')", "'There is no evidence.'", "'Noël & Söhne, a family office'", "'There''s no site of its own'", "'\n  none'", "' YES: ' || coalesce(answer, '')",
    "'It stays, so far, without ' || coalesce(answer, '') || ': NO, evidence that it is'", "NULL",
])) + " ELSE answer END"
JUDGED = "CASE entity_id % 7 WHEN 0 THEN 'affirmative' WHEN 1 THEN 'negative' WHEN 2 THEN 'unclear' WHEN 3 THEN 'other' END"
DENIES = lambda c: f"regexp_matches({SQUEEZE(f"regexp_replace(lower(coalesce({c}, 'None')), '[^{WORD}{SPACE}]+', ' ', 'g')")}, '^(no|none|not|insufficient)( |$)|^there (is|are) no( |$)|no affirmative evidence|not a family office|no evidence that')"
AFFIRMS = lambda c: f"starts_with({SQUEEZE(f"lower(coalesce({c}, 'None'))")}, 'yes')"


def polar(ledger):
    return ledger.withColumn("answer", F.expr(POLAR))


def judged(ledger):
    """Verdicts on both questions of an entity: the second one's is that of the next entity."""
    ids = ledger.select("entity_id").distinct()
    first = ids.select("entity_id", F.lit("G1.Q3").alias("question_id"), F.expr(JUDGED).alias("verdict"))
    return first.unionByName(ids.select("entity_id", F.lit("G1.Q5").alias("question_id"), F.expr(JUDGED.replace("entity_id", "(entity_id + 1)")).alias("verdict")))


@query("val07_identity_gate", "v_ledger", sql=f"""
WITH l AS (SELECT *, {POLAR} AS said, {LAST.format(keys='entity_id, question_id')} AS n FROM v_ledger),
q3 AS (SELECT * FROM l WHERE n = 1 AND question_id = 'G1.Q3'), q5 AS (SELECT * FROM l WHERE n = 1 AND question_id = 'G1.Q5'), e AS (SELECT entity_id, {JUDGED} AS v FROM (SELECT DISTINCT entity_id FROM v_ledger) AS i)
SELECT entity_id, 'G1.Q3' AS field, 'V5_firm_is_fo' AS check_id, 'fatal' AS severity FROM e LEFT JOIN q3 USING (entity_id)
 WHERE status IS NULL OR status IN ('could_not_verify', 'contradicted') OR CASE v WHEN 'affirmative' THEN false WHEN 'negative' THEN true ELSE {DENIES('said')} END
UNION ALL SELECT entity_id, 'G1.Q5', 'V5_firm_is_fo', 'fatal' FROM q5
 WHERE status = 'confirmed' AND CASE {JUDGED.replace('entity_id', '(entity_id + 1)')} WHEN 'affirmative' THEN true WHEN 'negative' THEN false ELSE {AFFIRMS('said')} END""")
def val07(ledger):
    return V.identity_gate(polar(ledger), judged(ledger))


@query("val08_completeness", "v_ledger", sql="""
WITH t AS (SELECT * FROM v_ledger), l AS (SELECT * FROM t WHERE status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted', 'superseded')), e AS (SELECT DISTINCT entity_id FROM t),
x AS (SELECT e.entity_id, count(*) FILTER (field_name = 'principal_name' OR question_id = 'G2.Q1') AS a, count(*) FILTER (field_name IN ('principal_email', 'principal_phone') OR question_id = 'G2.Q2') AS b,
 count(*) FILTER (field_name IN ('recent_investments', 'important_insight') OR question_id IN ('G3.Q1', 'G3.Q2')) AS c FROM e LEFT JOIN l USING (entity_id) GROUP BY e.entity_id)
SELECT entity_id, 'principal_name' AS field, 'V6_completeness' AS check_id, 'warn' AS severity FROM x WHERE a = 0 UNION ALL SELECT entity_id, 'principal_email', 'V6_completeness', 'warn' FROM x WHERE b = 0
UNION ALL SELECT entity_id, 'recent_investments', 'V6_completeness', 'warn' FROM x WHERE c = 0""")
def val08(ledger):
    return V.completeness(ledger)


@query("val09_release_rule", "v_ledger", sql="""
SELECT entity_id, field_name, answer AS rejected_value, 'verification_failed' AS reason_code, source_url AS evidence_url FROM v_ledger WHERE field_name = 'aum_usd' AND entity_id % 3 = 0""")
def val09(ledger):
    failed = ledger.filter("entity_id % 3 = 0").select("entity_id", F.col("field_name").alias("field"))
    return V.release_rule(ledger, failed, ["aum_usd"])[1]


@query("val10_v1_worklist", "v_ledger", sql="""
WITH e AS (SELECT *, coalesce(sum(seq % 3 + 1) OVER (PARTITION BY entity_id ORDER BY created_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM v_ledger
 WHERE source_class <> 'serper_organic' AND status IN ('confirmed', 'verified', 'single_source'))
SELECT entity_id, claim_id, CAST(spent AS BIGINT) AS spent FROM e WHERE spent < 15""")
def val10(ledger):
    return V.v1_worklist(ledger, F.col("seq") % 3 + 1, 15)


@query("val11_apply_judgments", "v_ledger", sql="""
SELECT claim_id, CASE seq % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'fatal' WHEN 2 THEN 'warn' END AS severity, CASE WHEN seq % 5 = 1 THEN 'contradicted' ELSE status END AS status FROM v_ledger""")
def val11(ledger):
    judged = ledger.filter("seq % 5 < 3").select("claim_id", F.expr("CASE seq % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'not_stated' END").alias("judgment"))
    return V.apply_judgments(ledger, judged).select("claim_id", "severity", "status")


# replies of every shape with what each means: support, polarity, verdict
REPLIES = [
    ('```json {"verdict": "supported", "reason": "r"} ```', "supported", "unclear", None), ('{"supported": false}', "not_stated", "unclear", None), ("I cannot say.", None, "unclear", None), ('{"verdict": "maybe", "reason": "r"}', None, "unclear", None),
    ('{"verdict": "contradicted"}', None, "unclear", None), ('{"supported": true, "reason": "x"}', "supported", "unclear", None), ('{"verdict": "negative"}', None, "negative", None), ('```{"verdict": "affirmative", "reason": "r"}```', None, "affirmative", None),
    ('{"verdict": "pursue_low", "rationale": "thin"}', None, "unclear", "pursue_low"), ('{"verdict": "pursue"}', None, "unclear", None), ('[{"verdict": "supported", "reason": "r"}]', None, "unclear", None), ('{"verdict": "not_stated", "reason": ""}', "not_stated", "unclear", None),
]
NTH = f"(conv_id + turn) % {len(REPLIES)}"
REPLY = f"CASE {NTH} " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(REPLIES)) + " END"
MEANS = lambda i: f"CASE {NTH} " + " ".join(f"WHEN {k} THEN {f"'{r[i]}'" if r[i] else 'NULL'}" for k, r in enumerate(REPLIES)) + " END"


@query("val12_parse_judge_json", "v_answer", sql=f"SELECT conv_id, turn, {MEANS(1)} AS judgment, {MEANS(2)} AS polarity, {MEANS(3)} AS verdict FROM v_answer")
def val12(answers):
    reply = F.expr(REPLY)
    return answers.select("conv_id", "turn", V.parse_judge_json(reply).alias("judgment"), V.parse_polarity(reply).alias("polarity"), V.parse_verdict(reply)["verdict"].alias("verdict"))


@query("val12_parse_claims", "v_ledger", sql="""
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY seq) - 1 AS place, question_id, answer FROM (SELECT entity_id, seq, coalesce(question_id, 'G9.Q9') AS question_id, answer FROM v_ledger WHERE entity_id % 5 > 0) QUALIFY question_id IN ('G1.Q1', 'G1.Q2', 'G3.Q1')""")
def val12_claims(ledger):
    item = F.struct("seq", F.coalesce("question_id", F.lit("G9.Q9")).alias("question_id"), "answer")
    blob = ledger.groupBy("entity_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = F.to_json(F.transform("items", lambda i: F.struct(i["question_id"].alias("question_id"), i["answer"].alias("answer"))))
    replies = blob.select("entity_id", F.when(F.col("entity_id") % 5 == 0, "no array").otherwise(F.concat(F.lit("```json\n"), text, F.lit("\n```"))).alias("reply"))
    return V.parse_claims(replies, ["G1.Q1", "G1.Q2", "G3.Q1"], ["entity_id"]).select("entity_id", "place", "question_id", "answer")


@query("val13_field_status", "v_ledger", sql=f"""
SELECT entity_id, field_key AS field, status, extraction_method AS method FROM (SELECT *, coalesce(field_name, question_id) AS field_key, {LAST.format(keys='entity_id, coalesce(field_name, question_id)')} AS n FROM v_ledger) WHERE n = 1""")
def val13(ledger):
    return V.field_status(ledger)


def findings_of(ledger):
    return ledger.select("entity_id", F.expr("CASE WHEN seq % 50 = 0 THEN 'V6_completeness' WHEN seq % 3 = 0 THEN 'V5_firm_is_fo' ELSE 'V4_contradiction' END").alias("check_id"), F.expr("CASE WHEN seq % 41 = 0 THEN 'fatal' WHEN seq % 37 = 0 THEN 'warn' ELSE 'info' END").alias("severity"), F.col("field_name").alias("field"), "seq")


FINDINGS = """f AS (SELECT entity_id, CASE WHEN seq % 50 = 0 THEN 'V6_completeness' WHEN seq % 3 = 0 THEN 'V5_firm_is_fo' ELSE 'V4_contradiction' END AS check_id, CASE WHEN seq % 41 = 0 THEN 'fatal' WHEN seq % 37 = 0 THEN 'warn' ELSE 'info' END AS severity, field_name AS field, seq FROM v_ledger)"""


WAVES = "CASE WHEN seq % 7 < 2 AND entity_id % 3 > 0 THEN CAST(1 + seq % 2 AS STRING) ELSE '0' END"
#: Findings of wave 0 and of a later run: most rows are in one of them, some claims in both, some findings name no claim.
NAMED = "SELECT *, CASE WHEN seq % 6 > 0 THEN 'k' || CAST(seq % 11 AS STRING) END AS claim_id FROM f"


@query("val14_skip_if_unchanged", "v_ledger", sql=f"""
WITH {FINDINGS}, g AS ({NAMED}), w AS (SELECT entity_id, bool_or({WAVES} IN ('1', '2')) AS rerun FROM v_ledger GROUP BY entity_id), o AS (SELECT * FROM g WHERE seq % 2 = 1), n AS (SELECT * FROM g WHERE seq % 2 = 0)
SELECT o.* FROM o JOIN w USING (entity_id) WHERE NOT rerun UNION ALL SELECT n.* FROM n JOIN w USING (entity_id) WHERE rerun
UNION ALL SELECT o.* FROM o JOIN w USING (entity_id) WHERE rerun AND check_id = 'V4_contradiction' AND NOT EXISTS (SELECT 1 FROM n WHERE n.entity_id = o.entity_id AND n.check_id = 'V4_contradiction' AND n.claim_id IS NOT DISTINCT FROM o.claim_id)""")
def val14(ledger):
    f = findings_of(ledger).withColumn("claim_id", F.when(F.col("seq") % 6 > 0, F.concat(F.lit("k"), (F.col("seq") % 11).cast("string"))))
    return V.skip_if_unchanged(ledger.select("entity_id", F.expr(WAVES).alias("wave")), f.filter("seq % 2 = 1"), f.filter("seq % 2 = 0"))


@query("val15_outcome", "v_ledger", sql=f"""
WITH {FINDINGS}, r AS (SELECT entity_id, max(CASE WHEN severity = 'fatal' AND check_id = 'V6_completeness' THEN 2 WHEN severity IN ('fatal', 'warn') THEN 1 ELSE 0 END) AS k FROM f GROUP BY entity_id)
SELECT entity_id, CASE k WHEN 2 THEN 'reject' WHEN 1 THEN 'ship_with_caveats' ELSE 'ship' END AS outcome FROM r""")
def val15(ledger):
    return V.outcome(findings_of(ledger), ledger)


KIND = "CASE seq % 3 WHEN 0 THEN 'an MFO' WHEN 1 THEN 'sfo' ELSE 'unclear' END"


@query("val16_type_final", "v_ledger", sql=f"""
WITH x AS (SELECT *, {KIND} AS said, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, seq) AS f, CASE WHEN status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted', 'superseded') THEN row_number() OVER (PARTITION BY entity_id, status IN ('could_not_verify', 'removed_failed_validation', 'contradicted', 'superseded') ORDER BY created_at DESC, seq DESC) END AS l FROM v_ledger WHERE question_id = 'G1.Q4'),
t AS (SELECT *, CASE WHEN said LIKE '%MFO%' THEN 'MFO' WHEN upper(said) LIKE '%SFO%' THEN 'SFO' ELSE 'type_unconfirmed' END AS ty FROM x)
SELECT a.entity_id, CASE WHEN a.status IN ('could_not_verify', 'removed_failed_validation', 'contradicted', 'superseded') THEN 'type_unconfirmed' ELSE a.ty END AS type_first,
 coalesce(b.ty, 'type_unconfirmed') AS type_last FROM t a LEFT JOIN t b ON a.entity_id = b.entity_id AND b.l = 1 WHERE a.f = 1""")
def val16(ledger):
    x = ledger.withColumn("answer", F.expr(KIND))
    return V.type_first(x).withColumnRenamed("type_final", "type_first").join(V.type_last_settled(x).withColumnRenamed("type_final", "type_last"), "entity_id")


@query("val17_domain_mx_findings", "v_entity", sql="""
SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'info' ELSE 'warn' END AS severity, CASE record_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'no_mx' ELSE 'unresolved' END AS detail FROM v_entity""")
def val17(entities):
    return V.domain_mx_findings(entities.select("record_id"), entities.filter("record_id % 3 < 2").select("record_id", (F.col("record_id") % 3 == 0).alias("has_mx")))


@query("val18_registration_recheck", "v_entity", sql="""
SELECT record_id, CASE WHEN record_id % 4 = 0 THEN 0 WHEN record_id % 4 = 1 THEN 0 ELSE record_id % 4 END AS hits, CASE WHEN record_id % 4 < 2 THEN 'warn' ELSE 'info' END AS severity FROM v_entity""")
def val18(entities):
    hits = entities.filter("record_id % 4 > 0").select("record_id", F.explode(F.sequence(F.lit(1), (F.col("record_id") % 4).cast("int"))).alias("n")).select("record_id", (F.col("record_id") % 4 == 1).alias("error"))
    return V.registration_recheck(entities, hits)


@query("val19_rejections", "v_ledger", sql=f"""
WITH {FINDINGS}, x AS (SELECT entity_id, bool_or(check_id = 'V5_firm_is_fo') AS at0, bool_or(check_id = 'V6_completeness') AS late, string_agg(check_id || ':' || coalesce(field, 'None'), ';' ORDER BY seq) AS codes, string_agg(DISTINCT field, ';' ORDER BY field) AS fields FROM f WHERE severity = 'fatal' GROUP BY entity_id)
SELECT entity_id, codes AS reason_code, 'wave0' AS stage FROM x WHERE at0 UNION ALL SELECT entity_id, coalesce(fields, 'V6_completeness'), 'final' FROM x WHERE late""")
def val19(ledger):
    f = findings_of(ledger)
    return V.rejections(f, "wave0").unionByName(V.rejections(f, "final"))
