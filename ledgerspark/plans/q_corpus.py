"""Queries of the corpus build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from .registry import query

# fields and answers of every kind, put to the claims of the ledger
WIDE = ["investing_thesis", "investing_mandates", "fit_tags", "check_size_range", "recent_investments", "public_list_overlap", "discovery_class_b", "discovery_class_a", "sector_focus", "important_insight"]
FIELD = "CASE seq % 16 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(WIDE)) + " ELSE field_name END"
ANSWER = """CASE seq % 16 WHEN 0 THEN CASE WHEN seq % 3 = 0 THEN NULL ELSE 'We back founders' END WHEN 1 THEN '["energy","credit"]' WHEN 2 THEN 'climate' WHEN 3 THEN '$500K to $2M' WHEN 4 THEN CASE WHEN seq % 5 = 0 THEN '' ELSE 'Acme' END WHEN 5 THEN '["list a"]'
 WHEN 9 THEN CASE seq % 4 WHEN 1 THEN 'access_window' WHEN 3 THEN 'fresh_liquidity' ELSE 'other' END ELSE answer END"""
SETTLED = "status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted')"
LISTED = lambda v: f"CASE WHEN {v} LIKE '[%' THEN replace(replace(replace(replace({v}, '[', ''), ']', ''), '\"', ''), ',', '|') ELSE coalesce({v}, '') END"


AMOUNT = lambda x: f"CAST(TRY_CAST(replace(regexp_extract({x}, '([0-9][0-9,.]*)', 1), ',', '') AS DOUBLE) * CASE upper(regexp_extract({x}, '[0-9]\\s*([KkMmBb])', 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END AS BIGINT)"
PART = lambda i: AMOUNT(f"string_split_regex(check_size_range, '\\s+(?:to|-)\\s+')[{i}]")
KINDS_SAID = "CASE WHEN question_id = 'G1.Q4' THEN CASE seq % 5 WHEN 0 THEN 'an mfo' WHEN 1 THEN 'SFO' ELSE 'unclear' END"
SCALAR_SQL = [*C.SCALARS, "investing_thesis", "investing_mandates", "fit_tags", "public_list_overlap", "check_size_range", "important_insight"]


@query("cor01_build_records", "v_ledger", "v_entity", "v_run", "v_source", sql=f"""
WITH k AS (SELECT entity_id, {FIELD} AS field_name, {KINDS_SAID} ELSE {ANSWER} END AS answer, status, retrieved_at, created_at, seq, question_id FROM v_ledger),
l AS (SELECT *, CASE WHEN {SETTLED} THEN answer END AS v, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, seq DESC) AS n FROM k),
w AS (SELECT entity_id, {", ".join(f"max(v) FILTER (n = 1 AND field_name = '{f}') AS {f}" for f in SCALAR_SQL)}, {", ".join(f"max(status) FILTER (n = 1 AND field_name = '{f}') AS {f}_status" for f in C.CONTACTS)},
 min(CASE WHEN starts_with(field_name, 'discovery_class_') THEN substring(field_name, 17) END) AS discovery_class_primary,
 strftime(max(CAST(retrieved_at AS DATE)) FILTER (status NOT IN ('could_not_verify', 'removed_failed_validation') AND field_name IN ({", ".join(f"'{f}'" for f in C.DATE_FIELDS)})), '%Y-%m-%d') AS latest_signal,
 CASE WHEN bool_or(field_name IS NOT NULL AND status = 'verified') THEN 'verified_evidence_present' WHEN bool_or(field_name IS NOT NULL AND status IN ('single_source', 'confirmed', 'format_only')) THEN 'single_source_only' ELSE 'thin' END AS record_confidence FROM l GROUP BY entity_id),
o AS (SELECT entity_id, arg_max(state, seq) AS outcome FROM v_run GROUP BY 1), h AS (SELECT entity_id, upper(substring(arg_max(state, (retrieved_at, seq)), 1, 2)) AS hq_state FROM v_source WHERE state IS NOT NULL GROUP BY entity_id),
t AS (SELECT entity_id, CASE WHEN arg_max(answer, (created_at, seq)) LIKE '%mfo%' THEN 'MFO' WHEN arg_max(answer, (created_at, seq)) = 'SFO' THEN 'SFO' END AS ty FROM k WHERE question_id = 'G1.Q4' AND status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted', 'superseded') GROUP BY 1)
SELECT w.entity_id, {", ".join(C.SCALARS)}, {", ".join(f"{f}_status" for f in C.CONTACTS)}, {LISTED("coalesce(investing_thesis, investing_mandates)")} AS mandates, {LISTED("fit_tags")} AS fit_tags, {LISTED("public_list_overlap")} AS public_list_overlap, {PART(1)} AS check_size_min, {PART(2)} AS check_size_max,
 CASE important_insight WHEN 'fresh_liquidity' THEN 'high' WHEN 'access_window' THEN 'medium' ELSE CASE WHEN important_insight IS NOT NULL THEN 'low' END END AS urgency_tier, CASE WHEN recent_investments <> '' THEN 'active' END AS activity_status, discovery_class_primary, 'US' AS hq_country, latest_signal, record_confidence,
 trim(e.name_raw) AS entity_name, outcome, h.hq_state, coalesce(ty, 'type_unconfirmed') AS entity_type FROM w LEFT JOIN (SELECT record_id, name_raw FROM v_entity) e ON e.record_id = w.entity_id LEFT JOIN o ON o.entity_id = w.entity_id LEFT JOIN h ON h.entity_id = w.entity_id LEFT JOIN t ON t.entity_id = w.entity_id""")
def cor01(ledger, entities, runs, sources):
    claims = ledger.withColumns({"field_name": F.expr(FIELD), "answer": F.expr(f"{KINDS_SAID} ELSE {ANSWER} END")})
    named = entities.select(F.col("record_id").alias("entity_id"), F.trim("name_raw").alias("entity_name"))
    out = C.build_records(claims, named, runs.select("entity_id", F.col("state").alias("outcome"), "seq"), sources)
    return out.withColumns({c: F.array_join(c, "|") for c in C.LISTS})


RANGES = "CASE doc_id % 7 WHEN 0 THEN '$500K to $2M' WHEN 1 THEN '$1,250 - $3B' WHEN 2 THEN 'about ' || CAST(doc_id AS STRING) || 'M' WHEN 3 THEN '$' || CAST(doc_id AS STRING) || '.5m to ' || CAST(doc_id * 3 AS STRING) || ' M' WHEN 4 THEN CAST(doc_id AS STRING) || ',000-2M' WHEN 5 THEN NULL ELSE 'open to all' END"


@query("cor02_parse_check_range", "v_doc", sql=f"WITH x AS (SELECT doc_id, string_split_regex({RANGES}, '\\s+(?:to|-)\\s+') AS p FROM v_doc) SELECT doc_id, {AMOUNT('p[1]')} AS low, {AMOUNT('p[2]')} AS high FROM x")
def cor02(d):
    return d.select("doc_id", C.parse_check_range(F.expr(RANGES)).alias("r")).select("doc_id", "r.low", "r.high")


@query("cor03_hq_state", "v_source", sql="SELECT entity_id, upper(substring(arg_max(state, (retrieved_at, seq)), 1, 2)) AS hq_state FROM v_source WHERE state IS NOT NULL GROUP BY entity_id")
def cor03(s):
    return C.hq_state(s)


DF = ", ".join(f"'{f}'" for f in C.DATE_FIELDS)
LIVE = "status NOT IN ('could_not_verify', 'removed_failed_validation')"


@query("cor04_record_signals", "v_ledger", sql=f"""
SELECT entity_id, strftime(max(CAST(retrieved_at AS DATE)) FILTER ({LIVE} AND field_name IN ({DF})), '%Y-%m-%d') AS latest_signal, CASE WHEN bool_or(status = 'verified') THEN 'verified_evidence_present' WHEN bool_or(status IN ('single_source', 'confirmed', 'format_only')) THEN 'single_source_only' ELSE 'thin' END AS record_confidence
FROM v_ledger GROUP BY entity_id""")
def cor04(ledger):
    return C.record_signals(ledger)


# records with every field known or not, as SQL; lists are texts with | between their parts
REC = {
    "entity_name": "trim(name_raw)", "entity_type": "CASE WHEN entity_type <> 'type_unconfirmed' THEN entity_type END", "hq_state": "hq_state", "hq_country": "CASE WHEN record_id % 4 = 0 THEN 'CA' END", "aum_usd": "CASE WHEN record_id % 6 > 0 THEN aum_usd END",
    "aum_basis": "CASE record_id % 3 WHEN 0 THEN '13F floor' WHEN 1 THEN '' END", "check_size_min": "CASE WHEN record_id % 5 = 1 THEN 250000 WHEN record_id % 5 = 2 THEN 0 END", "check_size_max": "CASE WHEN record_id % 10 < 3 THEN 5000000 END", "principal_name": "principal_name",
    "principal_title": "CASE WHEN record_id % 3 > 0 THEN 'Chair' END", "most_recent_signal_date": "CASE WHEN record_id % 7 = 0 THEN '2024-05-06' END", "urgency_tier": "CASE WHEN record_id % 5 > 2 THEN 'high' END", "record_confidence": "CASE WHEN record_id % 9 > 0 THEN 'thin' END",
}
REC_LISTS = {
    "public_list_overlap": "CASE WHEN record_id % 11 = 0 THEN 'list a|list b' END", "mandates": "CASE record_id % 7 WHEN 0 THEN 'energy|credit' WHEN 1 THEN 'We back founders.' WHEN 2 THEN 'Patient capital' END", "sector_focus": "CASE WHEN record_id % 8 = 0 THEN 'health' END",
    "stage_focus": "CASE WHEN record_id % 8 = 1 THEN 'seed|growth' END", "geography_focus": "CASE WHEN record_id % 8 = 2 THEN 'US' END", "fit_tags": "CASE WHEN record_id % 8 = 3 THEN 'x|y' END", "recent_investments": "CASE WHEN record_id % 6 = 0 THEN 'Acme|Beta' END", "recent_news": "CASE WHEN record_id % 6 = 1 THEN 'Moved' END",
}


def record(e):
    lists = [F.split(F.expr(x), r"\|").alias(c) for c, x in REC_LISTS.items()]
    return e.select("record_id", *[F.expr(x).alias(c) for c, x in REC.items()], *lists)


JOINED = lambda c: f"replace({c}, '|', ', ')"
LABEL = lambda label, c: f"CASE WHEN {c} <> '' THEN ' {label}: ' || {JOINED(c)} || '.' ELSE '' END"
USD = lambda c: f"'$' || format('{{:,}}', CAST({c} AS BIGINT))"
CHUNKS = f"""r AS (SELECT record_id, {", ".join(f"{x} AS {c}" for c, x in {**REC, **REC_LISTS}.items())} FROM v_entity),
t AS (SELECT *, CASE WHEN contains(mandates, '|') THEN ' Focus areas: ' || {JOINED("mandates")} || '.' WHEN mandates <> '' THEN ' ' || mandates || CASE WHEN regexp_matches(mandates, '[.!?]$') THEN '' ELSE '.' END ELSE '' END || {LABEL("Sector focus", "sector_focus")} || {LABEL("Stage focus", "stage_focus")} || {LABEL("Geography focus", "geography_focus")} || {LABEL("Fit tags", "fit_tags")}
 || CASE WHEN coalesce(check_size_min, 0) <> 0 OR coalesce(check_size_max, 0) <> 0 THEN ' Typical check size: ' || CASE WHEN coalesce(check_size_min, 0) <> 0 THEN {USD("check_size_min")} ELSE 'unspecified' END || ' to ' || CASE WHEN coalesce(check_size_max, 0) <> 0 THEN {USD("check_size_max")} ELSE 'unspecified' END || '.' ELSE '' END AS focus,
 {LABEL("Recent investments", "recent_investments")} || {LABEL("Recent news", "recent_news")} || {LABEL("Most recent dated signal", "most_recent_signal_date")} AS activity FROM r),
c AS (SELECT record_id, 'identity' AS facet, entity_name || ' is a ' || coalesce(entity_type, 'family office of unconfirmed type') || '.' || coalesce(' Headquartered in ' || hq_state || ', ' || coalesce(hq_country, 'US') || '.', '') || CASE WHEN coalesce(aum_usd, 0) <> 0 THEN ' Assets under management: approximately ' || {USD("aum_usd")} || CASE WHEN aum_basis <> '' THEN ' (' || aum_basis || ')' ELSE '' END || '.' ELSE '' END
 || coalesce(' Appears on public family-office lists: ' || {JOINED("public_list_overlap")} || '.', '') AS content FROM t
UNION ALL SELECT record_id, 'mandate', entity_name || '''s investing mandate.' || CASE WHEN focus <> '' THEN focus ELSE ' No investing thesis or mandate details have been confirmed for this record.' END FROM t
UNION ALL SELECT record_id, 'people', CASE WHEN principal_name <> '' THEN principal_name || ' is the named decision-maker at ' || entity_name || '.' || {LABEL("Title", "principal_title")} ELSE 'No named decision-maker has been confirmed for ' || entity_name || '.' END FROM t
UNION ALL SELECT record_id, 'activity', CASE WHEN activity <> '' THEN entity_name || ' activity.' || activity ELSE 'No recent activity signal has been confirmed for ' || entity_name || '.' END FROM t
UNION ALL SELECT record_id, 'why_now', CASE WHEN urgency_tier <> '' THEN entity_name || ' has an urgency tier of ' || urgency_tier || ', based on a dated signal in the record.' ELSE 'No specific why-now trigger has been confirmed for ' || entity_name || '.' END FROM t
UNION ALL SELECT record_id, 'summary', entity_name || ' (' || coalesce(entity_type, 'not confirmed') || ') — AUM ' || CASE WHEN coalesce(aum_usd, 0) <> 0 THEN {USD("aum_usd")} ELSE 'not confirmed' END || ', principal ' || coalesce(principal_name, 'not confirmed') || ', record confidence: ' || coalesce(record_confidence, 'None') || '.' FROM t)"""


@query("cor05_facet_chunks", "v_entity", sql=f"WITH {CHUNKS} SELECT * FROM c")
def cor05(e):
    return C.facet_chunks(record(e))


#: Texts with contacts of the record, of another one, and in other letters.
LEAKY = "content || CASE record_id % 7 WHEN 0 THEN ' Write to ' || coalesce(principal_email, '') WHEN 1 THEN ' Call ' || phone || '.' WHEN 2 THEN ' Mail ' || upper(coalesce(principal_email, '')) WHEN 3 THEN ' Call 212-555-9999' WHEN 4 THEN ' ' || coalesce(principal_email, '') || phone ELSE '' END"
PHONE_OF = "CASE WHEN record_id % 3 > 0 THEN '212-555-' || lpad(CAST(record_id % 10000 AS STRING), 4, '0') ELSE ' ' END"


@query("cor06_contact_leaks", "v_entity", sql=f"""
WITH {CHUNKS}, o AS (SELECT record_id, principal_email, {PHONE_OF} AS phone FROM v_entity), x AS (SELECT c.record_id, facet, principal_email, phone, {LEAKY.replace('record_id', 'c.record_id')} AS said FROM c JOIN o ON o.record_id = c.record_id)
SELECT record_id, facet, 'principal_email' AS field FROM x WHERE contains(said, principal_email) UNION ALL SELECT record_id, facet, 'principal_phone' FROM x WHERE trim(phone) <> '' AND contains(said, phone)""")
def cor06(e):
    own = e.select("record_id", "principal_email", F.expr(PHONE_OF).alias("phone"))
    chunks = C.facet_chunks(record(e)).join(own, "record_id").select("record_id", "facet", F.expr(LEAKY).alias("content"))
    return C.contact_leaks(chunks, own.withColumnRenamed("phone", "principal_phone"))


@query("cor07_embed_chunks", "v_entity")
def cor07(e):
    return C.embed_chunks(C.facet_chunks(e))


NAMES = "entity_id, entity_name, verdict, aum_usd, aum_basis, aum_as_of, investing_mandates, sector_focus, direct_vs_fund, recent_investments, why_now_trigger_concentration, why_now_trigger_liquidity, why_now_trigger_access_window, principal_name, principal_title, principal_phone, headcount, discovery_class, public_list_overlap".split(", ")


def imported(e):
    known = {"entity_id": F.col("record_id").cast("string"), "entity_name": F.trim("name_raw"), "verdict": F.col("outcome"), "aum_usd": F.concat(F.lit("$"), F.format_number("aum_usd", 0)), "investing_mandates": F.expr("CASE WHEN record_id % 2 = 0 THEN 'energy; credit' ELSE 'n/a' END"), "principal_name": F.coalesce("principal_name", F.lit("not found")), "principal_phone": F.lit("212-555-0100"), "discovery_class": F.col("discovery_class")}
    return C.csv_records(e.select(*[known.get(n, F.lit("")).alias(n) for n in NAMES]))


@query("cor08_csv_provenance", "v_entity", sql="""
SELECT CAST(record_id AS STRING) AS record_id, 'aum_usd' AS field_name, CAST(aum_usd AS STRING) AS value, 'csv_import' AS source_class, 'imported' AS status FROM v_entity UNION ALL SELECT CAST(record_id AS STRING), 'investing_mandates', 'energy, credit', 'csv_import', 'imported' FROM v_entity WHERE record_id % 2 = 0
UNION ALL SELECT CAST(record_id AS STRING), 'principal_name', principal_name, 'csv_import', 'imported' FROM v_entity WHERE principal_name IS NOT NULL UNION ALL SELECT CAST(record_id AS STRING), 'discovery_class', discovery_class, 'csv_import', 'imported' FROM v_entity UNION ALL SELECT CAST(record_id AS STRING), 'verdict', outcome, 'csv_import', 'imported' FROM v_entity""")
def cor08(e):
    return C.csv_provenance(imported(e))


WORTH = "'$' || format('{:,}', aum_usd)"


@query("cor08_csv_chunks", "v_entity", sql=f"""
WITH r AS (SELECT CAST(record_id AS STRING) AS record_id, trim(name_raw) AS name, outcome, discovery_class, principal_name, record_id % 2 = 0 AS mandated, {WORTH} AS worth FROM v_entity)
SELECT record_id, 'identity' AS facet, name || ' is a family office / advisory entity (imported record, verdict: ' || outcome || '). Assets under management: ' || worth || '. Discovery sources: ' || discovery_class || '.' AS content FROM r
UNION ALL SELECT record_id, 'mandate', name || '''s investing mandate and focus. ' || CASE WHEN mandated THEN 'Mandates: energy, credit.' ELSE 'No mandate details in the record.' END FROM r
UNION ALL SELECT record_id, 'people', CASE WHEN principal_name IS NULL THEN 'No named decision-maker in the record for ' || name || '.' ELSE principal_name || ' is the named contact at ' || name || '.' END FROM r
UNION ALL SELECT record_id, 'activity', 'No recent activity recorded for ' || name || '.' FROM r
UNION ALL SELECT record_id, 'why_now', 'No specific why-now trigger recorded for ' || name || '.' FROM r
UNION ALL SELECT record_id, 'summary', name || ': imported ' || outcome || ' record. AUM ' || worth || '. Principal: ' || coalesce(principal_name, 'not named') || '.' FROM r""")
def cor08_chunks(e):
    return C.csv_chunks(imported(e))


@query("cor09_merge_sources", "v_entity", sql="SELECT record_id, CASE WHEN discovery_class IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'pipeline' ELSE 'csv' END AS source FROM v_entity")
def cor09(e):
    return C.merge_sources(e.filter("discovery_class IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')").select("record_id", F.lit("pipeline").alias("source")), e.select("record_id", F.lit("csv").alias("source")))


# what is stored, and a delta of every second class; the sides overlap and cover all rows
DELTA_OF = "discovery_class IN ('BUILDING', 'AUTOMOBILE')"
BASE_OF = "NOT (discovery_class = 'BUILDING' AND entity_type = 'SFO' AND hq_state = 'TX')"


@query("cor10_merge_records", "v_entity", sql=f"""
WITH b AS (SELECT record_id, name_raw, hq_state, aum_usd, CASE WHEN outcome = 'ship' THEN 'csv' ELSE 'pipeline' END AS source, 'old' AS build_hash FROM v_entity WHERE coalesce({BASE_OF}, true)),
d AS (SELECT record_id, 'new' AS name_raw, 'ZZ' AS hq_state, aum_usd + 1 AS aum_usd, 'pipeline' AS source, 'new' AS build_hash FROM v_entity WHERE {DELTA_OF})
SELECT coalesce(b.record_id, d.record_id) AS record_id, CASE WHEN b.record_id IS NOT NULL THEN b.name_raw ELSE d.name_raw END AS name_raw, CASE WHEN b.record_id IS NOT NULL THEN b.hq_state ELSE d.hq_state END AS hq_state, CASE WHEN d.record_id IS NULL THEN b.aum_usd ELSE d.aum_usd END AS aum_usd,
 coalesce(d.source, b.source) AS source, coalesce(d.build_hash, b.build_hash) AS build_hash FROM b FULL JOIN d ON b.record_id = d.record_id WHERE NOT (d.record_id IS NULL AND b.source = 'pipeline')""")
def cor10(e):
    base = e.filter(f"coalesce({BASE_OF}, true)").select("record_id", "name_raw", "hq_state", "aum_usd", F.expr("CASE WHEN outcome = 'ship' THEN 'csv' ELSE 'pipeline' END").alias("source"), F.lit("old").alias("build_hash"))
    delta = e.filter(DELTA_OF).select("record_id", F.lit("new").alias("name_raw"), F.lit("ZZ").alias("hq_state"), (F.col("aum_usd") + 1).alias("aum_usd"), F.lit("pipeline").alias("source"), F.lit("new").alias("build_hash"))
    return C.merge_records(base, delta, prune=True)


@query("cor10_merge_chunks", "v_entity", sql=f"""
WITH {CHUNKS} SELECT c.record_id, facet, CASE WHEN {DELTA_OF} THEN content ELSE 'old ' || facet END AS content FROM c JOIN v_entity e ON e.record_id = c.record_id WHERE outcome <> 'reject'""")
def cor10_chunks(e):
    old = C.facet_chunks(record(e)).withColumn("content", F.concat(F.lit("old "), "facet"))
    return C.merge_chunks(old, e.filter("outcome <> 'reject'").select("record_id"), record(e.filter(DELTA_OF)), embed=None)


@query("cor11_dataset_meta", "v_entity", sql="""
WITH p AS (SELECT discovery_class, count(*) AS n, sum(CAST('0x' || substr(sha1(CAST(record_id AS STRING)), 1, 8) AS BIGINT)) AS h FROM v_entity GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS records, sha1(CAST(CAST(sum(h) AS BIGINT) AS STRING)) AS build_hash, string_agg(discovery_class || '=' || CAST(n AS STRING), ',' ORDER BY discovery_class) AS classes FROM p""")
def cor11(e):
    return C.dataset_meta(e).withColumn("classes", F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ","))


@query("cor12_corpus_health", "v_entity", sql="SELECT CASE WHEN record_id % 3 = 0 THEN 'csv' ELSE 'pipeline' END AS source, count(*) AS live, max('b' || CAST(record_id % 10 AS STRING)) AS newest_build FROM v_entity GROUP BY 1")
def cor12(e):
    return C.corpus_health(e.select(F.expr("CASE WHEN record_id % 3 = 0 THEN 'csv' ELSE 'pipeline' END").alias("source"), F.concat(F.lit("b"), (F.col("record_id") % 10).cast("string")).alias("build_hash")))


@query("cor13_provenance_table", "v_ledger", sql="SELECT entity_id AS record_id, field_name, answer AS value, source_url, source_class, status, confidence FROM v_ledger")
def cor13(ledger):
    return C.provenance_table(ledger)
