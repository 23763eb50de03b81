"""Queries of entity resolution and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD
from ..operators import resolve as R
from .registry import query

SQUEEZE = lambda c: f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"
SPOKEN = lambda c: SQUEEZE(f"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^{WORD}{SPACE}]', ' ', 'g')")
NORM = f"upper(replace({SQUEEZE('name_raw')}, 'ß', 'ss'))"
CORE = SPOKEN(rf"regexp_replace(name_raw, '{R.LAST_SUFFIX}', '\1')")
GEN = ", ".join(f"'{g}'" for g in R.GENERIC)
TOKENS = f"list_sort(list_distinct(list_filter(list_transform(string_split({SQUEEZE('name_raw')}, ' '), lambda t: lower(trim(t, '.,&'))), lambda t: t NOT IN ({GEN}) AND length(t) > 1)))"

# names as registers and pages spell them: other scripts and spaces, suffixes with and without dots, one or several of them
SPELT = "CASE record_id % 13 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate([
    "'\t ' || name_raw || '　'", "'Noël & Söhne ' || name_raw", "name_raw || ' L.L.C.'", "name_raw || ' Inc, Co'", "name_raw || ',LLC.'", "'DISCO'", "name_raw || ' Holdings Group, Limited'", "'Weißer ' || name_raw || ' CO'",
    "'(' || name_raw || '), Corp\n'", "'The Inc'", "''", "'Company ' || name_raw || ' GROUP'",
])) + " ELSE name_raw END"
NAMES = f"(SELECT record_id, {SPELT} AS name_raw FROM v_entity)"


def spelt(e):
    return e.select("record_id", F.expr(SPELT).alias("name_raw"))


@query("er01_normalize_name", "v_entity", sql=f"SELECT record_id, {NORM} AS name, 'disc_' || substring(sha1({NORM}), 1, 16) AS entity_id FROM {NAMES} AS s")
def er01(e):
    return spelt(e).select("record_id", R.normalize_name(F.col("name_raw")).alias("name"), R.entity_id(F.col("name_raw")).alias("entity_id"))


@query("er02_build_entities", "v_entity", sql=f"""
WITH n AS (SELECT 'disc_' || substring(sha1({NORM}), 1, 16) AS entity_id, CASE WHEN seq % 2 = 0 THEN name_raw ELSE upper(name_raw) END AS name, seq FROM v_entity),
c AS (SELECT entity_id, arg_min(name, seq) AS canonical_name, min(seq) AS first_seq FROM n GROUP BY entity_id)
SELECT entity_id, canonical_name, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (name <> canonical_name), '') AS aliases, first_seq FROM n JOIN c USING (entity_id) GROUP BY entity_id, canonical_name, first_seq""")
def er02(e):
    return R.build_entities(e.select("seq", F.when(F.col("seq") % 2 == 0, F.col("name_raw")).otherwise(F.upper("name_raw")).alias("name_raw")))


FEED = """SELECT seq, entity_id, CASE source_class WHEN '13f_filing' THEN 'edgar_13f' WHEN '5500_filing' THEN 'dol_5500' WHEN 'adv_name' THEN NULL ELSE source_class END AS discovery_class, CASE WHEN seq % 11 > 0 THEN filed_year END AS filed_year, filed_qtr,
 CASE seq % 3 WHEN 0 THEN CAST(value_usd AS STRING) WHEN 1 THEN '' END AS table_value_total, CASE WHEN seq % 7 > 0 THEN prior_value_usd END AS aum_13f, participant_count AS position_count, CASE WHEN seq % 5 > 0 THEN CAST(filed_year AS STRING) ELSE '' END AS plan_year,
 participant_count, CASE WHEN seq % 4 = 0 THEN '523920' END AS naics, 'src-' || CAST(seq % 100 AS STRING) AS discovery_source_id, state, CASE WHEN seq % 6 > 0 THEN CAST(seq AS STRING) || ' Main St' END AS address_raw,
 '{"n":' || CAST(participant_count AS STRING) || '}' AS signals, '[]' AS people, CAST(NULL AS STRING) AS raw_payload, retrieved_at FROM v_source"""


def members(**values):
    """A JSON object without its null members, as text."""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{k}\":' || {v}" for k, v in values.items()) + "], lambda x: x IS NOT NULL), ',') || '}'"


def quoted(c):
    return f"'\"' || replace({c}, '\"', '\\\"') || '\"'"


WHOLE = {"discovery_source_id": quoted("discovery_source_id"), "state": quoted("state")}
FILING = members(
    quarter="'\"' || CASE WHEN filed_qtr = 1 THEN CAST(filed_year - 1 AS STRING) || 'Q4' ELSE CAST(filed_year AS STRING) || 'Q' || CAST(filed_qtr - 1 AS STRING) END || '\"'",
    filed_in_quarter="'\"' || CAST(filed_year AS STRING) || 'Q' || CAST(filed_qtr AS STRING) || '\"'",
    value_usd="coalesce(nullif(table_value_total, ''), CAST(aum_13f AS STRING))", position_count="CAST(position_count AS STRING)", **WHOLE, address_raw=quoted("address_raw"),
)
PLAN = members(plan_year="nullif(plan_year, '')", participant_count="CAST(participant_count AS STRING)", naics=quoted("naics"), **WHOLE)
REST = members(signals=quoted("signals"), people=quoted("people"), state=WHOLE["state"], address_raw=quoted("address_raw"), discovery_source_id=WHOLE["discovery_source_id"], raw_payload=quoted("raw_payload"))


@query("er03_map_source", "v_source", sql=f"""
WITH f AS ({FEED}) SELECT seq, entity_id, CASE discovery_class WHEN 'edgar_13f' THEN '13f_filing' WHEN 'dol_5500' THEN '5500_filing' ELSE coalesce(discovery_class, 'unknown') END AS source_class,
 CASE discovery_class WHEN 'edgar_13f' THEN {FILING} WHEN 'dol_5500' THEN {PLAN} ELSE {REST} END AS payload, retrieved_at FROM f""")
def er03(s):
    return R.map_source(s.sparkSession.sql(FEED.replace("v_source", "{v_source}").replace("'{\"", "'{{\"").replace("'}'", "'}}'"), v_source=s))


@query("er04_holdings_quarter", "v_source", sql="SELECT filed_year, filed_qtr, CASE WHEN filed_qtr = 1 THEN CAST(filed_year - 1 AS STRING) || 'Q4' ELSE CAST(filed_year AS STRING) || 'Q' || CAST(filed_qtr - 1 AS STRING) END AS holdings, count(*) AS n FROM v_source GROUP BY 1, 2, 3")
def er04(s):
    return s.groupBy("filed_year", "filed_qtr", R.holdings_quarter(F.col("filed_year"), F.col("filed_qtr")).alias("holdings")).agg(F.count(F.lit(1)).alias("n"))


FAMILY = f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper(name_raw), '[.'']', '', 'g'), '[^A-Z0-9]+', ' ', 'g')), '^THE ', ''), '{R.LEGAL_TAIL}', ''), '{R.GENERIC_TAIL}', '')), '')"


@query("er05_cluster_names", "v_entity", sql=f"""
WITH t AS (SELECT seq, name_raw, {FAMILY} AS token FROM v_entity), l AS (SELECT token, (list(name_raw ORDER BY length(name_raw) DESC, seq))[1] AS leader, count(*) AS n FROM t WHERE token IS NOT NULL GROUP BY token)
SELECT token, leader, coalesce((SELECT string_agg(DISTINCT name_raw, '|' ORDER BY name_raw) FROM t WHERE t.token = l.token AND name_raw <> leader), '') AS aliases, n AS rows FROM l""")
def er05(e):
    return R.cluster_names(e)


@query("er06_cross_source_key", "v_entity", sql=f"""
WITH k AS (SELECT seq, record_id, CASE WHEN record_id % 10 = 0 THEN 'ein:' || CAST(record_id % 50 AS STRING) WHEN record_id % 10 = 1 THEN 'crd:' || CAST(record_id % 70 AS STRING) ELSE 'name:' || {CORE} || '|' || coalesce(hq_state, '') END AS cross_key FROM v_entity)
SELECT cross_key, min(record_id) AS record_id FROM k GROUP BY cross_key""")
def er06(e):
    x = e.withColumn("ein", F.when(F.col("record_id") % 10 == 0, (F.col("record_id") % 50).cast("string"))).withColumn("crd", F.when(F.col("record_id") % 10 == 1, (F.col("record_id") % 70).cast("string"))).withColumn("cik", F.lit(None).cast("string"))
    return R.cross_source_key(x).select("cross_key", "record_id")


@query("er07_core_name_phrase", "v_entity", sql=f"SELECT record_id, {CORE} AS phrase FROM {NAMES} AS s")
def er07(e):
    return spelt(e).select("record_id", R.core_name_phrase(F.col("name_raw")).alias("phrase"))


@query("er08_distinctive_tokens", "v_entity", sql=f"SELECT record_id, array_to_string({TOKENS}, ' ') AS tokens FROM {NAMES} AS s")
def er08(e):
    return spelt(e).select("record_id", F.array_join(F.array_sort(R.distinctive_tokens(F.col("name_raw"))), " ").alias("tokens"))


@query("er09_name_match", "v_entity", sql=f"""
WITH t AS (SELECT seq, {TOKENS} AS x FROM v_entity), q AS (SELECT seq AS query_id, x FROM t WHERE seq % 20 = 0)
SELECT query_id, seq, CASE WHEN len(list_intersect(q.x, t.x)) = len(q.x) OR len(list_intersect(q.x, t.x)) = len(t.x) THEN 'exact' ELSE 'partial' END AS match FROM q JOIN t ON len(list_intersect(q.x, t.x)) > 0""")
def er09(e):
    return R.name_match(e.filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("name_raw").alias("q_name")), e)


OTHER_NAME = "CASE seq % 6 WHEN 0 THEN 'Hollis' WHEN 1 THEN 'Ivor Hollis' WHEN 2 THEN 'jane DOE' WHEN 3 THEN 'Doe, John' WHEN 4 THEN '' ELSE 'O-Neil Li' END"


@query("er10_person_names_match", "v_mail", sql=f"""
WITH t AS (SELECT seq, list_distinct(regexp_extract_all(lower(principal_name), '[a-z]{{2,}}')) AS x, list_distinct(regexp_extract_all(lower({OTHER_NAME}), '[a-z]{{2,}}')) AS y FROM v_mail)
SELECT seq, coalesce(len(x) > 0 AND len(y) > 0 AND (list_has_all(x, y) OR list_has_all(y, x)), false) AS same FROM t""")
def er10(m):
    return m.select("seq", R.person_names_match(F.col("principal_name"), F.expr(OTHER_NAME)).alias("same"))


WHOLE_NAME = SQUEEZE("regexp_replace(lower(name_raw), '[.,]', ' ', 'g')")


@query("er11_normalize_entity_name", "v_entity", sql=f"""
WITH c AS (SELECT record_id, {WHOLE_NAME} AS p FROM {NAMES} AS s), r AS (SELECT record_id, p, regexp_replace(p, '{R.SUFFIX_RUN}', '') AS phrase FROM c), t AS (SELECT *, string_split(phrase, ' ') AS w FROM r)
SELECT record_id, phrase, array_to_string(list_filter(CASE WHEN w[1] = 'the' THEN w[2:] ELSE w END, lambda t: length(t) > 2), ' ') AS tokens, trim(p[length(phrase) + 1:]) AS corporate FROM t""")
def er11(e):
    return spelt(e).select("record_id", R.normalize_entity_name(F.col("name_raw")).alias("n")).select("record_id", "n.*")


# endings and beginnings that the patterns ask for, put to the names of the view
NAMED = "CASE record_id % 31 " + " ".join(f"WHEN {k} THEN '{w[0]}' || name_raw || '{w[1]}'" for k, w in enumerate([("", " Bancorp"), ("First ", " Savings"), ("", " Credit Union"), ("", ", N.A."), ("", " Trust Company"), ("", " Pension Plan"), ("", " Employees Retirement"), ("", " Life Co"), ("", " Casualty"), ("", " Fund, LLC"), ("", " Fund"), ("", " ETF"), ("", " Closed-End"), ("", " Securities, Inc"), ("", " Clearing"), ("", " Corp"), ("", " Incorporated"), ("City of ", ""), ("The State of ", ""), ("", " S.p.A."), ("", " OY"), ("", " A/S"), ("", " GmbH"), ("", " College"), ("", " Endowment")])) + " ELSE name_raw END"
ON = {"X.foreign": "replace(p, '.', '')"}
EXCL = ", ".join(f"CASE WHEN regexp_matches({ON.get(c, 'p')}, '{p}'){' AND record_id % 2 = 0' if c == 'X.public' else ''} THEN '{c}' END" for c, p in R.EXCLUSIONS.items())


@query("adm01_hard_exclusions", "v_entity", sql=f"WITH c AS (SELECT record_id, lower(trim({NAMED})) AS p FROM v_entity) SELECT record_id, coalesce(array_to_string(list_filter([{EXCL}], lambda x: x IS NOT NULL), ','), '') AS reasons FROM c")
def adm01(e):
    return R.hard_exclusions(e.select("record_id", F.expr(NAMED).alias("name_raw"), (F.col("record_id") % 2 == 0).alias("files_reports")))


@query("adm02_structural_exclusions", "v_source", sql="""
WITH s AS (SELECT entity_id, max(participant_count) AS retail, min(participant_count) AS hnw, CAST(sum(value_usd) AS BIGINT) * 3000 AS raum, string_agg(DISTINCT source_class, '+' ORDER BY source_class) AS classes, max(filed_year) AS plan_year FROM v_source GROUP BY entity_id)
SELECT entity_id, array_to_string(list_filter([CASE WHEN entity_id % 11 = 0 THEN 'broker_dealer' END, CASE WHEN retail > hnw AND raum < 1000000000 THEN 'retail_heavy' END, CASE WHEN classes = '13f_filing' THEN 'only_13f' END, CASE WHEN entity_id % 13 = 0 OR plan_year < 2001 - 5 THEN 'defunct' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def adm02(s):
    g = s.groupBy("entity_id").agg(F.max("participant_count").alias("retail"), F.min("participant_count").alias("hnw"), (F.sum("value_usd") * 3000).alias("raum"), F.array_join(F.array_sort(F.collect_set("source_class")), "+").alias("classes"), F.max("filed_year").alias("plan_year"))
    return R.structural_exclusions(g.withColumn("broker_dealer", F.col("entity_id") % 11 == 0).withColumn("defunct", F.col("entity_id") % 13 == 0).withColumn("as_of_year", F.lit(2001)))


@query("adm03_admit", "v_entity", sql="""
SELECT record_id, CASE WHEN record_id % 2 = 0 AND record_id % 3 = 0 THEN 'SFO' WHEN record_id % 5 < 3 AND record_id % 7 < 4 AND record_id % 2 = 1 THEN 'MFO' ELSE 'no' END AS admitted_as FROM v_entity""")
def adm03(e):
    flag = lambda t: F.expr(t)
    return R.admit(e.select("record_id", flag("record_id % 2 = 0").alias("anchor"), flag("record_id % 3 = 0").alias("operating"), flag("record_id % 5 < 3").alias("registered"), flag("record_id % 7 < 4").alias("self_described"), flag("record_id % 2 = 1").alias("multi_family")))


@query("adm04_evidence_bar", "v_source", sql="""
SELECT entity_id, count(DISTINCT source_class) AS classes, bool_or(source_class IN ('13f_filing', '5500_filing')) AS has_primary, bool_or(state IS NOT NULL) AS has_state,
 count(DISTINCT source_class) >= 2 AND bool_or(source_class IN ('13f_filing', '5500_filing')) AND bool_or(state IS NOT NULL) AS passes FROM v_source GROUP BY entity_id""")
def adm04(s):
    return R.evidence_bar(s, ["13f_filing", "5500_filing"])


@query("adm05_split_report", "v_entity", sql="SELECT entity_type, count(*) AS entities, greatest(0, CASE entity_type WHEN 'SFO' THEN 400 WHEN 'MFO' THEN 250 END - count(*)) AS shortfall FROM v_entity WHERE entity_type IN ('SFO', 'MFO') GROUP BY 1")
def adm05(e):
    return R.split_report(e.filter("entity_type IN ('SFO', 'MFO')"), {"SFO": 400, "MFO": 250})
