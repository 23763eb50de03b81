"""Queries of facts and derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD
from ..operators import facts as X
from .q_cells import TIER
from .q_ledger import RANK_SQL
from .q_resolve import CORE, SQUEEZE
from .registry import query

LASTC = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source_class ORDER BY retrieved_at DESC, seq DESC) AS n FROM v_source) WHERE n = 1)"
HQ = "CASE WHEN filed_qtr = 1 THEN CAST(filed_year - 1 AS STRING) || 'Q4' ELSE CAST(filed_year AS STRING) || 'Q' || CAST(filed_qtr - 1 AS STRING) END"
DELTA = "floor(CAST((value_usd - prior_value_usd) * 10000 AS DOUBLE) / nullif(abs(prior_value_usd), 0) + 0.5) / 100"


@query("fx01_latest_per_class", "v_source", sql=f"WITH {LASTC} SELECT entity_id, source_class, seq, value_usd FROM l")
def fx01(s):
    return X.latest_per_class(s).select("entity_id", "source_class", "seq", "value_usd")


@query("fx02_facts_5500", "v_source", sql=f"WITH {LASTC} SELECT entity_id, filed_year AS plan_year, participant_count FROM l WHERE source_class = '5500_filing'")
def fx02(s):
    return X.facts_5500(s)


# the adviser rows as index entries and the contributor rows as domain checks, with JSON payloads
PAYLOADS = """SELECT seq, entity_id, retrieved_at, CASE source_class WHEN 'adv_name' THEN 'adv_index' WHEN 'fec_employer' THEN 'domain_check' ELSE source_class END AS source_class,
 CASE WHEN source_class = 'adv_name' THEN '{"present":' || CASE WHEN seq % 3 = 0 THEN 'true' ELSE 'false' END || ',"client_count":' || CAST(participant_count AS STRING) || CASE WHEN seq % 2 = 0 THEN ',"crd":"' || CAST(seq AS STRING) || '"}' ELSE '}' END
  WHEN source_class = 'fec_employer' THEN '{"domain":"fam' || CAST(seq AS STRING) || '.com"' || CASE WHEN seq % 4 = 0 THEN '}' ELSE ',"mx_present":' || CASE WHEN seq % 3 = 0 THEN 'true' ELSE 'false' END || '}' END END AS payload FROM v_source"""


def payloads(s):
    """Braces of SQL text are doubled for the formatter of spark.sql."""
    return s.sparkSession.sql(PAYLOADS.replace("{", "{{").replace("}", "}}").replace("v_source", "{v}"), v=s)


@query("fx02_facts_adv_index", "v_source", sql=f"WITH {LASTC} SELECT entity_id, seq % 3 = 0 AS adv_present, participant_count AS adv_client_count, CASE WHEN seq % 2 = 0 THEN CAST(seq AS STRING) END AS adv_crd FROM l WHERE source_class = 'adv_name'")
def fx02_adv(s):
    return X.facts_adv_index(payloads(s))


@query("fx02_facts_domain", "v_source", sql=f"WITH {LASTC} SELECT entity_id, 'fam' || CAST(seq AS STRING) || '.com' AS domain, CASE WHEN seq % 4 > 0 THEN seq % 3 = 0 END AS domain_mx_present FROM l WHERE source_class = 'fec_employer'")
def fx02_domain(s):
    return X.facts_domain(payloads(s))


@query("fx03_facts_13f", "v_source", sql=f"WITH {LASTC} SELECT entity_id, value_usd, {HQ} AS quarter, CAST({DELTA} AS DOUBLE) AS qoq_delta_pct FROM l WHERE source_class = '13f_filing'")
def fx03(s):
    return X.facts_13f(s)


@query("fx04_facts_conference", "v_source", sql="""
SELECT entity_id, string_agg(CAST(seq AS STRING) || ':' || strftime(retrieved_at, '%Y-%m-%d') || ':' || CAST(value_usd AS STRING), ';' ORDER BY seq) AS sightings FROM v_source WHERE source_class = 'conference_sighting' GROUP BY entity_id""")
def fx04(s):
    shown = F.transform("sightings", lambda x: F.concat_ws(":", x["seq"].cast("string"), F.date_format(x["date"], "yyyy-MM-dd"), x["value_usd"].cast("string")))
    return X.facts_conference(s).select("entity_id", F.array_join(shown, ";").alias("sightings"))


@query("fx05_facts_adv_name", "v_source", sql="SELECT entity_id, arg_max(value_usd, (retrieved_at, seq)) AS latest_value, arg_min(state, CASE WHEN state IS NOT NULL THEN seq END) AS first_state FROM v_source WHERE source_class = 'adv_name' GROUP BY entity_id")
def fx05(s):
    return X.facts_adv_name(s)


@query("fx06_facts_fec", "v_source", sql="""SELECT entity_id, max(participant_count) AS contributors, strftime(min(retrieved_at), '%Y-%m-%d') AS first_date, strftime(max(retrieved_at), '%Y-%m-%d') AS last_date, coalesce(string_agg(DISTINCT state, ',' ORDER BY state), '') AS states FROM v_source WHERE source_class = 'fec_employer' GROUP BY entity_id""")
def fx06(s):
    return X.facts_fec(s)


@query("fx07_injected_facts", "v_source", sql=f"""WITH {LASTC} SELECT entity_id, coalesce(max(value_usd) FILTER (source_class = 'fec_employer'), max(value_usd) FILTER (source_class = 'adv_name'), max(value_usd) FILTER (source_class = 'conference_sighting'), max(value_usd) FILTER (source_class = '5500_filing'), max(value_usd) FILTER (source_class = '13f_filing')) AS value_usd,
 count(DISTINCT source_class) AS source_class_count FROM l GROUP BY entity_id""")
def fx07(s):
    return X.injected_facts(s)


LEADS = "CASE WHEN source_class = 'adv_name' THEN 'website' ELSE 'person' END"


# ten neighbouring ids are one entity and there are 97 values, so that entities have more than ten seeds
TEN = "entity_id - entity_id % 10"


@query("fx08_unverified_leads", "v_source", sql=f"""
WITH d AS (SELECT {TEN} AS entity_id, {LEADS} AS kind, CAST(value_usd % 97 AS STRING) AS value, min(seq) AS seq FROM v_source WHERE source_class NOT IN ('13f_filing', '5500_filing', 'conference_sighting') GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq, kind, value) AS place FROM d) SELECT * FROM p WHERE place <= 10""")
def fx08(s):
    return X.unverified_leads(s.select(F.expr(TEN).alias("entity_id"), "source_class", F.expr(LEADS).alias("kind"), (F.col("value_usd") % 97).cast("string").alias("value"), "seq"))


@query("fx09_pre_answer_claims", "v_source", sql=f"""
WITH {LASTC} SELECT entity_id, 'G1.Q4' AS question_id, 'MFO (ADV-registered, ' || CAST(participant_count AS STRING) || ' HNW clients)' AS answer, source_class FROM l WHERE source_class = 'adv_name' AND participant_count >= 15
UNION ALL SELECT entity_id, 'G3.Q1', '13F value $' || format('{{:,}}', value_usd) || ' (' || {HQ} || ')', source_class FROM l WHERE source_class = '13f_filing'
UNION ALL SELECT entity_id, 'G1.Q6', 'Active per Form 5500 filing for plan year ' || CAST(filed_year AS STRING), source_class FROM l WHERE source_class = '5500_filing'
UNION ALL SELECT entity_id, 'G3.Q2', 'Conference sighting on ' || strftime(retrieved_at, '%Y-%m-%d'), source_class FROM l WHERE source_class = 'conference_sighting'""")
def fx09(s):
    return X.pre_answer_claims(s)


NO_13F = "entity_id NOT IN (SELECT entity_id FROM l WHERE source_class = '13f_filing')"
AUM = f"""SELECT entity_id, 'aum_usd' AS field_name, CAST(value_usd AS STRING) AS answer, 'derived_13f' AS extraction_method FROM l WHERE source_class = '13f_filing'
UNION ALL SELECT entity_id, 'aum_basis', '13f_floor', 'derived_13f' FROM l WHERE source_class = '13f_filing' UNION ALL SELECT entity_id, 'aum_as_of', {HQ}, 'derived_13f' FROM l WHERE source_class = '13f_filing'
UNION ALL SELECT entity_id, 'aum_usd', CAST(value_usd AS STRING), 'adv_raum' FROM l WHERE source_class = 'adv_name' AND {NO_13F} UNION ALL SELECT entity_id, 'aum_basis', 'adv_raum', 'adv_raum' FROM l WHERE source_class = 'adv_name' AND {NO_13F}
UNION ALL SELECT entity_id, 'aum_as_of', strftime(retrieved_at, '%Y-%m-%d'), 'adv_raum' FROM l WHERE source_class = 'adv_name' AND {NO_13F}"""


@query("der01_aum_claims", "v_source", sql=f"WITH {LASTC} {AUM}")
def der01(s):
    return X.aum_claims(s)


TRIG = f"SELECT entity_id, CASE WHEN d <= -25 THEN 'concentration_pain' ELSE 'fresh_liquidity' END AS trigger, d AS qoq_delta_pct FROM (SELECT entity_id, CAST({DELTA} AS DOUBLE) AS d FROM l WHERE source_class = '13f_filing') WHERE abs(d) >= 25"


@query("der02_why_now_from_delta", "v_source", sql=f"WITH {LASTC} {TRIG}")
def der02(s):
    return X.why_now_from_delta(s)


@query("der03_headcount_claim", "v_source", sql=f"WITH {LASTC} SELECT entity_id, 'headcount' AS field_name, CAST(participant_count AS STRING) AS answer, 'derived_5500' AS extraction_method FROM l WHERE source_class = '5500_filing'")
def der03(s):
    return X.headcount_claim(s)


TODAY = "1998-01-01"


@query("der04_access_window", "v_source", sql=f"SELECT entity_id, seq, strftime(retrieved_at, '%Y-%m-%d') AS day FROM v_source WHERE source_class = 'conference_sighting' AND CAST(retrieved_at AS DATE) > DATE '{TODAY}'")
def der04(s):
    return X.access_window(s, TODAY)


#: Three people for every source row, some without a name, with titles under several keys.
PEOPLE = """SELECT seq, entity_id, source_class, place, CASE (seq + place) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Jane Doe' ELSE 'P' || CAST(seq % 50 AS STRING) || ' Roe' END AS name, CASE seq % 3 WHEN 0 THEN 'HOLLIS, IVOR' WHEN 1 THEN '' END AS full_name,
 CASE (seq + place) % 5 WHEN 0 THEN 'CEO' WHEN 1 THEN '' WHEN 2 THEN 'Jane Doe' END AS title, CASE (seq + place) % 7 WHEN 0 THEN 'Investor' END AS occupation, CASE seq % 2 WHEN 0 THEN 'Chair' END AS role FROM v_source, (SELECT {places} AS place)"""
FIRST_PERSON = f"""pe AS ({PEOPLE.format(places="unnest([0, 1, 2])")}), fp AS (SELECT seq, entity_id, source_class, coalesce(nullif(name, ''), nullif(full_name, '')) AS principal_name, coalesce(nullif(title, ''), nullif(occupation, ''), nullif(role, '')) AS title FROM pe WHERE coalesce(nullif(name, ''), nullif(full_name, '')) IS NOT NULL AND source_class IN ('adv_name', 'fec_employer')
 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY place) = 1)"""


def people(s):
    return s.sparkSession.sql(PEOPLE.format(places="explode(array(0, 1, 2))").replace("v_source", "{v}"), v=s)


@query("der05_principal_from_people", "v_source", sql=f"WITH {FIRST_PERSON} SELECT * FROM fp")
def der05(s):
    return X.principal_from_people(people(s))


@query("der06_discovery_class_claims", "v_source", sql="SELECT DISTINCT entity_id, 'discovery_class_' || source_class AS field_name FROM v_source")
def der06(s):
    return X.discovery_class_claims(s)


@query("der07_public_list_overlap", "v_entity", sql="""
WITH n AS (SELECT record_id, upper(trim(name_raw)) AS name FROM v_entity UNION SELECT record_id, upper(trim(principal_name)) FROM v_entity WHERE principal_name IS NOT NULL), l AS (SELECT DISTINCT upper(trim(name_raw)) AS name FROM v_entity WHERE seq % 7 = 0)
SELECT record_id, string_agg(DISTINCT name, '|' ORDER BY name) AS overlap FROM n JOIN l USING (name) GROUP BY record_id""")
def der07(e):
    return X.public_list_overlap(e.select("record_id", F.array_compact(F.array("name_raw", "principal_name")).alias("names")), e.filter("seq % 7 = 0").select(F.col("name_raw").alias("name")))


TITLES = "CASE record_id % 6 WHEN 0 THEN 'Founder and CEO' WHEN 1 THEN 'Managing Partner' WHEN 2 THEN 'Receptionist' WHEN 3 THEN 'Vice President' WHEN 4 THEN 'CFO' END"
ROLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '\\b({'|'.join(g)})\\b') THEN {i}" for i, g in enumerate(X.ROLES)) + f" ELSE {len(X.ROLES)} END"


@query("der08_role_rank", "v_entity", sql=f"SELECT record_id, {ROLE_SQL} AS rank FROM (SELECT record_id, {TITLES} AS t FROM v_entity)")
def der08(e):
    return e.select("record_id", X.role_rank(F.expr(TITLES)).alias("rank"))


K = "CAST(floor(seq / 12) AS BIGINT)"
#: The ledger as research leaves it: distilled values beside answers, with every way in which they can be missing or wrong.
RESEARCH = f"""SELECT seq, claim_id, entity_id, field_name, question_id, status, source_class, extraction_method, retrieved_at, created_at, CASE {K} % 4 WHEN 0 THEN NULL ELSE 'https://s' || CAST({K} % 3 AS STRING) END AS source_url,
 CASE question_id WHEN 'G2.Q1' THEN CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Ivor Hollis' ELSE ' DOE, Jane ' || CAST({K} % 7 AS STRING) END WHEN 'G2.Q2' THEN CASE {K} % 3 WHEN 0 THEN 'https://www.LinkedIn.com/in/x' || CAST(seq AS STRING) WHEN 1 THEN 'https://linkedin.com/company/y' END
  WHEN 'G2.Q3' THEN CASE {K} % 7 WHEN 0 THEN ' CEO ' WHEN 1 THEN 'No title could be determined' WHEN 2 THEN repeat('x', 81) WHEN 3 THEN 'Ivor Hollis' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'Partner' END WHEN 'G3.Q1' THEN CASE WHEN {K} % 2 = 0 THEN 'Bought ' || CAST(seq AS STRING) END WHEN 'G3.Q2' THEN CASE {K} % 3 WHEN 0 THEN 'fresh_liquidity' WHEN 1 THEN ' ' END END AS subject_value,
 CASE question_id WHEN 'G2.Q3' THEN CASE {K} % 6 WHEN 0 THEN 'Managing Partner' WHEN 1 THEN 'Hollis' WHEN 2 THEN 'Fam' || CAST(entity_id % 200 AS STRING) || ' LLC' WHEN 3 THEN NULL WHEN 4 THEN 'Analyst' ELSE 'Never a title' END WHEN 'G3.Q1' THEN CASE {K} % 5 WHEN 0 THEN 'No recent exits' WHEN 1 THEN 'Norwegian fund' WHEN 2 THEN '  ' ELSE '  They moved ' || CAST(seq AS STRING) END
  WHEN 'G3.Q2' THEN CASE {K} % 5 WHEN 0 THEN 'There are no hires' WHEN 1 THEN 'None' ELSE 'It grew ' END ELSE answer END AS answer FROM v_ledger"""
FIRMS = "SELECT record_id AS entity_id, name_raw AS firm FROM v_entity"


def research(ledger):
    return ledger.sparkSession.sql(RESEARCH.replace("v_ledger", "{v}"), v=ledger)


def firms(entities):
    return entities.select(F.col("record_id").alias("entity_id"), F.col("name_raw").alias("firm"))


NEGATIVE = lambda x: f"regexp_matches({SQUEEZE(f"regexp_replace(lower({x}), '[^{WORD}{SPACE}]+', ' ', 'g')")}, '^(no|none|not|never|unable|insufficient)( |$)|^there (is|are) no( |$)')"
MALFORMED = lambda x: f"(coalesce({x}, '') = '' OR length({x}) > 80 OR {NEGATIVE(x)})"
NAMES_OF = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z]{{2,}}'))"
SAME_PERSON = lambda x, y: f"coalesce(len({NAMES_OF(x)}) > 0 AND len({NAMES_OF(y)}) > 0 AND (list_has_all({NAMES_OF(x)}, {NAMES_OF(y)}) OR list_has_all({NAMES_OF(y)}, {NAMES_OF(x)})), false)"
CORE_OF = lambda x: CORE.replace("name_raw", f"coalesce({x}, '')")
IS_FIRM = lambda x, y: f"({CORE_OF(x)} <> '' AND {CORE_OF(y)} <> '' AND (contains({CORE_OF(y)}, {CORE_OF(x)}) OR contains({CORE_OF(x)}, {CORE_OF(y)})))"
PLAUSIBLE = lambda x, person, firm: f"(NOT {MALFORMED(x)} AND NOT {SAME_PERSON(x, person)} AND NOT {IS_FIRM(x, firm)})"
TRIMMED = lambda x: f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"
GOOD = "status IN ('confirmed', 'single_source', 'verified')"
PAIR = f"""rs AS ({RESEARCH}), rv AS (SELECT *, {TRIMMED('subject_value')} AS sv, {TRIMMED('answer')} AS av, {RANK_SQL} AS sr FROM rs),
tt AS (SELECT entity_id, source_url, coalesce(sv, av) AS t, claim_id AS title_id, sv IS NOT NULL AS title_distilled FROM rv WHERE {GOOD} AND question_id = 'G2.Q3' AND source_url <> '' QUALIFY row_number() OVER (PARTITION BY entity_id, source_url ORDER BY sr, retrieved_at DESC NULLS LAST, claim_id) = 1),
pr AS (SELECT rv.entity_id, subject_value AS principal_name, t AS principal_title, claim_id, title_id, title_distilled FROM rv LEFT JOIN tt ON rv.entity_id = tt.entity_id AND rv.source_url = tt.source_url WHERE {GOOD} AND question_id = 'G2.Q1' AND sv IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY rv.entity_id ORDER BY {ROLE_SQL}, sr, retrieved_at DESC NULLS LAST, claim_id) = 1)"""


@query("der09_project_people_pair", "v_ledger", sql=f"WITH {PAIR} SELECT * FROM pr")
def der09(ledger):
    return X.project_people_pair(research(ledger))


PROJECTED = f"""{PAIR}, fi AS ({FIRMS}), pf AS (SELECT pr.*, firm FROM pr LEFT JOIN fi USING (entity_id)),
be AS (SELECT * FROM rv WHERE question_id IN ('G2.Q1', 'G2.Q2', 'G2.Q3', 'G3.Q1', 'G3.Q2') QUALIFY row_number() OVER (PARTITION BY entity_id, question_id ORDER BY sr, retrieved_at DESC NULLS LAST, claim_id) = 1),
sa AS (SELECT entity_id, arg_min(sv, (created_at, seq)) AS person FROM rv WHERE question_id = 'G2.Q1' AND sv IS NOT NULL GROUP BY 1),
bf AS (SELECT be.*, person, firm, pr.entity_id IS NOT NULL AS paired FROM be LEFT JOIN sa ON sa.entity_id = be.entity_id LEFT JOIN fi ON fi.entity_id = be.entity_id LEFT JOIN pr ON pr.entity_id = be.entity_id WHERE {GOOD}),
every AS (SELECT entity_id, 'principal_name' AS field, principal_name AS answer, claim_id, 'G2.Q1' AS question_id FROM pf
 UNION ALL SELECT entity_id, 'principal_title', principal_title, title_id, 'G2.Q3' FROM pf WHERE principal_title IS NOT NULL AND CASE WHEN title_distilled THEN NOT {MALFORMED('principal_title')} ELSE {PLAUSIBLE('principal_title', 'principal_name', 'firm')} END
 UNION ALL SELECT entity_id, 'principal_title', coalesce(sv, av), claim_id, question_id FROM bf WHERE question_id = 'G2.Q3' AND NOT paired AND CASE WHEN sv IS NOT NULL THEN NOT {MALFORMED('sv')} ELSE {PLAUSIBLE('av', 'person', 'firm')} END
 UNION ALL SELECT entity_id, 'principal_linkedin', subject_value, claim_id, question_id FROM bf WHERE question_id = 'G2.Q2' AND sv IS NOT NULL AND contains(lower(sv), 'linkedin.com/in/')
 UNION ALL SELECT entity_id, CASE question_id WHEN 'G3.Q1' THEN 'recent_investments' ELSE 'important_insight' END, CASE WHEN sv IS NOT NULL THEN subject_value ELSE av END, claim_id, question_id FROM bf WHERE question_id IN ('G3.Q1', 'G3.Q2') AND (sv IS NOT NULL OR (av IS NOT NULL AND NOT {NEGATIVE('av')})))"""
SETTLED = "SELECT DISTINCT entity_id, field_name AS field FROM rs WHERE field_name IS NOT NULL AND regexp_matches(extraction_method, '^derived_(13f|5500|conference)') AND status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded')"


@query("der10_project_questions", "v_ledger", "v_entity", sql=f"WITH {PROJECTED}, sd AS ({SETTLED}) SELECT * FROM every WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.entity_id = every.entity_id AND sd.field = every.field)")
def der10(ledger, entities):
    return X.project_questions(research(ledger), firms(entities))


ABSENT = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(["'No recent exits'", "'Norwegian fund'", "'\"None\" found'", "'There are no hires'", "'Noël & Söhne bought in'", "' \nnever: ' || text", "'There''s no news'", "''"])) + " ELSE text END"


@query("der11_is_negative_answer", "v_doc", sql=f"SELECT doc_id, {NEGATIVE('s')} AS negative FROM (SELECT doc_id, {ABSENT} AS s FROM v_doc) AS t")
def der11(d):
    return d.select("doc_id", X.is_negative_answer(F.expr(ABSENT)).alias("negative"))


SAID_TITLES = "CASE record_id % 9 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Jane Doe' WHEN 2 THEN 'no title found' WHEN 3 THEN trim(name_raw) WHEN 4 THEN repeat('x', 90) WHEN 5 THEN 'Fam' || CAST(record_id % 200 AS STRING) WHEN 6 THEN NULL WHEN 7 THEN 'Chair of ' || name_raw ELSE 'LLC' END"


@query("der12_is_plausible_title", "v_entity", sql=f"""
WITH t AS (SELECT record_id, record_id % 9 AS k, name_raw, {SAID_TITLES} AS t FROM v_entity), c AS (SELECT *, {CORE.replace("name_raw", "coalesce(t, '')")} AS tp, {CORE} AS fp FROM t)
SELECT record_id, coalesce(tp <> '' AND fp <> '' AND (contains(fp, tp) OR contains(tp, fp)), false) AS firm, k IN (0, 5, 7, 8) AND NOT coalesce(tp <> '' AND fp <> '' AND (contains(fp, tp) OR contains(tp, fp)), false) AS plausible FROM c""")
def der12(e):
    t = F.expr(SAID_TITLES)
    return e.select("record_id", X.title_matches_firm(F.coalesce(t, F.lit("")), F.col("name_raw")).alias("firm"), X.is_plausible_title(t, F.lit("jane doe"), F.col("name_raw")).alias("plausible"))


PRIN = f"""p AS (SELECT *, {TIER} AS tier FROM v_ledger), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier, created_at, seq) AS n FROM p WHERE field_name = 'principal_name' AND trim(coalesce(answer, '')) <> '' AND status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded')) WHERE n = 1)"""


TITLED = f"""SELECT seq, claim_id, l.entity_id, field_name, extraction_method, status, created_at, firm, CASE field_name WHEN 'principal_name' THEN CASE {K} % 4 WHEN 0 THEN 'Ivor Hollis' WHEN 1 THEN ' ' ELSE 'DOE, Jane' END WHEN 'principal_title' THEN CASE {K} % 5 WHEN 0 THEN 'Hollis' WHEN 1 THEN firm WHEN 2 THEN 'Jane Doe' WHEN 3 THEN NULL ELSE 'CEO' END ELSE answer END AS answer,
 CASE {K} % 3 WHEN 0 THEN 'Jane DOE' WHEN 1 THEN 'Ivor Hollis' END AS owner FROM v_ledger l LEFT JOIN ({FIRMS}) f ON f.entity_id = l.entity_id"""
RECONCILE = lambda order: f"""wn AS (SELECT entity_id, arg_min(answer, (CASE WHEN extraction_method LIKE 'projected%' THEN 0 WHEN extraction_method LIKE 'derived%' THEN 1 ELSE 2 END, {order})) AS winner FROM c WHERE field_name = 'principal_name' AND {TRIMMED('answer')} IS NOT NULL GROUP BY 1),
rc AS (SELECT c.*, CASE WHEN field_name = 'principal_title' AND ({SAME_PERSON('answer', 'winner')} OR {IS_FIRM('answer', 'firm')} OR (winner IS NOT NULL AND coalesce(starts_with(extraction_method, 'derived_'), false) AND NOT {SAME_PERSON('owner', 'winner')})) THEN 'superseded' ELSE status END AS now FROM c LEFT JOIN wn ON wn.entity_id = c.entity_id)"""  # noqa: E731


@query("der13_reconcile_titles", "v_ledger", "v_entity", sql=f"WITH c AS ({TITLED}), {RECONCILE('created_at, seq')} SELECT claim_id, now AS status FROM rc")
def der13(ledger, entities):
    titled = ledger.sparkSession.sql(TITLED.replace("v_ledger", "{v}").replace("v_entity", "{e}"), v=ledger, e=entities)
    return X.reconcile_titles(titled, ["created_at", "seq"]).select("claim_id", "status")


@query("der14_select_principal", "v_ledger", sql=f"WITH {PRIN} SELECT entity_id, answer AS principal_name, claim_id FROM w")
def der14(ledger):
    return X.select_principal(ledger)


UUID5 = "concat(substr(h, 1, 12), '5', substr(h, 14, 3), substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INT) + 1, 1), substr(h, 18, 15))"
LISTED_NAMES = "SELECT DISTINCT upper(trim(name_raw)) AS name FROM v_entity WHERE record_id % 7 = 0"


@query("der15_wave_minus_1", "v_source", "v_ledger", "v_entity", sql=f"""
WITH {LASTC}, {FIRST_PERSON}, {PROJECTED}, a AS ({AUM}), t AS ({TRIG}), li AS ({LISTED_NAMES}),
ov AS (SELECT record_id AS entity_id, list_sort(list(DISTINCT name)) AS names FROM (SELECT record_id, upper(trim(unnest([name_raw, principal_name]))) AS name FROM v_entity) JOIN li USING (name) GROUP BY 1),
dv AS (SELECT entity_id, field_name, answer, extraction_method, CASE extraction_method WHEN 'adv_raum' THEN 'adv_name' ELSE '13f_filing' END AS source_class, NULL AS owner, 0 AS part, 0 AS ord, answer AS shown FROM a
 UNION ALL SELECT entity_id, 'important_insight', trigger, 'derived_13f_qoq', '13f_filing', NULL, 1, 0, trigger FROM t UNION ALL SELECT entity_id, 'headcount', CAST(participant_count AS STRING), 'derived_5500', '5500_filing', NULL, 2, 0, CAST(participant_count AS STRING) FROM l WHERE source_class = '5500_filing'
 UNION ALL SELECT entity_id, 'important_insight', 'access_window', 'derived_conference', 'conference_sighting', NULL, 3, 0, 'access_window' FROM v_source WHERE source_class = 'conference_sighting' AND CAST(retrieved_at AS DATE) > DATE '{TODAY}'
 UNION ALL SELECT entity_id, 'principal_name', principal_name, 'derived_' || source_class, source_class, NULL, 4, seq, principal_name FROM fp UNION ALL SELECT entity_id, 'principal_title', title, 'derived_' || source_class, source_class, principal_name, 4, seq, title FROM fp WHERE {TRIMMED('title')} IS NOT NULL
 UNION ALL SELECT DISTINCT entity_id, 'discovery_class_' || source_class, 'true', 'derived_entity_sources', source_class, NULL, 5, 0, 'True' FROM v_source
 UNION ALL SELECT entity_id, 'public_list_overlap', array_to_string(names, '|'), 'derived_public_list_match', 'public_list', NULL, 6, 0, '[' || array_to_string(list_transform(names, lambda x: chr(39) || x || chr(39)), ', ') || ']' FROM ov),
sd AS ({SETTLED} UNION SELECT entity_id, field_name FROM dv WHERE regexp_matches(extraction_method, '^derived_(13f|5500|conference)')),
pj AS (SELECT entity_id, field AS field_name, answer, 'projected_' || question_id AS extraction_method, source_class, NULL AS owner, 7 AS part, 0 AS ord, answer AS shown FROM every JOIN (SELECT claim_id, source_class FROM rs) USING (claim_id) WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.entity_id = every.entity_id AND sd.field = every.field)),
c AS (SELECT u.*, 'confirmed' AS status, firm FROM (SELECT * FROM dv UNION ALL SELECT * FROM pj) AS u LEFT JOIN fi ON fi.entity_id = u.entity_id), {RECONCILE('part, ord')},
hs AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', CAST(entity_id AS STRING), field_name, coalesce(source_class, 'None'), extraction_method, coalesce(shown, 'None')))) AS h FROM rc)
SELECT entity_id, {UUID5} AS claim_id, field_name, answer, extraction_method, source_class, now AS status FROM hs""")
def der15(s, ledger, e):
    entities = e.select("record_id", F.col("name_raw").alias("firm"), F.array_compact(F.array("name_raw", "principal_name")).alias("names"))
    return X.wave_minus_1(s, TODAY, people(s), entities, e.filter("record_id % 7 = 0").select(F.col("name_raw").alias("name")), research(ledger))
