"""Views over the supplied tables, in SQL that Spark and DuckDB read alike, and the helpers that build queries and their SQL on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Questions in the words of users, with places for a state, a code, a mandate, a number and a name.
QUESTIONS = [
    "How many SFOs are in <s>?", "Top <n> MFOs over $<n> million in <c>", "Who is <w> Family Office?", "offices between $1m and $<n> billion in <s>", "Which family offices invest in <m> or climate?",
    "Tell me about the largest <m> investors based in <s>", "single-family offices under <n>k, around 3.5 million", "What share of multi family offices over 2,500 thousand hold <m>", "first <n> firms at least $1.5b but less than <n> billion",
    "SFOs in <c> run by a director", "fintech and biotech offices near <s> with <m>", "number of records ~ <n>m", "list of <m> managers for <w>", "leading 30 offices 5-<n>m, XX or <c>", "", "<m> <m> over <n> above 7 at most 1.2.3b",
]
PLACES = ["Alabama", "Georgia", "New York", "West Virginia", "District of Columbia", "Washington DC", "North Dakota", "Texas", "Kansas", "Maine", "the Moon"]
CODES = ["AL", "GA", "NY", "WV", "DC", "ZZ", "TX"]
TOPICS = ["real estate", "tech", "biotech", "life sciences", "venture capital", "energy", "fintech", "fund of funds", "soft robotics", "climate", "impactful art", "direct credit"]


#: Names and addresses of people, in many spellings.
FIRST = ["Jane", "Al", "Reza", "Todd", "Mary Ann", "Li", "Shannon", "Thomas", "J", "O-Neil", "Bo", "Ivor"]
LAST = ["Doe", "Roe", "Rahimi", "Barlow", "Hale", "Ng", "Smithers-Jones", "Hollis", "de la Cruz", "Li", "Constantinopolis"]
SHARED = ["info", "No-Reply", "contacts+x", "_info", "Contact.Us", "adminvfo", "general", "hr", "help", "noreply+1"]
DOMAINS = ["fam.com", "mail.fam.com", "FAM.com", "www.fam.com", "fam.com", "other.com", "notfam.com", "fam.com"]


def pick(words: list[str], of: str) -> str:
    """One of the words by a number."""
    return f"CASE ({of}) % {len(words)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"


def mail() -> str:
    """v_mail: one address for every customer, eight customers a firm; each firm has a style and a principal who is one of the eight."""
    firm, k = "CAST(floor(c_custkey / 8) AS BIGINT)", "c_custkey"
    first, last = pick(FIRST, "p_first"), pick(LAST, "p_last")
    whole = f"CASE firm % 8 WHEN 0 THEN {first} || ' ' || {last} WHEN 1 THEN upper({last}) || ', ' || {first} || ' SR' WHEN 2 THEN 'Dr ' || {first} || ' ' || {last} || ' Jr.' WHEN 3 THEN {last} WHEN 4 THEN NULL WHEN 5 THEN {first} || ' Q. ' || {last} || ' III' WHEN 6 THEN '' ELSE ' ' || {first} || '  ' || {last} END"
    f, n = f"lower(replace({pick(FIRST, f'{k} * 7')}, ' ', ''))", f"lower(replace({pick(LAST, f'{k} * 5')}, ' ', ''))"
    local = f"CASE CASE WHEN {k} % 5 = 0 THEN {k} % 7 ELSE firm % 7 END WHEN 0 THEN {f} || '.' || {n} WHEN 1 THEN substring({f}, 1, 1) || '.' || {n} WHEN 2 THEN {f} WHEN 3 THEN substring({f}, 1, 1) || {n} WHEN 4 THEN {n} || '_' || {f} WHEN 5 THEN {pick(SHARED, k)} ELSE upper({f}) || '1' END"
    base = f"SELECT {k}, {firm} AS firm, {firm} * 56 + 21 AS p_first, {firm} * 40 + 15 AS p_last FROM customer"
    return f"SELECT {k} AS seq, firm, {whole} AS principal_name, CASE WHEN {k} % 41 = 0 THEN NULL ELSE {local} || '@' || {pick(DOMAINS, f'{k} * 3 + firm')} END AS email, 'https://fam.com/p' || CAST({k} % 3 AS STRING) AS url FROM ({base}) AS b"


def asked() -> str:
    """v_ask: one question for every customer."""
    text = pick(QUESTIONS, "c_custkey")
    for mark, value in (("s", pick(PLACES, "c_custkey")), ("c", pick(CODES, "c_custkey")), ("m", pick(TOPICS, "c_custkey")), ("n", "CAST(c_custkey % 400 AS STRING)"), ("w", "c_name")):
        text = f"replace({text}, '<{mark}>', {value})"
    return f"SELECT c_custkey AS query_id, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE {text} END AS query_text FROM customer"


VIEWS = {
    "v_ledger": """
SELECT event_id AS seq, 'c' || CAST(event_id AS STRING) AS claim_id, user_id AS entity_id,
 CASE event_type WHEN 'signup' THEN 'principal_name' WHEN 'click' THEN 'principal_title' WHEN 'view' THEN 'aum_usd'
  WHEN 'purchase' THEN 'important_insight' ELSE 'recent_news' END AS field_name,
 CASE event_id % 12 WHEN 0 THEN 'G1.Q1' WHEN 1 THEN 'G1.Q2' WHEN 2 THEN 'G1.Q3' WHEN 3 THEN 'G1.Q4' WHEN 4 THEN 'G1.Q5'
  WHEN 5 THEN 'G1.Q6' WHEN 6 THEN 'G2.Q1' WHEN 7 THEN 'G2.Q2' WHEN 8 THEN 'G2.Q3' WHEN 9 THEN 'G3.Q1' WHEN 10 THEN 'G3.Q2' END AS question_id,
 CASE event_id % 9 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'single_source' WHEN 3 THEN 'verified' WHEN 4 THEN 'could_not_verify'
  WHEN 5 THEN 'contradicted' WHEN 6 THEN 'pattern_inferred' WHEN 7 THEN 'superseded' ELSE 'removed_failed_validation' END AS status,
 CASE event_id % 7 WHEN 0 THEN '13f_filing' WHEN 1 THEN 'site_scrape' WHEN 2 THEN 'serper_organic' WHEN 3 THEN 'fec_employer' WHEN 4 THEN 'snov'
  WHEN 5 THEN 'gdelt' ELSE 'tool_unavailable' END AS source_class,
 CASE event_id % 5 WHEN 0 THEN 'projected_G2.Q1' WHEN 1 THEN 'derived_13f' WHEN 2 THEN 'jsonld' WHEN 3 THEN 'snov_error' END AS extraction_method,
 CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'view' THEN CAST(event_id % 4 * 1000000 AS STRING) ELSE 'Value ' || CAST(event_id % 4 AS STRING) END AS answer,
 CASE WHEN event_type = 'view' AND event_id % 17 <> 0 THEN CAST(event_id % 4 * 1000000 AS DOUBLE) END AS answer_num,
 'https://site' || CAST(event_id % 13 AS STRING) || '.example.com/p' AS source_url,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS retrieved_at, ts AS created_at, value AS cost_usd, props AS payload
FROM events""",
    "v_source": """
SELECT o_orderkey AS seq, o_custkey AS entity_id,
 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '13f_filing' WHEN '2' THEN '5500_filing' WHEN '3' THEN 'adv_name' WHEN '4' THEN 'fec_employer' ELSE 'conference_sighting' END AS source_class,
 CAST(round(o_totalprice) AS BIGINT) AS value_usd, CAST(o_orderkey % 7 * 50000 AS BIGINT) AS prior_value_usd,
 year(o_orderdate) AS filed_year, quarter(o_orderdate) AS filed_qtr, o_orderkey % 40 AS participant_count,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'Texas' ELSE 'ny' END AS state, o_orderdate AS retrieved_at
FROM orders""",
    "v_entity": """
SELECT c_custkey AS seq, c_custkey AS record_id,
 'The Fam' || CAST(c_custkey % 200 AS STRING) || CASE c_custkey % 6 WHEN 0 THEN ' Family Office LLC' WHEN 1 THEN '  family   office' WHEN 2 THEN ' Bank, N.A.'
  WHEN 3 THEN ' Wealth Advisors, Inc.' WHEN 4 THEN ' Investors Pty Ltd' ELSE ' Capital B.V.' END AS name_raw,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'SFO' WHEN 'MACHINERY' THEN 'MFO' ELSE 'type_unconfirmed' END AS entity_type,
 CASE c_nationkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'NY' WHEN 2 THEN 'CA' END AS hq_state,
 CAST(round(c_acctbal * 100000) AS BIGINT) AS aum_usd, c_mktsegment AS discovery_class,
 CASE WHEN c_custkey % 4 <> 0 THEN 'DOE, Jane ' || CAST(c_custkey % 50 AS STRING) END AS principal_name,
 CASE c_custkey % 5 WHEN 0 THEN '_info@fam.com' WHEN 1 THEN 'jane.doe@fam.com' WHEN 2 THEN 'Info+x@fam.com' END AS principal_email,
 CASE c_custkey % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'ship_with_caveats' ELSE 'reject' END AS outcome
FROM customer""",
    "v_cand": """
SELECT c_custkey AS entity_id, c_mktsegment AS discovery_class_primary, CAST(c_custkey % 23 AS BIGINT) AS actionability_score,
 CASE WHEN c_nationkey % 2 = 0 THEN 'SFO' ELSE 'MFO' END AS type_final, c_custkey % 4 AS verified_cell_count, c_custkey % 3 AS urgency_tier_rank, c_custkey % 5 AS discovery_class_count
FROM customer""",
    "v_chunk": """
SELECT d.doc_id AS chunk_id, d.doc_id % 100 AS record_id,
 CASE d.doc_id % 6 WHEN 0 THEN 'identity' WHEN 1 THEN 'mandate' WHEN 2 THEN 'people' WHEN 3 THEN 'activity' WHEN 4 THEN 'why_now' ELSE 'summary' END AS facet,
 d.text AS content, e.embedding AS embedding
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""",
    "v_run": """
SELECT event_id AS seq, 'r' || CAST(event_id % 40 AS STRING) AS run_id, user_id AS entity_id, event_type AS tool,
 CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'done' END AS state, event_id % 6 <> 0 AS ok,
 CAST(floor(value * 100) AS BIGINT) AS duration_ms, ts AS called_at
FROM events""",
    "v_query": """
SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'how many SFOs are in Texas' WHEN 1 THEN 'top ' || CAST(n_nationkey AS STRING) || ' MFOs over $' || CAST(n_nationkey + 1 AS STRING) || ' million'
  WHEN 2 THEN 'who is ' || n_name || ' Family Office' WHEN 3 THEN 'offices between $1m and $' || CAST(n_nationkey AS STRING) || ' billion in West Virginia' ELSE 'which family offices invest in real estate or fintech' END AS query_text
FROM nation""",
    "v_ask": asked(),
    "v_mail": mail(),
    "v_doc": "SELECT * FROM documents",
    "v_page": "SELECT * FROM pages",
    "v_answer": "SELECT * FROM conversations",
    "v_quote": "SELECT * FROM benchmark",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of sf_dir. Table names are resolved at once, so views of several folders can live together."""
    text = VIEWS[name]
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"ledgerspark_{table}")
            text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 ledgerspark_{table}", text)
    return spark.sql(text)


def oracle(sql: str) -> str:
    """SQL for DuckDB: the views that it names go before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    sql = sql.strip()
    if not head:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
