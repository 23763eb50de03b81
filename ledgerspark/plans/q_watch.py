"""Queries of the signals watch and the address audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.web import dedupe_key
from ..operators import watch as W
from .q_contacts import HOST, IS_ROLE, NEWS, PLAIN_LOCAL, WIDE
from .registry import query

KIND = "CASE field_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.KINDS.items()) + " END"
#: Ledger rows of the signal fields with values of every kind: prose, short ones, tokens, blanks.
FIELD = "CASE field_name WHEN 'aum_usd' THEN 'recent_investments' WHEN 'principal_title' THEN 'recent_key_hires' WHEN 'important_insight' THEN CASE WHEN seq % 2 = 0 THEN 'recent_fund_commitments' ELSE field_name END ELSE field_name END"
VALUE = "CASE seq % 8 WHEN 0 THEN 'META_TITLE_QUOTE' WHEN 1 THEN answer WHEN 2 THEN '   short   one ' WHEN 3 THEN NULL WHEN 4 THEN '            ' ELSE '  Opened an office in year ' || coalesce(answer, '') || chr(10) END"
PROV = f"SELECT seq, entity_id, {FIELD} AS field_name, status, {VALUE} AS answer, retrieved_at, source_url, source_class, confidence FROM v_ledger"
SIGNAL_LIST = ", ".join(f"'{f}'" for f in W.KINDS)
BASE = f"""pr AS ({PROV}), ok AS (SELECT *, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS v FROM pr WHERE field_name IN ({SIGNAL_LIST}) AND status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted')),
b AS (SELECT entity_id AS record_id, {KIND} AS kind, v AS title, CASE WHEN field_name = 'important_insight' THEN v END AS meaning, CAST(retrieved_at AS DATE) AS day, source_url, {HOST.replace('url', 'source_url')} AS source_domain, source_class AS source_name, confidence, field_name, seq FROM ok WHERE length(v) >= 12 AND NOT regexp_matches(v, '^[A-Z_]+$'))"""


def prov(ledger):
    return ledger.sparkSession.sql(PROV.replace("v_ledger", "{v}"), v=ledger)


@query("wat01_baseline_signals", "v_ledger", sql=f"WITH {BASE} SELECT * EXCLUDE (day), strftime(day, '%Y-%m-%d') AS day FROM b")
def wat01(ledger):
    return W.baseline_signals(prov(ledger)).withColumn("day", F.col("day").cast("string"))


@query("wat02_watch_board", "v_ledger", "v_entity", sql=f"""
WITH {BASE}, u AS (SELECT record_id, day FROM b UNION ALL SELECT record_id, day FROM b WHERE kind = 'personnel') SELECT u.record_id, name_raw AS name, count(*) AS signals, count(day) AS dated, strftime(max(day), '%Y-%m-%d') AS newest FROM u JOIN v_entity e ON u.record_id = e.record_id GROUP BY 1, 2""")
def wat02(ledger, entities):
    b = W.baseline_signals(prov(ledger))
    return W.watch_board(b, b.filter("kind = 'personnel'"), entities.select("record_id", F.col("name_raw").alias("name")))


NOW = "2024-06-30 00:00:00"
ARTICLE = "CASE page_id % 4 WHEN 0 THEN 'News of Thth Capital today' WHEN 1 THEN 'The Coury Firm Group buys' WHEN 2 THEN 'Nothing here' ELSE 'Turtle Creek Wealth grows' END"
PHRASE = "CASE page_id % 4 WHEN 0 THEN 'thth' WHEN 1 THEN 'coury firm' WHEN 2 THEN 'absent' ELSE 'turtle creek wealth' END"
DAY = "CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '2023-01-01 00:00:00' ELSE '2024-06-01 00:00:00' END"


def articles(p):
    return p.select("page_id", (F.col("page_id") % 40).alias("record_id"), F.expr(ARTICLE).alias("title"), "url", F.to_timestamp(F.expr(DAY)).alias("observed_at"), F.expr(PHRASE).alias("phrase"), F.when(F.col("page_id") % 4 == 3, 3).otherwise(2).alias("n_tokens"))


ACC = f"""a AS (SELECT page_id, page_id % 40 AS record_id, url, {HOST} AS h, CAST({DAY} AS TIMESTAMP) AS observed_at FROM v_page),
r AS (SELECT *, CASE WHEN observed_at IS NULL THEN 'undated' WHEN observed_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY THEN 'stale' WHEN {NEWS} THEN 'blocked_domain' WHEN page_id % 4 = 2 THEN 'name_not_matched' ELSE 'accepted' END AS result FROM a)"""


@query("wat03_accept_article", "v_page", sql=f"WITH {ACC} SELECT page_id, result FROM r")
def wat03(p):
    return W.accept_article(articles(p), NOW, 90).select("page_id", "result")


AT = "2024-05-31 13:05:09"
#: Dates as sources write them, <n> a number from 1 to 28, <y> a year, <t> a time of day.
DATED = [
    "20240610T1<t>00Z", "2024-06-1<d>T12:00:00Z", "<n> weeks ago", "Jun <n>, <y>", "<n> hours ago", "<n> Months ago", "soon", "<y>-06-20T12:00:00.25Z", "2024-06-<m>T12:00:00+0<d>:30", "mar <n> <y>", "<n> years ago", "<y>-03-0<d>", "1 day ago", "<n> minutes ago", "", "  2024-06-<m> 10:<t>  ",
    "Foo <n>, <y>", "2024-13-45", "20241345T000000Z", "<n> month  ago", "Feb 30, <y>",
]
RAW = "CASE doc_id % " + str(len(DATED)) + " " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(DATED)) + " END"
for mark, value in (("n", "CAST(1 + doc_id % 28 AS STRING)"), ("y", "CAST(2015 + doc_id % 12 AS STRING)"), ("d", "CAST(1 + doc_id % 9 AS STRING)"), ("m", "CAST(10 + doc_id % 19 AS STRING)"), ("t", "CAST(10 + doc_id % 50 AS STRING)")):
    RAW = f"replace({RAW}, '<{mark}>', {value})"
ISO = "^\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$"
AGO = "(?i)^(\\d+)\\s+(hour|day|week|month|year)s?\\s+ago$"


@query("wat04_parse_article_date", "v_doc", sql=f"""
WITH r AS (SELECT doc_id, trim({RAW}) AS s FROM v_doc), x AS (SELECT *, TRY_CAST(regexp_extract(s, '{AGO}', 1) AS INT) AS n, lower(regexp_extract(s, '{AGO}', 2)) AS unit, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract(s, '^([A-Za-z]{{3}})\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})$', 1))) AS mon,
 TRY_CAST(regexp_extract(s, '^[A-Za-z]{{3}}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})$', 1) AS INT) AS dd, TRY_CAST(regexp_extract(s, '^[A-Za-z]{{3}}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})$', 2) AS INT) AS yy FROM r),
t AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(s, '^\\d{{8}}T\\d{{6}}Z$') THEN try_strptime(s, '%Y%m%dT%H%M%SZ') END,
 CASE WHEN regexp_matches(s, '{ISO}') THEN CASE WHEN regexp_extract(s, '{ISO}', 1) IN ('', 'Z') THEN TRY_CAST(replace(s, 'Z', '') AS TIMESTAMP) ELSE TRY_CAST(left(s, 19) AS TIMESTAMP) - (CASE WHEN s[20] = '-' THEN -1 ELSE 1 END) * (INTERVAL 1 MINUTE * (CAST(s[21:22] AS INT) * 60 + CAST(right(s, 2) AS INT))) END END,
 TIMESTAMP '{AT}' - CASE unit WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY END * n,
 CASE WHEN unit IN ('month', 'year') THEN date_trunc('month', TIMESTAMP '{AT}') - INTERVAL 1 MONTH * (n * CASE unit WHEN 'year' THEN 12 ELSE 1 END) + (TIMESTAMP '{AT}' - date_trunc('month', TIMESTAMP '{AT}')) END,
 CASE WHEN mon > 0 THEN make_timestamp(yy, mon, 1, 0, 0, 0) + INTERVAL 1 DAY * (dd - 1) END) AS ts FROM x)
SELECT doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM t""")
def wat04(d):
    return d.select("doc_id", F.date_format(W.parse_article_date(F.expr(RAW), F.to_timestamp(F.lit(AT))), "yyyy-MM-dd HH:mm:ss").alias("at"))


KEY = f"sha1(coalesce({HOST}, '') || lower(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')))"


@query("wat05_dedupe_key", "v_page", sql=f"SELECT page_id, {KEY} AS key FROM v_page")
def wat05(p):
    return p.select("page_id", dedupe_key(F.col("url")).alias("key"))


@query("wat06_new_articles", "v_page", sql=f"""
WITH {ACC}, k AS (SELECT r.page_id, r.record_id, r.url, x.key FROM r JOIN (SELECT page_id, {KEY} AS key FROM v_page) x USING (page_id) WHERE result = 'accepted')
SELECT page_id, key FROM k WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s.page_id % 5 = 1 AND s.record_id = k.record_id AND s.key = k.key) AND NOT EXISTS (SELECT 1 FROM k p WHERE p.page_id % 5 = 2 AND p.record_id = k.record_id AND p.url = k.url)""")
def wat06(p):
    acc = W.accept_article(articles(p), NOW, 90).filter("result = 'accepted'")
    known = acc.filter("page_id % 5 = 1").select("record_id", dedupe_key(F.col("url")).alias("key"))
    return W.new_articles(acc, known, acc.filter("page_id % 5 = 2").select("record_id", F.col("url").alias("source_url"))).select("page_id", "key")


@query("wat07_insert_signals", "v_page", sql=f"""
WITH s AS (SELECT page_id AS seq, page_id % 3 AS record_id, {KEY.replace('page_id', 'page_id')} AS key FROM v_page), b AS (SELECT * FROM s WHERE seq < 50), d AS (SELECT record_id, key, min(seq) AS seq FROM s WHERE seq >= 50 GROUP BY 1, 2)
SELECT record_id, key, seq FROM b UNION ALL SELECT record_id, key, seq FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.record_id = d.record_id AND b.key = d.key)""")
def wat07(p):
    s = p.select((F.col("page_id") % 3).alias("record_id"), dedupe_key(F.col("url")).alias("key"), F.col("page_id").alias("seq"))
    return W.insert_signals(s.filter("seq < 50"), s.filter("seq >= 50"))


@query("wat08_interpret_overlay", "v_page", sql=f"""
WITH {ACC}, i AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY observed_at DESC, url) - 1 AS idx FROM r WHERE result = 'accepted') SELECT record_id, page_id, idx, CASE WHEN idx % 2 = 0 THEN 'hire' ELSE 'firm_news' END AS kind, CASE WHEN idx % 2 = 0 THEN repeat('m', 200) END AS meaning FROM i WHERE idx < 6""")
def wat08(p):
    items = W.interpret_inputs(W.accept_article(articles(p), NOW, 90).filter("result = 'accepted'").select("record_id", "page_id", "url", "observed_at"))
    replies = items.filter("idx % 2 = 0").select("record_id", "idx", F.lit("hire").alias("kind"), F.expr("repeat('m', 300)").alias("meaning"))
    return W.overlay(items.select("record_id", "page_id", "idx"), replies)


@query("wat09_org_state", "v_page", sql="""
WITH s AS (SELECT DISTINCT page_id % 40 AS record_id FROM v_page WHERE page_id % 2 = 0), r AS (SELECT page_id % 40 AS record_id, max(page_id) AS seen, max(page_id) FILTER (page_id % 3 > 0) AS f, sum(page_id % 3) AS n FROM v_page WHERE page_id % 5 > 0 GROUP BY 1)
SELECT coalesce(s.record_id, r.record_id) AS record_id, coalesce(seen, CASE WHEN s.record_id IS NOT NULL THEN 1 END) AS last_researched, coalesce(f, CASE WHEN s.record_id IS NOT NULL THEN 1 END) AS last_found, CAST(CASE WHEN s.record_id IS NOT NULL THEN 10 ELSE 0 END + coalesce(n, 0) AS BIGINT) AS total FROM s FULL JOIN r ON s.record_id = r.record_id""")
def wat09(p):
    one = F.lit(1).cast("long")
    state = p.filter("page_id % 2 = 0").select((F.col("page_id") % 40).alias("record_id")).distinct().select("record_id", one.alias("last_researched"), one.alias("last_found"), F.lit(10).alias("total"))
    return W.org_state(state, p.filter("page_id % 5 > 0").select((F.col("page_id") % 40).alias("record_id"), F.col("page_id").alias("at"), (F.col("page_id") % 3).alias("found")))


@query("wat10_research_queue", "v_ledger", "v_entity", sql=f"""
WITH {BASE}, st AS (SELECT record_id, record_id % 50 AS lr FROM v_entity WHERE record_id % 3 > 0), ws AS (SELECT record_id, CASE WHEN record_id % 5 > 0 THEN DATE '2024-01-20' + CAST(record_id % 9 AS INT) END AS day FROM v_entity WHERE discovery_class = 'HOUSEHOLD'),
p AS (SELECT record_id FROM b UNION SELECT record_id FROM ws), n AS (SELECT record_id, max(day) AS newest FROM (SELECT entity_id AS record_id, CAST(retrieved_at AS DATE) AS day FROM ok UNION ALL SELECT * FROM ws) WHERE day IS NOT NULL GROUP BY 1)
SELECT e.record_id, e.name_raw AS name FROM v_entity e JOIN p ON p.record_id = e.record_id LEFT JOIN st ON st.record_id = e.record_id LEFT JOIN n ON n.record_id = e.record_id ORDER BY lr NULLS FIRST, newest NULLS FIRST, name_raw, e.record_id LIMIT 300""")
def wat10(ledger, entities):
    state = entities.filter("record_id % 3 > 0").select("record_id", (F.col("record_id") % 50).alias("last_researched"))
    stored = entities.filter("discovery_class = 'HOUSEHOLD'").select("record_id", F.when(F.col("record_id") % 5 > 0, F.date_add(F.lit("2024-01-20").cast("date"), (F.col("record_id") % 9).cast("int"))).alias("day"))
    return W.research_queue(entities.select("record_id", F.col("name_raw").alias("name")), state, prov(ledger), stored, 300)


TIMED = "SELECT seq, run_id, state, CASE WHEN seq % 7 > 0 THEN duration_ms END AS duration_ms FROM v_run"


@query("wat11_run_counts", "v_run", sql=f"""
WITH c AS ({TIMED}), n AS (SELECT run_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'running') AS "left" FROM c GROUP BY 1),
m AS (SELECT run_id, list_sort(list(duration_ms)) AS ds FROM c WHERE state IN ('done', 'failed', 'skipped') AND duration_ms IS NOT NULL GROUP BY 1), k AS (SELECT n.*, CASE WHEN done + failed + skipped >= 3 THEN ds[len(ds) // 2 + 1] END AS median_ms FROM n LEFT JOIN m USING (run_id))
SELECT *, CAST(floor(CAST(median_ms * "left" AS DOUBLE) / 6 + 0.5) AS BIGINT) AS eta_ms FROM k""")
def wat11(runs):
    return W.run_counts(runs.sparkSession.sql(TIMED.replace("v_run", "{v}"), v=runs), 6)


@query("aud01_validator_worklist", "v_mail", sql="""
WITH r AS (SELECT seq AS record_id, CASE WHEN seq % 3 = 0 THEN 'type_unconfirmed' WHEN seq % 3 = 1 THEN 'SFO' END AS entity_type, principal_name, CASE seq % 4 WHEN 0 THEN email WHEN 1 THEN '  ' END AS principal_email FROM v_mail), c AS (SELECT seq AS record_id, CASE WHEN seq % 2 = 0 THEN 'email' ELSE 'type' END AS mode, CASE seq % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' END AS status, seq % 6 AS attempts FROM v_mail),
o AS (SELECT 'type' AS mode, record_id, trim(coalesce(principal_email, '')) = '' AS late FROM r WHERE entity_type = 'type_unconfirmed' UNION ALL SELECT 'email', record_id, trim(coalesce(principal_name, '')) = '' FROM r WHERE trim(coalesce(principal_email, '')) = '')
SELECT mode, record_id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY late, record_id) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.record_id = o.record_id AND c.mode = o.mode AND (coalesce(status = 'done', false) OR attempts >= 3))) WHERE n <= 100""")
def aud01(m):
    kind = F.when(F.col("seq") % 3 == 0, "type_unconfirmed").when(F.col("seq") % 3 == 1, "SFO")
    r = m.select(F.col("seq").alias("record_id"), kind.alias("entity_type"), "principal_name", F.when(F.col("seq") % 4 == 0, F.col("email")).when(F.col("seq") % 4 == 1, "  ").alias("principal_email"))
    status = F.when(F.col("seq") % 5 == 0, "done").when(F.col("seq") % 5 == 1, "failed").when(F.col("seq") % 5 == 2, "partial")
    c = m.select(F.col("seq").alias("record_id"), F.when(F.col("seq") % 2 == 0, "email").otherwise("type").alias("mode"), status.alias("status"), (F.col("seq") % 6).alias("attempts"))
    one = lambda mode: W.validator_worklist(r, c, mode, 100).select(F.lit(mode).alias("mode"), "record_id")
    return one("type").unionByName(one("email"))


ATTRIBUTED = f"CASE WHEN {IS_ROLE} OR {WIDE} THEN 'role' WHEN len(list_filter(regexp_split_to_array(lower(coalesce(principal_name, '')), '[^a-z]+'), lambda t: length(t) > 2 AND contains({PLAIN_LOCAL}, t))) > 0 THEN 'principal' ELSE 'unknown' END"
#: Each firm's addresses as its records' principal addresses.
WRONG = f"w AS (SELECT seq AS record_id, email, {ATTRIBUTED} AS attribution FROM v_mail WHERE email IS NOT NULL), bad AS (SELECT * FROM w WHERE attribution <> 'principal')"


def addressed(m):
    return m.select(F.col("seq").alias("record_id"), "principal_name", F.col("email").alias("principal_email"))


@query("aud02_email_result", "v_mail", sql=f"""
WITH x AS (SELECT seq AS record_id, principal_name, CASE WHEN ends_with(lower(email), '@fam.com') THEN email WHEN seq % 2 = 0 THEN 'jdoe@fam.com' END AS email, seq % 13 = 0 AS outage FROM v_mail), f AS (SELECT *, CASE WHEN email IS NULL THEN NULL WHEN trim(coalesce(principal_name, '')) = '' OR {IS_ROLE} OR {WIDE} THEN 'firm_email' ELSE 'principal_email' END AS field FROM x)
SELECT record_id, email, field, CASE WHEN outage THEN NULL WHEN field = 'principal_email' THEN 'done' WHEN field = 'firm_email' THEN 'partial' ELSE 'failed' END AS checkpoint FROM f""")
def aud02(m):
    return W.email_result(m.select(F.col("seq").alias("record_id"), "principal_name", F.lit("fam.com").alias("domain"), F.lit("x@elsewhere.org").alias("site"), F.col("email").alias("vendor"), F.when(F.col("seq") % 2 == 0, "jdoe@fam.com").alias("pattern"), (F.col("seq") % 13 == 0).alias("outage")))


@query("aud03_audit_emails", "v_mail", sql=f"WITH {WRONG} SELECT record_id, email AS firm_email, CAST(NULL AS STRING) AS principal_email, 'email_attribution_' || attribution AS audit FROM bad")
def aud03(m):
    return W.audit_emails(addressed(m))


@query("aud03_demote", "v_mail", sql=f"""
WITH {WRONG} SELECT record_id, 'principal_email' AS field_name, CAST(NULL AS STRING) AS answer, 'removed_failed_validation' AS status FROM bad UNION ALL SELECT record_id, 'firm_email', email, 'single_source' FROM bad UNION ALL SELECT record_id, 'audit', email, 'email_attribution_' || attribution FROM bad""")
def aud03_demote(m):
    claims, audit = W.demote(addressed(m))
    return claims.unionByName(audit.select("record_id", F.lit("audit").alias("field_name"), F.col("before").alias("answer"), F.col("audit").alias("status")))


@query("aud04_invariants", "v_mail", sql=f"SELECT count(*) FILTER (email IS NOT NULL AND {IS_ROLE}) AS role_principals, count(*) FILTER (email IS NOT NULL AND trim(coalesce(principal_name, '')) = '') AS nameless_principals FROM v_mail")
def aud04(m):
    return W.invariants(addressed(m))
