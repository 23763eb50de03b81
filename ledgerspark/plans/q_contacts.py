"""Queries of contacts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import contacts as C
from .q_resolve import CORE, SPOKEN
from .registry import query

HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', ''), '')"
AGG = " OR ".join(f"h = '{a}' OR ends_with(h, '.{a}')" for a in W.AGGREGATORS)


@query("con01_host", "v_page", sql=f"SELECT page_id, {HOST} AS host FROM v_page")
def con01(p):
    return p.select("page_id", W.host(F.col("url")).alias("host"))


NEWS = " OR ".join(f"h = '{a}' OR ends_with(h, '.{a}')" for a in W.NO_NEWS)
# listed hosts, hosts below them and hosts that only look like them, put to the pages
LINKS = "CASE page_id % 97 " + " ".join(f"WHEN {k} THEN 'https://{sub}{h}/p'" for k, (sub, h) in enumerate(zip(["www.", "sub.", "not", ""] * 15, sorted({*W.AGGREGATORS, *W.NO_NEWS}), strict=False))) + " ELSE url END"


@query("con02_is_aggregator", "v_page", sql=f"SELECT page_id, {AGG} AS aggregator, {NEWS} AS blocked FROM (SELECT page_id, {HOST} AS h FROM (SELECT page_id, {LINKS} AS url FROM v_page))")
def con02(p):
    h = W.host(F.expr(LINKS))
    return p.select("page_id", W.is_aggregator(h).alias("aggregator"), W.is_blocked_domain(h).alias("blocked"))


@query("con03_domain_from_sources", "v_page", sql=f"WITH x AS (SELECT page_id % 50 AS entity_id, page_id AS seq, {HOST} AS h FROM v_page) SELECT entity_id, arg_max(h, seq) AS domain FROM x WHERE h IS NOT NULL AND NOT ({AGG}) GROUP BY entity_id")
def con03(p):
    return C.domain_from_sources(p.select((F.col("page_id") % 50).alias("entity_id"), F.col("page_id").alias("seq"), F.col("url").alias("website")))


@query("con04_domain_matches_entity", "v_page", sql=f"""
WITH x AS (SELECT page_id, regexp_replace(split_part({HOST}, '.', 1), '[^a-z0-9]', '', 'g') AS l FROM v_page) SELECT page_id, starts_with(l, 'th') OR starts_with(l, 'ersth') OR contains(l, 'ersth') AS matches FROM x""")
def con04(p):
    return p.select("page_id", C.domain_matches_entity(W.host(F.col("url")), F.array(F.lit("th"), F.lit("ersth"))).alias("matches"))


@query("con05_resolve_domain", "v_page", sql=f"""
WITH x AS (SELECT page_id % 40 AS entity_id, page_id % 2 AS tier, page_id AS pos, {HOST} AS h FROM v_page), f AS (SELECT *, regexp_replace(split_part(h, '.', 1), '[^a-z0-9]', '', 'g') AS label FROM x WHERE h IS NOT NULL AND NOT ({AGG}))
SELECT entity_id, h AS domain FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier, pos) AS n FROM f WHERE starts_with(label, 'th') OR starts_with(label, 'blog') OR contains(label, 'shing')) WHERE n = 1""")
def con05(p):
    return C.resolve_domain(p.select((F.col("page_id") % 40).alias("entity_id"), (F.col("page_id") % 2).alias("tier"), F.col("page_id").alias("pos"), F.col("url").alias("link"), F.array(F.lit("th"), F.lit("blog"), F.lit("shing")).alias("tokens")))


# blocks of every shape, put to the pages; <n> is the page, <d> its digits as nested arrays
LD = [
    '{"@type": "Person", "name": "A<n>", "jobTitle": "CEO"}', '{"@graph": [{"@type": "Org"}, {"@type": "Person", "name": "B<n>"}]}', '{"@type": "Org", "founder": {"@type": "Person", "name": "C<n>", "jobTitle": "Founder"}}',
    '{"@type": "Org", "employee": [{"@type": "Dog", "name": "no"}, {"@type": "Person", "name": "D<n>", "jobTitle": "CFO"}]}', '{"@type": "Org"}', 'not json', '[[{"@type": "Org", "employees": [{"@type": ["Thing", "Person"], "name": "E<n>", "jobTitle": "COO"}]}]]',
    '{"@graph": [{"@type": "Org", "member": {"employee": {"@type": "Person", "name": ""}, "founder": [{"@type": "Person", "name": "F<n>"}]}}, {"@type": "Person", "name": "late"}]}', '{"people": [{"@type": "Person", "name": "elsewhere"}], "employees": {"@graph": {"@type": "Person", "name": "G<n>", "jobTitle": "Chair"}}}',
    '{"@type": "Person", "founder": {"@type": "Person", "name": "H<n>"}, "member": {"@type": "Person", "name": "second"}}', '{"@type": ["Person"], "name": "I<n>", "employee": {"@type": "Person", "name": "inner"}}', '"Person"',
]
LD_TEXT = f"replace(CASE page_id % {len(LD)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LD)) + " END, '<n>', CAST(page_id AS STRING))"
LD_HTML = f"""html || '<script type="application/ld+json">' || {LD_TEXT} || '</script><script async type="application/ld+json" id="x">{{"@type": "Person", "name": "Z' || CAST(page_id AS STRING) || '", "jobTitle": "Last"}}</script>'"""
LD_KEYS = ", ".join(f"json_extract(v, '$.\"{k}\"')" for k in C.NESTED)


@query("con06_jsonld_person", "v_page", sql=f"""
WITH RECURSIVE b AS (SELECT page_id, unnest(regexp_extract_all({LD_HTML}, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) AS j, generate_subscripts(regexp_extract_all({LD_HTML}, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), 1) AS nth FROM v_page),
w AS (SELECT page_id, [nth] AS path, CAST(j AS JSON) AS v FROM b WHERE json_valid(j)
 UNION ALL SELECT page_id, list_append(path, i), items[i] FROM (SELECT page_id, path, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [{LD_KEYS}] ELSE [] END AS items FROM w) AS n, unnest(range(1, len(items) + 1)) AS t(i) WHERE items[i] IS NOT NULL),
p AS (SELECT page_id, path, v->>'name' AS name, v->>'jobTitle' AS title FROM w WHERE json_type(v) = 'OBJECT' AND (v->>'@type' = 'Person' OR json_contains(json_extract(v, '$."@type"'), '"Person"')) AND coalesce(v->>'name', '') <> '')
SELECT page_id, name, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY path) AS n FROM p) WHERE n = 1""")
def con06(p):
    return C.jsonld_person(p.select("page_id", F.expr(LD_HTML).alias("html")))


MAILS = "CASE WHEN page_id % 3 = 0 THEN ' Info@' || h || '. ' WHEN page_id % 3 = 1 THEN ' jane.doe@mail.' || h || '; x@other.org' ELSE '' END"


@query("con07_harvest_emails", "v_page", sql=f"""
WITH x AS (SELECT page_id, url, {HOST} AS h FROM v_page), m AS (SELECT h AS domain, page_id, url, CASE page_id % 3 WHEN 0 THEN 'info@' || h WHEN 1 THEN 'jane.doe@mail.' || h END AS email FROM x WHERE page_id % 3 < 2)
SELECT domain, email, arg_min(url, page_id) AS url FROM m GROUP BY 1, 2""")
def con07(p):
    x = p.withColumn("h", W.host(F.col("url")))
    return C.harvest_emails(x.select("page_id", "url", F.expr(MAILS).alias("html")))


LOCAL = "split_part(email, '@', 1)"
PLAIN_LOCAL = f"lower(split_part({LOCAL}, '+', 1))"
ROLES = "[" + ", ".join(f"'{w}'" for w in W.ROLE_LOCALS) + "]"
IS_ROLE = f"list_contains({ROLES}, {PLAIN_LOCAL})"
LETTERS = f"regexp_replace({PLAIN_LOCAL}, '[^a-z]', '', 'g')"
WIDE = f"len(list_filter({ROLES}, lambda w: starts_with({LETTERS}, w) OR ends_with({LETTERS}, w))) > 0"
MAIL_HOST = "regexp_replace(lower(regexp_extract(email, '@([^@]*)$', 1)), '^www\\.', '')"
ON_FAM = f"coalesce({MAIL_HOST} = 'fam.com' OR ends_with({MAIL_HOST}, '.fam.com'), false)"
NAME_LIST = "list_filter(regexp_extract_all(lower(CASE WHEN contains(principal_name, ',') THEN regexp_replace(principal_name, '^([^,]*),(.*)$', '\\2 \\1') ELSE principal_name END), '[a-z]+'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in W.NAME_WORDS) + "))"
MINE = f"(coalesce(length(last) > 2 AND contains(regexp_replace(lower({LOCAL}), '[^a-z]', '', 'g'), last), false) OR coalesce(length(first) > 2 AND regexp_replace(lower({LOCAL}), '[^a-z]', '', 'g') = first, false))"
#: Addresses of each firm seen once, with the principal's names; those of other people; the firm's convention.
PEERS = f"""m AS (SELECT *, {NAME_LIST} AS names FROM v_mail WHERE email IS NOT NULL), h AS (SELECT *, names[1] AS first, names[len(names)] AS last FROM m QUALIFY row_number() OVER (PARTITION BY firm, lower(email) ORDER BY seq) = 1),
o AS (SELECT firm, seq, url, {LOCAL} AS l, regexp_replace(lower({LOCAL}), '[^a-z]', '', 'g') AS w FROM h WHERE first IS NOT NULL AND NOT {IS_ROLE} AND NOT {MINE}),
g AS (SELECT firm, count(*) AS n, count(*) FILTER (contains(l, '.')) AS dots, arg_min(l, seq) FILTER (contains(l, '.')) AS lead, count(*) FILTER (w <> '') AS words, count(*) FILTER (w <> '' AND length(w) <= 8) AS short, arg_min(url, seq) AS url FROM o GROUP BY firm),
c AS (SELECT firm, url, CASE WHEN dots >= greatest(1, n // 2) THEN CASE WHEN length(split_part(lead, '.', 1)) = 1 THEN 'f.last' ELSE 'first.last' END WHEN words > 0 THEN CASE WHEN short >= greatest(1, words // 2) THEN 'first' ELSE 'flast' END END AS pattern FROM g)"""


@query("con08_email_on_domain", "v_mail", sql=f"SELECT seq, {ON_FAM} AS on_domain FROM v_mail")
def con08(m):
    return m.select("seq", W.email_on_domain(F.col("email"), F.lit("www.FAM.com")).alias("on_domain"))


@query("con09_is_role_address", "v_mail", sql=f"SELECT seq, {IS_ROLE} AS role, {WIDE} AS wide FROM v_mail WHERE email IS NOT NULL")
def con09(m):
    e = F.col("email")
    return m.filter(e.isNotNull()).select("seq", W.is_role_address(e).alias("role"), W.is_role_address(e, True).alias("wide"))


@query("con10_email_field", "v_mail", sql=f"SELECT seq, CASE WHEN {IS_ROLE} OR trim(coalesce(principal_name, '')) = '' THEN 'firm_email' ELSE 'principal_email' END AS field FROM v_mail WHERE email IS NOT NULL")
def con10(m):
    return m.filter("email IS NOT NULL").select("seq", W.email_field(F.col("email"), F.col("principal_name")).alias("field"))


@query("con11_attribute_email", "v_mail", sql=f"""
SELECT seq, CASE WHEN {IS_ROLE} OR {WIDE} THEN 'role' WHEN len(list_filter(regexp_split_to_array(lower(coalesce(principal_name, '')), '[^a-z]+'), lambda t: length(t) > 2 AND contains({PLAIN_LOCAL}, t))) > 0 THEN 'principal' ELSE 'unknown' END AS attribution FROM v_mail WHERE email IS NOT NULL""")
def con11(m):
    return C.attribute_email(m.filter("email IS NOT NULL").withColumnRenamed("email", "principal_email")).select("seq", "attribution")


@query("con12_name_tokens", "v_mail", sql=f"SELECT seq, names[1] AS first, names[len(names)] AS last FROM (SELECT seq, {NAME_LIST} AS names FROM v_mail)")
def con12(m):
    return m.select("seq", W.name_tokens(F.col("principal_name")).alias("n")).select("seq", "n.first", "n.last")


@query("con13_matches_principal", "v_mail", sql=f"SELECT seq, {MINE} AS matches FROM (SELECT *, names[1] AS first, names[len(names)] AS last FROM (SELECT *, {NAME_LIST} AS names FROM v_mail)) WHERE email IS NOT NULL")
def con13(m):
    n = W.name_tokens(F.col("principal_name"))
    return m.filter("email IS NOT NULL").select("seq", W.matches_principal(F.split_part("email", F.lit("@"), F.lit(1)), n["first"], n["last"]).alias("matches"))


def firms(m):
    return m.select("firm", "principal_name").distinct().withColumn("domain", F.lit("fam.com"))


@query("con14_infer_pattern", "v_mail", sql=f"WITH {PEERS} SELECT firm, pattern, url FROM c WHERE pattern IS NOT NULL")
def con14(m):
    return C.infer_pattern(m.filter("email IS NOT NULL"), firms(m))


@query("con15_principal_email_on_site", "v_mail", sql=f"""
WITH {PEERS}, s AS (SELECT firm, arg_min(email, seq) AS email, arg_min(url, seq) AS url FROM h WHERE {MINE} GROUP BY firm), f AS (SELECT firm, names[1] AS first, names[len(names)] AS last FROM (SELECT DISTINCT firm, {NAME_LIST} AS names FROM v_mail)),
x AS (SELECT f.firm, s.email AS seen, s.url AS seen_url, c.url, CASE pattern WHEN 'first.last' THEN first || '.' || last WHEN 'f.last' THEN first[1] || '.' || last WHEN 'first' THEN first WHEN 'flast' THEN first[1] || last END || '@fam.com' AS built FROM f LEFT JOIN s ON s.firm = f.firm LEFT JOIN c ON c.firm = f.firm)
SELECT firm, coalesce(seen, built) AS email, CASE WHEN seen IS NOT NULL THEN 'single_source' WHEN built IS NOT NULL THEN 'pattern_inferred' END AS status, coalesce(seen_url, url) AS url FROM x""")
def con15(m):
    return C.principal_email_on_site(firms(m), m.filter("email IS NOT NULL"))


VENDOR = "SELECT seq, firm, email, CASE WHEN seq % 3 > 0 THEN seq % 101 END AS score, CASE WHEN seq % 7 = 0 THEN 'VALID' WHEN seq % 5 = 0 THEN 'unknown' END AS smtp_status, email IS NULL OR firm % 19 = 0 AS error, CASE WHEN firm % 5 = 4 THEN 'nowhere.org' ELSE 'fam.com' END AS domain, seq % 9 < 2 AS by_name, principal_name FROM v_mail WHERE firm % 23 > 0 OR seq % 8 = 1"


@query("con16_choose_email_vendor", "v_mail", sql=f"""
WITH r AS (SELECT *, nullif(lower(list_last(regexp_split_to_array(trim(regexp_replace(principal_name, '\\s+', ' ', 'g')), ' '))), '') AS last FROM ({VENDOR})), a AS (SELECT * FROM r WHERE NOT by_name OR last IS NOT NULL),
t AS (SELECT *, CASE WHEN by_name THEN 0 WHEN last IS NOT NULL AND contains(lower(email), last) THEN 1 ELSE 2 END AS tier FROM a WHERE email IS NOT NULL AND ({MAIL_HOST} = domain OR ends_with({MAIL_HOST}, '.' || domain))),
b AS (SELECT firm, email, CASE WHEN {IS_ROLE} OR trim(coalesce(principal_name, '')) = '' THEN 'firm_email' ELSE 'principal_email' END AS field, CASE tier WHEN 0 THEN CASE WHEN coalesce(score >= 70, false) OR coalesce(smtp_status = 'VALID', false) THEN 'medium' ELSE 'low' END WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY firm ORDER BY tier, seq) = 1),
g AS (SELECT firm, bool_or(error) AS error, count(*) FILTER (NOT error) AS n FROM a GROUP BY firm)
SELECT g.firm, b.email, b.field, b.confidence, CASE WHEN b.firm IS NOT NULL THEN 'found' WHEN error THEN 'outage' WHEN n > 0 THEN 'wrong_company' ELSE 'no_evidence' END AS result FROM g LEFT JOIN b ON g.firm = b.firm""")
def con16(m):
    return C.choose_email_vendor(m.sparkSession.sql(VENDOR.replace("v_mail", "{v}"), v=m))


#: Numbers in every spelling, of two offices, some too long or with an area that there is not; the page's text comes first.
DIGITS = "lpad(CAST(page_id % 10000 AS STRING), 4, '0')"
NUMBERED = f"html || CASE page_id % 9 WHEN 0 THEN 'Call (212) 555-' || {DIGITS} || ' now' WHEN 1 THEN 'T +1 646.555.' || {DIGITS} WHEN 2 THEN '1-212-555-' || {DIGITS} || '.' WHEN 3 THEN '212 555 ' || {DIGITS} || '7' WHEN 4 THEN '112-555-' || {DIGITS} WHEN 5 THEN 'no 9212555' || {DIGITS} || ' but (646)555' || {DIGITS} WHEN 6 THEN '2125550199,6465550199' ELSE 'none' END"


@query("con17_find_phone", "v_page", sql=f"""
WITH x AS (SELECT page_id, {HOST} AS domain, regexp_extract({NUMBERED}, '(?:^|[^0-9])(?:\\+?1[ .-]?)?\\(?([2-9][0-9]{{2}})\\)?[ .-]?([2-9][0-9]{{2}})[ .-]?([0-9]{{4}})(?:[^0-9]|$)', ['a', 'b', 'c']) AS n FROM v_page)
SELECT domain, arg_min('+1' || n.a || n.b || n.c, page_id) AS phone, 'format_only' AS status FROM x WHERE n.a <> '' GROUP BY domain""")
def con17(p):
    return C.find_phone(p.select("page_id", "url", F.expr(NUMBERED).alias("html")))


SERP = "CASE doc_id % 9 WHEN 0 THEN 'Jane Doe - CEO - Fam' WHEN 1 THEN 'A very long headline of news - Site' WHEN 2 THEN 'Roe | Partner - Fam' WHEN 3 THEN '' WHEN 4 THEN 'Jane Doe' WHEN 5 THEN NULL WHEN 6 THEN 'Mary-Jane ' || source || ' — Chair' WHEN 7 THEN 'one two three four five | Jane - x' ELSE substring(text, 1, 40) || ' | ' || lang END"
ASKED_NAME = "CASE doc_id % 4 WHEN 0 THEN ' JANE Doe' WHEN 1 THEN 'Roe' WHEN 2 THEN '' ELSE 'one' END"


@query("con18_serp_titles", "v_doc", sql=f"""
WITH x AS (SELECT doc_id, {SERP} AS t, lower(regexp_extract({ASKED_NAME}, '^\\s*(\\S+)', 1)) AS w FROM v_doc), y AS (SELECT *, {", ".join(f"CASE WHEN contains(t, '{m}') THEN trim(split_part(t, '{m}', 1)) END AS p{k}" for k, m in enumerate((" - ", " | ", " — ")))}, string_split(replace(t, ' | ', ' - '), ' - ') AS parts FROM x)
SELECT doc_id, coalesce({", ".join(f"CASE WHEN p{k} <> '' AND len(string_split_regex(p{k}, '\\s+')) <= 4 THEN p{k} END" for k in range(3))}) AS name, CASE WHEN len(parts) >= 2 AND w <> '' AND contains(lower(parts[1]), w) THEN trim(parts[2]) END AS title FROM y""")
def con18(d):
    return d.select("doc_id", C.name_from_serp_title(F.expr(SERP)).alias("name"), C.title_from_serp(F.expr(SERP), F.expr(ASKED_NAME)).alias("title"))


MENTIONED = ["Of  the, LLC", "en-la Inc.", "!", "L’été", "nivers", "The Co"]


@query("con19_mentions_entity", "v_doc", sql=f"""
WITH n AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in MENTIONED)}) AS v(name_raw)), p AS (SELECT {CORE} AS phrase FROM n), t AS (SELECT doc_id, {SPOKEN('text')} AS body FROM v_doc)
SELECT doc_id AS text_id, doc_id % 100 AS entity_id, coalesce(bool_or(phrase <> '' AND contains(body, phrase)), false) AS mentioned FROM t, p WHERE phrase <> 'the' OR doc_id % 100 < 20 GROUP BY 1, 2""")
def con19(d):
    texts = d.select((F.col("doc_id") % 100).alias("entity_id"), F.col("doc_id").alias("text_id"), "text")
    names = texts.select("entity_id").distinct().select("entity_id", F.explode(F.array(*[F.lit(t) for t in MENTIONED])).alias("phrase"))
    return C.mentions_entity(texts, names.filter("phrase <> 'The Co' OR entity_id < 20"))


@query("con20_pick_dated_signal", "v_doc", sql="""
WITH n AS (SELECT doc_id % 50 AS entity_id, doc_id % 2 AS tier, doc_id AS pos, doc_id % 3 > 0 AS mentioned, text AS title, CASE WHEN doc_id % 5 > 0 THEN '2024-01-01' END AS day FROM v_doc)
SELECT entity_id, 'recent_news' AS field_name, title, day FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier, pos) AS n FROM n WHERE mentioned AND (day IS NOT NULL OR tier > 0)) WHERE n = 1""")
def con20(d):
    n = d.select((F.col("doc_id") % 50).alias("entity_id"), (F.col("doc_id") % 2).alias("tier"), F.col("doc_id").alias("pos"), (F.col("doc_id") % 3 > 0).alias("mentioned"), F.col("text").alias("title"), F.when(F.col("doc_id") % 5 > 0, "2024-01-01").alias("day"))
    return C.pick_dated_signal(n)


@query("con21_wave1_gate", "v_ledger", sql="""
WITH l AS (SELECT entity_id, CASE WHEN field_name = 'recent_news' AND entity_id % 2 = 0 THEN 'firm_email' ELSE field_name END AS f, status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded') AS ok FROM v_ledger)
SELECT entity_id, bool_or(ok AND f = 'principal_name') AND bool_or(ok AND f = 'firm_email') AS promotable FROM l GROUP BY entity_id""")
def con21(ledger):
    f = F.when((F.col("field_name") == "recent_news") & (F.col("entity_id") % 2 == 0), "firm_email").otherwise(F.col("field_name"))
    return C.wave1_gate(ledger.withColumn("field_name", f))


@query("con22_check_citation_index", "v_doc", sql="SELECT doc_id % 100 AS entity_id, doc_id % 7 AS idx, doc_id AS fact, 'https://d/' || CAST(doc_id % 7 AS STRING) AS url FROM v_doc WHERE doc_id % 7 < 5 AND doc_id % 3 > 0")
def con22(d):
    facts = d.select((F.col("doc_id") % 100).alias("entity_id"), (F.col("doc_id") % 7).alias("idx"), F.col("doc_id").alias("fact"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'aum_usd' END").alias("field"))
    docs = facts.select("entity_id").distinct().select("entity_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("idx")).withColumn("url", F.concat(F.lit("https://d/"), F.col("idx").cast("string")))
    return C.check_citation_index(facts, docs, ["aum_usd"]).drop("field")


def bare(html):
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in W.NO_TEXT:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({out}, '{W.BOX.replace("'", "''")}', ' ', 'g')"


# half of the pages without their article element and with a box of links
LAID = "CASE WHEN page_id % 2 = 0 THEN html ELSE replace(replace(html, 'article>', 'span>'), '<footer>', '<div><a href=\"/x\">one two three four five</a> six seven eight nine ten eleven</div><p>too few words</p><footer>') END"
TEXT_OF = lambda x: f"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("con23_extract_text", "v_page", sql=f"""
WITH b AS (SELECT page_id, {bare(LAID)} AS h FROM v_page), n AS (SELECT page_id, h, nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*)</article>', 1), '') AS part FROM b),
k AS (SELECT page_id, part IS NOT NULL AS named, string_split_regex(coalesce(part, h), '{W.BREAK}') AS blocks FROM n),
l AS (SELECT page_id, named, list_transform(blocks, lambda x: {{'t': {TEXT_OF('x')}, 'a': coalesce(list_sum(list_transform(regexp_extract_all(x, '{W.LINK}', 1), lambda y: length({TEXT_OF('y')}))), 0)}}) AS blocks FROM k),
t AS (SELECT page_id, array_to_string(list_transform(list_filter(blocks, lambda x: x.t <> '' AND x.a * 3 <= length(x.t) AND len(string_split(x.t, ' ')) >= CASE WHEN named THEN 1 ELSE 10 END), lambda x: x.t), chr(10)) AS x FROM l)
SELECT page_id, CASE WHEN length(x) >= 200 THEN md5(x) END AS digest, CASE WHEN length(x) < 200 THEN 'too_short' ELSE 'ok' END AS result FROM t""")
def con23(p):
    return C.extract_text(p.select("page_id", F.expr(LAID).alias("html"))).select("page_id", F.md5("text").alias("digest"), "result")


@query("con24_pick_profile_url", "v_page", sql="SELECT page_id % 30 AS entity_id, arg_min(url, page_id) AS link FROM v_page WHERE contains(lower(url), '/en/') GROUP BY 1")
def con24(p):
    return C.pick_profile_url(p.select((F.col("page_id") % 30).alias("entity_id"), F.col("page_id").alias("pos"), F.col("url").alias("link")), "/en/")


# the fields of an entity are those of each question, so that some have no settled claim
FIELD = "coalesce(question_id, 'none') || ':' || field_name"
TIER = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query("con25_fill_unsettled", "v_ledger", sql=f"""
WITH k AS (SELECT entity_id, {FIELD} AS field_name, {TIER} AS tier, claim_id AS answer, answer IS NOT NULL AS usable, status FROM v_ledger),
d AS (SELECT DISTINCT entity_id, field_name FROM k WHERE status NOT IN ('could_not_verify', 'removed_failed_validation', 'superseded'))
SELECT entity_id, field_name, tier, answer, usable FROM (SELECT k.*, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY usable DESC, tier, answer) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.entity_id = k.entity_id AND d.field_name = k.field_name)) WHERE n = 1""")
def con25(ledger):
    keyed = ledger.withColumn("field_name", F.expr(FIELD))
    tiers = keyed.select("entity_id", "field_name", F.expr(TIER).alias("tier"), F.col("claim_id").alias("answer"), F.col("answer").isNotNull().alias("usable"))
    return C.fill_unsettled(keyed, tiers)
