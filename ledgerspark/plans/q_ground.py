"""Queries of the grounding checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ground as G
from ..operators.corpus import citable_facts
from .registry import query


@query("gnd01_citable_facts", "v_ledger", sql="""
SELECT entity_id, field_name, claim_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY created_at DESC, seq DESC) AS n FROM v_ledger WHERE status NOT IN ('could_not_verify', 'removed_failed_validation', 'contradicted')) WHERE n = 1""")
def gnd01(ledger):
    return citable_facts(ledger).select("entity_id", "field_name", "claim_id", "answer")


TOP, FOUND, OUT = "(length(content) % 23) / 1000.0", "length(content) % 7", "content LIKE '%tion the%'"


@query("gnd02_gate1", "v_chunk", sql=f"SELECT chunk_id, CASE WHEN {OUT} THEN 'decline_out_of_scope' WHEN {FOUND} = 0 THEN 'decline_zero_results' WHEN CAST({TOP} AS DOUBLE) < 0.01 THEN 'decline_low_score' ELSE 'proceed' END AS decision FROM v_chunk")
def gnd02(c):
    return c.select("chunk_id", G.gate1(F.expr(TOP).cast("double"), F.expr(FOUND), F.expr(OUT)).alias("decision"))


TAGGED = "replace(text, '. ', '. [r' || CAST(conv_id % 9 AS STRING) || ':f1, f2] ')"


@query("gnd03_normalize_tags", "v_answer", sql=f"SELECT conv_id, turn, regexp_replace({TAGGED}, '([.!?])[ \\t]*((?:\\[[^\\]]+\\][ \\t]*)*\\[[^\\]]+\\])', ' \\2\\1', 'g') AS text FROM v_answer")
def gnd03(a):
    return a.select("conv_id", "turn", G.normalize_tags(F.expr(TAGGED)).alias("text"))


# the tagged text of a turn, then lines of every kind; <br> is a line end
LINES = [
    "## Tier 1", "## Larkspur - $640M AUM", "---", "- **Note:** Lead with a climate thesis.", "We suggest a call next week.", "We suggest a call to value 7.", "Overall, the firm manages $640M.", "The record does not list an address.", "These offices are known:",
    "Nothing here is tagged.", "Reach out to Larkspur Partners.", "Ask about disc_0a1b.", "[r1:f1]", "| --- | --- |", "A figure of 12% was not confirmed.", "Known [r1:f1, f2].", "Unknown [r4:f1].", "Wrong [f1].", "Consider 1,200 things.", "No office has a confirmed stake.",
    "Alpha Advisors L.P. has $5M [r1:f1]. **1.** Beta Corp. grew<br>fast [r2:f1].", "### 2. Birch Family Office<br>is old<br>---<br>and so on", "Sr. Partner Jr. spoke! Then<br><br>1. One. [r1:f1] [r2:f2]<br>2. Two<br>  * three<br>-<br>- x", "See No. 5, St. Mary [note: r1:f1; f2] [r1:f1,;f3] or [1].<br>- a<br><br>| b | c |<br>| no information | $5 |",
    "Marola Investimentos Ltda. and U.S. Co. [ : ] [r1: f1 ,f2].  <br> It raised $500.<br>3 offices matched. 12) twelve", "Lead with it.<br>We could not confirm it<br>- Mr. X is unknown on file",
]
PICK_LINE = lambda of: f"replace(CASE ({of}) % {len(LINES)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LINES)) + " END, '<br>', chr(10))"
SAID_LINES = f"{TAGGED} || chr(10) || {PICK_LINE('conv_id + turn')} || chr(10) || {PICK_LINE('conv_id * 7 + turn')}"
LIT = lambda p: "'" + p.replace("'", "''") + "'"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ABBREVIATED = "|".join(x.replace(".", "\\.") for x in G.ABBREVIATIONS)
#: Sentences of the lines: end marks first, then the lines of each piece that open a block.
SENTENCES = f"""
n AS (SELECT conv_id, turn, regexp_replace({SAID_LINES}, '([.!?])[ \\t]*((?:\\[[^\\]]+\\][ \\t]*)*\\[[^\\]]+\\])', ' \\2\\1', 'g') AS text FROM v_answer),
m AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\b({ABBREVIATED})\\.', '\\1' || chr(1), 'g'), '(?m)(^{G.ORDINAL})\\.([\\s*])', '\\1' || chr(1) || '\\2', 'g') AS t FROM n),
e AS (SELECT conv_id, turn, generate_subscripts(ps, 1) AS piece, string_split(unnest(ps), chr(10)) AS lines FROM (SELECT conv_id, turn, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)) AS ps FROM m)),
b AS (SELECT conv_id, turn, piece, array_to_string(list_transform(lines, lambda x, i: CASE WHEN i = 1 THEN '' WHEN regexp_matches(array_to_string(lines[i:], chr(10)), {LIT('(?m)\\A' + G.BLOCK_OPENER)}) THEN chr(3) ELSE chr(10) END || x), '') AS t FROM e),
p AS (SELECT conv_id, turn, list_filter(list_transform(flatten(list(string_split(regexp_replace(t, '\\n+' || chr(3), chr(3), 'g'), chr(3)) ORDER BY piece)), lambda x: replace(x, chr(1), '.')), lambda x: regexp_matches(x, '\\S')) AS s FROM b GROUP BY conv_id, turn),
u AS (SELECT conv_id, turn, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM p)"""
KEYS = ["conv_id", "turn", "place"]


def said(a):
    return G.split_sentences(a.select("conv_id", "turn", F.expr(SAID_LINES).alias("text")))


@query("gnd04_split_sentences", "v_answer", sql=f"WITH {SENTENCES} SELECT * FROM u")
def gnd04(a):
    return said(a)


TAG_SQL = "'\\[[^\\]]*:[^\\]]*\\]'"
PAIRS = f"""
g AS (SELECT conv_id, turn, place, generate_subscripts(tags, 1) AS tag, list_filter(list_transform(string_split_regex(unnest(tags), '[,;]'), lambda x: {STRIP('x')}), lambda x: x <> '') AS raws FROM (SELECT *, regexp_extract_all(sentence, '\\[([^\\]]*:[^\\]]*)\\]', 1) AS tags FROM u)),
w AS (SELECT conv_id, turn, place, tag, unnest(range(len(raws))) AS nth, unnest(raws) AS raw FROM g),
k AS (SELECT *, {STRIP("last_value(CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id, turn, place, tag ORDER BY nth)")} AS record, {STRIP("CASE WHEN contains(raw, ':') THEN regexp_replace(raw, '^[^:]*:', '') ELSE raw END")} AS field FROM w),
pairs AS (SELECT conv_id, turn, place, row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY tag, nth) - 1 AS part, record, field, coalesce(record = '', true) OR field = '' OR contains(field, ':') AS malformed FROM k)"""


@query("gnd05_parse_tags", "v_answer", sql=f"WITH {SENTENCES}, {PAIRS} SELECT * FROM pairs")
def gnd05(a):
    return G.parse_tags(said(a), KEYS)


def classified(a):
    turns = a.select("conv_id").distinct()
    facts = turns.select("conv_id", F.explode(F.array(*[F.struct(F.lit(f"r{i}").alias("record"), F.lit(f"f{j}").alias("field"), F.lit(f" Value {i + 5 + j} ").alias("value")) for i in range(9) if i != 4 for j in (1, 2)])).alias("f")).select("conv_id", "f.*")
    return G.classify_sentences(said(a), facts, KEYS, ["conv_id"])


FIGURED = lambda x: f"regexp_matches({x}, {LIT(G.FIGURE)})"
SHAPED = lambda x: f"regexp_matches({STRIP(x)}, {LIT(G.STRUCTURE)})"
HEDGED = lambda x: f"(regexp_matches({STRIP(x)}, {LIT('(?i)' + G.HEDGES)}) OR regexp_matches({STRIP(x)}, {LIT(G.LIST_HEADER)}))"
CLASSES = f"""{SENTENCES}, {PAIRS},
facts AS (SELECT DISTINCT conv_id, 'r' || CAST(i AS STRING) AS record, 'f' || CAST(j AS STRING) AS field, 'value ' || CAST(i + 5 + j AS STRING) AS needle FROM v_answer, (SELECT unnest([0, 1, 2, 3, 5, 6, 7, 8]) AS i), (SELECT unnest([1, 2]) AS j)),
c AS (SELECT conv_id, turn, place, bool_or(malformed) AS malformed, bool_and(facts.record IS NOT NULL) AS all_known FROM pairs LEFT JOIN facts USING (conv_id, record, field) GROUP BY conv_id, turn, place),
d AS (SELECT *, {STRIP(f"regexp_replace(regexp_replace(regexp_replace(sentence, {TAG_SQL}, '', 'g'), '\\s+', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g')")} AS display, regexp_matches(sentence, {TAG_SQL}) AS tagged, list_filter(string_split(sentence, chr(10)), lambda x: regexp_matches(x, '\\S')) AS lines FROM u),
l AS (SELECT *, {FIGURED('sentence')} AS figure, len(list_filter(lines, lambda x: NOT {SHAPED('x')})) = 0 AS structure, len(list_filter(lines, lambda x: NOT ({HEDGED('x')} OR ({SHAPED('x')} AND NOT {FIGURED('x')})))) = 0 AS hedge FROM d),
a AS (SELECT *, NOT figure AND NOT regexp_matches(sentence, {LIT(G.RECORD_ID)}) AND NOT regexp_matches(sentence, {LIT(G.FIRM)}) AND (regexp_matches(sentence, {LIT(G.PERSON)}) OR regexp_matches(regexp_replace({STRIP('sentence')}, {LIT(G.LEAD_IN)}, ''), {LIT(G.OPENER)}))
 AND NOT EXISTS (SELECT 1 FROM facts WHERE facts.conv_id = l.conv_id AND contains(lower(sentence), needle)) AS advice FROM l),
classes AS (SELECT conv_id, turn, place, sentence, display, CASE WHEN display = '' THEN 'structural' WHEN tagged THEN CASE WHEN malformed OR NOT all_known THEN 'invalid' ELSE 'claim' END WHEN structure AND NOT figure THEN 'structural' WHEN hedge THEN 'neutral' WHEN advice THEN 'authorial' ELSE 'invalid' END AS kind,
 CASE WHEN display = '' THEN NULL WHEN tagged THEN CASE WHEN malformed THEN 'malformed citation tag' WHEN NOT all_known THEN 'tag references an unconfirmed or nonexistent field' END WHEN (structure AND NOT figure) OR hedge OR advice THEN NULL ELSE 'untagged' END AS reason FROM a LEFT JOIN c USING (conv_id, turn, place))"""


@query("gnd06_classify_sentences", "v_answer", sql=f"WITH {CLASSES} SELECT * FROM classes")
def gnd06(a):
    return classified(a)


@query("gnd07_entailment", "v_answer", sql=f"""
WITH {CLASSES}, t AS (SELECT conv_id, turn, coalesce(string_agg(sentence, ' ' ORDER BY place) FILTER (kind NOT IN ('invalid', 'structural')), '') AS kept, coalesce(sum(length(regexp_replace(sentence, '^\\s+|\\s+$', '', 'g'))) FILTER (kind = 'invalid'), 0) AS gone, coalesce(sum(length(display)) FILTER (kind = 'claim'), 0) AS held FROM classes GROUP BY conv_id, turn)
SELECT conv_id, turn, kept, round(CASE WHEN gone + held = 0 THEN 0 ELSE CAST(gone AS DOUBLE) / CAST(gone + held AS DOUBLE) END, 6) AS stripped_share, CASE WHEN gone + held = 0 THEN false ELSE CAST(gone AS DOUBLE) / CAST(gone + held AS DOUBLE) > 0.3 END AS discard FROM t""")
def gnd07(a):
    return G.entailment(classified(a), ["conv_id", "turn"])


@query("gnd08_quote_grounded", "v_quote", "v_doc", sql="""
WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM v_quote), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS b FROM v_doc),
h AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN d ON contains(b, q) GROUP BY item_id) SELECT q.item_id, doc_id, doc_id IS NOT NULL AS grounded FROM q LEFT JOIN h USING (item_id)""")
def gnd08(quotes, docs):
    return G.quote_grounded(quotes, docs, G.quote_candidates(quotes, docs))


PHRASED = [
    "Intro. It is a  Single-Family Office. More", "We serve families and our clients", "Fam7 Family Office LLC", "the Fam7 of it", "Founded 1990. One family. Client families too.", "The Family''s Capital is patient", "A multifamily office! With client relationships. End", "our family, our clients", "nothing. at all.",
]
SAID = f"CASE doc_id % {len(PHRASED) + 1} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PHRASED)) + " ELSE text END"
SIDE_OF = "CASE doc_id % 3 WHEN 0 THEN 'MFO' WHEN 1 THEN 'SFO' ELSE 'type_unconfirmed' END"
PHRASES = {"sfo": G.SFO_PHRASES, "mfo": G.MFO_PHRASES}
FIRST = {side: "CASE " + " ".join(f"WHEN contains(low, {LIT(p)}) THEN {LIT(p)}" for p in phrases) + " END" for side, phrases in PHRASES.items()}


@query("gnd09_quote_checks", "v_doc", sql=f"""
WITH s AS (SELECT doc_id, {SIDE_OF} AS side, {SAID} AS said FROM v_doc), f AS (SELECT *, lower(regexp_replace(said, '\\s+', ' ', 'g')) AS low FROM s)
SELECT doc_id, CASE WHEN side = 'MFO' THEN {FIRST['mfo']} IS NOT NULL ELSE {FIRST['sfo']} IS NOT NULL END AS decisive,
 len(list_filter(regexp_extract_all(lower(said), '[a-z]{{3,}}'), lambda w: w NOT IN ('fam', 'family', 'office', 'offices', 'llc', 'inc', 'the', 'and', 'for', 'wealth'))) = 0 AS only_name FROM f""")
def gnd09(d):
    return d.select("doc_id", G.quote_is_decisive(F.expr(SAID), F.expr(SIDE_OF)).alias("decisive"), G.snippet_is_name(F.expr(SAID), F.lit("Fam7")).alias("only_name"))


def mech(d):
    return G.mechanical_type(d.select((F.col("doc_id") % 100).alias("entity_id"), F.col("doc_id").alias("seq"), F.expr(SAID.replace("doc_id %", "(doc_id + doc_id % 100) %")).alias("text"), (F.col("doc_id") % 3 == 0).alias("own_site")))


MECH = f"""e AS (SELECT doc_id % 100 AS entity_id, doc_id AS seq, regexp_replace({SAID.replace("doc_id %", "(doc_id + doc_id % 100) %")}, '\\s+', ' ', 'g') AS whole, doc_id % 3 = 0 AS own_site FROM v_doc),
f AS (SELECT *, CASE WHEN own_site THEN 2 ELSE 1 END AS weight, lower(whole) AS low FROM e), h AS (SELECT *, {FIRST['sfo']} AS sp, {FIRST['mfo']} AS mp FROM f),
q AS (SELECT *, CASE WHEN side = 'SFO' THEN sp ELSE mp END AS phrase FROM h, (SELECT unnest(['SFO', 'MFO']) AS side)),
x AS (SELECT entity_id, side, seq, own_site, left(trim(regexp_extract(left(whole, strpos(low, phrase) - 1), '[^.]*$') || substr(whole, strpos(low, phrase), length(phrase)) || regexp_extract(substr(whole, strpos(low, phrase) + length(phrase)), '^[^.]*[.]?')), 400) AS quote,
 row_number() OVER (PARTITION BY entity_id, side ORDER BY own_site DESC, CASE WHEN own_site THEN -seq ELSE seq END) AS n FROM q WHERE phrase IS NOT NULL),
m AS (SELECT entity_id, CAST(sum(CASE WHEN sp IS NOT NULL THEN weight ELSE 0 END) AS BIGINT) AS sfo, CAST(sum(CASE WHEN mp IS NOT NULL THEN weight ELSE 0 END) AS BIGINT) AS mfo FROM h GROUP BY 1),
t AS (SELECT m.*, CASE WHEN sfo > mfo THEN 'SFO' WHEN mfo > sfo THEN 'MFO' ELSE 'unconfirmed' END AS mechanical FROM m)"""


@query("gnd10_mechanical_type", "v_doc", sql=f"WITH {MECH} SELECT t.*, quote, x.seq AS quote_seq, x.own_site AS quote_own FROM t LEFT JOIN x ON x.entity_id = t.entity_id AND side = mechanical AND n = 1")
def gnd10(d):
    return mech(d)


#: What a model judged of each entity, and what the checks of GND-08 and GND-09 said of its quote.
JUDGED = """SELECT entity_id, CASE entity_id % 5 WHEN 0 THEN 'SFO' WHEN 1 THEN 'MFO' WHEN 2 THEN 'type_unconfirmed' WHEN 3 THEN 'SFO' ELSE 'MFO' END AS judged, CASE entity_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' none ' WHEN 2 THEN NULL ELSE 'said of ' || CAST(entity_id AS STRING) END AS quote,
 entity_id % 4 > 0 AS grounded, entity_id % 3 = 1 AS own_site, entity_id % 11 = 5 AS only_name, entity_id % 6 <> 3 AS decisive FROM {m} WHERE entity_id % 13 > 0"""


@query("gnd11_type_verdict", "v_doc", sql=f"""
WITH {MECH}, y AS (SELECT t.entity_id, mechanical, x.quote AS found, coalesce(x.own_site, false) AS found_own FROM t LEFT JOIN x ON x.entity_id = t.entity_id AND side = mechanical AND n = 1), j AS ({JUDGED.format(m='t')}),
r AS (SELECT *, judged IN ('SFO', 'MFO') AS told, CASE WHEN judged = 'type_unconfirmed' OR upper(trim(coalesce(quote, ''))) IN ('', 'NONE') THEN 'llm_declined' WHEN NOT grounded THEN 'quote_not_grounded' WHEN only_name THEN 'quote_is_only_the_name' WHEN NOT decisive THEN 'quote_not_decisive' END AS reason FROM j JOIN y USING (entity_id)),
z AS (SELECT entity_id, CASE WHEN reason IS NULL THEN 1 WHEN mechanical <> 'unconfirmed' THEN 2 WHEN told THEN 3 END AS way, * EXCLUDE (entity_id) FROM r),
o AS (SELECT *, CASE way WHEN 1 THEN own_site WHEN 2 THEN found_own ELSE false END AS own FROM z WHERE way IS NOT NULL)
SELECT entity_id, CASE WHEN way = 2 THEN mechanical ELSE judged END AS type_final, CASE way WHEN 1 THEN CASE WHEN own THEN 'high' ELSE 'medium' END WHEN 2 THEN CASE WHEN own THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence, CASE WHEN own THEN 'confirmed' ELSE 'single_source' END AS status, CASE WHEN own THEN 'site_scrape' ELSE 'serper_organic' END AS source_class,
 CASE way WHEN 1 THEN quote WHEN 2 THEN found END AS quote, concat_ws(';', reason, CASE way WHEN 2 THEN 'recovered_mechanically' WHEN 3 THEN 'llm_unverified' END, CASE WHEN way < 3 THEN CASE WHEN own THEN 'own_site' ELSE 'third_party' END END) AS basis FROM o""")
def gnd11(d):
    m = mech(d)
    return G.type_verdict(d.sparkSession.sql(JUDGED.format(m="{m}"), m=m), m)
