"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem
from ..operators import retrieve as R
from ..sources.scratch import scratch_path
from .registry import query

LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
Q = "lower(coalesce(query_text, ''))"
STATE_SQL = f"CASE {' '.join(f"WHEN regexp_matches({Q}, '\\b{n}\\b') THEN '{c}'" for n, c in R.STATES.items())} WHEN regexp_extract(query_text, '\\b([A-Z]{{2}})\\b', 1) IN ({LISTED(sorted(set(R.STATES.values())))}) THEN regexp_extract(query_text, '\\b([A-Z]{{2}})\\b', 1) END"
TYPE_SQL = f"CASE WHEN regexp_matches({Q}, '\\b(sfos?|single[- ]family offices?)\\b') THEN 'SFO' WHEN regexp_matches({Q}, '\\b(mfos?|multi[- ]family offices?)\\b') THEN 'MFO' END"


@query("qry01_parse_filters", "v_ask", sql=f"""SELECT query_id, {TYPE_SQL} AS entity_type, {STATE_SQL} AS hq_state, array_to_string(list_filter([{LISTED(R.MANDATES)}], lambda m: regexp_matches({Q}, '\\b' || m || '\\b')), ',') AS mandates FROM v_ask""")
def qry01(q):
    return R.parse_filters(q)


NUM = "TRY_CAST(regexp_extract(replace({}, ',', ''), '^[0-9]+([.][0-9]+)?') AS DOUBLE)"
TIMES = "CASE left({}, 1) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 WHEN 't' THEN 1e3 ELSE 1 END"


@query("qry02_parse_amounts", "v_ask", sql=f"""
WITH r AS (SELECT query_id, {Q} AS q, regexp_extract({Q}, '{R.SPAN}', ['a', 'ua', 'b', 'ub']) AS s FROM v_ask),
w AS (SELECT *, list_transform(range(len(regexp_extract_all(q, '{R.BOUND}', 1))), lambda i: {{'w': regexp_extract_all(q, '{R.BOUND}', 1)[i + 1], 'n': regexp_extract_all(q, '{R.BOUND}', 2)[i + 1], 'u': regexp_extract_all(q, '{R.BOUND}', 3)[i + 1]}}) AS found FROM r),
d AS (SELECT *, list_transform(found, lambda x: {{'side': CASE WHEN regexp_matches(x.w, 'over|above|more|greater|at least|>') THEN 1 WHEN regexp_matches(x.w, 'under|below|less|fewer|at most|<') THEN 2 ELSE 3 END, 'v': {NUM.format('x.n')} * {TIMES.format('x.u')}}}) AS sided FROM w),
l AS (SELECT *, list_filter(sided, lambda x: x.side <> 2)[-1] AS lo, list_filter(sided, lambda x: x.side <> 1)[-1] AS hi, {NUM.format('s.a')} * {TIMES.format("coalesce(nullif(s.ua, ''), s.ub)")} AS x, {NUM.format('s.b')} * {TIMES.format("coalesce(nullif(s.ub, ''), s.ua)")} AS y FROM d)
SELECT query_id, CASE WHEN x IS NOT NULL THEN least(x, y) ELSE lo.v * CASE WHEN lo.side = 3 THEN 0.75 ELSE 1 END END AS aum_min, CASE WHEN x IS NOT NULL THEN greatest(x, y) ELSE hi.v * CASE WHEN hi.side = 3 THEN 1.25 ELSE 1 END END AS aum_max FROM l""")
def qry02(q):
    return R.parse_amounts(q)


NAMES = "n(code, pattern) AS (VALUES " + ", ".join(f"('{c}', '\\b(" + "|".join([n for n, k in R.STATES.items() if k == c] + [c.lower()]) + ")\\b')" for c in sorted(set(R.STATES.values()))) + ")"
TOPIC = f"""{NAMES}, f AS (SELECT query_id, regexp_replace({Q}, '[^\\p{{L}}\\p{{N}}\\s%$.-]', ' ', 'g') AS q, {TYPE_SQL} AS kind, {STATE_SQL} AS state FROM v_ask),
u AS (SELECT query_id, kind, CASE WHEN state IS NULL THEN q ELSE regexp_replace(q, pattern, ' ', 'g') END AS q FROM f LEFT JOIN n ON code = state),
k AS (SELECT query_id, CASE WHEN kind IS NULL THEN q ELSE regexp_replace(regexp_replace(q, '\\b(single|multi)[\\s-]?family\\b', ' ', 'g'), '\\b(sfo|mfo)\\b', ' ', 'g') END AS q FROM u),
topics AS (SELECT query_id, array_to_string(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '' AND NOT regexp_matches(x, '{R.AMOUNT}') AND x NOT IN ({LISTED(R.SCAFFOLDING)})), ' ') AS topic FROM k)"""


@query("qry03_topical_residual", "v_ask", sql=f"WITH {TOPIC} SELECT query_id, topic FROM topics")
def qry03(q):
    return R.topical_residual(q)


@query("qry04_shape", "v_ask", sql=f"""
SELECT query_id, CASE WHEN regexp_matches({Q}, '\\b(how many|how much|what (?:fraction|percentage|share|proportion)|number of|count of|total (?:number|count))\\b') THEN 'count' WHEN regexp_matches({Q}, '\\b(?:who is|what is|tell me about)\\b') THEN 'one' ELSE 'many' END AS shape,
 CASE WHEN regexp_extract({Q}, '\\b(?:top|first|best|leading)\\s+(\\d{{1,3}})\\b', 1) = '' THEN 10 ELSE greatest(1, least(25, CAST(regexp_extract({Q}, '\\b(?:top|first|best|leading)\\s+(\\d{{1,3}})\\b', 1) AS INT))) END AS top_n FROM v_ask""")
def qry04(q):
    return R.shape(q)


REPLY = "CASE length(topic) % 6 WHEN 0 THEN 'Terms:' || chr(10) || ' - Clean Energy, 2. Solar power, x, a much too long phrase, carbon ' WHEN 1 THEN 'no list here' WHEN 2 THEN topic || ', Beta, beta , BETA, gamma-ray, c3po, delta, epsilon, zeta, eta, theta, iota' WHEN 3 THEN '' WHEN 4 THEN 'one' || chr(10) || 'two, three' || chr(10) || 'four, five' ELSE 'Energy transition, * wind, 10 percent, wealth!' END"


@query("qry05_expand_terms", "v_ask", sql=f"""
WITH {TOPIC}, r AS (SELECT query_id, trim(topic) AS topic, {REPLY} AS reply FROM topics WHERE trim(topic) <> ''),
l AS (SELECT *, coalesce(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: contains(x, ','))[1], reply) AS line FROM r),
t AS (SELECT *, list_concat([lower(topic)], list_filter(list_transform(string_split(line, ','), lambda x: regexp_replace(lower(trim(x)), '^[-*\\d.\\s]+', '')), lambda x: length(x) BETWEEN 2 AND 30 AND regexp_matches(x, '^[a-z][a-z\\s-]*$') AND len(string_split_regex(x, '\\s+')) <= 2)) AS every FROM l)
SELECT query_id, CASE WHEN len(string_split_regex(topic, '\\s+')) > 2 OR reply = '' THEN topic ELSE array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i)[1:8], '|') END AS terms FROM t""")
def qry05(q):
    t = R.topical_residual(q)
    return R.expand_terms(t, t.filter("topic <> ''").select("topic").distinct().withColumn("reply", F.expr(REPLY)))


def specs(q):
    return q.select("query_id", F.when(F.col("query_id") % 3 == 0, "SFO").alias("want_type"), F.when(F.col("query_id") % 4 == 0, "TX").when(F.col("query_id") % 4 == 1, "ZZ").alias("want_state"), F.when(F.col("query_id") % 2 == 0, F.col("query_id") * 20_000_000).cast("long").alias("aum_min"), F.when(F.col("query_id") % 5 == 0, F.lit(700_000_000)).cast("long").alias("aum_max"))


SPEC = """s AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'SFO' END AS ty, CASE query_id % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'ZZ' END AS st, CASE WHEN query_id % 2 = 0 THEN query_id * 20000000 END AS lo, CASE WHEN query_id % 5 = 0 THEN 700000000 END AS hi FROM v_query)"""
T = ["(lo IS NULL OR aum_usd >= lo)", "(hi IS NULL OR aum_usd <= hi)", "(st IS NULL OR coalesce(hq_state = st, false))", "(ty IS NULL OR entity_type = ty)"]


@query("ret01_sweep", "v_entity", "v_query", sql=f"""
WITH {SPEC}, h AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY record_id) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM v_entity JOIN s ON {' AND '.join(T)}) SELECT *, total > 1000 AS truncated FROM h WHERE place <= 1000""")
def ret01(e, q):
    return R.sweep(e, specs(q))


@query("ret02_exclusion_reasons", "v_entity", sql="""
SELECT record_id, array_to_string(list_filter([CASE WHEN outcome = 'reject' THEN 'rejected outcome' END, CASE WHEN principal_name IS NULL THEN 'no named principal' END, CASE WHEN aum_usd < 0 THEN 'negative assets' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM v_entity""")
def ret02(e):
    return R.exclusion_reasons(e)


LV = ", ".join(f"count(*) FILTER ({' AND '.join(T[i:]) or 'true'}) AS n{i}" for i in range(5))


@query("ret03_relax", "v_entity", "v_query", sql=f"""
WITH {SPEC}, c AS (SELECT query_id, {LV} FROM v_entity CROSS JOIN s GROUP BY query_id) SELECT query_id, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 WHEN n3 > 0 THEN 3 WHEN n4 > 0 THEN 4 ELSE -1 END AS dropped,
 CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 ELSE n4 END AS rows FROM c""")
def ret03(e, q):
    return R.relax(e, specs(q))


FACETS = ["mandate", "activity", "why_now"]


def evidence(c):
    """Distances to the vectors of every chunk whose id is divisible by 20."""
    vectors = c.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.best_evidence(c, vectors, FACETS)


DIST = """q AS (SELECT chunk_id AS query_id, embedding AS vector FROM v_chunk WHERE chunk_id % 20 = 0),
d AS (SELECT query_id, record_id, chunk_id, facet, content, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])))) AS distance FROM v_chunk CROSS JOIN q WHERE facet IN ('mandate', 'activity', 'why_now')),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, record_id ORDER BY distance, chunk_id) AS n FROM d) WHERE n = 1), sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS sem_rank FROM e)"""


@query("ret04_best_evidence", "v_chunk", sql=f"WITH {DIST} SELECT query_id, record_id, chunk_id, facet, round(distance, 6) + 0.0 AS distance FROM e")
def ret04(c):
    return evidence(c).withColumn("distance", F.round("distance", 6) + 0.0)


@query("ret05_semantic_rank", "v_chunk", sql=f"WITH {DIST} SELECT query_id, record_id, sem_rank FROM sem")
def ret05(c):
    return R.semantic_rank(evidence(c)).select("query_id", "record_id", "sem_rank")


# the third word of every twentieth chunk, its second and fifth as one term, and a word with other endings
TERM_LIST = "regexp_extract_all(lower(content), '[a-z0-9]+')"


def stems_of(words: str) -> str:
    """CTEs that give every word of a CTE its stem, as st(word, stem)."""
    names = dict(w="w", p1="p1", p2="p2")
    out = [f"st_a AS (SELECT DISTINCT word, word AS w FROM {words} WHERE word NOT IN ({LISTED(stem.STOP_WORDS)}))", f"st_b AS (SELECT word, w, {stem.R1.format(**names)} AS p1 FROM st_a)", f"st_0 AS (SELECT word, w, p1, {stem.R2.format(**names)} AS p2 FROM st_b)"]
    out += [f"st_{k + 1} AS (SELECT word, {step.format(**names)} AS w, p1, p2 FROM st_{k})" for k, step in enumerate(stem.STEPS)]
    return ", ".join([*out, f"st AS (SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(word, '^[a-z]+$') THEN w ELSE word END AS stem FROM st_{len(stem.STEPS)})"])


LEX = f"""tk AS (SELECT record_id, chunk_id, {TERM_LIST} AS t FROM v_chunk), tm AS (SELECT chunk_id AS query_id, unnest([t[3], t[2] || ' ' || t[5], t[4] || 'ing']) AS term FROM tk WHERE chunk_id % 20 = 0),
ex AS (SELECT record_id, chunk_id, len(t) AS n, unnest(t) AS word FROM tk), tw AS (SELECT query_id, term, unnest(string_split(term, ' ')) AS word FROM tm WHERE term IS NOT NULL), bo AS (SELECT word FROM ex UNION SELECT word FROM tw), {stems_of('bo')},
w AS (SELECT DISTINCT query_id, term, stem FROM tw JOIN st USING (word)), nd AS (SELECT query_id, term, count(*) AS need FROM w GROUP BY 1, 2), tf AS (SELECT record_id, chunk_id, n, stem, count(*) AS tf FROM ex JOIN st USING (word) GROUP BY 1, 2, 3, 4),
ht AS (SELECT query_id, term, record_id, chunk_id, n, count(*) AS have, sum(tf) AS tf FROM tf JOIN w USING (stem) GROUP BY 1, 2, 3, 4, 5),
lx AS (SELECT query_id, record_id, max(round(tf / n, 9)) AS score FROM ht JOIN nd USING (query_id, term) WHERE have = need GROUP BY 1, 2), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS lex_rank FROM lx)"""


def lexical(c):
    """Ranks over stored postings."""
    path = scratch_path(c.sparkSession, "postings")
    R.write_postings(c, path)
    t = c.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.expr("regexp_extract_all(lower(content), '([a-z0-9]+)', 1)").alias("t"))
    one = lambda i: F.get("t", F.lit(i - 1))
    terms = t.select("query_id", F.explode(F.array(one(3), F.concat(one(2), F.lit(" "), one(5)), F.concat(one(4), F.lit("ing")))).alias("term")).filter("term IS NOT NULL")
    return R.lexical_rank(c.sparkSession.read.parquet(path), terms)


@query("ret06_lexical_rank", "v_chunk", sql=f"WITH {LEX} SELECT query_id, record_id, lex_rank FROM lex")
def ret06(c):
    return lexical(c).select("query_id", "record_id", "lex_rank")


RRF = f"""{DIST}, {LEX}, rr AS (SELECT coalesce(sem.query_id, lex.query_id) AS query_id, coalesce(sem.record_id, lex.record_id) AS record_id, sem_rank, lex_rank, coalesce(1.0::DOUBLE / (sem_rank + 60), 0) + coalesce(1.0::DOUBLE / (lex_rank + 60), 0) AS raw FROM sem FULL JOIN lex ON sem.query_id = lex.query_id AND sem.record_id = lex.record_id),
fused AS (SELECT query_id, record_id, sem_rank, lex_rank, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS fit_rank FROM rr)"""


@query("ret07_rrf", "v_chunk", sql=f"WITH {RRF} SELECT * FROM fused")
def ret07(c):
    return R.rrf(R.semantic_rank(evidence(c)), lexical(c))


@query("ret08_relevance_gate", "v_chunk", sql=f"""
WITH {RRF} SELECT f.query_id, f.record_id, CASE WHEN fit_rank = 0 THEN 'no match' WHEN e.chunk_id % 7 = 0 THEN 'no thesis' WHEN f.query_id % 40 = 0 AND distance > 0.65 THEN 'too far' END AS reason FROM fused f JOIN e ON f.query_id = e.query_id AND f.record_id = e.record_id""")
def ret08(c):
    content = F.when(F.col("chunk_id") % 7 == 0, F.lit(R.NON_STATEMENTS[0] + " for it.")).otherwise("text")
    return R.rrf(R.semantic_rank(evidence(c)), lexical(c), keep=["chunk_id", "distance"]).filter("sem_rank IS NOT NULL").select("query_id", "record_id", R.relevance_gate(F.col("fit_rank"), content, F.col("distance"), F.col("query_id") % 40 == 0).alias("reason"))


STATED = "CASE doc_id % 6 WHEN 0 THEN text || '" + R.NON_STATEMENTS[1] + "' WHEN 1 THEN lower('" + R.NON_STATEMENTS[0] + "') WHEN 2 THEN '" + R.NON_STATEMENTS[3] + ".' WHEN 3 THEN NULL ELSE text END"


@query("rnk01_is_non_statement", "v_doc", sql=f"SELECT doc_id, coalesce({" OR ".join(f"contains(t, '{m}')" for m in R.NON_STATEMENTS)}, false) AS non_statement FROM (SELECT doc_id, {STATED} AS t FROM v_doc) AS x")
def rnk01(d):
    return d.select("doc_id", R.is_non_statement(F.expr(STATED)).alias("non_statement"))


FIXED = lambda c, n: f"CAST(round(CAST(CAST(CAST({c} AS DOUBLE) AS VARCHAR) AS DECIMAL(20, 17)), {n}) AS VARCHAR)"
FACET = "CASE chunk_id % 3 WHEN 0 THEN 'mandate' WHEN 1 THEN 'activity' END"


@query("rnk02_fit_score", "v_chunk", sql=f"""
WITH {RRF}, x AS (SELECT f.query_id, f.record_id, e.chunk_id, CASE WHEN f.record_id % 5 <> 0 THEN fit_rank END AS r, CASE WHEN f.record_id % 4 <> 0 THEN distance END AS d, f.record_id % 3 AS hit FROM fused f JOIN e ON f.query_id = e.query_id AND f.record_id = e.record_id),
y AS (SELECT *, greatest(0, least(1, r)) AS p, greatest(0, least(1, 1 - d / 2)) AS s, chunk_id % 7 = 0 AS silent, coalesce({FACET}, 'no facet') AS facet FROM x)
SELECT query_id, record_id, round(CASE WHEN silent THEN 0 ELSE 0.75 * CASE WHEN r IS NOT NULL AND d IS NOT NULL THEN 0.4 * p + 0.6 * s WHEN r IS NOT NULL THEN p WHEN d IS NOT NULL THEN s ELSE 0 END + 0.25 * (hit / 2) END, 5) AS fit,
 CASE WHEN silent THEN '' ELSE concat_ws('; ', CASE WHEN r IS NOT NULL AND d IS NOT NULL THEN concat('evidence rank ', {FIXED('p', 2)}, ' x similarity ', {FIXED('s', 2)}, ' (', facet, ')') WHEN r IS NOT NULL THEN concat('fused evidence rank ', {FIXED('p', 3)}, ' (', facet, ')') WHEN d IS NOT NULL THEN concat('evidence distance ', {FIXED('d', 3)}, ' (', facet, ')') END,
 CASE hit WHEN 1 THEN 'matches 1 of 2 spec mandate tag' WHEN 2 THEN 'matches 2 of 2 spec mandate tags' END) END AS why,
 CASE WHEN silent THEN 'no investing thesis on file' WHEN r IS NULL AND d IS NULL THEN 'no evidence chunk for the thesis' ELSE '' END AS gaps FROM y""")
def rnk02(c):
    rank, distance = F.when(F.col("record_id") % 5 != 0, F.col("fit_rank")), F.when(F.col("record_id") % 4 != 0, F.col("distance"))
    content = F.when(F.col("chunk_id") % 7 == 0, F.lit(R.NON_STATEMENTS[0] + " for it.")).otherwise("text")
    x = R.rrf(R.semantic_rank(evidence(c)), lexical(c), keep=["chunk_id", "distance"]).filter("sem_rank IS NOT NULL").select("query_id", "record_id", R.fit(rank, distance, content, F.expr(FACET), F.col("record_id") % 3, F.lit(2)).alias("f"))
    return x.select("query_id", "record_id", F.round("f.score", 5).alias("fit"), F.array_join("f.why", "; ").alias("why"), F.array_join("f.gaps", "; ").alias("gaps"))


STAT = "CASE record_id % 7 WHEN 0 THEN 'could_not_verify' WHEN 1 THEN 'pattern_inferred' ELSE 'verified' END"


REACHED = f"SELECT record_id, CASE WHEN record_id % 5 = 3 THEN '' ELSE principal_email END AS m, CASE WHEN record_id % 11 > 0 THEN {STAT} END AS ms, CASE record_id % 4 WHEN 0 THEN '212' WHEN 1 THEN '' END AS ph, CASE WHEN record_id % 3 = 0 THEN 'contradicted' END AS ps, CASE WHEN record_id % 6 < 2 THEN 'l' END AS li, principal_name AS nm FROM v_entity"


@query("rnk03_reach_score", "v_entity", sql=f"""
WITH r AS ({REACHED}), x AS (SELECT *, coalesce(m <> '', false) AS hm, coalesce(ph <> '', false) AS hp, coalesce(ms IN ('could_not_verify', 'removed_failed_validation', 'contradicted'), false) AS mbad, coalesce(ps IN ('could_not_verify', 'removed_failed_validation', 'contradicted'), false) AS pbad FROM r),
y AS (SELECT *, CASE WHEN hm AND NOT mbad THEN CASE WHEN coalesce(ms IN ('pattern_inferred', 'format_only'), false) THEN 2 ELSE 1 END WHEN hp AND NOT pbad THEN 3 WHEN coalesce(li <> '', false) THEN 4 WHEN coalesce(nm <> '', false) THEN 5 ELSE 6 END AS k FROM x)
SELECT record_id, [1.0, 0.85, 0.75, 0.5, 0.25, 0.0][k] AS reach, CASE k WHEN 1 THEN 'reachable via email (' || coalesce(ms, 'null') || ')' WHEN 2 THEN 'email address inferred, not sourced (' || ms || ')' WHEN 3 THEN 'reachable via phone' WHEN 4 THEN 'linkedin available' WHEN 5 THEN 'named principal but no contact path' ELSE '' END AS why,
 CASE WHEN k < 3 THEN '' WHEN k = 5 THEN 'no email,no phone,no linkedin' WHEN k = 6 THEN 'no named principal,no email,no phone,no linkedin' ELSE concat_ws(',', CASE WHEN NOT hm THEN 'no email' END, CASE WHEN k = 4 AND NOT hp THEN 'no phone' END) END AS gaps FROM y""")
def rnk03(e):
    r = e.sparkSession.sql(REACHED.replace("v_entity", "{v}"), v=e)
    x = r.select("record_id", R.reach(*[F.col(c) for c in ("m", "ms", "ph", "ps", "li", "nm")]).alias("r"))
    return x.select("record_id", F.col("r.score").alias("reach"), F.array_join("r.why", ",").alias("why"), F.array_join("r.gaps", ",").alias("gaps"))


@query("rnk04_recency_score", "v_source", sql="""
WITH x AS (SELECT seq, date_diff('day', CAST(retrieved_at AS DATE), DATE '1998-01-01') AS d FROM v_source)
SELECT seq, CASE WHEN seq % 10 = 0 THEN 0.0 WHEN d <= 90 THEN 1.0 WHEN d <= 180 THEN 0.75 WHEN d <= 365 THEN 0.5 ELSE 0.25 END AS recency,
 CASE WHEN seq % 10 = 0 THEN '' ELSE 'most recent signal ' || CAST(d AS STRING) || 'd old (' || CASE WHEN d <= 90 THEN '≤90d' WHEN d <= 180 THEN '≤180d' WHEN d <= 365 THEN '≤365d' ELSE 'stale' END || ')' END AS why, CASE WHEN seq % 10 = 0 THEN 'no recent signal date' ELSE '' END AS gaps FROM x""")
def rnk04(s):
    x = s.select("seq", R.recency(F.when(F.col("seq") % 10 != 0, F.to_date("retrieved_at")), F.to_date(F.lit("1998-01-01"))).alias("r"))
    return x.select("seq", F.col("r.score").alias("recency"), F.array_join("r.why", "; ").alias("why"), F.array_join("r.gaps", "; ").alias("gaps"))


CONFS = "CASE record_id % 4 WHEN 0 THEN 'verified_evidence_present' WHEN 1 THEN 'single_source_only' ELSE 'thin' END"


@query("rnk05_trust_score", "v_entity", sql=f"""
SELECT record_id, round(CASE {CONFS} WHEN 'verified_evidence_present' THEN 1.0 WHEN 'single_source_only' THEN 0.6 ELSE 0.3 END * CASE WHEN outcome = 'ship_with_caveats' THEN 0.8 ELSE 1 END, 6) AS trust,
 'record confidence: ' || {CONFS} || CASE WHEN outcome = 'ship_with_caveats' THEN '; scaled by 0.8 (outcome: ship_with_caveats)' ELSE '' END AS why FROM v_entity""")
def rnk05(e):
    x = e.select("record_id", R.trust(F.expr(CONFS), F.col("outcome")).alias("t"))
    return x.select("record_id", F.round("t.score", 6).alias("trust"), F.array_join("t.why", "; ").alias("why"))


PARTS = "CAST(record_id % 10 AS DOUBLE) / 10 AS fit, CASE WHEN record_id % 25 = 3 THEN 0.5 ELSE CAST(record_id % 4 AS DOUBLE) / 4 END AS reach, 0.25 AS recency, CAST(record_id % 3 AS DOUBLE) / 4 AS trust"


def scores(e):
    return e.selectExpr("record_id % 25 AS query_id", "record_id", *[p.strip() for p in PARTS.split(", ")])


SC = f"""sc AS (SELECT record_id % 25 AS query_id, record_id, {PARTS} FROM v_entity),
mm AS (SELECT query_id, count(*) AS n, CASE WHEN max(fit) - min(fit) > 1e-9 THEN 0.35 ELSE 0 END AS a, CASE WHEN max(reach) - min(reach) > 1e-9 THEN 0.30 ELSE 0 END AS b, CASE WHEN max(recency) - min(recency) > 1e-9 THEN 0.20 ELSE 0 END AS c, CASE WHEN max(trust) - min(trust) > 1e-9 THEN 0.15 ELSE 0 END AS d FROM sc GROUP BY 1),
ew AS (SELECT query_id, CASE WHEN n < 2 OR a + b + c + d = 0 THEN 0.35 ELSE CAST(a AS DOUBLE) / (a + b + c + d) END AS w_fit, CASE WHEN n < 2 OR a + b + c + d = 0 THEN 0.30 ELSE CAST(b AS DOUBLE) / (a + b + c + d) END AS w_reach, CASE WHEN n < 2 OR a + b + c + d = 0 THEN 0.20 ELSE CAST(c AS DOUBLE) / (a + b + c + d) END AS w_recency, CASE WHEN n < 2 OR a + b + c + d = 0 THEN 0.15 ELSE CAST(d AS DOUBLE) / (a + b + c + d) END AS w_trust FROM mm)"""


@query("rnk06_effective_weights", "v_entity", sql=f"WITH {SC} SELECT query_id, round(w_fit, 6) AS w_fit, round(w_reach, 6) AS w_reach, round(w_recency, 6) AS w_recency, round(w_trust, 6) AS w_trust FROM ew")
def rnk06(e):
    w = R.effective_weights(scores(e))
    return w.select("query_id", *[F.round(c, 6).alias(c) for c in w.columns[1:]])


@query("rnk07_rank", "v_entity", sql=f"""
WITH {SC}, a AS (SELECT DISTINCT query_id, 3 + query_id % 9 AS top_n, query_id % 2 = 0 AS topical FROM sc), x AS (SELECT sc.query_id, record_id, fit, fit * w_fit + reach * w_reach + recency * w_recency + trust * w_trust AS s, row_number() OVER (PARTITION BY sc.query_id ORDER BY fit DESC, record_id) AS f FROM sc JOIN ew USING (query_id)),
p AS (SELECT x.*, top_n, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, record_id) AS place FROM x JOIN a USING (query_id) WHERE NOT topical OR f <= top_n) SELECT query_id, record_id, place, round(s, 6) AS score FROM p WHERE place <= top_n""")
def rnk07(e):
    x = scores(e)
    return R.rank(x, x.select("query_id").distinct().select("query_id", (3 + F.col("query_id") % 9).alias("top_n"), (F.col("query_id") % 2 == 0).alias("topical")))


REPLIES = "CASE conv_id % 3 WHEN 0 THEN '[0, 2]' WHEN 1 THEN 'none of them' ELSE '[]' END"


@query("rnk08_apply_keep_list", "v_answer", sql="SELECT conv_id, turn AS place FROM v_answer WHERE CASE conv_id % 3 WHEN 0 THEN turn IN (0, 2) WHEN 1 THEN true ELSE false END")
def rnk08(a):
    return R.apply_keep_list(a.select("conv_id", F.col("turn").alias("place")), a.filter("turn = 0").select("conv_id", F.expr(REPLIES).alias("reply")))


@query("agg01_count_matching", "v_entity", "v_query", sql=f"WITH {SPEC} SELECT query_id, count(record_id) AS matching FROM s LEFT JOIN v_entity ON {' AND '.join(T)} AND (query_id % 2 = 0 OR record_id % 3 = 0) GROUP BY query_id")
def agg01(e, q):
    records = e.withColumn("mandates", F.when(F.col("record_id") % 3 == 0, F.array(F.lit("real estate"), F.lit("energy"))).otherwise(F.array(F.lit("tech"))))
    asked = specs(q).withColumn("want_mandates", F.when(F.col("query_id") % 2 == 1, F.array(F.lit("energy"))))
    return R.count_matching(records, asked)


@query("agg02_record_view", "v_entity", "v_query", sql="""
WITH i AS (SELECT query_id, unnest([3, 1, 2]) * 10 + query_id AS record_id, unnest([0, 1, 2]) AS place FROM v_query) SELECT query_id, place, record_id, entity_type, CASE WHEN record_id % 2 = 0 THEN 'hook' END AS hook FROM i LEFT JOIN v_entity USING (record_id)""")
def agg02(e, q):
    ids = q.select("query_id", F.array(*[F.col("query_id").cast("long") + 10 * k for k in (3, 1, 2)]).alias("ids"))
    return R.record_view(ids, e, e.filter("record_id % 2 = 0").select("record_id", F.lit("hook").alias("hook"))).select("query_id", "place", "record_id", "entity_type", "hook")


@query("agg03_baseline_diff", "v_answer", sql="""
WITH c AS (SELECT conv_id, coalesce(list(DISTINCT turn) FILTER (length(text) % 2 = 0), []) AS a, coalesce(list(DISTINCT turn) FILTER (length(text) % 3 = 0), []) AS b FROM v_answer GROUP BY conv_id)
SELECT conv_id AS query_id, array_to_string(list_sort(list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: CAST(x AS VARCHAR))), ',') AS lost, array_to_string(list_sort(list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: CAST(x AS VARCHAR))), ',') AS gained FROM c""")
def agg03(answers):
    cited = lambda n: answers.groupBy(F.col("conv_id").alias("query_id")).agg(F.collect_set(F.when(F.length("text") % n == 0, F.col("turn"))).alias("cited"))
    return R.baseline_diff(cited(2), cited(3))


LOG = """SELECT role AS intent, CASE WHEN turn % 2 = 0 THEN {none} ELSE {one} END AS relaxed_filters, CASE WHEN length(text) % 5 = 0 THEN {none} ELSE {one} END AS retrieved_record_ids, CASE WHEN turn % 7 > 0 THEN length(text) / 1000.0 END AS top_score,
 CASE length(text) % 11 WHEN 0 THEN 'decline_low_score' WHEN 1 THEN 'decline_out_of_scope' WHEN 2 THEN 'decline_zero_results' ELSE 'proceed' END AS gate1_decision, CASE WHEN length(text) % 11 < 3 THEN NULL WHEN turn % 5 = 4 THEN 'discard_over_threshold' ELSE 'proceed' END AS gate2_decision, (turn % 4) / 4.0 AS stripped_fraction FROM v_answer"""


@query("agg03_query_log_stats", "v_answer", sql=f"""
WITH log AS ({LOG.format(none="[]", one="['x']")})
SELECT intent, count(*) AS queries, count(*) FILTER (len(relaxed_filters) > 0) AS relaxed, count(*) FILTER (len(retrieved_record_ids) = 0) AS empty, count(*) FILTER (starts_with(gate1_decision, 'decline') OR starts_with(gate2_decision, 'discard')) AS refused,
 round(avg(CAST(top_score AS DOUBLE)), 6) AS mean_top_score, round(avg(CAST(stripped_fraction AS DOUBLE)), 6) AS mean_stripped FROM log GROUP BY intent""")
def agg03_log(answers):
    columns = LOG.format(none="CAST(array() AS array<string>)", one="array('x')").removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    log = answers.sparkSession.sql(f"SELECT {columns} FROM {{answers}}", answers=answers)
    return R.query_log_stats(log.withColumn("top_score", F.col("top_score").cast("double")).withColumn("stripped_fraction", F.col("stripped_fraction").cast("double")))
