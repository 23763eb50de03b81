"""What large tables need of plans: costly columns are worked out once and over all cores, and pairs of rows are not shuffled."""

from pyspark.sql import functions as F

from ledgerspark.operators import resolve as R
from ledgerspark.operators import retrieve as T
from ledgerspark.operators import watch as W


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_audit_works_an_address_out_once(spark):
    rows = spark.range(4).select(F.col("id").alias("record_id"), F.lit("Jane Doe").alias("principal_name"), F.concat(F.lit("marker"), F.col("id").cast("string"), F.lit("@fam.com")).alias("principal_email"))
    bad = W.audit_emails(rows.repartition(1))
    assert optimized(bad).count("marker") == 1
    assert {tuple(r) for r in bad.select("record_id", "firm_email", "audit").collect()} == {(i, f"marker{i}@fam.com", "email_attribution_unknown") for i in range(4)}


def test_demote_reads_one_file_over_all_cores(spark):
    rows = spark.range(0, 4, 1, 1).select(F.col("id").alias("record_id"), F.lit("Jane Doe").alias("principal_name"), F.lit("info@fam.com").alias("principal_email"))
    claims, _ = W.demote(rows)
    assert claims.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert claims.count() == 8


def test_topics_are_worked_out_once(spark):
    asked = spark.range(6).select(F.col("id").alias("query_id"), F.concat(F.lit("marker"), F.col("id").cast("string")).alias("query_text"))
    topics = T.topical_residual(asked)
    assert optimized(T.expand_terms(topics, topics.filter("topic <> ''").select("topic", F.lit("a, b").alias("reply")))).count("concat(marker") == 2  # once a use of the topics
    assert {r.topic for r in topics.collect()} == {f"marker{i}" for i in range(6)}


def test_name_pairs_are_not_grouped(spark):
    names = [(1, "Acme Rowe LLC"), (2, "ACME"), (2, "Rowe Zorn"), (3, "Zorn Bank"), (4, "The LLC"), (5, None), (6, "Bank Zorn, Inc")]
    queries = [(10, "Acme Rowe"), (11, "Zorn"), (12, "Bank Mill"), (13, "")]
    n = spark.createDataFrame(names, "seq int, name_raw string")
    q = spark.createDataFrame(queries, "query_id int, q_name string")
    got = R.name_match(q, n)
    tokens = {(k, name): set(r) for k, name, r in [(*x[:2], x[2]) for x in n.unionByName(q.select(F.col("query_id").alias("seq"), F.col("q_name").alias("name_raw"))).select("seq", "name_raw", R.distinctive_tokens(F.col("name_raw"))).collect()] if r}
    want = {}
    for (qid, _), a in tokens.items():
        for (seq, _), b in tokens.items():
            if qid >= 10 > seq and a & b:
                want[qid, seq] = "exact" if want.get((qid, seq)) == "exact" or a <= b or b <= a else "partial"
    rows = got.collect()
    assert len(rows) == len(want) and {(r.query_id, r.seq): r.match for r in rows} == want
    top = optimized(got).split("Join")[0]
    assert "Aggregate" not in top


def test_name_pairs_are_written_out_last(spark):
    n = spark.range(2300).select(F.col("id").alias("seq"), F.concat(F.lit("Rowe "), F.when(F.col("id") % 2 == 0, "Bank").otherwise("Mill")).alias("name_raw"))
    n = n.unionByName(spark.createDataFrame([(None, "Bank"), (-1, "Zorn")], "seq long, name_raw string"))
    q = spark.range(220).select(F.col("id").alias("query_id"), F.when(F.col("id") < 210, "Bank Rowe LLC").otherwise("Zorn").alias("q_name")).unionByName(spark.createDataFrame([(None, "Mill")], "query_id long, q_name string"))
    got = R.name_match(q, n)
    assert optimized(got).split("Join")[0].count("Generate explode") == 1  # the join gives a row per query and block of names
    rows = [tuple(r) for r in got.collect()]
    bank = {(i, s): "exact" if s is None or s % 2 == 0 else "partial" for i in range(210) for s in (None, *range(2300))}
    want = bank | {(i, -1): "exact" for i in range(210, 220)} | {(None, s): "exact" for s in range(1, 2300, 2)}
    assert len(rows) == len(want) and {r[:2]: r[2] for r in rows} == want


def test_one_file_is_embedded_over_all_cores(spark):
    from ledgerspark.operators import corpus as C

    chunks = spark.range(0, 3, 1, 1).select(F.col("id").alias("record_id"), F.when(F.col("id") > 0, F.repeat(F.lit("one two two "), F.col("id").cast("int"))).alias("content"))
    rows = C.embed_chunks(chunks)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.record_id: sorted(x for x in r.embedding if x) for r in rows.collect()}
    assert got[0] == [] and got[1] == got[2] and abs(got[1][1] - 2 * got[1][0]) < 1e-6


def test_words_are_stemmed_once_and_stem_sets_looked_for_once(spark):
    chunks = spark.createDataFrame([(1, 10, "funds of energy and energy"), (1, 11, "energy fund"), (2, 12, "fund the moon"), (3, 13, "moons")], "record_id int, chunk_id int, content string")
    stored = T.postings(chunks)
    assert "Join" in optimized(stored)
    terms = spark.createDataFrame([(1, "energy"), (2, "energies fund"), (3, "fund energy"), (3, "the"), (4, "moon fund"), (4, "moon"), (5, "sun fund")], "query_id int, term string")
    got = {(r.query_id, r.record_id): (round(r.score, 6), r.lex_rank) for r in T.lexical_rank(stored, terms).collect()}
    assert got == {(1, 1): (0.5, 1), (2, 1): (1.0, 1), (3, 1): (1.0, 1), (4, 3): (1.0, 1), (4, 2): (round(2 / 3, 6), 2)}


def test_fusing_broadcasts_no_query(spark):
    ranks = lambda c: spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], f"query_id int, record_id int, {c} int")
    got = T.rrf(ranks("sem_rank"), ranks("lex_rank"))
    assert "strategy=broadcast" not in optimized(got) and optimized(got).count("Join") == 1
    assert {(r.query_id, r.record_id): r.fit_rank for r in got.collect()} == {(1, 1): 1.0, (1, 2): 0.983871, (2, 1): 1.0}


def test_evidence_of_a_fit_score_is_looked_for_once(spark):
    from ledgerspark.plans import q_retrieve as Q

    chunks = spark.createDataFrame([(i, i % 7, "mandate", "one two three four five", [1.0, float(i)]) for i in range(60)], "chunk_id long, record_id long, facet string, content string, embedding array<float>")
    df = Q.rnk02(chunks)
    assert optimized(df).count("FlatMapCoGroupsInPandas") == 2  # the vectors, and the sets of stems
    assert df.count() == 3 * 7


def test_chunks_of_a_record_share_a_tile(spark):
    chunks = spark.range(900).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 100).alias("record_id"))
    tiles = {r.record_id: r.tiles for r in T._tiled(chunks, 900, 50, 100).groupBy("record_id").agg(F.count_distinct("tile").alias("tiles")).collect()}
    assert tiles.pop(0) <= 4 and set(tiles.values()) == {1}  # a record of many chunks in slices, any other whole


def test_sets_of_stems_by_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(T, "STEM_TILE", 20)
    monkeypatch.setattr(T, "STEM_SLICE", 5)
    rnd = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "zz"]
    chunks = [(i, 0 if i % 3 else i % 5, [rnd.choice(words[:4]) for _ in range(rnd.randint(1, 5))]) for i in range(60)]
    terms = [(q, " ".join(rnd.sample(words, rnd.randint(1, 3)))) for q in range(12) for _ in range(2)]
    want = {}
    for q, term in terms:
        for _, r, t in chunks:
            asked = set(term.split())
            if asked <= set(t):
                want[q, r] = max(want.get((q, r), 0), round(sum(x in asked for x in t) / len(t), 9))
    stored = T.postings(spark.createDataFrame([(c, r, " ".join(t)) for c, r, t in chunks], "chunk_id long, record_id long, content string"))
    got = T.lexical_rank(stored, spark.createDataFrame(terms, "query_id long, term string"))
    assert {(r.query_id, r.record_id): r.score for r in got.collect()} == want


def test_claims_of_a_field_of_few_values_are_not_spread_by_keys(spark, monkeypatch):
    import random

    from ledgerspark.operators import validate as V

    rnd = random.Random(5)
    pick = rnd.choice
    rows = [
        (i, f"c{i}", pick([1, 2, None]), pick(["aum", "name", None]), "G1.Q1", pick(["confirmed", "verified", "single_source", "contradicted", None]), pick([*sorted(V.CONFIRMING)[:3], "other", None]), pick([None, "Acme", " acme ", "Acme Rowe Family", "Rowe", "", "7"]), pick([None, None, 1.0, 2.0]), f"u{i}", i % 50)
        for i in range(400)
    ]
    ledger = spark.createDataFrame(rows, "seq long, claim_id string, entity_id long, field_name string, question_id string, status string, source_class string, answer string, answer_num double, source_url string, created_at long")
    text = lambda a: ("None" if a is None else a).lower().strip()

    def fits(a, b):
        if a[8] is not None and b[8] is not None:
            return a[8] == b[8]
        x, y = text(a[7]), text(b[7])
        return x != "" and y != "" and (x in y or y in x)

    want = {}
    for a in rows:
        by = None
        if a[5] == "confirmed" and a[2] is not None:
            by = min(((b[10], b[0], b[9], b[6]) for b in rows if b[2] == a[2] and (b[3] or b[4]) == (a[3] or a[4]) and b[5] in ("confirmed", "verified", "single_source") and b[6] in V.CONFIRMING and b[6] != a[6] and fits(a, b)), default=None)
        want[a[1]] = ("verified" if by else "single_source") if a[5] in ("confirmed", None) else a[5], by and by[2], by and by[3]
    for most in (64, 25, 3):  # all fields, some and none
        monkeypatch.setattr(V, "FEW", most)
        df = V.cross_class(ledger)
        assert {r.claim_id: (r.status, r.confirming_url, r.confirming_class) for r in df.collect()} == want
        if most == 64:
            assert "xxhash64" not in optimized(df) and optimized(df).count("Join") == 1


def test_sources_and_claims_are_read_once(spark):
    from ledgerspark.operators import facts as X

    day = F.to_timestamp(F.lit("2020-01-05"))
    cls = F.element_at(F.array(F.lit("13f_filing"), F.lit("adv_name"), F.lit("adv_name")), (F.col("id") % 3 + 1).cast("int"))
    sources = spark.range(6).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("entity_id"), cls.alias("source_class"), F.when(F.col("id") != 5, F.col("id") * 10).alias("value_usd"), F.lit(2020).alias("filed_year"), F.lit(1).alias("filed_qtr"), day.alias("retrieved_at"))
    sources = sources.filter("seq <> 0").withColumn("entity_id", F.when(F.col("seq") == 3, 7).otherwise(F.col("entity_id")))
    got = X.aum_claims(sources)
    assert optimized(got).count("Range (") == 1
    # 1: the newest adviser row has no value; 0: rows 2 and 4; 7: a 13F
    assert {tuple(r) for r in got.collect()} == {(0, "aum_usd", "40", "adv_raum"), (0, "aum_basis", "adv_raum", "adv_raum"), (0, "aum_as_of", "2020-01-05", "adv_raum"), (7, "aum_usd", "30", "derived_13f"), (7, "aum_basis", "13f_floor", "derived_13f"), (7, "aum_as_of", "2019Q4", "derived_13f")}

    field = F.when(F.col("id") % 2 == 0, "principal_name").otherwise("principal_title")
    claims = spark.range(4).select(F.col("id").alias("seq"), F.lit(1).alias("entity_id"), field.alias("field_name"), F.when(F.col("id") == 3, "CEO").otherwise("Jane Doe").alias("answer"), F.lit("derived_x").alias("extraction_method"), F.lit("confirmed").alias("status"), F.lit("Jane Doe").alias("owner"), F.lit("Acme LLC").alias("firm"))
    settled = X.reconcile_titles(claims, ["seq"])
    assert optimized(settled).count("Range (") == 1
    assert {r.seq: r.status for r in settled.collect()} == {0: "confirmed", 1: "superseded", 2: "confirmed", 3: "confirmed"}


def test_a_sentence_is_split_and_read_once(spark):
    from ledgerspark.operators import ground as G

    answers = spark.range(0, 3, 1, 1).select(F.col("id").alias("conv_id"), F.lit("It grew [r1:f1]. It shrank [r9:f1]. It is [:x]. We suggest a call. We suggest to name Larkspur.").alias("text"))
    facts = spark.createDataFrame([(0, "r1", "f1", " Larkspur "), (0, "r1", "f1", "abc"), (0, None, "f1", None), (1, "r9", "f1", "we")], "conv_id long, record string, field string, value string")
    sentences = G.split_sentences(answers)
    assert sentences.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    df = G.classify_sentences(sentences, facts, ["conv_id", "place"], ["conv_id"])
    assert optimized(df).count("Range (") == 1
    got = {(r.conv_id, r.place): (r.kind, r.reason) for r in df.collect()}
    unknown, bad, free = ("invalid", "tag references an unconfirmed or nonexistent field"), ("invalid", "malformed citation tag"), ("authorial", None)
    want = {0: [("claim", None), unknown, bad, free, ("invalid", "untagged")], 1: [unknown, ("claim", None), bad, free, free], 2: [unknown, unknown, bad, free, free]}
    assert got == {(c, i): x for c, rows in want.items() for i, x in enumerate(rows)}
