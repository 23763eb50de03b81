"""Rules that are easy to get wrong, on small hand-made ledgers, against plain Python."""

import random
import re
import uuid
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerspark.operators import cells, corpus, ground, ledger, retrieve, validate

SCHEMA = "seq long, created_at timestamp, claim_id string, entity_id long, field_name string, question_id string, status string, source_class string, extraction_method string, answer string, answer_num double, source_url string, retrieved_at timestamp, confidence string"


def claims(spark, n, seed, fields=("aum_usd", "headcount")):
    import datetime

    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rnd.randint(0, 3))
        rows.append((i, day, f"c{i}", rnd.randint(0, 5), rnd.choice([*fields, None]), "G1.Q3", rnd.choice(["confirmed", "verified", "contradicted", "superseded", "could_not_verify", "removed_failed_validation"]), rnd.choice(["snov", "gdelt", "13f_filing", None]), rnd.choice(["projected_x", "derived_y", "jsonld", None]), rnd.choice(["", "abc", "ab", "xyz", "No", None]), None, "u", None, "low"))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_contradiction_scan(spark):
    for seed in range(3):
        df, rows = claims(spark, 120, seed)
        got = sorted((r.claim_id, r.other_id) for r in validate.contradiction_findings(df).collect())
        norm = lambda a: str(a).strip().lower()
        fits = lambda a, b: bool(norm(a)) and bool(norm(b)) and (norm(a) in norm(b) or norm(b) in norm(a))
        want, groups = [], {}
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            if r[4] and r[6] not in ("could_not_verify", "superseded"):
                groups.setdefault((r[3], r[4]), []).append([r[2], r[6], r[9]])
        for g in groups.values():
            for i, a in enumerate(g):
                for b in g[i + 1 :]:
                    if a[1] == b[1] == "contradicted":
                        continue
                    if not fits(a[2], b[2]):
                        a[1] = b[1] = "contradicted"
                        want.append((a[0], b[0]))
        assert got == sorted(want)


def test_cells_do_not_depend_on_partitions(spark):
    df, rows = claims(spark, 300, 9, ("principal_name", "aum_usd"))
    one = sorted(map(str, cells.resolve_cells(df).collect()))
    assert one == sorted(map(str, cells.resolve_cells(df.repartition(7, "claim_id")).collect()))
    for r in cells.resolve_cells(df).collect():
        own = [c for c in sorted(rows, key=lambda c: (c[1], c[0])) if (c[3], c[4]) == (r.entity_id, r.field_name)]
        assert r.winner_id == own[-1][2]
        fit = [c for c in own if r.field_name == "principal_name" and c[6] not in ("superseded", "removed_failed_validation") and c[9]]
        rank = lambda c: 0 if (c[8] or "").startswith("projected_") else 1 if (c[8] or "").startswith("derived_") else 2
        if fit:
            best = min(map(rank, fit))
            assert r.value == "; ".join(dict.fromkeys(c[9] for c in fit if rank(c) == best))
        else:
            assert r.value == (None if own[-1][6] == "removed_failed_validation" else own[-1][9])


def test_uuid5(spark):
    names = ["a", "x|None|é|u|3", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ledger.uuid5_url(F.col("n"))).collect()]
    assert got == [uuid.uuid5(uuid.NAMESPACE_URL, n).hex for n in names]


def test_quota_against_scan(spark):
    rnd = random.Random(2)
    for n, cap in ((50, 15), (7, 2), (400, 3)):
        rows = [(i, f"k{rnd.randint(0, 5)}", rnd.randint(0, 6), rnd.choice(["SFO", "MFO"]), rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(0, 2)) for i in range(300)]
        df = spark.createDataFrame(rows, "entity_id long, discovery_class_primary string, actionability_score long, type_final string, verified_cell_count long, urgency_tier_rank long, discovery_class_count long")
        got = {r.entity_id: r.excluded for r in cells.select_quota(df, n, cap).collect()}
        want, per = {}, {}
        for r in sorted(rows, key=lambda r: (-r[2], r[3] != "SFO", -r[4], -r[5], -r[6], r[0])):
            if sum(not x for x in want.values()) >= n:
                break
            want[r[0]] = per.get(r[1], 0) >= cap
            per[r[1]] = per.get(r[1], 0) + (not want[r[0]])
        assert got == want


def test_negation_reads_tokens(spark):
    texts = {"No, none.": True, "Noble Family": False, "Norwegian fund": False, "There is no evidence": True, "yes; no evidence that it is": True, "": False}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", validate.negative_fo(F.col("t")).alias("n")).collect()}
    assert got == texts


def test_state_names_are_tried_in_order(spark):
    q = spark.createDataFrame([(1, "offices in West Virginia"), (2, "in NY please"), (3, "in Texas")], "query_id long, query_text string")
    assert {r.query_id: r.hq_state for r in retrieve.parse_filters(q).collect()} == {1: "VA", 2: "NY", 3: "TX"}


def test_empty_ledger(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (cells.resolve_cells, cells.alternatives, validate.cross_class, validate.contradictions, validate.contradiction_findings, validate.identity_gate, validate.completeness, ledger.latest_by_field, ledger.select_claim):
        assert f(none).count() == 0


def test_vectors_of_chunks(spark):
    texts = ["Alpha beta alpha", "", None, "Émile 12"]
    got = corpus.embed_chunks(spark.createDataFrame(list(enumerate(texts)), "id long, content string")).collect()
    for r in got:
        n = Counter(zlib.crc32(w.encode()) % corpus.VECTOR_SIZE for w in re.findall("[a-z0-9]+", (r.content or "").lower()))
        size = sum(v * v for v in n.values()) ** 0.5 or 1
        assert all(abs(x - n[i] / size) < 1e-6 for i, x in enumerate(r.embedding)) and len(r.embedding) == corpus.VECTOR_SIZE


def test_contradictions_of_a_hot_field(spark):
    """All claims of one field: the pairs are those of the scan, and the plan joins by position."""
    data = [(i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}", f"c{i}", 1, "aum_usd", "confirmed", "a" if i % 50 else "b") for i in range(600)]
    df = spark.createDataFrame(data, "seq long, created_at string, claim_id string, entity_id long, field_name string, status string, answer string").withColumn("answer_num", F.lit(None).cast("double"))
    found = validate.contradiction_findings(df)
    assert found.count() == 599 and "a_least" in found._jdf.queryExecution().executedPlan().toString()


def test_quotes_of_any_length_are_found(spark):
    body = "zero one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "nothing here"), (2, body), (3, body + " more"), (4, None), (5, "")], "doc_id long, text string")
    said = ["three", "hre", "two three", "wo thr", "one two three", "ne two thr", "one two three four five six seven", "one two three four five six seven eight", "one two three four five six seven eigh", "ero  one two three four five six seven eight ni", "nine ten", "one three", "one two three four five six eight", ""]
    quotes = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    got = {r.item_id: r.doc_id for r in ground.quote_grounded(quotes, docs, ground.quote_candidates(quotes, docs)).collect()}
    fold = [" ".join(s.split()) for s in said]
    assert got == {i: 2 if s and s in body else None for i, s in enumerate(fold)}
    assert got[0] == got[2] == got[6] == got[7] == 2
