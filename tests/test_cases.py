"""Cases of the rules that are easy to get wrong, and brute force where SQL says little."""

import json
import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import web
from ledgerspark.operators import contacts, corpus, facts, ground, ledger, provenance, resolve, retrieve, validate, watch
from ledgerspark.sources import stored


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


# JSON-LD of any depth


def nested(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.2:
        return rnd.choice([None, "x", 3, {"@type": "Person", "name": rnd.choice(["", f"N{rnd.randint(0, 99)}", None, 5])}, {"@type": ["Thing", "Person"], "name": f"L{rnd.randint(0, 99)}", "jobTitle": "T"}])
    if kind < 0.5:
        return [nested(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    keys = rnd.sample(["@graph", "employee", "founder", "member", "employees", "people", "name"], rnd.randint(1, 4))
    return {"@type": rnd.choice(["Org", "Person", ["Org"]]), **{k: nested(rnd, depth - 1) for k in keys}}


def nodes(data):
    if isinstance(data, list):
        for x in data:
            yield from nodes(x)
    elif isinstance(data, dict):
        yield data
        for key in contacts.NESTED:
            if data.get(key):
                yield from nodes(data[key])


def test_jsonld_at_any_depth(spark):
    rnd = random.Random(3)
    pages, want = [], {}
    for i in range(150):
        blocks = [rnd.choice(["", "{bad", json.dumps(nested(rnd, rnd.randint(0, 6)))]) for _ in range(rnd.randint(0, 3))]
        pages.append((i, "<p>x" + "".join(f"<SCRIPT async type='application/ld+json'>\n{b}</script>" for b in blocks)))
        for b in blocks:
            try:
                found = [n for n in nodes(json.loads(b)) if (n.get("@type") == "Person" or (isinstance(n.get("@type"), list) and "Person" in n["@type"])) and n.get("name") and not isinstance(n["name"], (list, dict))]
            except ValueError:
                continue
            if found:
                want[i] = (str(found[0]["name"]), found[0].get("jobTitle") if isinstance(found[0].get("jobTitle"), str) else None)
                break
    got = {r.page_id: (r.name, r.title) for r in contacts.jsonld_person(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    plain = {i: w for i, w in want.items() if i in got and not got[i][0].startswith(("[", "{"))}
    assert {i: got[i] for i in plain} == plain and len(plain) > 30 and set(want) <= set(got)


# sentences


def brute_sentences(text):
    text = re.sub(r"([.!?])[ \t]*((?:\[[^\]]+\][ \t]*)*\[[^\]]+\])", r" \2\1", text)
    for a in ground.ABBREVIATIONS:
        text = re.sub(rf"\b{re.escape(a)}\.", f"{a}\x00", text)
    text = re.sub(r"(^|\n)([ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__|\*)?\s*\d+)\.(?=\s|\*)", "\\1\\2\x00", text)
    opener = r"[ \t]*(?:#{1,6}[ \t]|(?:-{3,}|\*{3,}|_{3,})[ \t]*$|\||(?:\*\*|__|\*)?\s*\d+[.)\x00]|[-*•]\s)"
    parts = re.split(rf"(?m)(?<=[.!?])\s+|\n+(?={opener})", text)
    return [x.replace("\x00", ".") for x in parts if x.strip()]


PIECES = ["Alpha Advisors L.P.", "has $5M", "[r:aum]", ".", "!", " ", " ", "\n", "\n\n", "**1.**", "1.", "12)", "### 2.", "- ", "* ", "---", "***", "| a |", "Beta Corp.", "Dr. Roe", "Sr.", "raised $500.", "3 offices", "U.S.", "it?", "[1]", "[a:b, c]", "#", "•", "_", "Ltda.", "No."]


def test_sentences_against_a_scan(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["", "Alpha Advisors L.P. has $5M [r:aum]. **1.** Beta Corp. grew\nfast [r:x].", "One. [a:x] [a:y] Two.\n\n## Head\n1. First\n2. Second"]
    rows = ground.split_sentences(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).orderBy("i", "place").collect()
    got = {i: [r.sentence for r in rows if r.i == i] for i in range(len(texts))}
    assert got == {i: brute_sentences(t) for i, t in enumerate(texts)}
    assert got[301] == ["Alpha Advisors L.P. has $5M [r:aum].", "**1.** Beta Corp. grew\nfast [r:x]."]


def test_type_verdict_recoveries(spark):
    judged = [(1, "SFO", "q", False, False, False, True), (2, "SFO", "q", True, True, False, True), (3, "MFO", "q", True, False, False, True), (4, "MFO", "q", True, True, True, True), (5, "type_unconfirmed", "", None, None, None, None), (6, "SFO", "q", True, True, False, True), (7, "type_unconfirmed", None, None, None, None, None), (8, "SFO", "q", True, False, False, False)]
    j = spark.createDataFrame(judged, "entity_id long, judged string, quote string, grounded boolean, own_site boolean, only_name boolean, decisive boolean")
    m = spark.createDataFrame([(1, "unconfirmed", None, None), (2, "MFO", "x", True), (3, "MFO", "x", True), (4, "SFO", "said", True), (5, "MFO", "said", False), (7, "unconfirmed", None, None), (8, "unconfirmed", None, None)], "entity_id long, mechanical string, quote string, quote_own boolean")
    got = {r.entity_id: (r.type_final, r.confidence, r.status, r.quote) for r in ground.type_verdict(j, m).collect()}
    assert got == {1: ("SFO", "low", "single_source", None), 2: ("SFO", "high", "confirmed", "q"), 3: ("MFO", "medium", "single_source", "q"), 4: ("SFO", "medium", "confirmed", "said"), 5: ("MFO", "low", "single_source", "said"), 8: ("SFO", "low", "single_source", None)}


# names and addresses


def test_names_and_addresses(spark):
    assert column(spark, ["noreply@x.com", "Contacts+a@x.com", "general@x.com", "hr@x.com", "no-reply@x.com", "jane@x.com"], web.is_role_address) == [True, True, True, False, True, False]
    names = column(spark, ["Dr J Roe", "HALE, THOMAS SR", "Li", "", None, "A. B.", "Mary Ann O'Neil III"], web.name_tokens)
    assert [None if n is None else (n.first, n.last) for n in names] == [("roe", "roe"), ("thomas", "hale"), ("li", "li"), (None, None), (None, None), (None, None), ("mary", "neil")]
    pairs = spark.createDataFrame([(0, "Hollis", "Ivor Hollis"), (1, "HOLLIS, EDITH", "Ivor Hollis"), (2, "", "x"), (3, None, "x"), (4, "Ivor A Hollis", "hollis ivor")], "i long, a string, b string")
    assert [r.x for r in pairs.orderBy("i").select(resolve.person_names_match(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, True]
    hits = spark.createDataFrame([(0, "j.ane", "jane", "li"), (1, "li", "li", "doe"), (2, "jd.oe-x", "al", "doe")], "i long, l string, f string, n string")
    assert [r.x for r in hits.orderBy("i").select(web.matches_principal(F.col("l"), F.col("f"), F.col("n")).alias("x")).collect()] == [True, False, True]


@pytest.mark.parametrize("locals_,pattern", [(["z.roe", "shannon", "mark"], "f.last"), (["shannonx", "jeremias"], "first"), (["jane.smith", "info"], "first.last"), (["constantine1", "maximiliana"], "flast"), (["info", "jdoe"], None), (["...", "jsmithersonx"], "first.last")])
def test_patterns_of_firms(spark, locals_, pattern):
    mails = spark.createDataFrame([(1, i, f"{x}@f.com", f"u{i}") for i, x in enumerate(locals_)], "firm long, seq long, email string, url string")
    got = contacts.infer_pattern(mails, spark.createDataFrame([(1, "John Doe")], "firm long, principal_name string")).collect()
    assert [r.pattern for r in got] == ([pattern] if pattern else [])


def test_vendor_order(spark):
    cols = "firm long, seq long, email string, score long, smtp_status string, error boolean, domain string, by_name boolean, principal_name string"
    rows = [
        (1, 0, "x@o.com", 99, None, False, "f.com", True, "Jane Doe"), (1, 1, "a@f.com", 10, None, False, "f.com", True, "Jane Doe"), (1, 2, "doe@f.com", 90, None, False, "f.com", False, "Jane Doe"),
        (2, 0, "a@f.com", 90, "valid", False, "f.com", False, "Jane Doe"), (2, 1, "doe@f.com", None, None, False, "f.com", False, "Jane Doe"), (3, 0, "a@f.com", 90, None, False, "f.com", False, None),
        (4, 0, "x@o.com", 90, None, False, "f.com", False, "Doe"), (5, 0, None, None, None, True, "f.com", True, "Doe"), (6, 0, "info@f.com", 90, "VALID", False, "f.com", True, "Doe"),
    ]
    got = {r.firm: (r.email, r.field, r.confidence, r.result) for r in contacts.choose_email_vendor(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("a@f.com", "principal_email", "low", "found"), 2: ("doe@f.com", "principal_email", "medium", "found"), 3: ("a@f.com", "firm_email", "low", "found"), 4: (None, None, None, "wrong_company"), 5: (None, None, None, "outage"), 6: ("info@f.com", "firm_email", "medium", "found")}


# dates, keys, signals


def test_article_dates(spark):
    now = F.lit("2026-03-31 13:05:09").cast("timestamp")
    texts = ["2026-06-20T12:00:00.000Z", "2026-06-20T12:00:00+02:00", "Jun 10 2026", "1 month ago", "2 years ago", "20260620t120000z", "5 minutes ago", "2026-06-20", None, " 3 Hours ago ", "Jun 31, 2026"]
    got = column(spark, texts, lambda v: F.date_format(watch.parse_article_date(v, now), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2026-06-20 12:00:00", "2026-06-20 10:00:00", "2026-06-10 00:00:00", "2026-03-03 13:05:09", "2024-03-31 13:05:09", "2026-06-20 12:00:00", None, "2026-06-20 00:00:00", None, "2026-03-31 10:05:09", "2026-07-01 00:00:00"]


def test_spent_keys(spark):
    said = spark.createDataFrame([(0, 429, "rate limit reached"), (1, 400, "Not enough credits"), (2, 400, None), (3, 500, "no credits"), (4, None, "no credits")], "i long, s int, b string").orderBy("i")
    assert [(r.a, r.b) for r in said.select(provenance.is_exhausted(F.col("s"), F.col("b")).alias("a"), provenance.is_exhausted(F.col("s"), F.col("b"), "watch").alias("b")).collect()] == [(True, False), (True, True), (False, False), (False, False), (False, False)]


LEDGER = "entity_id long, claim_id string, field_name string, question_id string, status string, answer string, answer_num double, source_class string, source_url string, created_at timestamp, retrieved_at timestamp, seq long"


def test_contradicted_claims_date_a_record(spark):
    day = datetime(2024, 5, 1)
    rows = [(1, "a", "recent_news", None, "contradicted", "x", None, "c", "u", day, day, 1), (2, "b", "recent_news", None, "could_not_verify", "x", None, "c", "u", day, day, 2)]
    got = {r.entity_id: r.latest_signal for r in corpus.record_signals(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == {1: "2024-05-01", 2: None}


def test_wave0_rejections_name_every_fatal_finding_in_order(spark):
    f = spark.createDataFrame([(1, "V4_contradiction", "fatal", "b", 1), (1, "V5_firm_is_fo", "fatal", None, 2), (1, "V4_contradiction", "fatal", "a", 3), (2, "V4_contradiction", "fatal", "b", 4), (3, "V6_completeness", "fatal", None, 5)], "entity_id long, check_id string, severity string, field string, seq long")
    assert {r.entity_id: r.reason_code for r in validate.rejections(f, "wave0").collect()} == {1: "V4_contradiction:b;V5_firm_is_fo:None;V4_contradiction:a"}
    assert {r.entity_id: r.reason_code for r in validate.rejections(f, "final").collect()} == {3: "V6_completeness"}


# corroboration by keys


def test_corroboration_against_all_pairs(spark):
    rnd = random.Random(7)
    words = ["", " ", "a", "ab", "Value 1", "value 11", "the quick brown fox", "quick brown", "The Quick Brown Fox jumps over", "fox jumps ov", "none", None, "é", "xyz" * 9, "z" + "xyz" * 4]
    classes = ["13f_filing", "site_scrape", "5500_filing", "serper_organic", None]
    rows = [(rnd.randint(0, 2), f"c{i}", rnd.choice(["f", "g"]), None, rnd.choice(["confirmed", "confirmed", "verified", "single_source", "contradicted"]), rnd.choice(words), rnd.choice([None, None, None, 1.0, 2.0]), rnd.choice(classes), f"u{i}", datetime(2024, 1, 1 + rnd.randint(0, 3)), None, i) for i in range(220)]
    norm = lambda a: ("None" if a is None else a).lower().strip(" ")

    def fits(a, b):
        if a[6] is not None and b[6] is not None:
            return a[6] == b[6]
        x, y = norm(a[5]), norm(b[5])
        return bool(x) and bool(y) and (x in y or y in x)

    from ledgerspark.vocab import CONFIRMING

    want = {}
    for a in rows:
        if a[4] != "confirmed":
            want[a[1]] = (a[4], None)
            continue
        found = [b for b in rows if b[:1] == a[:1] and b[2] == a[2] and b[4] in ("confirmed", "verified", "single_source") and b[7] in CONFIRMING and b[7] != a[7] and fits(a, b)]
        best = min(found, key=lambda b: (b[9], b[11]), default=None)
        want[a[1]] = ("verified", best[8]) if best else ("single_source", None)
    got = {r.claim_id: (r.status, r.confirming_url) for r in validate.cross_class(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == want


def test_a_field_of_very_many_values(spark):
    """As many pairs as values, not their square: the rounds settle all but the first few."""
    n = 20_000
    day = datetime(2024, 1, 1)
    df = spark.range(n).select(F.lit(1).cast("long").alias("entity_id"), F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("f").alias("field_name"), F.lit(None).cast("string").alias("question_id"), F.lit("confirmed").alias("status"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("z")).alias("answer"), F.lit(None).cast("double").alias("answer_num"), F.when(F.col("id") % 2 == 0, "13f_filing").otherwise("site_scrape").alias("source_class"), F.lit("u").alias("source_url"), F.lit(day).alias("created_at"), F.lit(day).alias("retrieved_at"), F.col("id").alias("seq"))
    assert validate.contradictions(df).filter("status = 'contradicted'").count() == n
    assert validate.cross_class(df).filter("status = 'single_source'").count() == n


# stored tables


def test_a_delta_of_one_key_rewrites_one_partition(spark, tmp_path):
    path = f"file://{tmp_path}/claims"
    claim = lambda i, status, seq: (f"c{i}", 1, None, "f", status, "x", "u", datetime(2024, 1, 1), seq)
    schema = "claim_id string, entity_id long, question_id string, field_name string, status string, answer string, source_url string, created_at timestamp, seq long"
    base, delta = spark.createDataFrame([claim(i, "confirmed", i) for i in range(200)], schema), spark.createDataFrame([claim(7, "verified", 900)], schema)
    stored.merge_stored(path, base, ["claim_id"], ledger.upsert_claims, buckets=8)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "claims").rglob("*.parquet")}
    before = files()
    stored.merge_stored(path, delta, ["claim_id"], ledger.upsert_claims, buckets=8)
    after = files()
    assert len({p.parent for p in set(before) ^ set(after)}) == 1
    got = Counter(map(str, stored.read_stored(spark, path).select(*base.columns).collect()))
    assert got == Counter(map(str, ledger.upsert_claims(base, delta).collect()))
    stored.merge_stored(path, delta.limit(0), ["claim_id"], ledger.upsert_claims, buckets=8)
    assert files() == after


def test_a_mirror_written_twice_and_one_that_fails(spark, tmp_path):
    path = f"file://{tmp_path}/mirror"
    rows = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run_id string, n long")
    for _ in range(2):
        stored.write_mirror({"prov": rows}, path)
    read = lambda: sorted((r.run_id, r.n) for r in spark.read.parquet(f"{path}/prov").collect())
    assert read() == [("r1", 1), ("r1", 2), ("r2", 3)]
    stored.write_mirror({"prov": rows.filter("run_id = 'r1' AND n = 1")}, path)  # the run's rows as they are now; the other run stays
    assert read() == [("r1", 1), ("r2", 3)]
    with pytest.raises(Exception):
        stored.write_mirror({"prov": rows.withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("long"))}, path)
    assert read() == [("r1", 1), ("r2", 3)]


# pages


def test_main_text_leaves_menus_and_footers(spark):
    long_ = "This is the story of a firm that grew for many years and then moved its office to another town. "
    html = [
        f"<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='side ad'>Buy this now please</div><article><h1>Head</h1><p>{long_}</p><script>x='</p>'</script><ul><li><a>a link</a></li><li>an item</li></ul></article><footer>&copy; all of it</footer></body></html>",
        f"<body><div id=menu><a>one two three four five six seven eight nine ten</a></div><div>{long_}<a>here</a></div><p>short</p><table><tr><td>{long_}</td></tr></table></body>", "", None, "<p>" + "x" * 50,
    ]
    got = column(spark, html, web.main_text)
    assert got == [f"Head\n{long_.strip()}\nan item", f"{long_.strip()} here", "", None, ""]
    pages = spark.createDataFrame([(0, html[0] * 3), (1, "y" * 60), (2, None)], "page_id long, html string")
    assert {r.page_id: r.result for r in contacts.extract_text(pages, most=5000, least=80).collect()} == {0: "ok", 1: "too_short", 2: "too_short"}
    assert {r.page_id: r.result for r in contacts.extract_text(pages, most=50, least=80).collect()} == {0: "too_large", 1: "too_large", 2: "too_short"}


def test_titles_of_search_results(spark):
    assert column(spark, ["Roe", "Jane Doe - CEO", "A long headline of five words - x", "Jane | CEO", "Jane — CEO", " - x"], contacts.name_from_serp_title) == [None, "Jane Doe", None, "Jane", "Jane", None]


def test_people_without_names_and_structured_sources(spark):
    people = spark.createDataFrame([(1, 9, 0, "", "Roe", None, "Chair", None, "fec_employer"), (1, 9, 1, "Doe", None, "CEO", None, None, "fec_employer"), (2, 9, 0, "X", None, None, None, None, "13f_filing")], "seq long, entity_id long, place int, name string, full_name string, title string, occupation string, role string, source_class string")
    assert [tuple(r)[2:4] for r in facts.principal_from_people(people).collect()] == [("Roe", "Chair")]


def test_ranks_of_queries_with_their_own_numbers(spark):
    s = spark.createDataFrame([(q, r, float(r % 5) / 5, float(r % 3) / 3, 0.5, 0.5) for q in (1, 2) for r in range(20)], "query_id long, record_id long, fit double, reach double, recency double, trust double")
    asked = spark.createDataFrame([(1, 3, True), (2, 5, False)], "query_id long, top_n int, topical boolean")
    got = Counter(r.query_id for r in retrieve.rank(s, asked).collect())
    assert got == {1: 3, 2: 5}
