"""Names, mentions and negations in scripts and spaces beyond ASCII, against cases and plain Python."""

import random
import re

from pyspark.sql import functions as F

from ledgerspark.operators import contacts, facts, resolve, validate


def one(spark, values, column):
    """The values of a column function over texts."""
    frame = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in frame.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_core_phrase_loses_one_suffix(spark):
    want = {
        "Acme, L.L.C.": "acme", "Acme LLC.": "acme llc", "Acme Inc. Co": "acme inc", "DISCO": "disco", "First Bank, N.A.": "first bank n a", "Müller & Co": "müller", "Weiß ltd\n": "weiss", "Acme Company": "acme company",
        "CO": "", "Étude,LP": "étude", "Pty Ltd": "pty", "": "", "a_b  Corp": "a_b",
    }
    assert one(spark, want, resolve.core_name_phrase) == list(want.values())


def test_core_phrase_like_plain_python(spark):
    suffix = re.compile(r"\s*,?\s*\b(?:L\.L\.C\.|LLC|INC\.?|LP|LLP|LTD|CORP|CO)\s*$", re.IGNORECASE)
    random.seed(5)
    parts = ["LLC", "L.L.C.", "inc.", "Inc", " ", ",", " ", "\n", "é", "Co", "x", ".", "-", "corp", "_", "lp", "Straße", "Ω"]
    names = ["".join(random.choice(parts) for _ in range(random.randint(0, 7))) for _ in range(600)]
    want = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", suffix.sub("", n).casefold().replace("ς", "σ"))).strip() for n in names]
    assert one(spark, names, resolve.core_name_phrase) == want


def test_normal_names_know_white_space_of_any_kind(spark):
    assert one(spark, ["\t Acme  　Fund\n", "acme fund", None], resolve.normalize_name) == ["ACME FUND", "ACME FUND", None]


def test_distinctive_tokens_keep_inner_marks(spark):
    got = one(spark, ["The B.V. Family Offices & Co., Trust", "Bakken Investments,", "A&B. x Bank"], resolve.distinctive_tokens)
    assert got == [["b.v"], ["bakken"], ["a&b", "bank"]]


def test_best_of_several_names(spark):
    q = spark.createDataFrame([(1, "Bakken Energy LLC"), (2, "The Family Office")], "query_id int, q_name string")
    names = spark.createDataFrame([(7, "Bakken North Dakota"), (7, "Bakken"), (8, "Energy Trust"), (8, "Solar Energy"), (9, "Family Trust"), (10, "Wind Energy")], "seq int, name_raw string")
    assert {(r.query_id, r.seq): r.match for r in resolve.name_match(q, names).collect()} == {(1, 7): "exact", (1, 8): "exact", (1, 10): "partial"}


def test_entity_names_lose_the_run_of_suffixes(spark):
    want = {"Reap Financial Group, LLC": ("reap financial", "reap financial", "group llc"), "The Coury Firm": ("the coury firm", "coury firm", ""), "Acme L.L.C.": ("acme l l c", "acme", ""), "Co": ("", "", "co"), "Vista Trust": ("vista trust", "vista trust", "")}
    assert [tuple(r) for r in one(spark, want, resolve.normalize_entity_name)] == list(want.values())


def test_mentions_by_core_phrase(spark):
    texts = spark.createDataFrame([(1, 1, "Die Müller-Söhne kauften"), (1, 2, "Mller S hne"), (2, 3, "discography"), (3, 4, "all of it"), (4, 5, None)], "entity_id int, text_id int, text string")
    names = spark.createDataFrame([(1, "MÜLLER SÖHNE, LLC"), (2, "Disco Inc."), (3, "LLC"), (4, "x")], "entity_id int, phrase string")
    assert {r.text_id: r.mentioned for r in contacts.mentions_entity(texts, names).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_negations_in_other_scripts(spark):
    texts = {"Noël et fils": False, "Não": False, " \nNo.": True, "There's no site": False, "“None” found": True, "No": True}
    assert one(spark, texts, validate.negative_fo) == list(texts.values())
    assert one(spark, texts, facts.is_negative_answer) == list(texts.values())


def test_compatible_answers_without_outer_white_space(spark):
    row = spark.range(1).select(validate.compatible(F.lit(" Yes\n"), F.lit("yes"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("a"), validate.compatible(F.lit("\n"), F.lit("yes"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_identity_gate_takes_verdicts_first(spark):
    said = [(1, "G1.Q3", "confirmed", "No site", 1), (2, "G1.Q3", "confirmed", "A family office", 2), (3, "G1.Q3", "contradicted", "Yes", 3), (4, "G1.Q3", "confirmed", "No site", 4), (5, "G1.Q3", "confirmed", "Yes", 5), (6, "G1.Q3", "confirmed", "Yes", 6), (7, "G1.Q3", "confirmed", "Yes", 7)]
    said += [(5, "G1.Q5", "confirmed", "Yes, plain", 8), (6, "G1.Q5", "confirmed", "It is a plain adviser", 9), (7, "G1.Q5", "single_source", "Yes", 10)]
    ledger = spark.createDataFrame([(e, q, s, a, f"2024-01-{n:02}", n) for e, q, s, a, n in said], "entity_id int, question_id string, status string, answer string, created_at string, seq int")
    verdicts = [(1, "G1.Q3", "affirmative"), (2, "G1.Q3", "affirmative"), (2, "G1.Q3", "negative"), (3, "G1.Q3", "affirmative"), (4, "G1.Q3", "unclear"), (5, "G1.Q5", "negative"), (6, "G1.Q5", "affirmative"), (7, "G1.Q5", "affirmative"), (99, "G1.Q3", "negative")]
    polarity = spark.createDataFrame(verdicts, "entity_id int, question_id string, verdict string")
    found = lambda *p: {(r.entity_id, r.field) for r in validate.identity_gate(ledger, *p).collect()}
    assert found(polarity) == {(2, "G1.Q3"), (3, "G1.Q3"), (4, "G1.Q3"), (6, "G1.Q5")}
    assert found() == {(1, "G1.Q3"), (3, "G1.Q3"), (4, "G1.Q3"), (5, "G1.Q5")}
