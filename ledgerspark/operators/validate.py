"""Validation of a ledger: corroboration across source classes, contradictions, staleness, identity, completeness, release.

The pair rules look at the distinct (answer, class) values of a group, never at pairs of claims: a group with very many
claims has few distinct values to compare, and each claim then joins what its value found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, squeeze, strip
from ..vocab import CHANNEL, CONFIRMING, DATED_SIGNAL, DECISION_MAKER, MULTI_VALUED, STALE_DAYS
from .ledger import field_key, latest, latest_by_field


def is_confirming(source_class: Column) -> Column:
    """VAL-01: only a listed class confirms."""
    return F.coalesce(source_class.isin(CONFIRMING), F.lit(False))


def normal(answer: Column) -> Column:
    return strip(F.lower(F.coalesce(answer, F.lit("None"))))


def compatible(a: Column, b: Column, a_num: Column, b_num: Column) -> Column:
    """VAL-02: numbers must be equal; texts equal or one within the other."""
    return _compatible(normal(a), normal(b), a_num, b_num)


def _compatible(na: Column, nb: Column, a_num: Column, b_num: Column) -> Column:
    texts = (na != "") & (nb != "") & ((na == nb) | F.contains(na, nb) | F.contains(nb, na))
    return F.when(a_num.isNotNull() & b_num.isNotNull(), a_num == b_num).otherwise(texts)


def keyed(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("field_key", field_key()).filter("field_key IS NOT NULL")


GROUP = ["entity_id", "field_key"]
VALUE = [*GROUP, "answer", "answer_num", "source_class"]


def same_value(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    out = None
    for a, b in names.items():
        test = left[a].eqNullSafe(right[b])
        out = test if out is None else out & test
    return out


#: Letters of a gram and grams of a window in the keys of texts; texts of fewer than SHORT_TEXT letters are keys as a whole.
GRAM, WINDOW = 4, 8
SHORT_TEXT = GRAM + WINDOW - 1


def _runs(text: Column, n: Column, count: Column) -> Column:
    """Hashes of the runs of n letters at the first `count` places."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.substring(text, i, n)))).otherwise(F.array().cast("array<bigint>"))


def inner_key(text: Column) -> Column:
    """What every text that holds this one has among its outer keys: the text itself if it is short, else the least gram of its first window."""
    short = F.length(text) < SHORT_TEXT
    return F.struct(F.when(short, F.length(text)).otherwise(SHORT_TEXT).alias("len"), F.when(short, F.xxhash64(text)).otherwise(F.array_min(_runs(text, F.lit(GRAM), F.lit(WINDOW)))).alias("hash"))


def outer_keys(text: Column) -> Column:
    """Keys of all texts that this one can hold: its short runs, and the least gram of each window."""
    n = F.length(text)
    runs = lambda k: F.transform(F.array_distinct(_runs(text, k, n - k + 1)), lambda h: F.struct(k.alias("len"), h.alias("hash")))
    short = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(SHORT_TEXT - 1)), runs))
    least = lambda g: F.when(F.size(g) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - WINDOW + 1), lambda i: F.array_min(F.slice(g, i, F.lit(WINDOW)))))).otherwise(F.array().cast("array<bigint>"))
    long_ = F.transform(F.flatten(F.transform(F.array(_runs(text, F.lit(GRAM), n - GRAM + 1)), least)), lambda h: F.struct(F.lit(SHORT_TEXT).alias("len"), h.alias("hash")))
    return F.concat(short, long_)


#: Values of a field that may confirm, up to which every claim of the field is put to all of them.
FEW = 64


def cross_class(ledger: DataFrame) -> DataFrame:
    """VAL-03: a confirmed claim is verified by the first compatible settled claim of another, confirming class; else it has a single source.

    Statuses that the rule itself writes stay inside the set it accepts, so all claims can be judged at once. Claims go to the values of their field that may confirm, where these are FEW at
    most; in a field with more, values meet by keys that compatible ones share, equal numbers or a text within the other, never all values of the field.
    """
    rows = keyed(ledger)
    asking = rows.filter("status = 'confirmed'")
    first = F.min(F.struct("created_at", "seq", "source_url"))
    giving = rows.filter(F.col("status").isin("confirmed", "verified", "single_source") & is_confirming(F.col("source_class"))).groupBy(*VALUE).agg(first.alias("f"))
    counted = giving.withColumn("values", F.count(F.lit(1)).over(Window.partitionBy(*GROUP)))
    told = F.struct("f.created_at", "f.seq", F.col("f.source_url").alias("url"), F.col("source_class").alias("cls"), normal(F.col("answer")).alias("text"), F.col("answer_num").alias("num"))
    few = counted.filter(F.col("values") <= FEW).groupBy(*GROUP).agg(F.collect_list(told).alias("given"))
    met = lambda t: F.filter("given", lambda g: ~F.col("source_class").eqNullSafe(g["cls"]) & _compatible(t, g["text"], F.col("answer_num"), g["num"]))
    least = F.get(F.transform(F.array(normal(F.col("answer"))), lambda t: F.array_min(F.transform(met(t), lambda g: F.struct(*[g[c].alias(c) for c in ("created_at", "seq", "url", "cls")])))), F.lit(0))
    out = lambda r, status, by: r.select(*[F.col(c) for c in ledger.columns if c != "status"], "field_key", status.alias("status"), by["url"].alias("confirming_url"), by["cls"].alias("confirming_class"))
    judged = F.when(F.col("by").isNotNull(), "verified").otherwise("single_source")
    none = F.lit(None).cast("struct<url:string,cls:string>")
    rest = out(rows.filter("NOT (status <=> 'confirmed')"), F.coalesce("status", F.lit("single_source")), none)
    many = giving.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") > FEW).select(*GROUP)
    if many.isEmpty():
        return rest.unionByName(out(asking.join(few, GROUP, "left").withColumn("by", least), judged, F.col("by")))
    crowded = asking.join(many, GROUP, "left_semi")
    best = _by_keys(crowded.select(*VALUE).distinct(), counted.filter(F.col("values") > FEW).drop("values"))
    found = crowded.join(best, same_value(crowded, best, {c: f"b_{c}" for c in VALUE}), "left")
    plain = asking.join(many, GROUP, "left_anti").join(few, GROUP, "left").withColumn("by", least)
    return rest.unionByName(out(plain, judged, F.col("by"))).unionByName(out(found, judged, F.col("by")))


def _by_keys(asking: DataFrame, giving: DataFrame) -> DataFrame:
    """The first given value that each asking one is compatible with, found by keys."""
    other = giving.select(*[F.col(c).alias(f"o_{c}") for c in VALUE], "f")
    text, o_text = normal(F.col("answer")), normal(F.col("o_answer"))
    numbers = (F.array(F.struct(F.lit(0).alias("len"), F.xxhash64(c).alias("hash"))) for c in ("answer_num", "o_answer_num"))
    none = F.array().cast("array<struct<len:int,hash:bigint>>")
    inner, outer = (lambda t: F.when(t != "", F.array(inner_key(t))).otherwise(none)), (lambda t: F.when(t != "", outer_keys(t)).otherwise(none))
    pairs = None
    for a_keys, o_keys in ((inner(text), outer(o_text)), (outer(text), inner(o_text)), tuple(F.when(F.col(c).isNotNull(), n).otherwise(none) for c, n in zip(("answer_num", "o_answer_num"), numbers, strict=True))):
        a = asking.withColumn("key", F.explode(a_keys))
        o = other.withColumn("o_key", F.explode(o_keys))
        met = a.join(o, (a["entity_id"] == o["o_entity_id"]) & (a["field_key"] == o["o_field_key"]) & (a["key"] == o["o_key"])).drop("key", "o_key")
        pairs = met if pairs is None else pairs.unionByName(met)
    found = pairs.filter(~F.col("source_class").eqNullSafe(F.col("o_source_class")) & compatible(F.col("answer"), F.col("o_answer"), F.col("answer_num"), F.col("o_answer_num")))
    best = found.groupBy(*VALUE).agg(F.min(F.struct(F.col("f.created_at").alias("created_at"), F.col("f.seq").alias("seq"), F.col("f.source_url").alias("url"), F.col("o_source_class").alias("cls"))).alias("by"))
    return best.select(*[F.col(c).alias(f"b_{c}") for c in VALUE], "by")


#: Values that are put to the others of their field, in rounds: the first, the next two, and so on; the last round has the rest.
ROUNDS = [(1, 1), (2, 3), (4, 7), (8, 15), (16, 1 << 30)]


def in_conflict(ledger: DataFrame) -> DataFrame:
    """Settled, single-valued, field-bearing claims, with the first place in write order of a claim that each is incompatible with (least).

    Values that are compatible with the same ones count as one. They are put to the first values of their field in rounds, and one that has met its first
    incompatible value takes part no more: a field of very many different values is settled by its first few.
    """
    rows = ledger.filter(F.col("field_name").isNotNull() & ~F.col("field_name").isin(MULTI_VALUED) & ~F.col("status").isin("could_not_verify", "superseded"))
    own = Window.partitionBy("entity_id", "field_name").orderBy("created_at", "seq")
    rows = rows.withColumn("pos", F.row_number().over(own)).withColumn("text", normal(F.col("answer")))
    value = ["entity_id", "field_name", "text", "answer_num"]
    values = rows.groupBy(*value).agg(F.min("pos").alias("first_pos"))
    values = values.withColumn("nth", F.row_number().over(Window.partitionBy("entity_id", "field_name").orderBy("first_pos")))
    other = values.select(*[F.col(c).alias(f"o_{c}") for c in value], F.col("first_pos").alias("o_pos"), F.col("nth").alias("o_nth"))
    left, met = values.select(*value), None
    same = (F.col("entity_id") == F.col("o_entity_id")) & (F.col("field_name") == F.col("o_field_name"))
    for low, high in ROUNDS:
        clash = left.join(other.filter(F.col("o_nth").between(low, high)), same & ~compatible(F.col("text"), F.col("o_text"), F.col("answer_num"), F.col("o_answer_num")))
        # a value may be incompatible with itself (an empty text); then its own first two claims count
        hit = clash.groupBy(*value).agg(F.min("o_pos").alias("least"))
        met = hit if met is None else met.unionByName(hit)
        gone = hit.select(*[F.col(c).alias(f"g_{c}") for c in value])
        left = left.join(gone, same_value(left, gone, {c: f"g_{c}" for c in value}), "left_anti")
    least = met.select(*[F.col(c).alias(f"l_{c}") for c in value], "least")
    return rows.join(least, same_value(rows, least, {c: f"l_{c}" for c in value}), "left").select(*[c for c in rows.columns if c != "text"], "least")


def contradictions(ledger: DataFrame) -> DataFrame:
    """VAL-04: both claims of any incompatible pair are contradicted."""
    bad = in_conflict(ledger).filter("least IS NOT NULL").select("claim_id", F.lit(True).alias("__bad"))
    return ledger.join(bad, "claim_id", "left").withColumn("status", F.when(F.col("__bad"), "contradicted").otherwise(F.col("status"))).drop("__bad")


def contradiction_findings(ledger: DataFrame) -> DataFrame:
    """VAL-05: the pairs that a scan in write order reports, which skips a pair whose claims are both contradicted already.

    With least(x) the first place incompatible with x, the pair i < j is reported unless (i was contradicted from the start or least(i) < j)
    and (j was, or least(j) < i).
    """
    rows = in_conflict(ledger).filter("least IS NOT NULL").select("entity_id", "field_name", "claim_id", "status", "answer", "answer_num", "pos", "least")
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    # a pair is reported for its first or for its second claim: then the other stands at the first place incompatible with it, which is a join key
    same = (F.col("a_entity_id") == F.col("b_entity_id")) & (F.col("a_field_name") == F.col("b_field_name"))
    apart = (F.col("a_pos") < F.col("b_pos")) & ~compatible(F.col("a_answer"), F.col("b_answer"), F.col("a_answer_num"), F.col("b_answer_num"))
    by_first = a.filter("a_status <> 'contradicted'").join(b, same & (F.col("a_least") == F.col("b_pos"))).filter(apart)
    by_second = a.join(b.filter("b_status <> 'contradicted'"), same & (F.col("b_least") == F.col("a_pos"))).filter(apart)
    out = [F.col("a_entity_id").alias("entity_id"), F.col("a_field_name").alias("field"), F.col("a_claim_id").alias("claim_id"), F.col("b_claim_id").alias("other_id")]
    return by_first.select(*out).unionByName(by_second.select(*out)).distinct()


def staleness(ledger: DataFrame, now: str) -> DataFrame:
    """VAL-06: settled claims older than STALE_DAYS whole days."""
    age = F.floor((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("retrieved_at").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    rows = ledger.filter(F.col("status").isin("confirmed", "verified", "single_source") & F.col("retrieved_at").isNotNull()).withColumn("age_days", age)
    return rows.filter(F.col("age_days") > STALE_DAYS).select("claim_id", F.lit("V5_staleness").alias("check_id"), F.lit("warn").alias("severity"), field_key().alias("field"), "age_days")


def negative_fo(answer: Column) -> Column:
    """A settled negative answer: a leading token or phrase, or one of a few phrases anywhere. Marks part tokens, letters of any script do not."""
    joined = squeeze(F.lower(F.regexp_replace(F.coalesce(answer, F.lit("None")), f"[^{WORD}{SPACE}]+", " ")))
    return joined.rlike(r"^(no|none|not|insufficient)( |$)|^there (is|are) no( |$)|no affirmative evidence|not a family office|no evidence that")


def identity_gate(ledger: DataFrame, polarity: DataFrame | None = None) -> DataFrame:
    """VAL-07: fatal where G1.Q3 is missing, unsettled or negative, and where G1.Q5 is confirmed and affirmative. The last claim of a question counts.

    polarity (entity_id, question_id, verdict) holds judged answers: affirmative and negative override what the words say, anything else leaves it to them; of two
    verdicts on one answer the negative one counts.
    """
    last = latest(ledger.filter(F.col("question_id").isin("G1.Q3", "G1.Q5")), ["entity_id", "question_id"])
    at = lambda q, c: F.max(F.when(F.col("question_id") == q, F.col(c)))
    pair = last.groupBy("entity_id").agg(at("G1.Q3", "status").alias("s3"), at("G1.Q3", "answer").alias("a3"), at("G1.Q5", "status").alias("s5"), at("G1.Q5", "answer").alias("a5"))
    grid = ledger.select("entity_id").distinct().join(pair, "entity_id", "left")
    said3, said5 = negative_fo(F.col("a3")), normal(F.col("a5")).startswith("yes")
    if polarity is not None:
        judged = polarity.filter(F.col("verdict").isin("affirmative", "negative") & F.col("question_id").isin("G1.Q3", "G1.Q5"))
        grid = grid.join(judged.groupBy("entity_id").agg(at("G1.Q3", "verdict").alias("v3"), at("G1.Q5", "verdict").alias("v5")), "entity_id", "left")
        said3, said5 = F.coalesce(F.col("v3") == "negative", said3), F.coalesce(F.col("v5") == "affirmative", said5)
    q3 = F.col("s3").isNull() | F.col("s3").isin("could_not_verify", "contradicted") | said3
    q5 = (F.col("s5") == "confirmed") & said5
    return grid.select("entity_id", F.explode(F.array_compact(F.array(F.when(q3, "G1.Q3"), F.when(F.coalesce(q5, F.lit(False)), "G1.Q5")))).alias("field")).withColumn("check_id", F.lit("V5_firm_is_fo")).withColumn("severity", F.lit("fatal"))


def completeness(ledger: DataFrame) -> DataFrame:
    """VAL-08: warnings for a missing decision maker, channel or dated signal."""
    live = ~F.col("status").isin("could_not_verify", "removed_failed_validation", "contradicted", "superseded")
    has = lambda names: F.coalesce(F.bool_or(live & (F.col("field_name").isin(names) | F.coalesce(F.col("question_id").isin(names), F.lit(False)))), F.lit(False))
    seen = ledger.groupBy("entity_id").agg(has(DECISION_MAKER).alias("a"), has(CHANNEL).alias("b"), has(DATED_SIGNAL).alias("c"))
    missing = F.array_compact(F.array(F.when(~F.col("a"), "principal_name"), F.when(~F.col("b"), "principal_email"), F.when(~F.col("c"), "recent_investments")))
    return seen.select("entity_id", F.explode(missing).alias("field")).withColumn("check_id", F.lit("V6_completeness")).withColumn("severity", F.lit("warn"))


def release_rule(ledger: DataFrame, failed: DataFrame, releasable: list[str]) -> tuple[DataFrame, DataFrame]:
    """VAL-09: blank releasable fields with a fatal finding (failed: entity_id, field); the second output lists what was blanked."""
    keys = failed.filter(F.col("field").isin(releasable)).select("entity_id", F.col("field").alias("field_key")).distinct()
    hit = ledger.withColumn("field_key", field_key()).join(keys.withColumn("__k", F.lit(True)), ["entity_id", "field_key"], "left")
    killed = F.coalesce("__k", F.lit(False))
    audit = hit.filter(killed).select("entity_id", F.col("field_key").alias("field_name"), F.col("answer").alias("rejected_value"), F.lit("verification_failed").alias("reason_code"), F.col("source_url").alias("evidence_url"))
    out = hit.withColumn("status", F.when(killed, "removed_failed_validation").otherwise(F.col("status"))).withColumn("answer", F.when(killed, F.lit(None)).otherwise(F.col("answer")))
    return out.drop("__k", "field_key"), audit


V1_EXEMPT = ["aum_basis", "principal_email", "principal_phone", "secondary_contact_email", "secondary_contact_phone"]


def v1_worklist(ledger: DataFrame, cost: Column, budget: float) -> DataFrame:
    """VAL-10: eligible claims of an entity in write order until the cost before each reaches the budget."""
    rows = ledger.filter(F.col("field_name").isNotNull() & ~F.col("field_name").isin(V1_EXEMPT) & (F.col("source_class") != "serper_organic") & F.col("source_url").isNotNull() & F.col("status").isin("confirmed", "verified", "single_source"))
    own = Window.partitionBy("entity_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cost", cost).withColumn("spent", F.coalesce(F.sum("cost").over(own), F.lit(0))).filter(F.col("spent") < budget).select("entity_id", "claim_id", "spent")


def apply_judgments(ledger: DataFrame, judgments: DataFrame) -> DataFrame:
    """VAL-11: judged claims (claim_id, judgment): contradicted ones flip."""
    kind = F.when(F.col("judgment") == "supported", "info").when(F.col("judgment") == "contradicted", "fatal").when(F.col("judgment").isNotNull(), "warn")
    joined = ledger.join(judgments.select("claim_id", "judgment"), "claim_id", "left").withColumn("severity", kind)
    return joined.withColumn("status", F.when(F.col("severity") == "fatal", "contradicted").otherwise(F.col("status")))


def reply_body(reply: Column) -> Column:
    """A model's reply without the code fence around it."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = bare(reply)
    return F.when(text.startswith("```"), bare(F.regexp_replace(F.regexp_replace(text, r"^`+|`+$", ""), r"^json", ""))).otherwise(text)


def parse_judge_json(reply: Column) -> Column:
    """VAL-12: whether a source supports a claim: supported, contradicted or not_stated with a reason beside; an old reply of true or false never contradicts; null if unreadable."""
    body = reply_body(reply)
    parsed = F.from_json(F.when(body.startswith("{"), body), "struct<verdict:string,reason:string,supported:boolean>")
    old = F.when(parsed["supported"], "supported").when(~parsed["supported"], "not_stated")
    word = F.when(parsed["verdict"].isin("supported", "contradicted", "not_stated") & parsed["reason"].isNotNull(), parsed["verdict"])
    return F.when(parsed["verdict"].isNotNull(), word).otherwise(old)


def parse_polarity(reply: Column) -> Column:
    """VAL-12: affirmative, negative or unclear; anything unreadable is unclear."""
    body = reply_body(reply)
    word = F.from_json(F.when(body.startswith("{"), body), "struct<verdict:string>")["verdict"]
    return F.when(word.isin("affirmative", "negative"), word).otherwise("unclear")


def parse_verdict(reply: Column) -> Column:
    """VAL-12: struct(verdict, rationale) of pursue or pursue_low with a rationale; null if unreadable."""
    body = reply_body(reply)
    parsed = F.from_json(F.when(body.startswith("{"), body), "struct<verdict:string,rationale:string>")
    return F.when(parsed["verdict"].isin("pursue", "pursue_low") & parsed["rationale"].isNotNull(), parsed)


def parse_claims(replies: DataFrame, questions: list[str], keys: list[str]) -> DataFrame:
    """VAL-12: the claims of JSON array replies (column reply); claims of unknown questions are dropped, unreadable replies give none."""
    body = reply_body(F.col("reply"))
    items = F.from_json(F.when(body.startswith("["), body), "array<struct<question_id:string,field_name:string,answer:string,status:string>>")
    return replies.select(*keys, F.posexplode(items).alias("place", "c")).select(*keys, "place", "c.*").filter(F.col("question_id").isin(questions))


def field_status(ledger: DataFrame) -> DataFrame:
    """VAL-13: status and method of the last claim of every field (the question where there is no field)."""
    return latest_by_field(ledger).select("entity_id", F.col("field_key").alias("field"), "status", F.col("extraction_method").alias("method"))


def skip_if_unchanged(waves: DataFrame, findings: DataFrame, fresh: DataFrame) -> DataFrame:
    """VAL-14: entities without later waves keep their old findings; the others take the fresh ones, and the old contradictions of claims that the fresh ones do not name."""
    rerun = waves.groupBy("entity_id").agg(F.bool_or(F.col("wave").isin("1", "2")).alias("rerun"))
    old = findings.join(rerun, "entity_id")
    again = fresh.join(rerun.filter("rerun").select("entity_id"), "entity_id", "left_semi")
    is_v4 = F.col("check_id") == "V4_contradiction"
    seen = again.filter(is_v4).select(F.col("entity_id").alias("s_entity"), F.col("claim_id").alias("s_claim")).distinct()
    carried = old.filter(F.col("rerun") & is_v4).join(seen, (F.col("entity_id") == F.col("s_entity")) & F.col("claim_id").eqNullSafe(F.col("s_claim")), "left_anti")
    return old.filter("NOT rerun").drop("rerun").unionByName(again).unionByName(carried.drop("rerun"))


def outcome(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """VAL-15: reject on a fatal completeness finding, caveats on any fatal or warning, else ship."""
    rank = F.when((F.col("severity") == "fatal") & (F.col("check_id") == "V6_completeness"), 2).when(F.col("severity").isin("fatal", "warn"), 1).otherwise(0)
    worst = findings.groupBy("entity_id").agg(F.max(rank).alias("rank"))
    return entities.select("entity_id").distinct().join(worst, "entity_id", "left").select("entity_id", F.when(F.col("rank") == 2, "reject").when(F.col("rank") == 1, "ship_with_caveats").otherwise("ship").alias("outcome"))


def type_of(answer: Column) -> Column:
    return F.when(F.contains(F.upper(answer), F.lit("MFO")), "MFO").when(F.contains(F.upper(answer), F.lit("SFO")), "SFO").otherwise("type_unconfirmed")


def type_first(ledger: DataFrame, question: str = "G1.Q4") -> DataFrame:
    """VAL-16: the first claim of the question decides, if its status allows."""
    first = ledger.filter(F.col("question_id") == question).groupBy("entity_id").agg(F.min(F.struct("created_at", "seq", "status", "answer")).alias("c"))
    bad = F.col("c.status").isin("could_not_verify", "removed_failed_validation", "contradicted", "superseded")
    return first.select("entity_id", F.when(bad, "type_unconfirmed").otherwise(type_of(F.coalesce("c.answer", F.lit("None")))).alias("type_final"))


def type_last_settled(ledger: DataFrame, question: str = "G1.Q4") -> DataFrame:
    """VAL-16: the last settled claim of the question decides; unsettled ones are passed over, and without any settled one the type is open."""
    bad = F.col("status").isin("could_not_verify", "removed_failed_validation", "contradicted", "superseded")
    own = ledger.filter(F.col("question_id") == question)
    last = own.groupBy("entity_id").agg(F.max(F.when(~bad, F.struct("created_at", "seq", "answer"))).alias("c"))
    return last.select("entity_id", F.when(F.col("c").isNull(), "type_unconfirmed").otherwise(type_of(F.coalesce("c.answer", F.lit("None")))).alias("type_final"))


def domain_mx_findings(entities: DataFrame, mx: DataFrame) -> DataFrame:
    """VAL-17: a domain without mail exchanger warns, an unresolved one warns otherwise (mx: record_id, has_mx)."""
    joined = entities.join(mx, "record_id", "left")
    return joined.select("record_id", F.when(F.col("has_mx"), "info").otherwise("warn").alias("severity"), F.when(F.col("has_mx"), "resolved").when(~F.col("has_mx"), "no_mx").otherwise("unresolved").alias("detail"))


def registration_recheck(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """VAL-18: lookup hits per entity (record_id, error): error and none warn, any hit informs."""
    n = hits.groupBy("record_id").agg(F.count_if(~F.col("error")).alias("hits"), F.bool_or("error").alias("error"))
    joined = entities.select("record_id").join(n, "record_id", "left")
    return joined.select("record_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(F.col("error"), "warn").when(F.coalesce("hits", F.lit(0)) == 0, "warn").otherwise("info").alias("severity"))


def rejections(findings: DataFrame, stage: str) -> DataFrame:
    """VAL-19: wave 0 rejects an entity on the identity check and names all its fatal findings, check and field, in order; later stages reject on fatal completeness and name the fatal fields."""
    fatal = findings.filter("severity = 'fatal'")
    check = "V5_firm_is_fo" if stage == "wave0" else "V6_completeness"
    own = fatal.groupBy("entity_id").agg(
        F.bool_or(F.col("check_id") == check).alias("rejects"), F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "check_id", F.coalesce("field", F.lit("None"))).alias("code")))).alias("codes"),
        F.array_sort(F.collect_set(F.nullif("field", F.lit("")))).alias("fields"),
    ).filter("rejects")
    code = F.array_join(F.transform("codes", lambda c: c["code"]), ";") if stage == "wave0" else F.when(F.size("fields") > 0, F.array_join("fields", ";")).otherwise("V6_completeness")
    return own.select("entity_id", code.alias("reason_code"), F.lit(stage).alias("stage"))
