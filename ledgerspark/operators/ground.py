"""Grounding: a table of answers against a table of facts, sentence by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, spread, strip

# What marks a line as a hedge, as structure, as asserting something, as naming a firm, and as advice.
HEDGES = "|".join([
    r"\bno\s+(record|records|information|data|entry|entries|field|fields|mention|detail|details|evidence)\b",
    r"\b(does|do|did)\s+not\s+(contain|include|list|show|specify|mention|provide|report|indicate|state)\b",
    r"\b(has|have|had)\s+not\s+been\b",
    r"\b(hasn't|haven't|hadn't)\s+been\b",
    r"\b(could|can|would)\s+not\s+be\b",
    r"\b(couldn't|cannot|can't)\s+be\b",
    r"\b(was|were|is|are)\s+not\s+(confirmed|available|disclosed|reported|verified|provided|known|found|listed|specified|identified|on file)\b",
    r"\b(not|n't|no|none|unconfirmed|unavailable|undisclosed|unknown)\b.*(confirm|disclos|verif|report|specif|identif|provid|list|avail|known|found|on file)",
])
LIST_HEADER = r":\s*$"
FIGURE = r"(?i)\$|\b\d{4}\b|\d+(?:\.\d+)?\s*%|\b\d{1,3}(?:,\d{3})+\b|\b\d+(?:\.\d+)?\s*(?:million|billion|trillion|bn|mm|k)\b"
STRUCTURE = r"^(?:#{1,6}[ \t]+\S.*|-{3,}|\*{3,}|_{3,}|\|[\s|:-]*-[\s|:-]*\|?|(?:\*\*|__|\*)?\s*(?:\d+[.)]|[-*•])\s*(?:\*\*|__)?)?$"
PERSON = r"(?i)\b(I|we|our|us|my|me|you|your|yours)\b"
OPENER = r"(?i)^(lead|position|reference|treat|approach|use|start|open|frame|pitch|emphasi[sz]e|target|prioriti[sz]e|focus|consider|highlight|mention|offer|propose|send|schedule|follow|build|keep|avoid|present|tailor|anchor|align|introduce|explore|engage|nurture|reach|ask|invite)\b"
FIRM = r"\b(LLC|L\.L\.C|Inc|Incorporated|Corp|Corporation|LP|L\.P|LLP|PLC|Trust|Capital|Partners|Advisors|Advisers|Management|Holdings|Ventures|Group|Associates|Foundation|Endowment|Family Office|Wealth)\b"
LEAD_IN = r"^[\s>]*(?:[-*•]|\d+[.)])?[ \t]*(?:(?:\*\*|__)[^*_\n]{0,40}(?:\*\*|__)[ \t]*:?[ \t]*)?"
RECORD_ID = r"(?i)\bdisc_[0-9a-f]+\b"
NEEDLE = 4  # letters of a value that is looked for in sentences
TAG = r"\[[^\]]*:[^\]]*\]"
TAG_RUN = r"([.!?])[ \t]*((?:\[[^\]]+\][ \t]*)*\[[^\]]+\])"
# Words whose full stop ends no sentence; longer ones before those that they begin with.
ABBREVIATIONS = ["Inc", "Ltda", "Ltd", "Corp", "Co", "LLC", "L.P", "LP", "L.L.C", "N.A", "S.A", "plc", "Pte", "Cos", "Bros", "St", "U.S", "No", "Sr", "Jr", "Mrs", "Mr", "Ms", "Dr", "Prof"]
# The number of a list item or heading with its full stop, and what opens a block at the start of a line (\x01 stands for a guarded full stop).
ORDINAL = r"[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__|\*)?\s*\d+"
BLOCK_OPENER = r"[ \t]*(?:#{1,6}[ \t]|(?:-{3,}|\*{3,}|_{3,})[ \t]*$|\||(?:\*\*|__|\*)?\s*\d+[.)\x01]|[-*•]\s)"
STRIP_SHARE = 0.3


def gate1(top: Column, n: Column, out_of_scope: Column) -> Column:
    """GND-02: whether to answer at all."""
    return F.when(out_of_scope, "decline_out_of_scope").when(n == 0, "decline_zero_results").when(top < 0.01, "decline_low_score").otherwise("proceed")


def normalize_tags(text: Column) -> Column:
    """GND-03: a run of tags after the end of a sentence goes before its mark."""
    return F.regexp_replace(text, TAG_RUN, " $2$1")


def split_sentences(answers: DataFrame) -> DataFrame:
    """GND-04: sentences of each answer, once its tags are in place: an end mark before white space divides, and a line end before a line that opens a block.

    The full stop of an abbreviation and that of a list number at the start of a line (bold or in a heading, too) end no sentence. Other line ends stay within their sentence.
    """
    mark = "\u0001"
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guarded = F.regexp_replace(normalize_tags(F.col("text")), rf"(?<![A-Za-z0-9_])({short})\.", f"$1{mark}")
    guarded = F.regexp_replace(guarded, rf"(^|\n)({ORDINAL})\.(?=\s|\*)", f"$1$2{mark}")
    parts = F.split(guarded, rf"(?m)(?<=[.!?])\s+|\n+(?={BLOCK_OPENER})")
    whole = F.filter(F.transform(parts, lambda p: F.translate(p, mark, ".")), lambda p: p.rlike(r"\S"))
    keys = [c for c in answers.columns if c != "text"]
    return spread(answers).select(*keys, F.posexplode(whole).alias("place", "sentence"))


def tag_pairs(sentence: Column) -> Column:
    """The (record, field, malformed) of the tags of a sentence, in order."""

    def pairs(tag: Column) -> Column:
        parts = F.filter(F.transform(F.split(tag, "[,;]"), strip), lambda p: p != "")
        named = lambda p: F.contains(p, F.lit(":"))

        def pair(p: Column, i: Column) -> Column:
            record = strip(F.split_part(F.try_element_at(F.filter(F.slice(parts, F.lit(1), i + 1), named), F.lit(-1)), F.lit(":"), F.lit(1)))
            field = strip(F.when(named(p), F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)).otherwise(p))
            return F.struct(record.alias("record"), field.alias("field"), (F.coalesce(record == "", F.lit(True)) | (field == "") | named(field)).alias("malformed"))

        return F.transform(parts, pair)

    return F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(r"\[([^\]]*:[^\]]*)\]"), F.lit(1)), pairs))


def parse_tags(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """GND-05: (record, field) pairs of the tags, brackets that hold a colon; a bare field takes the record before it in its own tag, parts that give no pair are malformed."""
    return sentences.select(*keys, F.posexplode(tag_pairs(F.col("sentence"))).alias("part", "p")).select(*keys, "part", "p.*")


def has(text: Column, pattern: str) -> Column:
    """Whether the text holds the pattern, whose word borders are those of ASCII letters, digits and _ alone."""
    w = "[A-Za-z0-9_]"
    return text.rlike(pattern.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"))


def shown(sentence: Column) -> Column:
    """The sentence without its tags and the spaces that they leave."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(sentence, TAG, ""), r"\s+", " "), r"\s+([.,;:!?])", "$1"))


def classify_sentences(sentences: DataFrame, facts: DataFrame, keys: list[str], answer: list[str]) -> DataFrame:
    """GND-06: structural, neutral, authorial, claim or invalid (with a reason), and the sentence as shown.

    facts: the answer's own facts, answer columns and record, field, value. A tag's every pair must be one of them. Without a tag, structure carries no
    figure, every line of a neutral sentence is a hedge, a list header or such structure, and advice names no figure, firm, record or value of a fact.
    A sentence is split, read and compared once: the facts of an answer, which are what a model was shown with the question, come to its sentences in one row.
    """
    text = F.col("sentence")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    structural = lambda x: strip(x).rlike(STRUCTURE)
    hedge = lambda x: has(strip(x), f"(?i){HEDGES}") | strip(x).rlike(LIST_HEADER)
    advice = ~has(text, FIGURE) & ~has(text, RECORD_ID) & ~has(text, FIRM) & (has(text, PERSON) | has(F.regexp_replace(strip(text), LEAD_IN, ""), OPENER))
    bare = lambda test: F.when(text.rlike(TAG), F.lit(False)).otherwise(test)  # noqa: E731  # a tagged sentence is judged by its tags alone
    rows = once(sentences.withColumns({
        "display": shown(text), "tagged": text.rlike(TAG), "scaffold": bare(~has(text, FIGURE) & F.forall(lines, structural)), "hedged": bare(F.forall(lines, lambda x: hedge(x) | (structural(x) & ~has(x, FIGURE)))), "advice": bare(advice), "pairs": tag_pairs(text),
    }))
    needle = F.lower(F.trim("value"))
    own = facts.groupBy(*answer).agg(F.collect_set(F.when(F.col("record").isNotNull() & F.col("field").isNotNull(), F.struct("record", "field"))).alias("known"), F.collect_set(F.when(F.length(needle) >= NEEDLE, needle)).alias("needles"))
    rows = rows.join(own, answer, "left")
    known = F.forall("pairs", lambda p: F.coalesce(F.array_contains("known", F.struct(p["record"].alias("record"), p["field"].alias("field"))), F.lit(False)))
    # only what would pass as advice is searched for values of its answer's facts
    named = F.col("advice") & F.coalesce(F.exists("needles", lambda n: F.contains(F.lower("sentence"), n)), F.lit(False))
    rows = rows.withColumns({"malformed": (F.size("pairs") == 0) | F.exists("pairs", lambda p: p["malformed"]), "all_known": known, "named": named})
    reason = (
        F.when(F.col("display") == "", None)
        .when(~F.col("tagged"), F.when(F.col("scaffold") | F.col("hedged") | (F.col("advice") & ~F.col("named")), None).otherwise("untagged"))
        .when(F.col("malformed"), "malformed citation tag")
        .when(~F.col("all_known"), "tag references an unconfirmed or nonexistent field")
    )
    kind = (
        F.when(F.col("display") == "", "structural").when(F.col("reason").isNotNull(), "invalid").when(F.col("tagged"), "claim").when(F.col("scaffold"), "structural").when(F.col("hedged"), "neutral").otherwise("authorial")
    )
    return rows.withColumn("reason", reason).select(*keys, "sentence", "display", kind.alias("kind"), "reason")


def entailment(classified: DataFrame, answer: list[str]) -> DataFrame:
    """GND-07: the kept text of each answer (structure goes too), and the stripped share of the characters that claim something, which may discard it."""
    bad = F.col("kind") == "invalid"
    stripped, claimed = F.when(bad, F.length(strip(F.col("sentence")))).otherwise(0), F.when(F.col("kind") == "claim", F.length("display")).otherwise(0)
    kept = F.array_sort(F.collect_list(F.when(~bad & (F.col("kind") != "structural"), F.struct("place", "sentence"))))
    out = classified.groupBy(*answer).agg(F.sum(stripped).alias("stripped_chars"), F.sum(claimed).alias("claim_chars"), kept.alias("kept"))
    share = F.coalesce(F.try_divide(F.col("stripped_chars"), F.col("stripped_chars") + F.col("claim_chars")), F.lit(0.0))
    return out.select(*answer, F.array_join(F.transform("kept", lambda k: k["sentence"]), " ").alias("kept"), F.round(share, 6).alias("stripped_share"), (share > STRIP_SHARE).alias("discard"))


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Words of a gram, and grams of a window; a window's anchor is its least hash. Quotes of at most two words that meet a text at once.
GRAM, WINDOW, SHORT_BLOCK = 4, 8, 10_000
#: Inner words from which a quote has a whole window.
LONG_QUOTE = GRAM + WINDOW - 1


def _grams(words: Column, n: Column) -> Column:
    """Hashes of all runs of n words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))


def _anchors(words: Column) -> Column:
    """The least hash of each window of grams."""
    windows = lambda h: F.when(F.size(h) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.array_min(F.slice(h, i, F.lit(WINDOW)))))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(_grams(words, F.lit(GRAM))), windows))


def quote_candidates(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Texts that may hold a quote, so that only they are compared in full (item_id, doc_id).

    A quote may begin and end inside a word of the text, so its first and last word are in no key. Quotes of LONG_QUOTE inner words or more are found by the anchor of their
    first window, which every text that holds the window has among its own; shorter ones by all their inner words; those of at most two words have no inner word and are searched
    for in every text, in blocks. A text gives a number for each anchor, and one for each of its places and length of short quotes.
    """
    words = lambda c: F.split(fold_space(c), " ")
    q = quotes.filter(fold_space(F.col("text")) != "").select("item_id", fold_space(F.col("text")).alias("quote"), words(F.col("text")).alias("w"))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = q.filter(F.size("w") > 2).select("item_id", inner.alias("w")).withColumn("len", F.least(F.size("w"), F.lit(LONG_QUOTE)))
    key = F.when(F.col("len") == LONG_QUOTE, F.array_min(F.slice(_grams(F.col("w"), F.lit(GRAM)), F.lit(1), F.lit(WINDOW)))).otherwise(F.xxhash64(F.array_join("w", " ")))
    keyed = keyed.select("item_id", "len", key.alias("k"))
    lengths = F.broadcast(keyed.agg(F.array_sort(F.collect_set("len")).alias("lengths")))  # LONG_QUOTE numbers at most
    e = evidence.select("doc_id", fold_space(F.col("text")).alias("body"))
    own = e.select("doc_id", F.split("body", " ").alias("w")).crossJoin(lengths).select("doc_id", "w", F.explode("lengths").alias("len")).filter(F.size("w") >= F.col("len") + 2)
    keys = own.select("doc_id", "len", F.explode(F.when(F.col("len") == LONG_QUOTE, _anchors(F.col("w"))).otherwise(F.array_distinct(_grams(F.col("w"), F.col("len"))))).alias("k"))
    long_ = keys.join(keyed, ["len", "k"]).select("item_id", "doc_id")
    short = q.filter(F.size("w") <= 2).select("item_id", "quote")
    blocks = -(-short.count() // SHORT_BLOCK)
    if not blocks:
        return long_.distinct()
    short = short.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    every = e.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return long_.unionByName(every.join(short, "block").filter(F.contains("body", F.col("quote"))).select("item_id", "doc_id")).distinct()


def quote_grounded(quotes: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """GND-08: first candidate text that holds the quote, white space folded (item_id, text; doc_id, text; item_id, doc_id)."""
    q = quotes.select("item_id", fold_space(F.col("text")).alias("quote"))
    e = evidence.select("doc_id", fold_space(F.col("text")).alias("body"))
    hit = candidates.join(q, "item_id").join(e, "doc_id").filter(F.contains("body", F.col("quote")) & (F.col("quote") != ""))
    found = hit.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return q.select("item_id").join(found, "item_id", "left").select("item_id", "doc_id", F.col("doc_id").isNotNull().alias("grounded"))


# Phrases that tell one family from several, and words that tell nothing beside a name.
MFO_PHRASES = ["multi-family office", "multi family office", "multifamily office", "client families", "families we serve", "our clients", "client relationships", "families and individuals", "serve families"]
SFO_PHRASES = ["single-family office", "single family office", "a single family", "one family", "our family", "sole source of capital", "the family's capital"]
FILLER = ["family", "office", "offices", "llc", "inc", "the", "and", "for", "wealth"]


def flat(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first listed phrase that the text holds, or null."""
    low = F.lower(flat(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])


def quote_is_decisive(text: Column, verdict: Column) -> Column:
    """GND-09: the text holds a phrase of the verdict's own side (of the single-family side, if the verdict is neither)."""
    return F.when(verdict == "MFO", first_phrase(text, MFO_PHRASES).isNotNull()).otherwise(first_phrase(text, SFO_PHRASES).isNotNull())


def snippet_is_name(text: Column, name: Column) -> Column:
    """GND-09: nothing but words of the name and filler; words of one or two letters do not count."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1))
    return F.size(F.array_except(words(text), F.concat(words(name), F.array(*[F.lit(w) for w in FILLER])))) == 0


def sentence_of(text: Column, phrase: Column) -> Column:
    """The sentence around the phrase's first place, 400 letters at most."""
    whole = flat(text)
    at, n = F.instr(F.lower(whole), phrase), F.length(phrase)
    head, tail = F.substring_index(F.substring(whole, F.lit(1), at - 1), ".", -1), F.substring(whole, at + n, F.length(whole))
    end = F.when(F.contains(tail, F.lit(".")), F.concat(F.split_part(tail, F.lit("."), F.lit(1)), F.lit("."))).otherwise(tail)
    return F.when(phrase.isNotNull(), F.substring(F.trim(F.concat(head, F.substring(whole, at, n), end)), 1, 400))


def mechanical_type(evidence: DataFrame) -> DataFrame:
    """GND-10: phrases per side and page, own pages twice; the greater side wins and brings its sentence (entity_id, seq, text, own_site).

    The quote is the last own page's, else the first page's, in the order of seq.
    """
    rows = evidence.withColumn("weight", F.when(F.col("own_site"), 2).otherwise(1))
    sums, order = [], F.struct("own_site", F.when(F.col("own_site"), F.col("seq")).otherwise(-F.col("seq")).alias("o"))
    for side, phrases in (("sfo", SFO_PHRASES), ("mfo", MFO_PHRASES)):
        rows = rows.withColumn(f"{side}_phrase", first_phrase(F.col("text"), phrases))
        has = F.col(f"{side}_phrase").isNotNull()
        sums += [F.sum(F.when(has, F.col("weight")).otherwise(0)).alias(side), F.max_by(F.struct("seq", "own_site", sentence_of(F.col("text"), F.col(f"{side}_phrase")).alias("quote")), F.when(has, order)).alias(f"{side}_best")]
    n = rows.groupBy("entity_id").agg(*sums)
    winner = F.when(F.col("sfo") > F.col("mfo"), "SFO").when(F.col("mfo") > F.col("sfo"), "MFO").otherwise("unconfirmed")
    best = F.when(winner == "SFO", F.col("sfo_best")).when(winner == "MFO", F.col("mfo_best"))
    return n.select("entity_id", "sfo", "mfo", winner.alias("mechanical"), best["quote"].alias("quote"), best["seq"].alias("quote_seq"), best["own_site"].alias("quote_own"))


def type_verdict(judged: DataFrame, mechanical: DataFrame) -> DataFrame:
    """GND-11: the claim row of each entity with evidence whose type is told; an unconfirmed one writes none.

    judged: entity_id, judged, quote, grounded (the evidence holds the quote), own_site (its page is the firm's), only_name, decisive; mechanical as from GND-10, a row for every
    entity with evidence. A judgement stands if it is made, its quote is there, grounded, more than the name and decisive: high on the firm's own page, else medium. The
    first gate that it fails is the reason for a recovery: the mechanical type, medium on the firm's own page, else low; without one the judged type at low confidence, unverified.
    """
    told = F.col("judged").isin("SFO", "MFO")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~F.coalesce(told, F.lit(False)) | F.upper(strip(F.coalesce(F.col("j.quote"), F.lit("")))).isin("", "NONE"), "llm_declined")
        .when(~sure("grounded"), "quote_not_grounded").when(sure("only_name"), "quote_is_only_the_name").when(~sure("decisive"), "quote_not_decisive")
    )
    rows = mechanical.alias("m").join(judged.alias("j"), "entity_id").withColumn("reason", reason)
    found = F.col("mechanical") != "unconfirmed"
    stands, recovered = F.col("reason").isNull(), F.col("reason").isNotNull() & found
    own = F.when(stands, sure("own_site")).when(recovered, sure("quote_own")).otherwise(F.lit(False))
    out = rows.select(
        "entity_id",
        F.when(stands, F.col("judged")).when(found, F.col("mechanical")).when(told, F.col("judged")).alias("type_final"),
        F.when(stands, F.when(own, "high").otherwise("medium")).when(recovered & own, "medium").otherwise("low").alias("confidence"),
        F.when(own, "confirmed").otherwise("single_source").alias("status"),
        F.when(own, "site_scrape").otherwise("serper_organic").alias("source_class"),
        F.when(stands, F.col("j.quote")).when(recovered, F.col("m.quote")).alias("quote"),
        F.concat_ws(";", "reason", F.when(stands, F.lit(None)).when(recovered, "recovered_mechanically").otherwise("llm_unverified"), F.when(stands | recovered, F.when(own, "own_site").otherwise("third_party"))).alias("basis"),
    )
    return out.filter("type_final IS NOT NULL")
