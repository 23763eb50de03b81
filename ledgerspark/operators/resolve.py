"""Entity resolution and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, once, spoken, spread, squeeze

# A legal suffix at the end of a name, suffixes of a news phrase (its dots and commas are spaces), and words that tell no firm from another.
LEGAL_SUFFIX = r"L\.L\.C\.|LLC|INC\.?|LP|LLP|LTD|CORP|CO"
PHRASE_SUFFIXES = ["inc", "llc", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "pllc", "pc", "plc", "group"]
GENERIC = [
    "family", "office", "offices", "llc", "lp", "llp", "inc", "incorporated", "the", "capital", "management", "advisors", "advisers", "partners", "group", "co", "company", "trust", "wealth", "holdings",
    "investments", "investment",
]
#: The patterns of both suffix rules; the first keeps what stands before the suffix as group 1.
LAST_SUFFIX = rf"(?i)(^|[^{WORD}])(?:{LEGAL_SUFFIX})[{SPACE}]*$"
SUFFIX_RUN = rf"(?:(?:^| )(?:{'|'.join(PHRASE_SUFFIXES)}))+$"


def normalize_name(name: Column) -> Column:
    """ER-01: trimmed, upper case, single spaces; white space of any kind counts."""
    return F.upper(squeeze(name))


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("disc_"), F.substring(F.sha1(normalize_name(name)), 1, 16))


def build_entities(feed: DataFrame, name: str = "name_raw") -> DataFrame:
    """ER-02: one row per normalised name: first spelling, other spellings sorted, order of first appearance."""
    rows = feed.select(F.col(name).alias("name"), "seq").withColumn("entity_id", entity_id(F.col("name")))
    names = rows.groupBy("entity_id", "name").agg(F.min("seq").alias("seq"))
    return names.groupBy("entity_id").agg(F.min_by("name", "seq").alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("names"), F.min("seq").alias("first_seq")).select(
        "entity_id", "canonical_name", F.array_join(F.array_except("names", F.array("canonical_name")), "|").alias("aliases"), "first_seq"
    )


def holdings_quarter(year: Column, quarter: Column) -> Column:
    """ER-04: the quarter before the filing's; the first wraps to the fourth of the year before."""
    return F.when(quarter == 1, F.concat((year - 1).cast("string"), F.lit("Q4"))).when(quarter.between(2, 4), F.concat(year.cast("string"), F.lit("Q"), (quarter - 1).cast("string")))


def map_source(feed: DataFrame) -> DataFrame:
    """ER-03: source class and payload per discovery class; an unknown class passes through whole.

    feed: seq, entity_id, discovery_class, filed_year, filed_qtr, table_value_total and aum_13f (of which the first known counts), position_count, plan_year,
    participant_count, naics, discovery_source_id, state, address_raw, signals, people, raw_payload (JSON texts), retrieved_at.
    """
    filed = F.when(F.col("filed_year").isNotNull() & F.col("filed_qtr").isNotNull(), F.concat(F.col("filed_year").cast("string"), F.lit("Q"), F.col("filed_qtr").cast("string")))
    value = F.coalesce(F.nullif(F.col("table_value_total"), F.lit("")), F.col("aum_13f").cast("string")).try_cast("double").cast("long")
    filing = F.struct(holdings_quarter(F.col("filed_year"), F.col("filed_qtr")).alias("quarter"), filed.alias("filed_in_quarter"), value.alias("value_usd"), "position_count", "discovery_source_id", "state", "address_raw")
    plan = F.struct(F.nullif(F.col("plan_year"), F.lit("")).cast("int").alias("plan_year"), "participant_count", "naics", "discovery_source_id", "state")
    rest = F.struct("signals", "people", "state", "address_raw", "discovery_source_id", "raw_payload")
    kind = F.when(F.col("discovery_class") == "edgar_13f", "13f_filing").when(F.col("discovery_class") == "dol_5500", "5500_filing").otherwise(F.coalesce("discovery_class", F.lit("unknown")))
    payload = F.when(F.col("discovery_class") == "edgar_13f", F.to_json(filing)).when(F.col("discovery_class") == "dol_5500", F.to_json(plan)).otherwise(F.to_json(rest))
    return feed.select("seq", "entity_id", kind.alias("source_class"), payload.alias("payload"), "retrieved_at")


def core_name_phrase(name: Column) -> Column:
    """ER-07: without the one legal suffix at the end, folded case, marks to spaces; letters of any script stay."""
    return spoken(F.regexp_replace(name, LAST_SUFFIX, "$1"))


def distinctive_tokens(name: Column) -> Column:
    """ER-08: lower-case tokens without dots, commas and ampersands at their ends, without generic ones and single letters."""
    tokens = F.transform(F.split(squeeze(name), " "), lambda t: F.lower(F.regexp_replace(t, r"^[.,&]+|[.,&]+$", "")))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(GENERIC) & (F.length(t) > 1)))


# Legal suffixes and generic tails of a name in upper case.
LEGAL_TAIL = r"( (LLC|INC|LP|LLP|LTD|CO|CORP|TRUST))+$"
GENERIC_TAIL = r"( (FAMILY OFFICES?|CAPITAL|MANAGEMENT|PARTNERS|HOLDINGS|ADVISORS))+$"


def family_token(name: Column) -> Column:
    """What is left of a name in upper case without marks, a leading THE, legal suffixes and generic tails."""
    upper = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(name), r"[.']", ""), r"[^A-Z0-9]+", " "), r"\s+", " "))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(upper, r"^THE ", ""), LEGAL_TAIL, ""), GENERIC_TAIL, "")), F.lit(""))


def cluster_names(names: DataFrame) -> DataFrame:
    """ER-05: clusters on the family token; the longest spelling leads, the earliest of equals, and the others are its aliases."""
    rows = names.select("seq", "name_raw", family_token(F.col("name_raw")).alias("token")).filter("token IS NOT NULL")
    spelt = rows.groupBy("token", "name_raw").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    leader = F.max_by("name_raw", F.struct(F.length("name_raw").alias("n"), (-F.col("seq")).alias("s"))).alias("leader")
    grouped = spelt.groupBy("token").agg(leader, F.array_sort(F.collect_set("name_raw")).alias("every"), F.sum("n").alias("rows"))
    return grouped.select("token", "leader", F.array_join(F.array_except("every", F.array("leader")), "|").alias("aliases"), "rows")


def cross_source_key(df: DataFrame) -> DataFrame:
    """ER-06: the best key there is, and one row for each."""
    key = F.coalesce(F.concat(F.lit("ein:"), "ein"), F.concat(F.lit("crd:"), "crd"), F.concat(F.lit("cik:"), "cik"), F.concat(F.lit("name:"), core_name_phrase(F.col("name_raw")), F.lit("|"), F.coalesce("hq_state", F.lit(""))))
    own = Window.partitionBy("cross_key").orderBy("seq")
    return df.withColumn("cross_key", key).withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


#: Keys of one kind that stand together: names when matches are written out, queries when they are dealt to them.
NAME_BLOCK, QUERY_BLOCK = 1000, 100


def _token_sets(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Each key once, with the token sets of its names and their digest; names without a distinctive token are left out (key, sets, kind)."""
    sets = once(spread(rows.select(key, name)).select(key, F.array_sort(distinctive_tokens(F.col(name))).alias("t")))
    kept = sets.filter(F.size("t") > 0).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("sets"))
    return once(kept.withColumn("kind", F.md5(F.to_json("sets"))))


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The keys of each kind in arrays of about size, dealt by hash (kind, block, key)."""
    sizes = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    dealt = rows.select("kind", key).join(sizes, "kind").groupBy("kind", F.pmod(F.xxhash64(key), F.col("blocks")).alias("block"))
    return dealt.agg(F.transform(F.collect_list(F.struct(key)), lambda x: x[key]).alias(key))  # structs, as a list leaves nulls out


def name_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """ER-09: candidate pairs share a distinctive token; exact if one token set holds the other, else partial (query_id, q_name; seq, name_raw). Several names of one seq: the best of them.

    Token sets are compared once, whatever the number of rows that have them: a pair of them meets at its least shared token. Blocks of queries are then dealt to blocks of names, each query
    meets a block in one row, and pairs of rows are written out from it last: they are not joined, sorted or shuffled.
    """
    q, n = _token_sets(queries, "query_id", "q_name"), _token_sets(names, "seq", "name_raw")
    kinds = lambda d: d.groupBy("kind").agg(F.first("sets").alias("sets"), F.ceil(F.count(F.lit(1)) / NAME_BLOCK).alias("blocks")).withColumn("w", F.array_distinct(F.flatten("sets"))).withColumn("t", F.explode("w"))
    asked, held = (kinds(d).select("t", *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "sets", "blocks", "w")]) for side, d in (("q", q), ("n", n)))
    met = asked.join(held, "t").filter(F.col("t") == F.array_min(F.array_intersect("q_w", "n_w")))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    exact = F.exists("q_sets", lambda a: F.exists("n_sets", lambda b: within(a, b) | within(b, a)))
    pairs = once(met.select("q_kind", "n_kind", "n_blocks", F.when(exact, "exact").otherwise("partial").alias("match")))
    wanted = _blocks(q, "query_id", QUERY_BLOCK).select("query_id", F.col("kind").alias("q_kind")).join(pairs, "q_kind").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the rows that come in are too few to tell how many go out
    deal = lambda d: d.repartition(tasks, "n_kind", "block")
    dealt = _blocks(n, "seq", NAME_BLOCK).withColumnRenamed("kind", "n_kind")
    each = deal(wanted.select("query_id", "n_kind", "block", "match")).withColumn("query_id", F.explode("query_id"))  # before the join, as all that one row of it gives out is held at once
    return each.join(deal(dealt).hint("merge"), ["n_kind", "block"]).select("query_id", F.explode("seq").alias("seq"), "match")


def person_names_match(a: Column, b: Column) -> Column:
    """ER-10: alphabetic tokens of two letters or more; one set holds the other."""
    ta, tb = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{2,})"), F.lit(1))) for x in (a, b))
    both = F.size(F.array_intersect(ta, tb))
    return F.coalesce((both > 0) & ((both == F.size(ta)) | (both == F.size(tb))), F.lit(False))


def normalize_entity_name(name: Column) -> Column:
    """ER-11: struct(phrase, tokens, corporate): the phrase without its trailing run of suffixes, its tokens over two letters but for a leading article, and the run."""
    whole = squeeze(F.regexp_replace(F.lower(name), "[.,]", " "))
    phrase = F.regexp_replace(whole, SUFFIX_RUN, "")
    tokens = F.filter(F.split(phrase, " "), lambda t, i: (F.length(t) > 2) & ~((i == 0) & (t == "the")))
    return F.struct(phrase.alias("phrase"), F.array_join(tokens, " ").alias("tokens"), F.trim(F.substring(whole, F.length(phrase) + 1, F.length(whole))).alias("corporate"))


# Reason code and name pattern of each exclusion, on the name in lower case.
EXCLUSIONS = {
    "X.bank": r"\bbank\b|bancorp|bancshares|banc\b|\bsavings\b|\bthrift\b|credit union|\bn\.?a\.?$|national association|trust compan(y|ies)|trust division|trust services",
    "X.pension": r"pension|retirement system|\bretrmt\b|employe\w* retirement|superannuation|\b401\(k\)\b|deferred compensation plan",
    "X.insurance": r"insurance|assurance|\bcasualty\b|\blife co\b|reinsurance",
    "X.fund": r"mutual fund|\bfund,? (inc|llc|lp|ltd)\b|\betf\b|index fund|closed.?end|diversified equity fund|\bfund gp\b|\bfeeder fund\b",
    "X.brokerdealer": r"securities,? inc|\bbrokerage\b|broker.?dealer|\bclearing\b",
    "X.public": r"\bcorp\b|\bincorporated\b",
    "X.govt": r"sovereign|municipal|state of\b|commonwealth of\b|\bcity of\b|\bcounty of\b",
    "X.foreign": r"\b(?:bv|nv|sa|spa|ag|ab|oy|plc|gmbh|sarl|pty ltd|a/s)\b",
    "X.university": r"university|college|endowment|school district",
}


def hard_exclusions(df: DataFrame) -> DataFrame:
    """ADM-01: reason codes of the name; the public one only with annual or quarterly reports (files_reports), the foreign one on the name without dots."""
    name = F.lower(F.trim("name_raw"))
    on = {"X.foreign": F.regexp_replace(name, r"\.", "")}
    also = {"X.public": F.coalesce("files_reports", F.lit(False))}
    codes = [F.when(on.get(code, name).rlike(p) & also.get(code, F.lit(True)), code) for code, p in EXCLUSIONS.items()]
    return df.select("record_id", F.array_join(F.array_compact(F.array(*codes)), ",").alias("reasons"))


def structural_exclusions(df: DataFrame) -> DataFrame:
    """ADM-02: broker, retail over wealthy clients without large assets, one-origin 13F, defunct or stale plan."""
    codes = {
        "broker_dealer": F.col("broker_dealer"),
        "retail_heavy": (F.col("retail") > F.col("hnw")) & (F.coalesce("raum", F.lit(0)) < 1_000_000_000),
        "only_13f": F.col("classes") == "13f_filing",
        "defunct": F.col("defunct") | (F.col("plan_year") < F.col("as_of_year") - 5),
    }
    return df.select("entity_id", F.array_join(F.array_compact(F.array(*[F.when(c, code) for code, c in codes.items()])), ",").alias("reasons"))


def admit(df: DataFrame) -> DataFrame:
    """ADM-03: SFO with anchor and operating signal; MFO registered, self-described and multi-family."""
    sfo, mfo = F.col("anchor") & F.col("operating"), F.col("registered") & F.col("self_described") & F.col("multi_family")
    return df.select("record_id", F.when(sfo, "SFO").when(mfo, "MFO").otherwise("no").alias("admitted_as"))


def evidence_bar(sources: DataFrame, primary: list[str]) -> DataFrame:
    """ADM-04: two source classes, one of them primary, and the required field known."""
    return sources.groupBy("entity_id").agg(F.count_distinct("source_class").alias("classes"), F.bool_or(F.col("source_class").isin(primary)).alias("has_primary"), F.bool_or(F.col("state").isNotNull()).alias("has_state")).withColumn(
        "passes", (F.col("classes") >= 2) & F.col("has_primary") & F.col("has_state")
    )


def split_report(df: DataFrame, targets: dict[str, int]) -> DataFrame:
    """ADM-05: count per type against its target."""
    counts = df.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))
    target = F.coalesce(*[F.when(F.col("entity_type") == k, v) for k, v in targets.items()])
    return counts.withColumn("shortfall", F.greatest(F.lit(0).cast("long"), target.cast("long") - F.col("entities")))
