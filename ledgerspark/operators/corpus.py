"""Corpus build: wide records, facet chunks, vectors, merges."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spread
from ..sources.readers import clean_cell, list_cell, money_cell
from .ledger import latest
from .validate import type_last_settled

DATE_FIELDS = ["important_insight", "recent_investments", "recent_fund_commitments", "recent_key_hires", "recent_news"]
UNSETTLED = ["could_not_verify", "removed_failed_validation", "contradicted"]


# Fields of a record that hold one value, and those that hold a list, with the claims they come from, the first settled one counts.
SCALARS = ["aum_usd", "aum_basis", "aum_as_of", "principal_name", "principal_title", "principal_email", "firm_email", "principal_phone", "sector_focus", "stage_focus", "geography_focus", "recent_investments", "recent_news"]
LISTS = {"mandates": ["investing_thesis", "investing_mandates"], "fit_tags": ["fit_tags"], "public_list_overlap": ["public_list_overlap"]}
CONTACTS = ["principal_email", "firm_email", "principal_phone"]
URGENCY = {"fresh_liquidity": "high", "concentration_pain": "high", "access_window": "medium"}


def as_list(value: Column) -> Column:
    """A JSON list as it is, any other text as a list of one, nothing as an empty list."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(F.array().cast("array<string>"))


def build_records(ledger: DataFrame, entities: DataFrame, outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """COR-01: one wide row per entity: of each field the last write, null if that one is unsettled, and the status of the contacts' last write; a thesis before mandates; lists as arrays.

    entities: entity_id, entity_name; outcomes: entity_id, outcome, seq, of which the last counts; sources as for COR-03, which gives the state.
    """
    at = F.struct("created_at", "seq")
    names = list(dict.fromkeys([*SCALARS, *[f for fs in LISTS.values() for f in fs], "check_size_range", "important_insight"]))
    settled = ~F.coalesce(F.col("status").isin(UNSETTLED), F.lit(False))
    of = lambda f: F.when(F.col("field_name") == f, at)
    last = [F.max_by(F.when(settled, F.col("answer")), of(f)).alias(f"last_{f}") for f in names]
    states = [F.max_by(F.col("status"), of(f)).alias(f"{f}_status") for f in CONTACTS]
    kind = F.min(F.when(F.col("field_name").startswith("discovery_class_"), F.substring("field_name", 17, 200))).alias("discovery_class_primary")
    rows = ledger.groupBy("entity_id").agg(*last, *states, kind)
    size = parse_check_range(F.col("last_check_size_range"))
    trigger = F.col("last_important_insight")
    urgency = F.when(trigger.isNotNull(), F.coalesce(*[F.when(trigger == k, v) for k, v in URGENCY.items()], F.lit("low")))
    lists = [as_list(F.coalesce(*[F.col(f"last_{f}") for f in fields])).alias(name) for name, fields in LISTS.items()]
    active = F.when(F.coalesce("last_recent_investments", F.lit("")) != "", "active")
    wide = rows.select(
        "entity_id", *[F.col(f"last_{f}").alias(f) for f in SCALARS], *[f"{f}_status" for f in CONTACTS], *lists, size["low"].alias("check_size_min"), size["high"].alias("check_size_max"), urgency.alias("urgency_tier"),
        active.alias("activity_status"), "discovery_class_primary", F.lit("US").alias("hq_country"),
    )
    latest_outcome = outcomes.groupBy("entity_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    kinds = type_last_settled(ledger).select("entity_id", F.col("type_final").alias("entity_type"))
    out = wide.join(record_signals(ledger), "entity_id")
    for part in (entities.select("entity_id", "entity_name"), latest_outcome, hq_state(sources), kinds):
        out = out.join(part, "entity_id", "left")
    return out.withColumn("entity_type", F.coalesce("entity_type", F.lit("type_unconfirmed")))


def money(text: Column) -> Column:
    n = F.regexp_extract(text, r"([0-9][0-9,.]*)", 1)
    u = F.upper(F.regexp_extract(text, r"[0-9]\s*([KkMmBb])", 1))
    value = F.try_to_number(F.regexp_replace(n, ",", ""), F.lit("999999999999.99")).cast("double")
    return (value * F.when(u == "K", 1e3).when(u == "M", 1e6).when(u == "B", 1e9).otherwise(1.0)).cast("long")


def parse_check_range(text: Column) -> Column:
    """COR-02: struct(low, high) of 'X to Y' or 'X - Y'; unreadable parts are null."""
    parts = F.split(text, r"\s+(?:to|-)\s+", 2)
    return F.struct(money(F.get(parts, F.lit(0))).alias("low"), money(F.get(parts, F.lit(1))).alias("high"))


def hq_state(sources: DataFrame) -> DataFrame:
    """COR-03: the latest state there is; its first two characters, whatever they are."""
    known = sources.filter("state IS NOT NULL")
    return known.groupBy("entity_id").agg(F.upper(F.substring(F.max_by("state", F.struct("retrieved_at", "seq")), 1, 2)).alias("hq_state"))


def record_signals(ledger: DataFrame) -> DataFrame:
    """COR-04: newest signal that is not refused (a contradicted one still dates the record), and the confidence of the record."""
    standing = ~F.coalesce(F.col("status").isin("could_not_verify", "removed_failed_validation"), F.lit(False))
    day = F.max(F.when(standing & F.col("field_name").isin(DATE_FIELDS), F.to_date("retrieved_at")))
    has = lambda *kinds: F.bool_or(F.col("field_name").isNotNull() & F.col("status").isin(*kinds))
    confidence = F.when(has("verified"), "verified_evidence_present").when(has("single_source", "confirmed", "format_only"), "single_source_only").otherwise("thin")
    return ledger.groupBy("entity_id").agg(day.cast("string").alias("latest_signal"), confidence.alias("record_confidence"))


#: Columns of a record that its texts read; a missing one counts as null. Those of the second list are arrays.
TEXT_COLUMNS = ["entity_name", "entity_type", "hq_state", "hq_country", "aum_usd", "aum_basis", "check_size_min", "check_size_max", "principal_name", "principal_title", "most_recent_signal_date", "urgency_tier", "record_confidence"]
ARRAY_COLUMNS = ["public_list_overlap", "mandates", "sector_focus", "stage_focus", "geography_focus", "fit_tags", "recent_investments", "recent_news"]


def facet_texts() -> dict[str, Column]:
    """Facet -> text of a record with all of TEXT_COLUMNS and ARRAY_COLUMNS; what is empty is left out, and each text says so if nothing is left."""
    name = F.col("entity_name")
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) if c in ARRAY_COLUMNS else F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    text = lambda c: F.array_join(c, ", ") if c in ARRAY_COLUMNS else F.col(c).cast("string")
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    some = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    part = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    labelled = lambda label, c: part(given(c), f"{label}: ", text(c), ".")
    or_not = lambda c, default="not confirmed": F.when(given(c), text(c)).otherwise(default)

    prose = F.array_join("mandates", ", ")
    mandates = F.when(F.size("mandates") > 1, F.concat(F.lit("Focus areas: "), prose, F.lit("."))).when(given("mandates"), F.concat(prose, F.when(prose.rlike("[.!?]$"), F.lit("")).otherwise(".")))
    size = part(some("check_size_min") | some("check_size_max"), "Typical check size: ", F.when(some("check_size_min"), usd("check_size_min")).otherwise("unspecified"), " to ", F.when(some("check_size_max"), usd("check_size_max")).otherwise("unspecified"), ".")
    focus = F.concat_ws(" ", mandates, labelled("Sector focus", "sector_focus"), labelled("Stage focus", "stage_focus"), labelled("Geography focus", "geography_focus"), labelled("Fit tags", "fit_tags"), size)
    basis = F.when(given("aum_basis"), F.concat(F.lit(" ("), F.col("aum_basis"), F.lit(")"))).otherwise("")
    activity = F.concat_ws(" ", labelled("Recent investments", "recent_investments"), labelled("Recent news", "recent_news"), labelled("Most recent dated signal", "most_recent_signal_date"))
    return {
        "identity": F.concat_ws(
            " ", F.concat(name, F.lit(" is a "), or_not("entity_type", "family office of unconfirmed type"), F.lit(".")), part(given("hq_state"), "Headquartered in ", F.col("hq_state"), ", ", or_not("hq_country", "US"), "."),
            part(some("aum_usd"), "Assets under management: approximately ", usd("aum_usd"), basis, "."), part(given("public_list_overlap"), "Appears on public family-office lists: ", text("public_list_overlap"), "."),
        ),
        "mandate": F.concat(name, F.lit("'s investing mandate. "), F.when(focus != "", focus).otherwise("No investing thesis or mandate details have been confirmed for this record.")),
        "people": F.when(given("principal_name"), F.concat_ws(" ", F.concat("principal_name", F.lit(" is the named decision-maker at "), name, F.lit(".")), labelled("Title", "principal_title"))).otherwise(F.concat(F.lit("No named decision-maker has been confirmed for "), name, F.lit("."))),
        "activity": F.when(activity != "", F.concat(name, F.lit(" activity. "), activity)).otherwise(F.concat(F.lit("No recent activity signal has been confirmed for "), name, F.lit("."))),
        "why_now": F.when(given("urgency_tier"), F.concat(name, F.lit(" has an urgency tier of "), "urgency_tier", F.lit(", based on a dated signal in the record."))).otherwise(F.concat(F.lit("No specific why-now trigger has been confirmed for "), name, F.lit("."))),
        "summary": F.concat(name, F.lit(" ("), or_not("entity_type"), F.lit(") — AUM "), F.when(some("aum_usd"), usd("aum_usd")).otherwise("not confirmed"), F.lit(", principal "), or_not("principal_name"), F.lit(", record confidence: "), F.coalesce("record_confidence", F.lit("None")), F.lit(".")),
    }


def text_record(records: DataFrame) -> DataFrame:
    """record_id and every column that facet_texts reads, null where records has none."""
    have = set(records.columns)
    name = [F.trim("name_raw").alias("entity_name")] if "entity_name" not in have and "name_raw" in have else []
    columns = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in TEXT_COLUMNS if not (name and c == "entity_name")]
    arrays = [F.col(c) if c in have else F.lit(None).cast("array<string>").alias(c) for c in ARRAY_COLUMNS]
    return records.select("record_id", *name, *columns, *arrays).withColumns({c: F.col(c).cast("long") for c in ("aum_usd", "check_size_min", "check_size_max")})


def facet_chunks(records: DataFrame, facets: dict[str, Column] | None = None) -> DataFrame:
    """COR-05: one text per record and facet: identity, mandate, people, activity, why_now and summary, or the given ones."""
    rows = records if facets else text_record(records)
    each = F.array(*[F.struct(F.lit(f).alias("facet"), text.alias("content")) for f, text in (facets or facet_texts()).items()])
    return rows.select("record_id", F.inline(each))


def contact_leaks(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """COR-06: chunks that hold the record's address or phone, and which of them; must be empty before a corpus ships."""
    contact = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("principal_email", "principal_phone")])).alias("c")
    own = records.select("record_id", contact).select("record_id", "c.*").filter(F.col("value").rlike(r"\S"))
    return chunks.join(own, "record_id").filter(F.contains("content", F.col("value"))).select("record_id", "facet", "field")


def assert_no_contact_leak(chunks: DataFrame, records: DataFrame) -> DataFrame:
    leaks = contact_leaks(chunks, records).agg(F.count(F.lit(1)).alias("n"))
    return leaks.select(F.assert_true(F.col("n") == 0, F.lit("a chunk holds a contact")).alias("ok"), "n")


VECTOR_SIZE = 64


def _hashed_vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    slot = functools.lru_cache(50_000)(lambda t: zlib.crc32(t.encode()) % VECTOR_SIZE)
    for batch in texts:
        places = [i * VECTOR_SIZE + slot(t) for i, text in enumerate(batch) for t in re.findall("[a-z0-9]+", (text or "").lower())]
        counts = np.bincount(np.array(places, np.int64), minlength=len(batch) * VECTOR_SIZE).astype(np.float64).reshape(-1, VECTOR_SIZE)
        yield pd.Series(list((counts / np.maximum(np.sqrt((counts * counts).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)), dtype=object)


def hashed_vector(text: Column) -> Column:
    """Unit vector of hashed word counts: the offline stand-in for an embedding model, whose place it takes at this seam."""
    return F.pandas_udf(_hashed_vectors, "array<float>")(text)


def embed_chunks(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """COR-07: chunks with their vectors; embed is the seam for a model."""
    return spread(chunks).withColumn("embedding", embed(F.col("content")))


def merge_sources(pipeline: DataFrame, csv: DataFrame, key: str = "record_id") -> DataFrame:
    """COR-09: the pipeline's row wins."""
    return pipeline.unionByName(csv.join(pipeline.select(key), key, "left_anti"))


FROZEN = ["name_raw", "hq_state"]


def merge_records(base: DataFrame, delta: DataFrame, prune: bool, source: str = "source", build: str = "build_hash") -> DataFrame:
    """COR-10: upsert in which some columns keep their first value; pruning drops rows of the delta's sources that it no longer has, and a partial batch never prunes."""
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])
    joined = b.join(delta, F.col("b_record_id") == F.col("record_id"), "full")
    old = F.col("record_id").isNull()
    cols = [F.when(F.col("b_record_id").isNotNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) if c in FROZEN or c == "record_id" else F.when(old, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns]
    out = joined.select(*cols, old.alias("__old"))
    if prune:
        seen = delta.select(F.col(source).alias("__s")).distinct()
        out = out.join(F.broadcast(seen.withColumn("__in", F.lit(True))), F.col(source) == F.col("__s"), "left").filter(~(F.col("__old") & F.coalesce("__in", F.lit(False))))
    return out.select(*base.columns)


def merge_chunks(chunks: DataFrame, records: DataFrame, delta: DataFrame, embed: Callable[[Column], Column] | None = hashed_vector) -> DataFrame:
    """COR-10: chunks after a merge: those of the delta's records are made (and embedded) anew, those of records that are gone go too, all others stay as they are.

    chunks: record_id, facet, content and, unless embed is None, embedding; records: the merged ones.
    """
    fresh = facet_chunks(delta)
    fresh = fresh if embed is None else embed_chunks(fresh, embed)
    stay = chunks.join(delta.select("record_id"), "record_id", "left_anti")
    return stay.select(*fresh.columns).unionByName(fresh).join(records.select("record_id"), "record_id", "left_semi")


def dataset_meta(records: DataFrame) -> DataFrame:
    """COR-11: a hash of the ids, their number and the counts per class."""
    per = records.groupBy("discovery_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha1(F.col("record_id").cast("string")), 1, 8), 16, 10).cast("long")).alias("h"))
    return per.agg(F.sum("n").alias("records"), F.sha1(F.sum("h").cast("string")).alias("build_hash"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("discovery_class", "n")))).alias("classes"))


def corpus_health(records: DataFrame) -> DataFrame:
    """COR-12: counts per source and the newest build."""
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("live"), F.max("build_hash").alias("newest_build"))


def provenance_table(ledger: DataFrame) -> DataFrame:
    """COR-13: all field claims, whatever their status."""
    return ledger.filter("field_name IS NOT NULL").select(F.col("entity_id").alias("record_id"), "field_name", F.col("answer").alias("value"), "source_url", "source_class", "status", "confidence")


def citable_facts(prov: DataFrame) -> DataFrame:
    """GND-01: the last fact of a record and field among the reliable ones."""
    return latest(prov.filter(~F.col("status").isin(UNSETTLED)), ["entity_id", "field_name"])


CSV_SOURCE = "csv_import"
CSV_FACTS = ["aum_usd", "aum_basis", "aum_as_of", "investing_mandates", "sector_focus", "direct_vs_fund", "recent_investments", "why_now_trigger_concentration", "why_now_trigger_liquidity", "why_now_trigger_access_window", "principal_name", "principal_title", "headcount", "discovery_class", "public_list_overlap", "verdict"]
CSV_TRIGGERS = {"why_now_trigger_concentration": "Concentration", "why_now_trigger_liquidity": "Liquidity", "why_now_trigger_access_window": "Access-window"}


def csv_records(rows: DataFrame) -> DataFrame:
    """COR-08: imported rows (text columns) as records: markers to null, money to whole dollars, lists to arrays; no type, no address."""
    c = lambda n: clean_cell(F.col(n))
    triggered = F.coalesce(*[c(t) for t in CSV_TRIGGERS]).isNotNull()
    return rows.select(
        c("entity_id").alias("record_id"), F.coalesce(c("entity_name"), F.lit("(unnamed)")).alias("entity_name"), F.lit("type_unconfirmed").alias("entity_type"), money_cell(F.col("aum_usd")).alias("aum_usd"),
        *[c(n).alias(n) for n in ("aum_basis", "aum_as_of", "sector_focus", "direct_vs_fund", "recent_investments", *CSV_TRIGGERS, "principal_name", "principal_title", "principal_phone", "headcount", "discovery_class")],
        list_cell(F.col("investing_mandates")).alias("investing_mandates"), list_cell(F.col("public_list_overlap")).alias("public_list_overlap"), F.coalesce(c("verdict"), F.lit("unknown")).alias("verdict"),
        F.when(c("principal_phone").isNotNull(), "imported").otherwise("could_not_verify").alias("principal_phone_status"), F.when(triggered, "triggered").alias("urgency_tier"),
        F.when(c("recent_investments").isNotNull(), "active").alias("activity_status"), F.lit("imported_unvalidated").alias("record_confidence"), F.lit(CSV_SOURCE).alias("source"),
    )


def csv_chunks(records: DataFrame) -> DataFrame:
    """COR-08: six texts of an imported record, each with what to say where nothing is known. The phone is in none of them."""
    name, say = F.col("entity_name"), lambda label, c: F.concat(F.lit(f"{label}: "), c, F.lit("."))
    listed = lambda n: F.nullif(F.array_join(n, ", "), F.lit(""))
    worth = F.coalesce(F.concat(F.lit("$"), F.format_number("aum_usd", 0)), F.lit("not disclosed"))
    focus = F.concat_ws(" ", say("Mandates", listed("investing_mandates")), say("Sector focus", F.col("sector_focus")), say("Instruments", F.col("direct_vs_fund")))
    why = F.concat_ws(" ", *[say(f"{label} trigger", F.col(n)) for n, label in CSV_TRIGGERS.items()])
    basis = F.when(F.col("aum_basis").isNotNull(), F.concat(F.lit(" ("), "aum_basis", F.lit(", as of "), F.coalesce("aum_as_of", F.lit("None")), F.lit(").")))
    texts = {
        "identity": F.concat_ws(" ", F.concat(name, F.lit(" is a family office / advisory entity (imported record, verdict: "), "verdict", F.lit(").")), F.concat(F.lit("Assets under management: "), worth, F.coalesce(basis, F.lit("."))), say("Headcount", F.col("headcount")), say("Discovery sources", F.col("discovery_class")), say("Public-list overlap", listed("public_list_overlap"))),
        "mandate": F.concat(name, F.lit("'s investing mandate and focus. "), F.coalesce(F.nullif(focus, F.lit("")), F.lit("No mandate details in the record."))),
        "people": F.coalesce(F.concat_ws(" ", F.concat("principal_name", F.lit(" is the named contact at "), name, F.lit(".")), F.when(F.col("principal_name").isNotNull(), say("Title", F.col("principal_title"))))),
        "activity": F.coalesce(F.concat(name, F.lit(" recent activity: "), "recent_investments"), F.concat(F.lit("No recent activity recorded for "), name, F.lit("."))),
        "why_now": F.when(why != "", F.concat(name, F.lit(" why-now triggers. "), why)).otherwise(F.concat(F.lit("No specific why-now trigger recorded for "), name, F.lit("."))),
        "summary": F.concat(name, F.lit(": imported "), "verdict", F.lit(" record. AUM "), worth, F.lit(". Principal: "), F.coalesce("principal_name", F.lit("not named")), F.lit(".")),
    }
    texts["people"] = F.coalesce(F.nullif(texts["people"], F.lit("")), F.concat(F.lit("No named decision-maker in the record for "), name, F.lit(".")))
    return facet_chunks(records, texts)


def csv_provenance(records: DataFrame) -> DataFrame:
    """COR-08: the citable facts of an imported record; its phone is not one."""
    text = lambda n: F.array_join(n, ", ") if n in ("investing_mandates", "public_list_overlap") else F.col(n).cast("string")
    facts = F.array(*[F.struct(F.lit(n).alias("field_name"), F.nullif(text(n), F.lit("")).alias("value")) for n in CSV_FACTS])
    return records.select("record_id", F.inline(facts)).filter("value IS NOT NULL").withColumn("source_class", F.lit(CSV_SOURCE)).withColumn("status", F.lit("imported"))
