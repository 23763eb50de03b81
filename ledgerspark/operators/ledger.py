"""Claim ledger: ids, merging, latest images, selection and status rules. Write order is (created_at, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import STATUS_RANK

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ORDER = ["created_at", "seq"]


def status_rank(status: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in STATUS_RANK.values()]), F.array_position(F.array(*[F.lit(k) for k in STATUS_RANK]), status).cast("int") - 1), F.lit(99))


def field_key() -> Column:
    return F.coalesce("field_name", "question_id")


def uuid5_url(name: Column) -> Column:
    """UUIDv5 in the URL namespace, as 32 hex digits: SHA-1 of namespace and name with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def claim_id(ledger: DataFrame) -> DataFrame:
    """LED-01: id from entity, question, field, url and answer; a missing part reads None."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("entity_id", "question_id", "field_name", "source_url", "answer")]
    return ledger.withColumn("minted_id", uuid5_url(F.concat_ws("|", *parts)))


def latest(df: DataFrame, keys: list, order: list | None = None) -> DataFrame:
    """Last row of each key in write order."""
    order = [F.desc(c) for c in (order or ORDER)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def latest_by_field(ledger: DataFrame) -> DataFrame:
    """LED-03: last write per entity and field (the question where there is no field)."""
    return latest(ledger.withColumn("field_key", field_key()).filter("field_key IS NOT NULL"), ["entity_id", "field_key"])


def select_claim(ledger: DataFrame) -> DataFrame:
    """LED-04: the winner per entity and question: strongest status, newest retrieval (none is oldest), least id."""
    own = Window.partitionBy("entity_id", "question_id").orderBy(status_rank(F.col("status")), F.desc_nulls_last("retrieved_at"), "claim_id")
    return ledger.filter("question_id IS NOT NULL").withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def upsert_claims(base: DataFrame, delta: DataFrame) -> DataFrame:
    """LED-02: base and a change log; on conflict only status and answer columns move, the rest keeps what came first."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumn("__d", F.lit(1)))
    moving = [c for c in ("status", "answer", "answer_num", "subject_value", "verification_method", "confirming_url", "confirming_class", "verified_at") if c in base.columns]
    first = F.struct("__d", "created_at", "seq")
    keep = [F.min_by(c, first).alias(c) for c in base.columns if c not in moving and c != "claim_id"]
    return both.groupBy("claim_id").agg(*keep, *[F.max_by(c, first).alias(c) for c in moving]).select(*base.columns)


def settled(rule: str) -> Column:
    """LED-08: the status rules that call a claim settled."""
    never = ["could_not_verify", "removed_failed_validation", "superseded"]
    return ~F.col("status").isin(never + (["contradicted"] if rule == "completeness" else []))


def settled_fields(ledger: DataFrame, rule: str = "enrichment") -> DataFrame:
    return ledger.filter(settled(rule) & F.col("field_name").isNotNull()).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("field_name")), ",").alias("fields"))


def latest_outcome(runs: DataFrame, outcome: str, order: str, shipped: list[str]) -> DataFrame:
    """LED-07: entities whose latest run shipped."""
    return latest(runs, ["entity_id"], [order]).filter(F.col(outcome).isin(shipped))


def latest_decisions(decisions: DataFrame, verdicts: list[str]) -> DataFrame:
    """LED-06: latest decision per entity first, then the verdict filter."""
    return latest(decisions, ["entity_id"], ["seq"]).filter(F.col("status").isin(verdicts))


def supersede_derived(ledger: DataFrame) -> DataFrame:
    """LED-09: a forced run marks derived claims as superseded."""
    derived = F.coalesce(F.col("extraction_method").startswith("derived_"), F.lit(False))
    return ledger.withColumn("status", F.when(derived, "superseded").otherwise(F.col("status")))


def downgrade_contradictions(claims: DataFrame, text: str = "answer") -> DataFrame:
    """LED-10: a contradiction that names fewer than two distinct URLs is confirmed if it has a source, else not verified."""
    urls = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(https?://[^\s)\]]+)"), F.lit(1))))
    weak = (F.col("status") == "contradicted") & (urls < 2)
    marked = claims.withColumn("downgraded", weak)
    return marked.withColumn("status", F.when(F.col("downgraded") & F.col("source_url").isNotNull(), "confirmed").when(F.col("downgraded"), "could_not_verify").otherwise(F.col("status")))


def tag_gaps(claims: DataFrame, lanes_with_evidence: DataFrame) -> DataFrame:
    """LED-11: unverified claims get a placeholder class that says whether their lane had usable evidence."""
    marked = claims.join(F.broadcast(lanes_with_evidence.withColumn("__e", F.lit(True))), "lane", "left")  # one row a lane
    gap = F.col("status") == "could_not_verify"
    return marked.withColumn("source_class", F.when(gap & F.col("__e"), "no_evidence_found").when(gap, "tool_unavailable").otherwise(F.col("source_class"))).drop("__e")


def stamp_method(claims: DataFrame, tools: DataFrame) -> DataFrame:
    """LED-12: a missing method becomes the tool that fetched the URL, else that of the lane."""
    return claims.join(tools, "source_url", "left").withColumn("extraction_method", F.coalesce("extraction_method", "tool", F.concat(F.lit("researcher_"), "lane"))).drop("tool")


def rename_field(ledger: DataFrame, names: dict[str, str]) -> DataFrame:
    """LED-13: field names of an older vocabulary."""
    return ledger.withColumn("field_name", F.coalesce(*[F.when(F.col("field_name") == a, F.lit(b)) for a, b in names.items()], F.col("field_name")))


def chain_steps(ledger: DataFrame) -> DataFrame:
    """LED-14: source hops of corroborated claims, numbered per entity."""
    own = Window.partitionBy("entity_id").orderBy(*ORDER)
    return ledger.filter("status = 'verified'").withColumn("step", F.row_number().over(own)).select("entity_id", "step", "claim_id", "source_class", "source_url")


def backfill_from_blobs(decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """LED-05: claims out of the JSON ledgers of decisions and rejections (entity_id, ledger), defaults filled in."""
    kind = "array<struct<question_id:string,field_name:string,answer:string,status:string,source_url:string,source_class:string,confidence:string>>"
    rows = decisions.select("entity_id", "ledger").unionByName(rejections.select("entity_id", "ledger"))
    out = rows.select("entity_id", F.inline(F.from_json("ledger", kind)))
    return claim_id(out.withColumn("status", F.coalesce("status", F.lit("could_not_verify"))).withColumn("confidence", F.coalesce("confidence", F.lit("low"))))
