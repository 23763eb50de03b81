"""Cells and sheets: the value of each field of an entity, what lost to it, and the wide record; scores and the quota-bound selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import COLUMN_ORDER, HIGH_VALUE, MULTI_VALUED, SIGNAL_FIELDS, STATUS_WEIGHT

KILLED = "removed_failed_validation"


def provenance_rank(method: Column) -> Column:
    """CELL-01: 0 for researched, 1 for derived, 2 for anything else or nothing."""
    return F.when(method.startswith("projected_"), 0).when(method.startswith("derived_"), 1).otherwise(2)


def resolve_cells(ledger: DataFrame) -> DataFrame:
    """CELL-02: entity_id, field_name, value, the last write (winner) and the claim that describes the value (first producer, else the winner).

    A multi-valued field joins the first-seen distinct answers of its best provenance tier; without an eligible one, and for other fields, the last write counts.
    """
    rows = ledger.filter("field_name IS NOT NULL").withColumn("at", F.struct("created_at", "seq"))
    eligible = F.col("field_name").isin(MULTI_VALUED) & ~F.col("status").isin(KILLED, "superseded") & F.coalesce(F.col("answer") != "", F.lit(False))
    rows = rows.withColumn("tier", F.when(eligible, provenance_rank(F.col("extraction_method"))))
    last = F.max_by(F.struct("claim_id", "status", "source_class", "answer"), "at")
    # one row for each answer of a tier: what a group holds is bounded by its distinct answers
    answers = rows.groupBy("entity_id", "field_name", "tier", F.when(F.col("tier").isNotNull(), F.col("answer")).alias("part")).agg(
        F.min("at").alias("first"), F.min_by(F.struct("claim_id", "status", "source_class"), "at").alias("by"), F.max("at").alias("end"), last.alias("last")
    )
    best = answers.groupBy("entity_id", "field_name").agg(
        F.max_by("last", "end").alias("winner"), F.min("tier").alias("best"), F.array_sort(F.collect_list(F.when(F.col("tier").isNotNull(), F.struct("tier", "first", "part", "by")))).alias("parts")
    )
    mine = F.filter("parts", lambda p: p["tier"] == F.col("best"))
    single = F.when(F.col("winner.status") != KILLED, F.col("winner.answer"))
    value = F.when(F.col("best").isNotNull(), F.array_join(F.transform(mine, lambda p: p["part"]), "; ")).otherwise(single)
    tell = lambda c: F.when(F.col("best").isNotNull(), F.get(mine, F.lit(0))["by"][c]).otherwise(F.col(f"winner.{c}"))
    return best.select("entity_id", "field_name", value.alias("value"), F.col("winner.claim_id").alias("winner_id"), tell("claim_id").alias("producer_id"), tell("status").alias("status"), tell("source_class").alias("source_class"), "best")


def alternatives(ledger: DataFrame) -> DataFrame:
    """CELL-03: claims with an answer that are not in their cell, and why."""
    cells = resolve_cells(ledger).select("entity_id", "field_name", "value", "winner_id", "best")
    rows = ledger.filter("field_name IS NOT NULL AND answer IS NOT NULL AND answer <> ''").withColumn("rank", provenance_rank(F.col("extraction_method")))
    dead = F.col("status").isin(KILLED, "superseded")
    first = F.row_number().over(Window.partitionBy("entity_id", "field_name", dead, "rank", "answer").orderBy("created_at", "seq"))
    rows = rows.withColumn("nth", first).join(cells, ["entity_id", "field_name"])
    multi = F.col("field_name").isin(MULTI_VALUED) & F.col("best").isNotNull()
    used = F.when(multi, ~dead & (F.col("rank") == F.col("best")) & (F.col("nth") == 1)).otherwise((F.col("claim_id") == F.col("winner_id")) & F.col("value").isNotNull())
    why = F.when(F.col("status") == "superseded", "superseded").when(F.col("status") == KILLED, "failed_validation").when(multi & (F.col("rank") == F.col("best")), "duplicate_value").when(multi & (F.col("rank") > F.col("best")), "lower_provenance_tier").when(multi, "weaker_status").otherwise("not_latest_write")
    return rows.filter(~used).select("entity_id", "field_name", "claim_id", why.alias("why_not_used"))


#: Columns of a record that stand before its fields; a field of such a name has no column of its own.
LEADING = ["entity_id", "canonical_name", "type_final", "lead_origin_source_class", "outcome"]


def records_pivot(ledger: DataFrame, present: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """CELL-04: one row per entity. The columns are given, so no job is needed to find them; high-value fields always have one, with status and class beside.

    With candidates (entity_id, canonical_name, type_final, discovery_class_primary, outcome) a row for each of them, claims or not, who it is before its fields.
    """
    every = (set(present) | set(HIGH_VALUE)) - set(LEADING[:4])
    ordered = [f for f in COLUMN_ORDER if f in every] + sorted(every - set(COLUMN_ORDER))
    cells = resolve_cells(ledger)
    at = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    columns, blank = [], {}
    for f in ordered:
        columns.append(at(f, "value").alias(f))
        if f in HIGH_VALUE:
            columns += [at(f, "status").alias(f"{f}_status"), at(f, "source_class").alias(f"{f}_source_class")]
            blank[f"{f}_status"] = F.coalesce(F.col(f"{f}_status"), F.lit("could_not_verify"))
    wide = cells.groupBy("entity_id").agg(*columns)
    if candidates is not None:
        head = candidates.select(*LEADING[:3], F.coalesce("discovery_class_primary", F.lit("unknown")).alias(LEADING[3]), LEADING[4])
        wide = head.join(wide, "entity_id", "left")
    return wide.withColumns(blank)


PROVENANCE = ["entity_id", "field_name", "answer", "status", "source_url", "source_class", "extraction_method", "confidence", "verification_method", "confirming_url", "confirming_class", "verified_at"]


def provenance_rows(ledger: DataFrame, selected: DataFrame) -> DataFrame:
    """CELL-05: unpivoted claims of the selected entities, with what confirmed them; null where the ledger has no such column."""
    rows = ledger.filter("field_name IS NOT NULL").join(selected.select("entity_id"), "entity_id", "left_semi")
    return rows.select(*[F.col(c) if c in ledger.columns else F.lit(None).cast("timestamp" if c == "verified_at" else "string").alias(c) for c in PROVENANCE])


def score_claims(ledger: DataFrame) -> DataFrame:
    """SEL-01: weighted status sum, verified cells, urgency and discovery classes per entity."""
    weight = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STATUS_WEIGHT.items()], F.lit(0))
    has = F.col("field_name").isNotNull()
    signal = F.col("field_name").isin(SIGNAL_FIELDS) & ~F.col("status").isin("could_not_verify", KILLED)
    urgency = F.max(F.when(signal & F.col("confidence").isin("high", "medium"), 2).when(signal, 1).otherwise(0))
    kind = F.when(F.col("field_name").startswith("discovery_class_"), F.substring("field_name", 17, 200))
    return ledger.groupBy("entity_id").agg(
        F.sum(F.when(has, weight).otherwise(0)).alias("actionability_score"), F.count_if(has & (F.col("status") == "verified")).alias("verified_cell_count"), urgency.alias("urgency_tier_rank"), F.min(kind).alias("discovery_class_primary"), F.count(kind).alias("discovery_class_count")
    )


def ranking() -> list[Column]:
    """Order of candidates, entity_id last so that it is total."""
    return [F.desc("actionability_score"), F.desc(F.col("type_final") == "SFO"), F.desc("verified_cell_count"), F.desc("urgency_tier_rank"), F.desc("discovery_class_count"), F.asc("entity_id")]


def select_quota(cands: DataFrame, n: int = 50, cap: int = 15) -> DataFrame:
    """SEL-02: the first n by rank with at most cap of a class; candidates over the cap that were met before the n-th are reported as excluded.

    Only the first n + cap of every class can matter to the running count, and those are cut before the one ordered pass.
    """
    own = Window.partitionBy(F.coalesce("discovery_class_primary", F.lit("unknown"))).orderBy(*ranking())
    ranked = cands.withColumn("class_rank", F.row_number().over(own))
    inside = ranked.filter(F.col("class_rank") <= cap)  # cap rows a class
    admitted = inside.withColumn("rank", F.row_number().over(Window.orderBy(*ranking()))).filter(F.col("rank") <= n)
    keys = ["actionability_score", "type_final", "verified_cell_count", "urgency_tier_rank", "discovery_class_count", "entity_id"]
    code = lambda: F.struct(F.col("actionability_score"), (F.col("type_final") == "SFO").cast("int").alias("s"), F.col("verified_cell_count"), F.col("urgency_tier_rank"), F.col("discovery_class_count"), (-F.col("entity_id")).alias("e"))
    last = admitted.agg(F.min(code()).alias("last"), F.count(F.lit(1)).alias("taken"))
    over = ranked.filter(F.col("class_rank") > cap).join(F.broadcast(last)).filter((F.col("taken") < n) | (code() > F.col("last")))  # one row
    out = admitted.withColumn("excluded", F.lit(False)).select("entity_id", "discovery_class_primary", "rank", "excluded", *keys[:1])
    return out.unionByName(over.select("entity_id", "discovery_class_primary", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("excluded"), *keys[:1]))


def production_records(selection: DataFrame) -> DataFrame:
    """SEL-03: what goes into production: rank and class of the selected, and the excluded marked as such."""
    return selection.select("entity_id", "rank", F.col("discovery_class_primary").alias("primary_class"), F.col("excluded").alias("excluded_by_quota"))


def reserve_draw(pool: DataFrame, gap: int) -> DataFrame:
    """SEL-04: draw from the fixable reserve, most discovery classes first, half again as many as are missing."""
    return pool.filter("thin_reason = 'fixable'").orderBy(F.desc("discovery_class_count"), "entity_id").limit(max(1, int(gap * 1.5)))


def class_report(selection: DataFrame, cap: int = 15) -> DataFrame:
    """CELL-06: selected entities and their mean score per class; below them the cap and what was selected under it (section: class, cap, selected)."""
    chosen = selection.filter("NOT excluded").groupBy(F.coalesce("discovery_class_primary", F.lit("unknown")).alias("discovery_class")).agg(F.count(F.lit(1)).alias("entity_count"), F.round(F.avg("actionability_score"), 2).alias("avg_actionability_score"))
    line = lambda section, name, n: (F.lit(section).alias("section"), name.alias("discovery_class"), n.alias("entity_count"))
    kinds = F.explode(F.array(F.struct(F.lit("class").alias("section"), F.col("avg_actionability_score")), F.struct(F.lit("selected").alias("section"), F.lit(None).cast("double").alias("avg_actionability_score"))))
    rows = chosen.select("discovery_class", "entity_count", kinds.alias("k")).select("k.section", "discovery_class", "entity_count", "k.avg_actionability_score")
    limit = selection.sparkSession.range(1).select(*line("cap", F.lit("quota cap per class"), F.lit(cap).cast("long")), F.lit(None).cast("double").alias("avg_actionability_score"))
    return rows.unionByName(limit)


# Fixed value: the reason of an exclusion by quota.
BY_QUOTA = "excluded to preserve source diversity"


def rejected_rows(rejections: DataFrame, selection: DataFrame) -> DataFrame:
    """CELL-07: rejections of every stage (entity_id, stage, reason_code, created_at) and the exclusions by quota, which have no time."""
    quota = selection.filter("excluded").select("entity_id", F.lit("quota").alias("stage"), F.lit(BY_QUOTA).alias("reason_code"), F.lit(None).cast(rejections.schema["created_at"].dataType).alias("created_at"))
    return rejections.select("entity_id", "stage", "reason_code", "created_at").unionByName(quota)


def audit_rows(audits: DataFrame) -> DataFrame:
    """CELL-07: audit entries in the order of writing, their JSON values decoded: text as text, everything else as JSON (seq, entity_id, field, before, after)."""
    value = lambda c: F.coalesce(F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "struct<v:string>")["v"], F.when(F.col(c) != "null", F.col(c))).alias(c)
    return audits.select("seq", "entity_id", "field", value("before"), value("after"))


#: Fields that need a word, what they hold and when they are filled.
DICTIONARY = [
    ("aum_usd", "assets under management in dollars, a floor", "from the total of a 13F filing; blank without one"),
    ("aum_basis", "how aum_usd was found", "wherever aum_usd is"),
    ("principal_name", "who decides: principal, chief investment officer or the like", "looked for before anything that costs more"),
    ("principal_email", "address of the principal or the firm", "blanked, with status removed_failed_validation and an audit row, if a check fails"),
    ("principal_phone", "telephone of the principal or the firm", "format_only unless a second source has it"),
    ("important_insight", "why now: concentration_pain, fresh_liquidity or access_window", "from the change between filings or a date to come; never a guess"),
    ("type_final", "SFO, MFO or type_unconfirmed", "from G1.Q4; type_unconfirmed where it is open or contradicted"),
    ("lead_origin_source_class", "class of the feed that the lead came from", "unknown without a discovery class; counts for the quota"),
]
#: Statuses that a cell of the records can have.
STATUS_NOTES = [
    ("verified", "sources of two classes or more agree"),
    ("single_source", "one source class only"),
    ("pattern_inferred", "built from a known pattern"),
    ("format_only", "the format is right, nothing more"),
    ("could_not_verify", "looked for and not found, or the tool was not there"),
    ("removed_failed_validation", "taken out by a check; the value is in the audit rows"),
]


def data_dictionary(spark) -> DataFrame:
    """CELL-08: what the fields hold and when they are filled, then what a status means (section: field, status)."""
    rows = [("field", *r) for r in DICTIONARY] + [("status", name, meaning, None) for name, meaning in STATUS_NOTES]
    return spark.createDataFrame(rows, "section string, name string, description string, inclusion_standard string")
