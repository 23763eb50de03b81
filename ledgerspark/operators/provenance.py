"""Field provenance, tool-call log and work queues as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.web import host
from ..vocab import HIGH_VALUE
from .ledger import latest

# A sentence for each extraction method, and the tools behind it.
NARRATIVES = {
    "derived_13f": "Assets under management derived as a floor from the firm's most recent 13F filing's reported portfolio value.",
    "derived_13f_qoq": "Assets under management derived from the quarter-over-quarter change in the firm's 13F filings.",
    "adv_raum": "Assets under management taken from the SEC ADV filing's Regulatory Assets Under Management (RAUM) figure.",
    "derived_5500": "Participant count derived from the firm's most recent Form 5500 annual report.",
    "derived_conference": "A conference sighting derived from a public conference attendee or speaker list.",
    "derived_entity_sources": "Derived from the entity's ingested discovery-feed source records.",
    "derived_public_list_match": "Derived by matching the firm against a public list of known family offices.",
    "jsonld": "The principal's name was parsed from the JSON-LD structured-data block on the firm's own website.",
    "serper_xray": "Found via a Serper Google search targeting the firm's domain (the x-ray query pattern).",
    "serper_news": "Found via a Serper Google News search.",
    "gdelt_docapi": "Found via the GDELT DOC 2.0 news API.",
    "snov_emails_by_name_domain": "A Snov.io name-targeted email lookup returned this address for the principal on the firm's domain.",
    "snov_domain_search": "A Snov.io domain-wide email search returned this address for the firm's domain.",
    "snov_no_match": "A Snov.io email lookup ran but found no address for this principal on the firm's domain.",
    "snov_error": "A Snov.io email lookup failed (credentials missing or an API error).",
    "site_scrape": "Scraped from the firm's own website via a headless-browser render.",
    "httpx_trafilatura": "Fetched from the firm's own website via a plain HTTP request and extracted with trafilatura.",
    "llm_wave2_extraction": "Extracted by the language model in enrichment wave 2 from fetched page content.",
}
METHOD_TOOLS = [
    ("serper_xray", "serper_search_raw"), ("serper_news", "serper_search_raw"), ("gdelt_docapi", "news_search_raw"), ("snov_emails_by_name_domain", "snov_emails_by_name_domain_raw"), ("snov_domain_search", "snov_domain_search_raw"),
    ("snov_no_match", "snov_emails_by_name_domain_raw"), ("snov_no_match", "snov_domain_search_raw"), ("snov_error", "snov_emails_by_name_domain_raw"), ("snov_error", "snov_domain_search_raw"), ("jsonld", "fetch_raw_html"),
    ("httpx_trafilatura", "fetch_page_free_first"), ("httpx_trafilatura", "fetch_raw_html"), ("site_scrape", "fetch_page_free_first"), ("site_scrape", "fetch_raw_html"),
]


def method_tools(spark: SparkSession) -> DataFrame:
    """extraction_method, tool: a fixed table."""
    return spark.createDataFrame(METHOD_TOOLS, "extraction_method string, tool string")


def field_grid(ledger: DataFrame) -> DataFrame:
    """PRV-01: every entity with the fields it has and the high-value ones."""
    high = F.explode(F.array(*[F.lit(f) for f in HIGH_VALUE]))
    own = ledger.filter("field_name IS NOT NULL").select("entity_id", "field_name")
    return own.unionByName(ledger.select("entity_id").distinct().select("entity_id", high.alias("field_name"))).distinct()


def method_summary(method: Column, source_class: Column, narratives: dict[str, str] = NARRATIVES) -> Column:
    """PRV-02: how a value was found, in a sentence."""
    known = F.coalesce(*[F.when(method == k, F.lit(v)) for k, v in narratives.items()])
    projected = F.when(method.startswith("projected_"), F.concat(F.lit("Researched in Layer 1 as question "), F.substring(method, 11, 100), F.lit(" and projected onto this field.")))
    return F.coalesce(projected, known, F.concat(method, F.lit(" via "), source_class), method, F.concat(F.lit("None via "), source_class), F.lit(""))


def checks_for_cell(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """PRV-03: findings on the field or on the winning claim: two equi-joins, each finding once."""
    f = findings.select("finding_id", "entity_id", "field", "claim_id")
    by_field = f.join(cells.select("entity_id", F.col("field_name").alias("field")), ["entity_id", "field"]).select("entity_id", F.col("field").alias("field_name"), "finding_id")
    by_claim = f.select("finding_id", "claim_id").join(cells.select("entity_id", "field_name", F.col("winner_id").alias("claim_id")), "claim_id").select("entity_id", "field_name", "finding_id")
    return by_field.unionByName(by_claim).distinct()


def match_tool_calls(cells: DataFrame, calls: DataFrame, tools: DataFrame, cap: int = 20) -> DataFrame:
    """PRV-04: calls of a cell by URL, by host, or by the tools of its method; the newest, each once (cells: entity_id, field_name, source_url, extraction_method)."""
    c = calls.select("seq", "entity_id", "tool", "result_url", "called_at").withColumn("call_host", host(F.col("result_url")))
    w = cells.withColumn("own_host", host(F.col("source_url")))
    key = ["entity_id", "field_name", "seq", "called_at"]
    by_url = w.join(c.withColumnRenamed("result_url", "source_url"), ["entity_id", "source_url"]).select(*key, F.lit(0).alias("how"))
    by_host = w.join(c.withColumnRenamed("call_host", "own_host"), ["entity_id", "own_host"]).select(*key, F.lit(0).alias("how"))
    by_tool = w.join(F.broadcast(tools), "extraction_method").join(c, ["entity_id", "tool"]).select(*key, F.lit(1).alias("how"))  # tools: a fixed table
    best = by_url.unionByName(by_host).unionByName(by_tool).groupBy(*key).agg(F.min("how").alias("how"))
    own = Window.partitionBy("entity_id", "field_name").orderBy(F.desc("called_at"), F.desc("seq"))
    return best.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= cap).select("entity_id", "field_name", "seq", F.when(F.col("how") == 0, "url").otherwise("method").alias("matched_by"))


def blank_reason(cells: DataFrame, audits: DataFrame) -> DataFrame:
    """PRV-05: why each cell is blank; the first rule that fits, with its detail and, where the release rule took a value, that value and its reason (entity_id, field_name, code, detail, rejected_value, reason_code).

    cells: entity_id, field_name; status, extraction_method, source_class and source_url of the winning claim, if there is one; has_claim, has_call (one matched to the field), calls (all of the lead's in the run).
    audits: entity_id, field_name, rejected_value, reason_code, seq, of which the newest of a field counts.
    """
    newest = audits.groupBy("entity_id", "field_name").agg(F.max_by(F.struct("rejected_value", "reason_code"), "seq").alias("audit"))
    rows = cells.join(newest, ["entity_id", "field_name"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    killed = yes(F.col("status") == "removed_failed_validation")
    down = yes(F.col("source_class") == "tool_unavailable") | yes(F.col("extraction_method").endswith("_error"))
    looked, worked = yes(F.col("has_claim")) | yes(F.col("has_call")), yes(F.col("calls") > 0)
    target = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("extraction_method", F.lit("")), F.nullif("source_class", F.lit("")), F.lit(""))
    code = F.when(killed, "removed_failed_validation").when(down, "tool_unavailable").when(looked | worked, "searched_not_found").otherwise("never_attempted")
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    detail = (
        F.when(killed & F.col("audit").isNotNull(), F.concat(F.lit("The value '"), said("audit.rejected_value"), F.lit("' was found but blanked by the release rule ("), said("audit.reason_code"), F.lit(").")))
        .when(killed, "The value was found but blanked by the release rule.")
        .when(down, F.concat(F.lit("The tool that would have found this value was unavailable ("), target, F.lit(").")))
        .when(looked, "A search or lookup ran but found no usable value for this field.")
        .when(worked, F.concat(F.col("calls").cast("string"), F.lit(" tool call(s) ran for this lead in this run, none of them attributable to this field.")))
        .otherwise("No claim or tool call for this field exists — it was never attempted.")
    )
    return rows.select("entity_id", "field_name", code.alias("code"), detail.alias("detail"), F.when(killed, F.col("audit.rejected_value")).alias("rejected_value"), F.when(killed, F.col("audit.reason_code")).alias("reason_code"))


def field_records(grid: DataFrame, cells: DataFrame, alternatives: DataFrame) -> DataFrame:
    """PRV-06: one nested record per entity and field."""
    alt = alternatives.groupBy("entity_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("claim_id", "why_not_used"))).alias("alternatives"))
    joined = grid.join(cells, ["entity_id", "field_name"], "left").join(alt, ["entity_id", "field_name"], "left")
    return joined.select("entity_id", "field_name", F.struct("value", "status", "source_class", "producer_id", "alternatives").alias("record"))


def run_summary(prov: DataFrame) -> DataFrame:
    """PRV-07: fields, shipped and blank ones per entity."""
    return prov.groupBy("entity_id").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("value").isNotNull()).alias("shipped"), F.count_if(F.col("value").isNull()).alias("blank"))


def newest_run_for_lead(prov: DataFrame) -> DataFrame:
    """PRV-08: the newest run that has rows for the lead."""
    return prov.groupBy("entity_id").agg(F.max_by("run_id", F.struct("called_at", "seq")).alias("run_id"))


def run_entities(queue: DataFrame, calls: DataFrame) -> DataFrame:
    """PRV-09: entities of a run by either record of work."""
    return queue.select("run_id", "entity_id").unionByName(calls.select("run_id", "entity_id")).distinct()


def runs_missing_log(runs: DataFrame, prov: DataFrame) -> DataFrame:
    return runs.select("run_id").distinct().join(prov.select("run_id").distinct(), "run_id", "left_anti")


def runs_list(runs: DataFrame, prov: DataFrame, limit: int) -> DataFrame:
    """PRV-10: newest runs with their number of leads; the limit is clamped to 1 to 200."""
    leads = prov.groupBy("run_id").agg(F.count_distinct("entity_id").alias("leads"))
    return runs.join(leads, "run_id", "left").select("run_id", "started_at", F.coalesce("leads", F.lit(0)).cast("long").alias("leads")).orderBy(F.desc_nulls_last("started_at"), "run_id").limit(max(1, min(limit, 200)))


def upsert_provenance(base: DataFrame, delta: DataFrame) -> DataFrame:
    """PRV-11: the last writer of a run, entity and field wins whole."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumn("__d", F.lit(1)))
    return latest(both, ["run_id", "entity_id", "field_name"], ["__d", "seq"]).drop("__d")


def run_status_view(leads: DataFrame, checkpoints: DataFrame, decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """PRV-12: state, verdict, reason and cost of every lead of a run, and the run's total cost (leads: run_id, entity_id).

    The state is the checkpoint's, queued without one; a decision gives verdict and rationale, else a rejection says reject and its reason.
    checkpoints: entity_id, state, cost_usd, seq; decisions: entity_id, verdict, rationale, seq; rejections: entity_id, reason_code, seq.
    """
    d = latest(decisions, ["entity_id"], ["seq"]).select("entity_id", F.struct("verdict", F.col("rationale").alias("reason")).alias("d"))
    r = latest(rejections, ["entity_id"], ["seq"]).select("entity_id", F.struct(F.lit("reject").alias("verdict"), F.col("reason_code").alias("reason")).alias("r"))
    c = latest(checkpoints, ["entity_id"], ["seq"]).select("entity_id", "state", "cost_usd")
    rows = leads.join(c, "entity_id", "left").join(d, "entity_id", "left").join(r, "entity_id", "left").withColumn("v", F.coalesce("d", "r")).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    total = rows.groupBy("run_id").agg(F.sum("cost_usd").alias("total_cost_usd"))
    return rows.join(total, "run_id").select("run_id", "entity_id", F.coalesce("state", F.lit("queued")).alias("status"), "v.verdict", "v.reason", "cost_usd", "total_cost_usd")


def redact_args(args: Column) -> Column:
    """TOOL-01: secret-named keys out, texts cut at 200."""
    kept = F.map_filter(args, lambda k, v: ~k.rlike("(?i)key|token|secret|password|auth"))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, 200))


def summarize_result(result: Column, error: Column) -> Column:
    """TOOL-02: length of the result list or text, empty, or the error."""
    n = F.json_array_length(F.get_json_object(result, "$.results"))
    text = F.get_json_object(result, "$.content")
    out = F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" results"))).when(text.isNotNull(), F.concat(F.length(text).cast("string"), F.lit(" chars")))
    return F.substring(out.when(result.isNull() | (result == "{}"), "empty").otherwise("ok"), 1, 200)


def cache_key(args: Column) -> Column:
    """TOOL-03: SHA-256 of the arguments as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))), 256)


def cacheable(body: Column, error: Column) -> Column:
    """TOOL-03: whether a response may be kept: no error, and a body."""
    return F.coalesce(error, F.lit("")).eqNullSafe("") & (F.coalesce(body, F.lit("")) != "")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """TOOL-03: requests with hit flag; errors and empties in the cache never hit (cache: key, body, error)."""
    good = cache.filter(cacheable(F.col("body"), F.col("error"))).select("key", "body").dropDuplicates(["key"])
    return requests.join(good, "key", "left").withColumn("cache_hit", F.col("body").isNotNull())


def recent_calls(calls: DataFrame, run: str, k: int) -> DataFrame:
    """TOOL-04: the newest k calls of a run."""
    return calls.filter(F.col("run_id") == run).orderBy(F.desc("called_at"), F.desc("seq")).limit(k)


# Phrases of a spent balance.
SPENT = ["not enough credits", "no credits", "insufficient credit", "consumed all your api credits", "credit limit", "quota exceeded", "out of credits", "limit reached"]


def is_exhausted(status: Column, body: Column, rule: str = "batch") -> Column:
    """TOOL-05: whether a response says that a key is spent: a client error with a phrase of a spent balance. 429 alone says so in the batch rule; the watch rule takes every 429 as throttling."""
    words = F.exists(F.array(*[F.lit(p) for p in SPENT]), lambda p: F.contains(F.lower(F.coalesce(body, F.lit(""))), p))
    said = F.coalesce(status.isin(400, 401, 402, 403), F.lit(False)) & words
    return F.coalesce(status == 429, F.lit(False)) | said if rule == "batch" else said


UNFINISHED = ["running", "failed", "retry"]


def unstarted(entities: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """QUE-01: entities never handed out."""
    return entities.join(checkpoints.select("entity_id").distinct(), "entity_id", "left_anti")


def resumable(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter(F.col("state").isin(UNFINISHED)).select("entity_id").distinct()


def tiers(sources: DataFrame, ranks: dict[str, int]) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("source_class") == c, r) for c, r in ranks.items()])
    return sources.withColumn("tier", rank).groupBy("entity_id").agg(F.min("tier").alias("tier"))


def priority_queue(entities: DataFrame, sources: DataFrame, checkpoints: DataFrame, ranks: dict[str, int], strict: bool = True) -> DataFrame:
    """QUE-02: unfinished work first, then new entities by their best tier, in order of arrival."""
    new = unstarted(entities, checkpoints).withColumn("turn", F.lit(1))
    old = entities.join(resumable(checkpoints), "entity_id", "left_semi").withColumn("turn", F.lit(0))
    queue = old.unionByName(new).join(tiers(sources, ranks), "entity_id", "left")
    if strict:
        queue = queue.filter("turn = 0 OR tier IS NOT NULL")
    return queue.select("entity_id", "turn", F.when(F.col("turn") == 1, F.coalesce("tier", F.lit(99))).alias("tier"), "seq").orderBy("turn", F.asc_nulls_first("tier"), "seq", "entity_id")


def queue_breakdown(queue: DataFrame, n_tiers: int) -> DataFrame:
    """QUE-03: queued entities per tier, empty tiers included."""
    every = queue.sparkSession.range(n_tiers).select(F.col("id").cast("int").alias("tier"))
    return every.join(queue.filter("tier IS NOT NULL").groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("entities"))


def merge_checkpoints(base: DataFrame, delta: DataFrame) -> DataFrame:
    """QUE-04: the newest state; attempts and cost stay where the new row has none."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumn("__d", F.lit(1)))
    at = F.struct("__d", "seq")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return both.groupBy("entity_id").agg(F.max_by("state", at).alias("state"), known("attempts").alias("attempts"), known("cost").alias("cost"))


def merge_validator_checkpoints(base: DataFrame, delta: DataFrame) -> DataFrame:
    """QUE-04, the validator's: per record and mode the newest status and error; every row of the delta is one more attempt, whatever its status (record_id, mode, status, last_error, attempts, seq; the delta without attempts)."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumns({"__d": F.lit(1), "attempts": F.lit(1).cast("long")}))
    at = F.struct("__d", "seq")
    return both.groupBy("record_id", "mode").agg(F.max_by("status", at).alias("status"), F.max_by("last_error", at).alias("last_error"), F.sum("attempts").alias("attempts"))


MOST_ATTEMPTS = 3


def rag_queue_image(events: DataFrame) -> DataFrame:
    """QUE-05: each entity's row of the ingest queue: a new enqueue makes it pending without attempts; every mark (pending with an error, done, stale) is an attempt and sets the state (events: entity_id, seq, kind)."""
    reset = events.groupBy("entity_id").agg(F.max(F.when(F.col("kind") == "enqueue", F.col("seq"))).alias("enqueued"))
    since = events.join(reset, "entity_id").filter("enqueued IS NOT NULL AND seq >= enqueued")
    mark = F.col("kind") != "enqueue"
    return since.groupBy("entity_id", "enqueued").agg(F.count_if(mark).alias("attempts"), F.coalesce(F.max_by("kind", F.when(mark, F.col("seq"))), F.lit("pending")).alias("state"))


def pending_entities(image: DataFrame, limit: int = 50) -> DataFrame:
    """QUE-05: what the next drain takes: pending with attempts left, in the order in which it was enqueued."""
    return image.filter((F.col("state") == "pending") & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("enqueued", "entity_id").limit(limit)


def stale_entities(pending: DataFrame, runs: DataFrame, shipped: list[str]) -> DataFrame:
    """QUE-05: pending entities whose latest run no longer ships them, which a drain marks stale (runs: entity_id, outcome, seq)."""
    now = runs.groupBy("entity_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    return pending.join(now, "entity_id", "left").filter(~F.coalesce(F.col("outcome").isin(shipped), F.lit(False))).select("entity_id")


def spend_report(costs: DataFrame, cap: float, warn: float = 0.75) -> DataFrame:
    """QUE-06: per run the first row at which the sum reaches the cap or the warning share."""
    own = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = costs.withColumn("spent", F.sum("cost").over(own))
    return rows.groupBy("run_id").agg(F.max("spent").alias("total"), F.min(F.when(F.col("spent") >= cap * warn, F.col("seq"))).alias("warned_at"), F.min(F.when(F.col("spent") >= cap, F.col("seq"))).alias("stopped_at"))


def progress_metrics(results: DataFrame, targets: DataFrame) -> DataFrame:
    """QUE-07: counts per run and the share of its target, null without one (targets: run_id, target)."""
    n = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("state") == "done").alias("confirmed"), F.count_if(F.col("state") == "failed").alias("failed"), F.sum("duration_ms").alias("spend"))
    return n.join(targets, "run_id", "left").withColumn("fraction", F.round(F.try_divide(F.col("confirmed"), "target"), 6))
