"""Signals watch: article gate, dedupe, board and queues; and the validator's audit of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, spread, strip
from ..functions.web import dedupe_key, host, is_blocked_domain, is_role_address
from .contacts import attribute_email, fold

# Signal kind of each field.
KINDS = {"recent_investments": "capital_deployment", "recent_fund_commitments": "capital_deployment", "recent_key_hires": "personnel", "important_insight": "mandate_shift", "recent_news": "firm_news"}
UNRELIABLE = ["could_not_verify", "removed_failed_validation", "contradicted"]
LEAST_VALUE = 12
# Words that make a name before them a firm.
MARKERS = ["llc", "inc", "lp", "ltd", "corp", "corporation", "co", "company", "pllc", "pc", "plc", "advisors", "advisers", "capital", "management", "partners", "group", "wealth", "holdings", "office", "family", "trust"]


def _signal_rows(prov: DataFrame) -> DataFrame:
    """Rows of the signal fields that no check has refused."""
    return prov.filter(F.col("field_name").isin(list(KINDS)) & ~F.coalesce(F.col("status").isin(UNRELIABLE), F.lit(False)))


def _prose(value: Column) -> Column:
    """LEAST_VALUE signs at least, and more than a token of capitals and underscores."""
    return F.coalesce((F.length(strip(value)) >= LEAST_VALUE) & ~strip(value).rlike("^[A-Z_]+$"), F.lit(False))


def baseline_signals(prov: DataFrame) -> DataFrame:
    """WAT-01: facts of the signal fields as signals; an insight is its own meaning, other fields have none."""
    kind = F.coalesce(*[F.when(F.col("field_name") == k, F.lit(v)) for k, v in KINDS.items()])
    value = strip(F.col("answer"))
    return _signal_rows(prov).filter(_prose(F.col("answer"))).select(
        F.col("entity_id").alias("record_id"), kind.alias("kind"), value.alias("title"), F.when(F.col("field_name") == "important_insight", value).alias("meaning"), F.to_date("retrieved_at").alias("day"),
        "source_url", host(F.col("source_url")).alias("source_domain"), F.col("source_class").alias("source_name"), "confidence", "field_name", "seq",
    )


def watch_board(base: DataFrame, research: DataFrame, records: DataFrame) -> DataFrame:
    """WAT-02: signals per organisation, the newest first, undated ones last by name (records: record_id, name)."""
    cols = ["record_id", "kind", "title", "day"]
    n = base.select(*cols).unionByName(research.select(*cols)).groupBy("record_id").agg(F.count(F.lit(1)).alias("signals"), F.count("day").alias("dated"), F.max("day").alias("newest"))
    return records.join(n, "record_id").select("record_id", "name", "signals", "dated", F.col("newest").cast("string").alias("newest")).orderBy(F.desc_nulls_last("newest"), "name")


def name_matched(title: Column, url: Column, phrase: Column, n_tokens: Column) -> Column:
    """The phrase as it stands in title or path, followed by a corporate word or at least three words long."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    hay, p = fold(F.concat_ws(" ", title, path)), fold(phrase)
    at = F.instr(hay, p)
    following = F.split_part(F.ltrim(F.substring(hay, at + F.length(p), F.lit(200))), F.lit(" "), F.lit(1))
    return (p != "") & (at > 0) & (following.isin(MARKERS) | (n_tokens >= 3))


def accept_article(articles: DataFrame, now: str, lookback_days: int) -> DataFrame:
    """WAT-03: the first rule that refuses an article, or accepted (record_id, title, url, observed_at, phrase, n_tokens). A future date is not refused."""
    age = F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds(F.col("observed_at").cast("timestamp"))
    reason = F.when(F.col("observed_at").isNull(), "undated").when(age > lookback_days * 86_400, "stale").when(is_blocked_domain(host(F.col("url"))), "blocked_domain").when(~F.coalesce(name_matched(F.col("title"), F.col("url"), F.col("phrase"), F.col("n_tokens")), F.lit(False)), "name_not_matched")
    return articles.withColumn("result", F.coalesce(reason, F.lit("accepted")))


ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
AGO = r"(?i)^(\d+)\s+(hour|day|week|month|year)s?\s+ago$"
MONTH_DAY = r"^([A-Za-z]{3})\s+(\d{1,2}),?\s+(\d{4})$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_article_date(raw: Column, now: Column) -> Column:
    """WAT-04: compact UTC, ISO with or without fractions and offset (without one: UTC), 'N units ago' and 'Jun 10, 2026', with or without the comma; else null.

    Months and years back keep the time of day; a day that the month does not have runs over into the next.
    """
    text = strip(raw)
    compact = F.try_to_timestamp(F.concat(F.upper(text), F.lit(" +0000")), F.lit("yyyyMMdd'T'HHmmss'Z' Z"))
    day_only, zoned = F.length(text) == 10, F.regexp_extract(text, ISO_DATE, 1) != ""
    clock = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    iso = F.when(text.rlike(ISO_DATE), F.when(day_only, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, clock).otherwise(F.concat(clock, F.lit("Z"))).try_cast("timestamp"))
    n, unit = F.regexp_extract(text, AGO, 1).try_cast("int"), F.lower(F.regexp_extract(text, AGO, 2))
    seconds = F.when(unit == "hour", 3600).when(unit == "day", 86_400).when(unit == "week", 604_800)
    back = F.timestamp_seconds(F.unix_seconds(now) - n.cast("long") * seconds)
    months = F.when(unit == "month", n).when(unit == "year", 12 * n)
    first = F.unix_date(F.add_months(F.trunc(now.cast("date"), "month"), -months)).cast("long")
    back_months = F.timestamp_seconds((first + F.dayofmonth(now) - 1) * 86_400 + F.pmod(F.unix_seconds(now), F.lit(86_400)))
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, MONTH_DAY, 1))).cast("int")
    opens = F.when(place > 0, F.make_date(F.regexp_extract(text, MONTH_DAY, 3).try_cast("int"), place, F.lit(1)))
    named = F.timestamp_seconds((F.unix_date(opens).cast("long") + F.regexp_extract(text, MONTH_DAY, 2).try_cast("int") - 1) * 86_400)
    return F.coalesce(compact, iso, back, back_months, named)


def new_articles(accepted: DataFrame, signals: DataFrame, prov: DataFrame) -> DataFrame:
    """WAT-06: neither known by key nor by exact URL."""
    keyed = accepted.withColumn("key", dedupe_key(F.col("url")))
    fresh = keyed.join(signals.select("record_id", "key"), ["record_id", "key"], "left_anti")
    return fresh.join(prov.select("record_id", F.col("source_url").alias("url")), ["record_id", "url"], "left_anti")


def insert_signals(base: DataFrame, delta: DataFrame) -> DataFrame:
    """WAT-07: the first writer of a record and key stays."""
    own = Window.partitionBy("record_id", "key").orderBy("seq")
    first = delta.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")
    return base.unionByName(first.join(base.select("record_id", "key"), ["record_id", "key"], "left_anti").select(*base.columns))


def interpret_inputs(items: DataFrame, n: int = 6) -> DataFrame:
    """WAT-08: the newest n per organisation, numbered from 0: what one prompt holds."""
    own = Window.partitionBy("record_id").orderBy(F.desc("observed_at"), "url")
    return items.withColumn("idx", F.row_number().over(own) - 1).filter(F.col("idx") < n)


def overlay(defaults: DataFrame, replies: DataFrame) -> DataFrame:
    """WAT-08: kind and meaning of a reply over the defaults; the meaning is cut at 200."""
    r = replies.select("record_id", "idx", F.col("kind").alias("r_kind"), F.substring("meaning", 1, 200).alias("r_meaning"))
    return defaults.join(r, ["record_id", "idx"], "left").withColumn("kind", F.coalesce("r_kind", F.lit("firm_news"))).withColumn("meaning", F.col("r_meaning")).drop("r_kind", "r_meaning")


def org_state(state: DataFrame, run: DataFrame) -> DataFrame:
    """WAT-09: last researched and found, and the total (record_id, last_researched, last_found, total; record_id, at, found)."""
    r = run.groupBy("record_id").agg(F.max("at").alias("at"), F.max(F.when(F.col("found") > 0, F.col("at"))).alias("found_at"), F.sum("found").alias("n"))
    j = state.join(r, "record_id", "full")
    return j.select("record_id", F.coalesce("at", "last_researched").alias("last_researched"), F.coalesce("found_at", "last_found").alias("last_found"), (F.coalesce("total", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("total"))


def research_queue(records: DataFrame, state: DataFrame, prov: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """WAT-10: organisations with a baseline signal or a stored one: never or longest ago researched, then the oldest newest signal (none first), then name.

    records: record_id, name; state: record_id, last_researched; stored: record_id, day. A refused value still dates its organisation.
    """
    pool = baseline_signals(prov).select("record_id").unionByName(stored.select("record_id")).distinct()
    dated = _signal_rows(prov).select(F.col("entity_id").alias("record_id"), F.to_date("retrieved_at").alias("day")).unionByName(stored.select("record_id", "day"))
    newest = dated.filter("day IS NOT NULL").groupBy("record_id").agg(F.max("day").alias("newest"))
    j = records.join(pool, "record_id", "left_semi").join(state.select("record_id", "last_researched"), "record_id", "left").join(newest, "record_id", "left")
    return j.orderBy(F.asc_nulls_first("last_researched"), F.asc_nulls_first("newest"), "name", "record_id").limit(limit).select("record_id", "name")


def run_counts(calls: DataFrame, concurrency: int) -> DataFrame:
    """WAT-11: counts by state, the upper median of the durations of what is done, failed or skipped, once there are three of them, and the time left for the rest."""
    over = F.col("state").isin("done", "failed", "skipped")
    n = calls.groupBy("run_id").agg(
        F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "skipped").alias("skipped"), F.count_if(~F.coalesce(over, F.lit(False))).alias("left"),
        F.count_if(over & F.col("duration_ms").isNotNull()).alias("timed"),
    )
    own = Window.partitionBy("run_id").orderBy("duration_ms", "seq")
    ranked = calls.filter(over & F.col("duration_ms").isNotNull()).select("run_id", "duration_ms", F.row_number().over(own).alias("place"))
    middle = ranked.join(n.select("run_id", "timed", (F.col("done") + F.col("failed") + F.col("skipped")).alias("completed")), "run_id").filter((F.col("completed") >= 3) & (F.col("place") == F.floor(F.col("timed") / 2) + 1))
    j = n.drop("timed").join(middle.select("run_id", F.col("duration_ms").alias("median_ms")), "run_id", "left")
    return j.withColumn("eta_ms", F.floor(F.col("median_ms") * F.col("left") / concurrency + 0.5).cast("long"))


MOST_ATTEMPTS = 3


def validator_worklist(records: DataFrame, checkpoints: DataFrame, mode: str, limit: int | None = None) -> DataFrame:
    """AUD-01: what a mode has to look at, those that a result can be used of first, then by id; without records that are done or tried three times in this mode. The limit comes after the skip.

    type: records of unconfirmed type, those with an address first. email: records without an address of the principal, those with a name first (checkpoints: record_id, mode, status, attempts).
    """
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    if mode not in ("type", "email"):
        raise ValueError(f"mode must be type or email, not {mode!r}")
    fit, last = (F.coalesce(F.col("entity_type") == "type_unconfirmed", F.lit(False)), blank("principal_email")) if mode == "type" else (blank("principal_email"), blank("principal_name"))
    skip = checkpoints.filter((F.col("mode") == mode) & (F.coalesce(F.col("status") == "done", F.lit(False)) | F.coalesce(F.col("attempts") >= MOST_ATTEMPTS, F.lit(False)))).select("record_id").distinct()
    todo = records.filter(fit).join(skip, "record_id", "left_anti").orderBy(last, "record_id")
    return todo if limit is None else todo.limit(limit)


def email_result(rows: DataFrame) -> DataFrame:
    """AUD-02: first tier with an address (site, vendor, pattern); nobody named means the firm's column; off-domain is dropped; an outage leaves no checkpoint."""
    on = lambda c: F.when(F.lower(F.col(c)).endswith(F.concat(F.lit("@"), F.col("domain"))), F.col(c))
    email = F.coalesce(on("site"), on("vendor"), on("pattern"))
    field = F.when(email.isNull(), F.lit(None)).when((strip(F.coalesce("principal_name", F.lit(""))) == "") | is_role_address(email, wide=True), "firm_email").otherwise("principal_email")
    status = F.when(F.col("outage"), F.lit(None)).when(field == "principal_email", "done").when(field == "firm_email", "partial").otherwise("failed")
    return rows.select("record_id", email.alias("email"), field.alias("field"), status.alias("checkpoint"))


def audit_emails(records: DataFrame) -> DataFrame:
    """AUD-03: addresses that stand with a principal but are a role's or nobody's: what becomes of both columns."""
    given = once(spread(records.select("record_id", "principal_name", "principal_email"))).filter("principal_email IS NOT NULL")
    bad = once(attribute_email(given)).filter("attribution <> 'principal'")
    return bad.select("record_id", F.col("principal_email").alias("firm_email"), F.lit(None).cast("string").alias("principal_email"), F.concat(F.lit("email_attribution_"), "attribution").alias("audit"))


def demote(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AUD-03: the claims that set misattributed addresses right (principal_email empties, firm_email takes the address), and the audit rows."""
    bad = audit_emails(records)
    claim = F.array(
        F.struct(F.lit("principal_email").alias("field_name"), F.lit(None).cast("string").alias("answer"), F.lit("removed_failed_validation").alias("status")),
        F.struct(F.lit("firm_email").alias("field_name"), F.col("firm_email").alias("answer"), F.lit("single_source").alias("status")),
    )
    return bad.select("record_id", F.inline(claim)), bad.select("record_id", F.lit("principal_email").alias("field"), F.col("firm_email").alias("before"), F.lit(None).cast("string").alias("after"), "audit")


def invariants(records: DataFrame) -> DataFrame:
    """AUD-04: principals with a role address, and addresses without a principal; both must be 0 after the audit."""
    given = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) != ""
    mail = given("principal_email")
    return records.agg(F.count_if(mail & is_role_address(F.col("principal_email"))).alias("role_principals"), F.count_if(mail & ~given("principal_name")).alias("nameless_principals"))
