"""Structured Streaming twins of the watch and ledger rules, on watermarks and Spark's state store.

A stream keeps what it has under a root folder that outlives the query: its checkpoint, and what it has given out. A restart on the same root goes on where the last run ended.
Running values go out as changes, a folder a batch with the keys that the batch touched; `image` reads the newest value of each key. Windows go out once the
watermark has closed them; those still open are read from the state store, so the newest windows are there as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, spread
from ..functions.web import dedupe_key
from ..operators.watch import accept_article
from ..sources.scratch import scratch_path

#: Change folders at the end of a run beyond which they are merged into one.
MOST_CHANGES = 50


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def _whole(spark: SparkSession, root: str, kind: str) -> dict[int, str]:
    """Whole folders below root named kind-number, by number."""
    names = [n for n in _children(spark, root) if n.startswith(f"{kind}-")]
    return {int(n.rpartition("-")[2]): f"{root}/{n}" for n in names if "_SUCCESS" in _children(spark, f"{root}/{n}")}


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def run_changes(stream: DataFrame, root: str, mode: str = "update") -> None:
    """Run a stream over what there is; each batch writes a folder of its own with what it gives out, so a batch that is run again writes the same folder again."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/change-{epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _changes(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows given out, with the number of their batch; those merged by compact stand under the last batch that they hold."""
    base = _whole(spark, root, "base")
    last = max(base, default=-1)
    parts = [(e, p) for e, p in [*((e, p) for e, p in base.items() if e == last), *((e, p) for e, p in _whole(spark, root, "change").items() if e > last)]]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    number = F.regexp_extract(F.input_file_name(), r"/(?:base|change)-(\d+)/[^/]*$", 1).cast("long")
    return spark.read.schema(schema).parquet(*[p for _, p in parts]).withColumn("batch", number)


def image(spark: SparkSession, root: str, keys: list[str], schema) -> DataFrame:
    """The newest row of each key."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = _changes(spark, root, schema).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, "row.*")


def compact(spark: SparkSession, root: str, keys: list[str], schema) -> None:
    """Merge the changes into one folder. Its number tells which changes it stands for, so it makes no difference where this is broken off."""
    last = max([*_whole(spark, root, "change"), *_whole(spark, root, "base")], default=None)
    if last is None:
        return
    old = [p for e, p in [*_whole(spark, root, "base").items(), *_whole(spark, root, "change").items()] if p != f"{root}/base-{last}"]
    if f"{root}/base-{last}" not in _whole(spark, root, "base").values():
        image(spark, root, keys, schema).write.mode("overwrite").parquet(f"{root}/base-{last}")
    for p in old:
        _drop(spark, p)


def running(stream: DataFrame, keys: list[str], root: str, mode: str = "update") -> DataFrame:
    """Run a stream of keyed values and read its image."""
    spark = stream.sparkSession
    run_changes(stream, root, mode)
    if len(_whole(spark, root, "change")) > MOST_CHANGES:
        compact(spark, root, keys, stream.schema)
    return image(spark, root, keys, stream.schema)


def stream_accept(articles: DataFrame, now: str, lookback_days: int, root: str | None = None) -> DataFrame:
    """STR-01: articles through the gate of WAT-03, one for each record and key (record_id, title, url, observed_at, phrase, n_tokens, seq).

    The state holds the keys of the lookback. A date after now counts as now for the watermark, so no article can push the others out, and every article that
    the gate accepts is within the watermark; of articles of one key in one batch any may stay.
    """
    spark = articles.sparkSession
    root = root or scratch_path(spark, "accepted")
    told = once(spread(articles.withColumn("observed_at", F.col("observed_at").cast("timestamp"))))
    fit = once(accept_article(told, now, lookback_days)).filter("result = 'accepted'")
    keyed = fit.select("record_id", dedupe_key(F.col("url")).alias("key"), "url", "observed_at", "seq", F.least("observed_at", F.to_timestamp(F.lit(now))).alias("seen_at"))
    first = keyed.withWatermark("seen_at", f"{lookback_days} days").dropDuplicatesWithinWatermark(["record_id", "key"]).drop("seen_at")
    run_changes(first, root, "append")
    return _changes(spark, root, first.schema).drop("batch")


def stream_ledger_image(claims: DataFrame, root: str | None = None) -> DataFrame:
    """STR-02: running last write per entity and field; the state holds one claim for each."""
    keys = ["entity_id", "field_name"]
    rest = [c for c in claims.columns if c not in keys]
    last = claims.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "seq")).alias("c")).select(*keys, "c.*")
    return running(last, keys, root or scratch_path(claims.sparkSession, "ledger-image"))


def _late_counts(rows: DataFrame, span: Column, late: str, root: str) -> DataFrame:
    """start, end, kind and stale: rows that came more than late behind the newest row of earlier batches. Each batch leaves one row for each window it met."""
    spark = rows.sparkSession
    schema = "start timestamp, end timestamp, kind string, stale long, newest timestamp"

    def seen(before: int | None = None) -> DataFrame:
        parts = [p for e, p in _whole(spark, root, "late").items() if before is None or e < before]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def step(batch: DataFrame, epoch: int) -> None:
        newest = seen(epoch).agg(F.max("newest")).first()[0]
        stale = F.col("at") < F.lit(newest) - F.expr(f"INTERVAL {late}") if newest else F.lit(False)
        n = batch.groupBy(span.alias("w"), "kind").agg(F.count_if(stale).alias("stale"), F.max("at").alias("newest"))
        n.select("w.start", "w.end", "kind", "stale", "newest").write.mode("overwrite").parquet(f"{root}/late-{epoch}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/late-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return seen().groupBy("start", "end", "kind").agg(F.sum("stale").alias("stale"))


def _windows(counts: DataFrame, root: str, name: str) -> DataFrame:
    """start, end, kind and signals of the windows that are closed and of those that the state store still holds."""
    spark = counts.sparkSession
    run_changes(counts, root, "append")
    closed = _changes(spark, root, counts.schema).select("w.start", "w.end", "kind", "signals")
    if not _children(spark, f"{root}/checkpoint/commits"):
        return closed
    state = spark.read.format("statestore").load(f"{root}/checkpoint")
    inner = F.col(f"value.{name}") if name in state.schema["value"].dataType.names else F.col(f"key.{name}")
    open_ = state.filter("value IS NOT NULL").select(inner["start"].alias("start"), inner["end"].alias("end"), F.col("key.kind").alias("kind"), F.col("value.count").alias("signals"))
    return closed.unionByName(open_)


def stream_signal_counts(signals: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days", root: str | None = None) -> DataFrame:
    """STR-03: signals per kind and window (tumbling, or sliding with slide) under a watermark: start, end, kind, signals, stale.

    stale counts the rows that came more than late behind the newest row of earlier batches; those whose window had closed are in no signals. Rows without a time count nowhere.
    """
    root = root or scratch_path(signals.sparkSession, "signal-counts")
    rows = signals.withColumn("at", F.col("at").cast("timestamp")).filter("at IS NOT NULL")
    span = F.window("at", window, slide) if slide else F.window("at", window)
    counts = _windows(rows.withWatermark("at", late).groupBy(span.alias("w"), "kind").agg(F.count(F.lit(1)).alias("signals")), root, "window")
    stale = _late_counts(rows, span, late, root)
    own = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("start", "end", "kind")]
    both = counts.alias("a").join(stale.alias("b"), own[0] & own[1] & own[2], "full")
    zero = F.lit(0).cast("long")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in ("start", "end", "kind")], F.coalesce("signals", zero).alias("signals"), F.coalesce("stale", zero).alias("stale"))


def stream_sessions(signals: DataFrame, gap_minutes: int = 30, late: str = "2 days", root: str | None = None) -> DataFrame:
    """STR-03: sessions of signals per kind under a watermark: start, end, kind, signals. Rows within late lengthen or join the sessions that they fall into; later ones whose session had closed are left out."""
    root = root or scratch_path(signals.sparkSession, "signal-sessions")
    rows = signals.withColumn("at", F.col("at").cast("timestamp")).filter("at IS NOT NULL").withWatermark("at", late)
    return _windows(rows.groupBy(F.session_window("at", f"{gap_minutes} minutes").alias("w"), "kind").agg(F.count(F.lit(1)).alias("signals")), root, "session_window")


def stream_progress(calls: DataFrame, root: str | None = None) -> DataFrame:
    """STR-04: running counters per run; the state holds one row for each."""
    n = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok"), F.sum("duration_ms").alias("spent_ms"))
    return running(n, ["run_id"], root or scratch_path(calls.sparkSession, "run-progress"))
