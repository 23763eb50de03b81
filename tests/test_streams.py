"""Streams: watermarks and state, restarts, late rows, and what a batch writes."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerspark.operators.watch import accept_article
from ledgerspark.streaming import stream


def folder_of(spark, path, batches, columns):
    for rows in batches:
        spark.createDataFrame(rows, columns).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)


SIGNALS = "kind string, at timestamp"


def read(spark, folder, schema=SIGNALS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_signal_counts_keep_the_newest_windows_and_count_stale(spark, tmp_path):
    folder, root = str(tmp_path / "signals"), f"file://{tmp_path}/state"
    columns = "kind string, at string"
    folder_of(spark, folder, [[("news", "2024-01-09 10:00"), ("news", "2024-01-10 12:00"), (None, "2024-01-10 12:00"), ("news", None)], [("news", "2024-01-10 13:00"), ("news", "2024-01-09 11:00")]], columns)
    found = lambda: {(str(r.start)[:10], r.kind): (r.signals, r.stale) for r in stream.stream_signal_counts(read(spark, folder), root=root).collect()}
    assert found() == {("2024-01-09", "news"): (2, 0), ("2024-01-10", "news"): (2, 0), ("2024-01-10", None): (1, 0)}
    # a restart: one row is behind the watermark and its window has gone, one is late but within it
    folder_of(spark, folder, [[("news", "2024-01-20 09:00")], [("news", "2024-01-21 09:00")], [("news", "2024-01-02 09:00"), ("news", "2024-01-19 11:00")]], columns)
    got = found()
    assert got.pop(("2024-01-02", "news")) == (0, 1)
    assert got == {("2024-01-09", "news"): (2, 0), ("2024-01-10", "news"): (2, 0), ("2024-01-10", None): (1, 0), ("2024-01-19", "news"): (1, 0), ("2024-01-20", "news"): (1, 0), ("2024-01-21", "news"): (1, 0)}
    assert found()[("2024-01-02", "news")] == (0, 1)  # nothing new: nothing changes
    held = spark.read.format("statestore").load(f"{root}/checkpoint")
    assert held.select("key.window.start").agg(F.min("start")).first()[0] >= datetime(2024, 1, 18)  # closed windows have left the state


def sessions(rows, gap=30):
    out, by = Counter(), defaultdict(list)
    for kind, at in rows:
        by[kind].append(at)
    for kind, times in by.items():
        start = end = None
        n = 0
        for t in sorted(times):
            if end is None or t > end:
                if n:
                    out[kind, start, end] = n
                start, n = t, 0
            end, n = t + timedelta(minutes=gap), n + 1
        out[kind, start, end] = n
    return out


def test_sessions_join_over_restarts(spark, tmp_path):
    folder, root = str(tmp_path / "signals"), f"file://{tmp_path}/state"
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), datetime(2024, 1, 9) + timedelta(minutes=rnd.randint(0, 2800))) for _ in range(120)]  # within the watermark, in any order
    for k in range(0, 120, 40):
        folder_of(spark, folder, [rows[k : k + 20], rows[k + 20 : k + 40]], "kind string, at timestamp")
        got = {(r.kind, r.start, r.end): r.signals for r in stream.stream_sessions(read(spark, folder), 30, root=root).collect()}
        assert got == sessions(rows[: k + 40])


def test_sliding_windows_count_each_row_in_each(spark, tmp_path):
    folder = str(tmp_path / "signals")
    folder_of(spark, folder, [[("a", "2024-01-09 10:00"), ("a", "2024-01-10 10:00")]], "kind string, at string")
    got = {str(r.start)[:10]: r.signals for r in stream.stream_signal_counts(read(spark, folder), "2 days", "1 day").collect()}
    assert got == {"2024-01-08": 1, "2024-01-09": 2, "2024-01-10": 1}


ARTICLES = "seq long, record_id long, title string, url string, at timestamp, phrase string, n_tokens int"


def test_articles_pass_the_gate_once(spark, tmp_path):
    folder, root = str(tmp_path / "articles"), f"file://{tmp_path}/state"
    columns = ARTICLES.replace("at timestamp", "at string")
    good = ("Turtle Creek Wealth grows", "turtle creek wealth", 3)
    row = lambda seq, url, at="2024-01-20 00:00", what=good: (seq, 1, what[0], url, at, what[1], what[2])
    batches = [
        [row(1, "https://a.com/x"), row(2, "https://www.a.com/x/"), row(3, "https://sub.reddit.com/x")],
        [row(4, "https://a.com/x"), row(5, "https://b.com/y", "2023-01-01 00:00"), row(6, "https://b.com/z", None), row(7, "https://b.com/q", "2099-01-01 00:00"), row(8, "https://b.com/r", what=("Nothing", "absent", 3))],
        [row(9, "https://c.com/old", "2023-11-05 00:00"), row(10, "https://a.com/x", "2024-01-30 00:00")],
    ]
    keys = set()
    for b in batches:  # a restart after each
        folder_of(spark, folder, [b], columns)
        out = stream.stream_accept(read(spark, folder, ARTICLES).withColumnRenamed("at", "observed_at"), "2024-01-31 00:00:00", 90, root).collect()
        keys = {(r.record_id, r.key) for r in out}
        assert len(keys) == len(out)
    every = spark.read.schema(ARTICLES).parquet(folder).withColumnRenamed("at", "observed_at")
    fit = accept_article(every, "2024-01-31 00:00:00", 90).filter("result = 'accepted'")
    assert keys == {tuple(r) for r in fit.select("record_id", stream.dedupe_key(F.col("url"))).collect()} and len(keys) == 3  # as the batch rule: a date in the future pushes nobody out


def claim(k, e, t):
    return (e, f"f{k % 3}", f"c{k}", t, k)


def test_a_batch_writes_the_keys_it_touched(spark, tmp_path, monkeypatch):
    folder, root = str(tmp_path / "claims"), f"file://{tmp_path}/state"
    schema = "entity_id long, field_name string, claim_id string, created_at timestamp, seq long"
    t0 = datetime(2024, 1, 1)
    first = [claim(k, k % 300, t0 + timedelta(minutes=k % 50)) for k in range(3000)]
    second = [claim(k, k % 4, t0 + timedelta(minutes=60 - k % 50)) for k in range(3000, 3010)] + [(7, None, "n", None, 1)]
    image = {}
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = stream.stream_ledger_image(read(spark, folder, schema), root)
        for e, f, c, t, s in rows:
            if (e, f) not in image or ((t is not None, t), s) > ((image[e, f][1] is not None, image[e, f][1]), image[e, f][2]):
                image[e, f] = (c, t, s)
        assert {(r.entity_id, r.field_name): r.claim_id for r in out.collect()} == {k: v[0] for k, v in image.items()}
    written = {e: spark.read.parquet(p).count() for e, p in stream._whole(spark, root, "change").items()}
    assert sorted(written.values())[0] <= 11 and len(written) == 2
    stream.compact(spark, root, ["entity_id", "field_name"], out.schema)
    stream.compact(spark, root, ["entity_id", "field_name"], out.schema)
    assert not stream._whole(spark, root, "change") and len(stream._whole(spark, root, "base")) == 1
    spark.createDataFrame([claim(9000, 1, t0 + timedelta(days=9))], schema).coalesce(1).write.mode("append").parquet(folder)
    monkeypatch.setattr(stream, "MOST_CHANGES", 0)  # merge at the end of the run
    again = stream.stream_ledger_image(read(spark, folder, schema), root)
    image[1, "f0"] = ("c9000", None, None)
    assert {(r.entity_id, r.field_name): r.claim_id for r in again.collect()} == {k: v[0] for k, v in image.items()} and not stream._whole(spark, root, "change")


def test_progress_over_restarts_and_without_rows(spark, tmp_path):
    folder, root = str(tmp_path / "calls"), f"file://{tmp_path}/state"
    schema = "run_id string, ok boolean, duration_ms long"
    spark.createDataFrame([], schema).write.parquet(folder)
    assert stream.stream_progress(read(spark, folder, schema), root).count() == 0
    assert stream.stream_sessions(spark.readStream.schema(SIGNALS).parquet(folder), root=f"{root}-s").count() == 0
    for rows in ([("a", True, 5), ("a", None, None)], [("a", False, 2), (None, True, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = {r.run_id: (r.calls, r.ok, r.spent_ms) for r in stream.stream_progress(read(spark, folder, schema), root).collect()}
    assert got == {"a": (3, 1, 7), None: (1, 1, 1)}
