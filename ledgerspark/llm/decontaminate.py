"""Benchmark decontamination by winnowing, DataFrame functions only.

A window is SPAN consecutive words of a benchmark item (the whole item if it is shorter). Of the hashes of the K-word grams in a
window the least is its fingerprint, so equal windows have equal fingerprints, and a document's distinct
fingerprints are about 2 / (SPAN - K + 2) of its words. Documents and benchmark meet on fingerprints; each hit is
extended to the document's windows that carry the fingerprint, and these are compared with the item's windows as text, so that
hash collisions count for nothing. Every shared window is found, as both sides choose the same gram of it.

The windows of a row are compared inside the stage that reads it, and its line at place -1 carries the number of words along, so
that every text is split once. Windows of items shorter than SPAN have the hash of the whole window as fingerprint; there are SPAN - 1 such lengths at most.

Benchmark windows are broadcast while their texts and keys take no more than BROADCAST_BYTES; a larger benchmark is joined by shuffling
fingerprints (those of very many documents are spread over tasks), and only documents with a hit are read again for their windows. Both ways give the same rows.

Defined results: null or empty texts have no words, no hits and are clean; items without words or without an item_id
are left out; rows of documents are told apart by doc_id and text, so repeated rows get the same result each; an empty table gives an
empty one; texts of any length are read whole; columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, join_salted, materialize, text_key, words

SPAN, K = 13, 5
#: A window counts with its text and WINDOW_BYTES for its keys.
BROADCAST_BYTES, WINDOW_BYTES = 32 << 20, 64


def grams(w: Column, k: int) -> Column:
    """Hash of the k words from each place on; [] for fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the words of every row."""
    return docs.select("doc_id", text_key("text").alias("text_key"), words(F.col("text")).alias("w"))


def marked(rows: DataFrame, span: int) -> DataFrame:
    """A row for each place `first` where a window of `span` words starts, with its fingerprint, and one at place -1 without.

    rows has w; its other columns stay. The fingerprint of a shorter span is its own hash.
    """
    k = K if span == SPAN else span
    n = span - k + 1
    hashed = rows.withColumn("h", grams(F.col("w"), k))
    placed = hashed.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("h") - n))).alias("first"))
    own = [F.get("h", F.col("first") + j) for j in range(n)]
    return placed.withColumn("mark", F.when(F.col("first") >= 0, F.least(*own) if n > 1 else own[0])).drop("h")


def window_text(span: int) -> Column:
    return F.array_join(F.slice("w", F.greatest(F.col("first") + 1, F.lit(1)), span), " ")


def item_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """item_id, mark, window of the items that have windows of this length."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") >= span) if span == SPAN else items.filter(F.size("w") == span)
    return marked(items, span).filter("first >= 0").select("item_id", "mark", window_text(span).alias("window")).distinct()


def hits(docs: DataFrame, windows: DataFrame, span: int, small: bool) -> DataFrame:
    """doc_id, text_key, n_words, first, last, item_id of every occurrence of a window, and for every row of docs one line at place -1."""
    rows = keyed(docs).withColumn("n_words", F.size("w").cast("long"))
    line = ["doc_id", "text_key", "n_words", "first", (F.col("first") + span - 1).alias("last"), "item_id"]
    if small:  # words stay beside their places in one stage and never move
        known = F.broadcast(windows.withColumnRenamed("mark", "own"))
        met = marked(rows, span).join(known, F.col("mark") == F.col("own"), "left")  # texts are compared after, where marks met
        return met.filter((F.col("first") < 0) | (F.col("item_id").isNotNull() & (window_text(span) == F.col("window")))).select(*line)
    # fingerprints move alone, each where it changes; then the rows that met one are read again
    change = marked(rows, span).filter("first >= 0").select("doc_id", "text_key", "mark").distinct()
    change = materialize(change, "window-marks")
    total = change.count()
    met = join_salted(change, windows.select("mark").distinct(), "mark", by="text_key", total=total)
    met = met.select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key")).distinct()
    again = rows.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_key")), "left_semi")
    shown = marked(again, span).filter("first >= 0").select("doc_id", "text_key", "n_words", "first", "mark", window_text(span).alias("shown"))
    found = join_salted(shown, windows, "mark", by="text_key", total=total, counted=change).filter("shown = window").select(*line)
    return found.unionByName(rows.select("doc_id", "text_key", "n_words", F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(None).cast(windows.schema["item_id"].dataType).alias("item_id")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (first and last word of each hit window) and text_key of every row."""
    sizes = benchmark.filter(F.col("item_id").isNotNull()).select(F.size(words(F.col("text"))).alias("n"), F.octet_length("text").alias("bytes")).filter("n > 0")
    short = [r[0] for r in sizes.filter(F.col("n") < SPAN).distinct().collect()]  # SPAN - 1 numbers at most
    # an item's windows hold each of its bytes SPAN times at most
    total = sizes.agg(F.sum(F.greatest(F.lit(1), F.col("n") - SPAN + 1) * WINDOW_BYTES + F.col("bytes") * SPAN)).first()[0] or 0
    small = total <= BROADCAST_BYTES
    found = hits(docs, item_windows(benchmark, SPAN), SPAN, small)
    for n in sorted(short):
        found = found.unionByName(hits(docs, item_windows(benchmark, n), n, small).filter("first >= 0"))
    hit = F.col("first") >= 0
    per_doc = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct("first", "last")))).alias("spans"), F.collect_set("item_id").alias("items"), F.count_if(~hit).cast("int").alias("rows")
    )
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate(
        "spans",
        start,
        lambda a, x: F.struct(F.greatest(a["end"], x["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"] - 1))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    items = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    out = per_doc.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), items.alias("items"), "spans", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("nth"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "items", "spans", "text_key"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad_id, bad_key, own = fresh_names(docs, "bad_id", "bad_key", "own_key")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    return docs.withColumn(own, text_key("text")).join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_key)), "left_anti").drop(own)


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contract in SQL; {docs} names the table of documents.
SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM {{docs}}),
i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS span, unnest(range(greatest(1, len(w) - {SPAN - 1}))) AS pos, w FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, span, array_to_string(w[pos + 1:pos + span], ' ') AS win FROM n),
s AS (SELECT DISTINCT span FROM iw),
dp AS (SELECT doc_id, span, w, unnest(range(greatest(0, len(w) - span + 1))) AS pos FROM d, s),
dw AS (SELECT doc_id, span, pos, array_to_string(w[pos + 1:pos + span], ' ') AS win FROM dp),
h AS (SELECT doc_id, dw.span, pos, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.span = iw.span),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + span)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
