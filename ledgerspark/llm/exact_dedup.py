"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 32 bytes has its low bits clear. A chunk is known by a 128-bit digest; the
distinct (digest, bytes) pairs of the corpus are grouped once, so that two different chunks of one digest get
different identifiers. Texts are then compared as ordered lists of identifiers: the long bytes move once, for the
check, and all later grouping and joining moves the short lists.

Defined results: a null text is the empty text; texts are equal when their UTF-8 bytes are. Of equal texts the row with
the largest doc_id stays (a null doc_id counts as smallest); of several rows with that same doc_id and text one stays. Rows that share a
doc_id but not their text are told apart by the text. An empty table gives an empty one; texts of any length are read whole;
columns of any name stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, join_groups, materialize

CUT_BITS, LEAST, MOST = 11, 256, 1 << 16
GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)
BATCH_BYTES = 4 << 20


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data. A cut depends on the 32 bytes before it and on the place of the cut before."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after each round h covers twice as many bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    places = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    cuts, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(places, at + LEAST)
        cut = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        cuts.append(cut)
        at = cut
    if at < n:
        cuts.append(n)
    return cuts


def blake(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def chunks(data: bytes, digest: Callable[[bytes], bytes] = blake) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    for cut in cut_points(data):
        piece = data[at:cut]
        out.append((digest(piece), piece))
        at = cut
    return out


def _recipes(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([[d for d, _ in chunks(t, digest)] for t in texts], pa.list_(pa.binary())),
            ],
            ["doc_id", "text_sha256", "digests"],
        )


def _chunk_rows(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """(digest, piece) of every chunk; repeats inside one batch go out once."""
    for batch in batches:
        seen: dict[bytes, bytes] = {}
        rest: list[tuple[bytes, bytes]] = []
        size = 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "piece"])

        for text in batch.column(0).to_pylist():
            for name, piece in chunks((text or "").encode(), digest):
                if seen.get(name) == piece:
                    continue
                seen[name] = piece
                rest.append((name, piece))
                size += len(piece)
            if size > BATCH_BYTES:
                yield out(rest)
                rest, size = [], 0
                seen.clear()
        yield out(rest)


def _places(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """Every chunk of every text with its place and bytes."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            sha = hashlib.sha256(data).hexdigest()
            rows += [(doc_id, sha, nth, name, piece) for nth, (name, piece) in enumerate(chunks(data, digest))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "text_sha256", "nth", "digest", "piece"])


def colliding(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Distinct (digest, piece, variant) of digests that stand for more than one piece; empty in all likelihood."""
    known = docs.select("text").mapInArrow(functools.partial(_chunk_rows, digest=digest), "digest binary, piece binary").distinct()
    twice = known.groupBy("digest").count().filter("count > 1").select("digest")
    found = known.join(twice, "digest", "left_semi")
    return found.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("piece")))


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = blake) -> DataFrame:
    """doc_id, text_sha256 and the ordered list of verified chunk identifiers of every row."""
    base = docs.select("doc_id", "text").mapInArrow(functools.partial(_recipes, digest=digest), "doc_id long, text_sha256 string, digests array<binary>")
    clash = materialize(colliding(docs, digest), "chunk-clash")
    if clash.isEmpty():  # every digest stands for one piece: digests are identifiers
        return base.withColumnRenamed("digests", "recipe")
    places = docs.select("doc_id", "text").mapInArrow(functools.partial(_places, digest=digest), "doc_id long, text_sha256 string, nth long, digest binary, piece binary")
    # a doc_id may stand on several texts: its variants are told apart by the text's hash
    named = places.join(clash, ["digest", "piece"]).groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("nth", "variant"))).alias("variants"))
    own = named.select(F.col("doc_id").alias("named_id"), F.col("text_sha256").alias("named_sha"), "variants")
    marked = base.join(own, F.col("doc_id").eqNullSafe(F.col("named_id")) & (F.col("text_sha256") == F.col("named_sha")), "left")
    suffix = F.to_json("variants").cast("binary")
    return marked.select("doc_id", "text_sha256", F.when(F.col("variants").isNull(), F.col("digests")).otherwise(F.concat("digests", F.array(suffix))).alias("recipe"))


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = blake) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. digest names a chunk (chunks that share a name are told apart)."""
    rows = materialize(recipes(docs, digest).withColumn("nth", F.monotonically_increasing_id()), "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "nth")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    joined = join_groups(rows, materialize(groups, "recipe-groups"), "recipe", "group_size", rows.count())
    return joined.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("nth") == F.col("stays.nth")).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept_id, kept_sha, own, nth = fresh_names(docs, "kept_id", "kept_sha", "own_sha", "nth_equal")
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    found = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256)).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)))
    once = Window.partitionBy(kept_id, kept_sha).orderBy(F.lit(1))
    return found.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
