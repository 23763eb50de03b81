"""Near-duplicate groups by SetSketch registers.

A document is the set of its SHINGLE-word shingles. Each of REGISTERS registers holds the least of independent exponential hashes over
the set, on a scale of powers of BASE and truncated to 16 bits; registers of a union are the greater of two, and two sets
agree in a register about as often as their similarity. Bands of ROWS registers put documents into buckets: at a
similarity of 0.75 two documents miss each other in all 32 bands once in 200,000 pairs.

Documents with equal sets are one class, and only classes go on. In every bucket each class is paired with the bucket's most central
class (the one whose buckets are the fullest), so a group of n near copies gives about n pairs and not n * n. A pair is
judged three times: by its sizes, by the similarity that makes its registers most likely, and on the full sets.
Confirmed links are joined into components.

What the stars leave open. A star is a center with all classes that share a bucket of its; classes of one bucket always meet in a star.
In a star that holds several components, the classes outside its largest one are seekers: a link to a class of another
component may still be missing. Each seeker is held against all classes of the star in other components, the heaviest seekers first (what they
join need not be held again), then all that are left. They are held by bitmaps: a bit for each
hashed shingle, in which two sets differ in at most as many bits as in shingles, so a pair whose bitmaps differ too much is no link and never becomes a row.
Tiles of SIDE by SIDE classes of a star are dealt to tasks, so no star is too large for one. Pairs that remain are judged as
above. So no two linked classes that share a bucket are left in different components.

Defined results: null and empty texts and texts without words have no shingles and stand alone; fewer than SHINGLE words are one shingle;
rows with words that share a doc_id are one document and therefore in one component, whatever their texts; rows with a null doc_id are linked with
nothing, their component_id is null and they are kept; equal rows get equal results; an empty table gives an empty one; texts of any length
are read whole. Sets and classes are compared by 64-bit hashes of shingles and 128-bit digests of sets.
near_groups does not look at other columns, whatever their names, and keep_one keeps them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh_names, join_groups, join_salted, materialize, text_key

SHINGLE, PERCENT = 5, 75
REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Pairs whose most likely similarity is below this are not looked at in full; 0.75 is six standard errors above it.
LIKELY = 0.5
#: Classes along each side of a tile, seekers' bitmap bytes of a tile, and seekers of a star in each round.
SIDE, TILE_BYTES, TURNS = 512, 8 << 20, (8, None)
#: Bits of a bitmap: at least eight for a shingle, a power of two within these.
FEWEST_BITS, MOST_BITS = 512, 1 << 20
CACHE = 500_000
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

_rng = np.random.default_rng(20240602)
FACTORS = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
MASKS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = (text or "").encode().translate(TO_LOWER).split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, n)
    k = min(SHINGLE, n)
    m = n - k + 1
    s = np.full(m, k, np.uint64)
    for i in range(k):
        s += h[i : i + m] * PLACES[i]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set, as 16-bit numbers."""
    x = s.astype(np.uint32)[None, :]
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 1024):
        np.minimum(least, ((x[:, at : at + 1024] ^ MASKS) * FACTORS).min(axis=1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sets, from the registers that are greater, smaller and equal and from the known sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    greater, smaller = p(u - v * j), p(v - u * j)
    equal = np.clip(1 - greater - smaller, 1e-9, 1)
    score = more * np.log(greater) + less * np.log(smaller) + (a.shape[1] - more - less) * np.log(equal)
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], 1)[:, 0]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sizes, digests, sketch = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, known)
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "registers"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
        n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        fine = likely_similarity(a, b, n_a, n_b) >= LIKELY
        yield batch.select(["a", "b"]).filter(pa.array(fine))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough. Rows come sorted by b, whose set is kept while it stays."""
    known = WordHashes()
    last, of_last = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            text = right[i].as_py()
            if last is None or text != last:
                last, of_last = text, shingles(text, known)
            own = shingles(left[i].as_py(), known)
            both = len(np.intersect1d(own, of_last, assume_unique=True))
            keep.append(both > 0 and 100 * both >= PERCENT * (len(own) + len(of_last) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit for each shingle, at the place that the low bits of its hash name."""
    m = min(max(FEWEST_BITS, 1 << int(8 * len(s) - 1).bit_length()), MOST_BITS)
    flags = np.zeros(m, bool)
    flags[(s & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as if made with fewer bits: width bytes, a power of two."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = [shingles(text, known) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], ["id", "n", "bits"])


class Tile:
    """The seekers of a tile by the width of their bitmaps."""

    def __init__(self, key: tuple):
        self.key, self.rows, self.packed = key, {}, {}

    def add(self, seeker: bytes, component: bytes, n: int, bits: bytes) -> None:
        self.rows.setdefault(len(bits), []).append((seeker, component, n, bits))

    def of(self, width: int, target: int) -> tuple:
        if (width, target) not in self.packed:
            ids, components, n, bits = zip(*self.rows[width], strict=True)
            matrix = folded(np.frombuffer(b"".join(bits), np.uint8).reshape(len(ids), width), target).view(np.uint64)
            self.packed[width, target] = ids, np.array(components, object), np.array(n), matrix
        return self.packed[width, target]

    def close(self, component: bytes, n: int, bits: bytes) -> Iterator[bytes]:
        """Seekers of other components whose bitmaps do not rule out a link to a class."""
        own = np.frombuffer(bits, np.uint8)[None, :]
        for width in self.rows:
            target = min(width, len(bits))
            ids, components, sizes, matrix = self.of(width, target)
            fine = np.flatnonzero((np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * PERCENT) & (components != component))
            if not len(fine):
                continue
            apart = np.bitwise_count(matrix[fine] ^ folded(own, target).view(np.uint64)).sum(axis=1, dtype=np.int64)
            # a link shares at least p / (100 + p) of both sizes together, so it differs in at most (100 - p) / (100 + p)
            for i in fine[apart * (100 + PERCENT) <= (sizes[fine] + n) * (100 - PERCENT)]:
                yield ids[i]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile that may be links. Rows come sorted by tile, seekers first."""
    tile = Tile(())
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        columns = [batch.column(c).to_pylist() for c in ("star", "i", "j", "member", "id", "component", "n", "bits")]
        for star, i, j, member, own, component, n, bits in zip(*columns, strict=True):
            if tile.key != (star, i, j):
                tile = Tile((star, i, j))
            if member:
                found += [(own, other) for other in tile.close(component, n, bits)]
            else:
                tile.add(own, component, n, bits)
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], ["a", "b"])


def judged(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """The distinct pairs (a, b) that are links: by sizes, by registers, and on the full sets; and a bound of their number. Many pairs may share an a or a b."""
    total = pairs.count()
    left = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    ends = join_salted(pairs, left, "a", by="b", total=total)
    sized = join_salted(ends, right, "b", by="a", total=total, counted=pairs).filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    likely = materialize(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely, "a binary, b binary"), "near-likely")  # reads the registers of all classes, however few the pairs
    member, center = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = join_salted(join_salted(likely, member, "a", by="b", total=total, hint="merge"), center, "b", by="a", total=total, counted=likely, hint="merge")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a binary, b binary"), "near-links"), total


def components(links: DataFrame, most: int) -> DataFrame:
    """id and component (the smallest id reachable) of all ends of links, of which there are `most` at most: each takes the least label around it, then its label's label, until nothing moves."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges", 2 * most)
    total = both.count()
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")), "near-labels", total)
    while True:
        around = join_salted(both, labels.select(F.col("id").alias("b"), "component"), "b", by="a", total=total).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = materialize(labels.join(around, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before")), "near-lower", total)
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        moved = materialize(join_salted(lower, jump, "component", by="id", total=total).select("id", F.col("root").alias("component"), "before"), "near-labels", total)
        labels = moved.select("id", "component")
        if moved.filter("component <> before").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame, most: int, total: int) -> DataFrame:
    """Labels of all classes (total) after some more links (most): only the components that the links join are looked at."""
    end = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    joins = join_salted(links.join(end("a"), "a"), end("b"), "b", by="a", total=most, counted=links).filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joins = materialize(joins.distinct(), "near-joins", most)
    if joins.isEmpty():
        return labels
    to = components(joins, most).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return materialize(join_salted(labels, to, "component", by="id", total=total, how="left").select("id", F.coalesce("to", "component").alias("component")), "near-labels", total)


def open_pairs(mixed: DataFrame, sought: DataFrame, bits: DataFrame, total: int) -> DataFrame:
    """Pairs of seekers with classes of their star in other components that bitmaps do not rule out.

    mixed: star, id, component, members (of the star), total rows at most; sought: some of these rows, with n and bits.
    """
    sizes = sought.groupBy("star").agg(F.max("members").alias("members"), F.count(F.lit(1)).alias("seekers"), F.sum(F.octet_length("bits")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("seekers") / SIDE), F.ceil(F.col("bytes") / TILE_BYTES)).alias("blocks")
    tiles = materialize(sizes.select("star", "members", F.ceil(F.col("members") / SIDE).alias("salts"), blocks), "near-tiles", total)
    salt, block = F.pmod(F.xxhash64("id"), "salts"), F.pmod(F.xxhash64("id", F.lit("block")), "blocks")
    everyone = join_groups(mixed.drop("members"), tiles, "star", "members", total).withColumn("i", salt).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    everyone = everyone.select("star", "i", "j", F.lit(True).alias("member"), "id", "component").join(bits, "id")
    some = join_groups(sought.drop("members"), tiles, "star", "members", total).withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    columns = ["star", "i", "j", "member", "id", "component", "n", "bits"]
    rows = everyone.select(*columns).unionByName(some.withColumn("member", F.lit(False)).select(*columns))
    dealt = rows.repartition("star", "i", "j").sortWithinPartitions("star", "i", "j", "member")
    return materialize(dealt.mapInArrow(_close, "a binary, b binary").distinct(), "near-pairs", total)


def linked(classes: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """id and component of the classes that have links. known: a, b, classes linked from the start."""
    bands = classes.select("id", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(REGISTERS // ROWS)])).alias("bucket"))
    n_classes = classes.count()
    total = n_classes * (REGISTERS // ROWS)
    buckets = materialize(bands.groupBy("bucket").count().filter("count > 1"), "near-buckets", total)
    members = materialize(join_groups(bands, buckets, "bucket", "count", total).select("bucket", "id", F.col("count").alias("fill")), "near-members", total)
    weight = materialize(members.groupBy("id").agg(F.sum("fill").alias("weight")), "near-weights", n_classes)
    members = materialize(members.join(weight, "id").select("bucket", "id", "weight", "fill"), "near-members", total)
    wanted = classes.join(weight.select("id"), "id", "left_semi").select("id", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    texts = docs.join(wanted, (F.col("doc_id") == F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("id", "text").dropDuplicates(["id"])
    texts = materialize(texts, "near-texts")

    center = members.groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("top"), F.max("fill").alias("fill")).select("bucket", F.col("top.id").alias("star"), "fill")
    stars = join_groups(members.drop("fill"), materialize(center, "near-centers", total), "bucket", "fill", total).select("star", "id", "weight").distinct()
    stars = materialize(stars, "near-stars", total)
    links, most = judged(stars.filter("star <> id").select(F.col("id").alias("a"), F.col("star").alias("b")), classes, texts)
    labels = materialize(weight.select("id").unionByName(known.select(F.col("a").alias("id"))).unionByName(known.select(F.col("b").alias("id"))).distinct(), "near-labels", n_classes)
    labels = merged(labels.withColumn("component", F.col("id")), links.unionByName(known), most + known.count(), n_classes)

    bits, tested = None, None
    for turn in TURNS:
        own = materialize(stars.join(labels, "id"), "near-own", most)
        kinds = own.groupBy("star", "component").count()
        kinds = kinds.groupBy("star").agg(F.sum("count").alias("members"), F.count(F.lit(1)).alias("components"), F.max(F.struct("count", "component")).alias("top"))
        kinds = materialize(kinds.filter("components > 1").select("star", "members", F.col("top.component").alias("main")), "near-mixed-stars", n_classes)
        mixed = materialize(join_groups(own, kinds, "star", "members", most), "near-mixed", most)
        if bits is None:  # no other star ever gets mixed
            bits = materialize(texts.join(mixed.select("id").distinct(), "id").select("id", "text").mapInArrow(_bitmaps, "id binary, n long, bits binary"), "near-bits")
        seekers = mixed.filter("component <> main")
        if tested is not None:
            seekers = seekers.join(tested, ["star", "id"], "left_anti")
        if turn:
            nth = F.row_number().over(Window.partitionBy("star").orderBy(F.desc("weight"), "id"))
            seekers = seekers.withColumn("nth", nth).filter(F.col("nth") <= turn)
        sought = materialize(seekers.select("star", "id", "component", "members").join(bits, "id"), "near-seekers")
        if sought.isEmpty():
            break
        pairs = open_pairs(mixed.select("star", "id", "component", "members"), sought, bits, most)
        labels = merged(labels, *judged(pairs, classes, texts), n_classes)
        done = sought.select("star", "id")
        tested = done if tested is None else tested.unionByName(done)
    return labels


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, class_id (the smallest doc_id with the same set) and text_key."""
    rows = docs.select("doc_id", "text", text_key("text").alias("text_key"))
    sketches = materialize(rows.mapInArrow(_sketches, "doc_id long, text_key long, n_shingles long, digest binary, registers binary"), "near-sketches")
    known = sketches.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy(F.col("digest").alias("id")).agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("id", "one.doc_id", "one.text_key", "n_shingles", "registers", "copies"), "near-classes")
    shared = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("high")).filter("a <> high").select("doc_id", "a")
    # doc_ids with several texts: one document
    total = sketches.count()
    same = join_salted(known.select("doc_id", F.col("digest").alias("b")), shared, "doc_id", by="b", total=total)
    labels = linked(classes, rows, materialize(same.filter("a <> b").select("a", "b").distinct(), "near-same-ids"))

    first = classes.select("id", F.col("doc_id").alias("class_id"), "copies").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = materialize(first, "near-first", total)
    roots = first.groupBy("component").agg(F.min("class_id").alias("component_id"))
    whole = materialize(join_salted(first, roots, "component", by="id", total=total).select(F.col("id").alias("digest"), "class_id", "component_id", "copies"), "near-components", total)
    grouped = join_groups(known.select("doc_id", "text_key", "n_shingles", "digest"), whole, "digest", "copies", total)
    grouped = grouped.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = sketches.filter("digest IS NULL OR doc_id IS NULL").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True), "class_id": F.col("doc_id")})
    columns = ["doc_id", "n_shingles", "component_id", "kept", "class_id", "text_key"]
    return grouped.select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps the one with the smallest doc_id, with all their columns."""
    gone_id, gone_key = fresh_names(docs, "gone_id", "gone_key")
    gone = near_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    return docs.join(gone, (docs["doc_id"] == gone[gone_id]) & (text_key(docs["text"]) == gone[gone_key]), "left_anti")
