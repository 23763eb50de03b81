"""Removal of repeated substrings: every byte covered by a LEAST-byte string that also starts somewhere else.

Sharing the work. A window is LEAST consecutive bytes of one text. The least hash among its GRAM-byte grams is its
anchor; equal windows have equal anchors at the same place. Consecutive windows with one anchor form a segment,
so all copies of a window lie in segments with the same anchor hash, and anchors can be dealt to tasks.

Settling segments. (1) An anchor hash that occurs once holds no repeat. (2) Equal segments (same anchor and digest) are repeats of each
other as a whole. (3) Different segments under one anchor hash may share some windows: one copy of each goes, with its bytes,
to a task that holds all segments of the anchor. There the segments are one string with a separator after each; from its
Burrows-Wheeler transform, intervals of suffixes with a common prefix are extended backwards breadth first, which gives the
common prefix lengths of neighbouring suffixes in increasing order. The extension stops at LEAST: neighbours without a length by
then share a window. (4) A group of more than MOST different segments is halved before: a window has its anchor's gram at some
distance from its start, windows of the greater distances all hold the same bytes before the gram and those of the lesser the same
bytes after it, so each half of a segment's windows goes to the group of those bytes, where (2) and (3) hold again. Equal windows
have equal distances and stay together. Halving goes on until groups are small; a half with one distance left is one window, so it ends.

Defined results: a null text is empty; texts under LEAST bytes keep all bytes; rows of documents are told apart by doc_id and text,
and equal rows repeat each other like any other texts; null doc_ids are a value like others; an empty table gives an empty one; texts of
any length are read whole, and no more than a piece of CHUNK bytes is hashed at once. Equal segments are told by 128 bits of hashes.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, join_sized, materialize, text_key

LEAST, GRAM = 200, 50
#: Different segments of a group that go through one transform, about 180 KB of text.
MOST = 512
CHUNK = 1 << 20
BATCH = 1 << 18

_rng = np.random.default_rng(20240603)
_ODD = lambda: np.uint64(int(_rng.integers(0, 1 << 62)) * 2 + 1)


class Rolling:
    """Polynomial hashes modulo 2**64 of all substrings of a byte string, from sums of value times power."""

    def __init__(self):
        self.values = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = _ODD()
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers, self.inverse = self._grown(1 << 14)

    def _grown(self, n):
        grow = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]))
        return grow(self.base), grow(self.back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.powers):
            self.powers, self.inverse = self._grown(max(n, min(2 * n, CHUNK + 2 * LEAST)))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[: n - 1])])

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def all_of(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        m = len(sums) - length
        x = (sums[length:] - sums[:m]) * self.inverse[:m]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


ANCHORS, OTHER = Rolling(), Rolling()


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor hash and digest of the segments of a text, in order."""
    out = []
    for at in range(0, max(0, len(data) - LEAST + 1), CHUNK):
        piece = np.frombuffer(data, np.uint8, min(CHUNK + LEAST - 1, len(data) - at), at)
        sums = ANCHORS.sums(piece)
        grams = ANCHORS.all_of(sums, GRAM)
        mask = np.uint64((1 << 24) - 1)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)  # the place in the low bits: the leftmost of equals
        width, have = LEAST - GRAM + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & mask).astype(np.int64)
        first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.append(first, len(place)))
        digest = OTHER.hashes(OTHER.sums(piece), first, first + count + LEAST - 1) ^ (count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((first + at, count, grams[place[first]], digest))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def kinds_of(anchor: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different segments by both hashes: the first place of each, the number of its places, and for every place the number of its kind."""
    order = np.lexsort((digest, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return order[fresh], np.bincount(kind), kind


PACK = 7  # symbols of nine bits in the first key


def repeats(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, whether the LEAST bytes from each place on occur elsewhere among the strings (or in the same one)."""
    total = sum(map(len, strings)) + len(strings)
    lengths = np.array([len(s) + 1 for s in strings])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths) - 1
    text[ends] = 0
    # suffixes in the order of their first symbols, by doubling; one that meets a separator first is like no other
    depth = min(PACK, LEAST)
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    key, alive = np.zeros(total, np.int64), np.ones(total, bool)
    for i in range(depth):
        key = (key << 9) | np.where(alive, padded[i : i + total], 0)
        alive &= padded[i : i + total] > 0
    order = np.argsort(key)
    apart = np.ones(total, bool)
    apart[1:] = (key[order[1:]] != key[order[:-1]]) | ~alive[order[1:]]
    starts = np.flatnonzero(apart)  # of the intervals of equal first symbols
    rank = np.empty(total, np.int64)
    rank[order] = np.cumsum(apart) - 1
    size = depth
    while size < LEAST and int(rank[order[-1]]) < total - 1:
        after = np.zeros(total, np.int64)
        after[:-size] = rank[size:] + 1
        key = rank * (total + 1) + after
        order = np.argsort(key)
        fresh = np.ones(total, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(fresh) - 1
        size *= 2
    before = text[order - 1]  # the transform
    step = np.empty(total, np.int32)
    step[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(total, dtype=np.int32)  # where the suffix one symbol longer stands
    known = np.zeros(total + 1, bool)  # whether the common prefix of a suffix and the one before has been found
    known[starts] = known[total] = True
    low, high = starts.astype(np.int32), np.append(starts[1:], total).astype(np.int32)
    many = high - low > 1
    single = low[~many]  # intervals of one suffix keep to themselves and are followed apart
    low, high = low[many], high[many]
    for _ in range(depth, LEAST):  # common prefixes of this length get known
        if not len(low) and not len(single):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
        inside = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes - low).astype(np.int32), sizes)
        # a separator before splits an interval into suffixes of their own
        symbol = before[inside]
        to = step[inside]
        group = (owner << 41) | (symbol << 32) | to
        group.sort()
        to = (group & 0xFFFFFFFF).astype(np.int32)
        head = group >> 32
        first = np.ones(len(head), bool)
        first[1:] = (head[1:] != head[:-1]) | ((head[1:] & 511) == 0)
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(head))).astype(np.int32)
        low = np.concatenate([to[at], step[single]])
        high = low + np.concatenate([count, np.ones(len(single), np.int32)])
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        many = high - low > 1
        single = low[~many]
        low, high = low[many], high[many]
    pair = np.flatnonzero(~known)
    shared = np.zeros(total, bool)
    shared[order[pair]] = True
    shared[order[pair - 1]] = True
    return [shared[e - n + 1 : e] for e, n in zip(ends, lengths, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different segment of a row, with the number of its places."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        parts, size = [], 0

        def out(parts):
            whole = [np.concatenate(x) for x in zip(*[p[1:] for p in parts], strict=True)]
            rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), keys.take(pa.array(rows)), pa.array(whole[0]), pa.array(whole[1].astype(np.int32)), _signed(whole[2]), _signed(whole[3]), pa.array(whole[4])], ["doc_id", "text_key", "start", "windows", "anchor", "digest", "times"])

        for i, text in enumerate(batch.column(2).to_pylist()):
            first, count, anchor, digest = segments((text or "").encode())
            if not len(first):
                continue
            own, times, _ = kinds_of(anchor, digest)
            parts.append((i, first[own], count[own], anchor[own], digest[own], times))
            size += len(own)
            if size > 50_000:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "text_key", "packed"])


PIECE = "group long, anchor long, digest long, first int, least int, greatest int, piece binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text, as pieces of their anchor's group with all distances."""
    z = zstandard.ZstdDecompressor()

    def out(flat, done, at, pieces):
        n = len(pieces)
        anchor, digest = flat.field(2)[done:at], flat.field(3)[done:at]
        numbers = [pa.array(np.full(n, x, np.int32)) for x in (0, 0, LEAST - GRAM)]
        return pa.RecordBatch.from_arrays([anchor, anchor, digest, *numbers, pa.array(pieces, pa.binary())], ["group", "anchor", "digest", "first", "least", "greatest", "piece"])

    for batch in batches:
        wanted = batch.column(1)
        flat = wanted.flatten()
        start, windows = (flat.field(i).to_pylist() for i in (0, 1))
        at, done, size, pieces = 0, 0, 0, []
        for packed, n in zip(batch.column(0).to_pylist(), pa.compute.list_value_length(wanted).to_pylist(), strict=True):
            data = z.decompress(packed)
            for i in range(at, at + n):
                pieces.append(data[start[i] : start[i] + windows[i] + LEAST - 1])
                size += len(pieces[-1])
            at += n
            if size > 4 * BATCH:
                yield out(flat, done, at, pieces)
                done, size, pieces = at, 0, []
        if pieces:
            yield out(flat, done, at, pieces)


def halves(group: int, anchor: int, first: int, least: int, greatest: int, piece: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """group, first window, least and greatest distance and bytes of the halves of a piece that have windows.

    A window's distance is that from its start to the gram of the anchor, the first gram in the piece with that hash.
    """
    grams = ANCHORS.all_of(ANCHORS.sums(np.frombuffer(piece, np.uint8)), GRAM).view(np.int64)
    at = int(np.flatnonzero(grams == anchor)[0])
    middle = (least + greatest + 1) // 2
    last = len(piece) - LEAST
    cut = at - middle  # the last window with at least the middle distance
    for low, high, start, end in ((middle, greatest, 0, min(cut, last)), (least, middle - 1, max(cut + 1, 0), last)):
        if low <= high and start <= end:
            common = piece[at - low : at + LEAST - high]
            named = hashlib.blake2b(common, digest_size=8, key=group.to_bytes(8, "little", signed=True), salt=low.to_bytes(2, "little")).digest()
            yield int.from_bytes(named, "little", signed=True), first + start, low, high, piece[start : end + LEAST]


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The halves of pieces, with a digest of their group and bytes."""
    for batch in batches:
        rows = []
        for group, anchor, digest, first, least, greatest, piece in zip(*[batch.column(c).to_pylist() for c in ("group", "anchor", "digest", "first", "least", "greatest", "piece")], strict=True):
            for own, start, low, high, part in halves(group, anchor, first, least, greatest, piece):
                rows.append((own, anchor, digest, start, low, high, part, hashlib.blake2b(part, digest_size=16, key=own.to_bytes(8, "little", signed=True)).digest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["group", "anchor", "digest", "first", "least", "greatest", "piece", "part"])


RUN = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of shared windows in the pieces of whole groups. Rows come sorted by group; several groups share one transform."""
    held: list[tuple[int, int, int, int, bytes]] = []

    def settle(rows):
        out = []
        for (_, anchor, digest, first, _), flags in zip(rows, repeats([r[4] for r in rows]), strict=True):
            for low, high in zip(*runs(flags), strict=True):
                out.append({"anchor": anchor, "digest": digest, "low": first + int(low), "high": first + int(high)})
        return pa.RecordBatch.from_pylist(out, RUN)

    size = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("group", "anchor", "digest", "first", "piece")], strict=True):
            if size > BATCH and held[-1][0] != row[0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield settle(held)


RUNS = "anchor long, digest long, low int, high int"


def shared_runs(pieces: DataFrame) -> DataFrame:
    """Runs of windows (anchor, digest, low, high) that pieces of one group share; groups of any size."""
    found = []
    while True:
        total = pieces.count()
        groups = materialize(pieces.groupBy("group").count().filter("count > 1"), "repeat-groups")
        large = groups.filter(F.col("count") > MOST)
        alone = join_salted(pieces, groups.filter(F.col("count") <= MOST).select("group"), "group", by="digest", total=total)
        found.append(alone.repartition("group").sortWithinPartitions("group").mapInArrow(_expand, RUNS))
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        split = join_salted(pieces, large.select("group"), "group", by="digest", total=total)
        split = materialize(split.select(*pieces.columns).mapInArrow(_halved, f"{PIECE}, part binary"), "repeat-halves")
        kinds = materialize(split.groupBy("group", "part").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("anchor", "digest", "first")).alias("one")), "repeat-half-kinds")
        # every window of equal halves is a repeat; one of them stands for all against the others of the group
        equal = join_salted(split.drop("group"), kinds.filter("copies > 1").select("part").distinct(), "part", by="digest", total=2 * total)
        windows = F.octet_length("piece") - (LEAST - 1)
        found.append(equal.select("anchor", "digest", F.col("first").alias("low"), (F.col("first") + windows).alias("high")))
        one = kinds.select(F.col("group").alias("own"), "one.*")
        same = [split["group"] == one["own"], *[split[c] == one[c] for c in ("anchor", "digest", "first")]]
        pieces = materialize(split.join(one, same, "left_semi").drop("part"), "repeat-pieces")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        spans = batch.column(3)
        flat = spans.flatten()
        first, last, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(spans), 0))
        ends = np.cumsum(sizes)
        rows = []
        for i, packed in enumerate(batch.column(2).to_pylist()):
            data = z.decompress(packed)
            n = len(data)
            own = slice(ends[i] - sizes[i], ends[i])
            opens, closes = first[own], last[own]
            if sizes[i] and times[own].max() > 1:  # segments that a text repeats itself: all their places
                start, count, anchor, digest = segments(data)
                _, number, place = kinds_of(anchor, digest)
                twice = number[place] > 1
                opens = np.concatenate([opens, start[twice]])
                closes = np.concatenate([closes, start[twice] + count[twice] + LEAST - 1])
            gone = np.zeros(n, bool)
            if len(opens):
                gone = np.cumsum(np.bincount(opens, minlength=n + 1) - np.bincount(closes, minlength=n + 1))[:n] > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(opens) else data
            low, high = runs(gone)
            rows.append((n, int(gone.sum()), len(low), hashlib.sha256(kept).hexdigest(), low, high))
        found = pa.StructArray.from_arrays([pa.array(np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)) for k in (4, 5)], ["first", "last"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32))
        columns = [batch.column(0), batch.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], pa.ListArray.from_arrays(offsets, found)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets, end excluded)."""
    rows = docs.select("doc_id", text_key("text").alias("text_key"), "text")
    found = rows.mapInArrow(_segments, "doc_id long, text_key long, start long, windows int, anchor long, digest long, times long")
    anchors = found.groupBy("anchor").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 1").select("anchor", "rows")
    anchors = materialize(anchors, "repeat-anchors")
    total = anchors.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    places = materialize(join_sized(found, anchors, ["anchor"], "rows", "doc_id", total, "merge").select(*found.columns), "repeat-places")

    kinds = places.groupBy("anchor", "digest").agg(F.sum("times").alias("copies"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("one"))
    kinds = materialize(kinds, "repeat-kinds")
    copied = materialize(kinds.filter("copies > 1").select("anchor", "digest", "rows"), "repeat-copied")
    whole = join_sized(places, copied, ["anchor", "digest"], "rows", "doc_id", total, "merge").select("doc_id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("windows") + LEAST - 1).alias("last"), "times")

    mixed = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "repeat-mixed")
    open_kinds = join_sized(kinds.drop("rows"), mixed, ["anchor"], "kinds", "digest", total, "merge").select("anchor", "digest", "copies", "one.*")
    wanted = open_kinds.groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.collect_list(F.struct("start", "windows", "anchor", "digest")).alias("wanted"))
    packed = rows.mapInArrow(_pack, "doc_id long, text_key long, packed binary")
    asked = packed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).dropDuplicates(["doc_id", "text_key"])
    pieces = materialize(asked.select("packed", "wanted").mapInArrow(_cut, PIECE), "repeat-pieces")
    shared = shared_runs(pieces).join(open_kinds.filter("copies = 1"), ["anchor", "digest"])
    parts = shared.select("doc_id", "text_key", (F.col("start") + F.col("low")).alias("first"), (F.col("start") + F.col("high") + LEAST - 1).alias("last"), F.lit(1).cast("long").alias("times"))

    spans = whole.unionByName(parts).groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.collect_list(F.struct("first", "last", "times")).alias("spans"))
    spans = materialize(spans, "repeat-spans")
    joined = packed.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    return joined.select("doc_id", "text_key", "packed", "spans").mapInArrow(_finish, "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>")
