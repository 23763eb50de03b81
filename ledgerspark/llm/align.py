"""Alignment of the tokens of two tokenizers by the byte offsets where both end one.

A text is encoded by both tokenizers; each list of tokens gives an ascending list of byte ends. The shorter list drives a galloping intersection:
each of its ends is looked for in the longer list from the place its rank suggests, in steps that double until the end is passed, then by
halves. The common ends cut both lists into groups that cover the same bytes; between two cuts the ranks tell how many tokens of each side the group
has, and which tokens overlap. The ends of many texts are searched at once, as arrays.

Two tokens are linked where they end at the same byte. So one's bytes end with the other's, and the linked pairs of ids can be listed from the two vocabularies
alone (LINKABLE pairs, some hundred thousand for vocabularies of 50,000 and 32,000). Corpus-wide counts are a table of that size at most, whatever the corpus: it
is counted in the tasks, summed by Spark and broadcast.

Texts are encoded in parts that both tokenizers treat alone (cut between a non-space and a space or line end, if the second vocabulary has no piece over such a place), and
parts met before come from a bounded store; that gives the ids of the whole text.

Defined results: a null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens, zeros and an empty digest; special tokens' strings
are plain text; texts of any length are read whole (a part without a space is one call of the tokenizer); repeated rows get equal results and count each; null ids are
ids like any other; other columns, whatever their names, are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Parts kept by a worker in each of two generations, their greatest length, and bytes of text that are encoded and aligned at once.
KEPT, KEPT_LENGTH, AT_ONCE = 200_000, 64, 1 << 20
#: Marks the ids of B where those of both sides stand in one row.
SIDE_B = 1 << 31
PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
SPACE = "▁"


def byte_of_sign() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself where it is printable, else the next sign from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _digits(ids: int, last: str) -> list[bytes]:
    """Each id in decimal digits, followed by ',' and then followed by `last`."""
    return [f"{i}{end}".encode() for i in range(ids) for end in (",", last)]


class Parts(dict):
    """Ids of parts, as bytes: those of A, then those of B with SIDE_B. When the young generation is full it becomes the old one, and parts that are met again come back from there."""

    def __init__(self):
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.old[part]
        return ids

    def unknown(self, parts) -> list[str]:
        return [p for p in dict.fromkeys(parts) if p not in self and p not in self.old]

    def age(self, gone: list[str]) -> None:
        for p in gone:
            self.pop(p, None)
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()


class Tokenizers:
    """Both tokenizers, the bytes of their tokens and the linkable pairs. One for each worker process and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = byte_of_sign()
        a_bytes = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Whether no piece reaches over the start of a run of spaces or over a line end.
        self.in_parts = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.known = Parts()
        self.odd: set[str] = set()
        #: What the digest has for each token of A and then of B, filled up with zero bytes.
        self.signs = np.array(_digits(len(self.a_bytes), "|") + _digits(len(self.b_bytes), ";"))
        self.signs_n = np.char.str_len(self.signs)

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        """Ascending codes (id of A * size of B + id of B) of all pairs of tokens of which one ends with the other."""
        found = []
        for one, other, flip in ((self.a_bytes, self.b_bytes, False), (self.b_bytes, self.a_bytes, True)):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(other):
                ids.setdefault(t, []).append(i)
            for i, t in enumerate(one):
                for at in range(len(t)):
                    found += [(j * len(self.b_bytes) + i) if flip else (i * len(self.b_bytes) + j) for j in ids.get(t[at:], ())]
        return np.unique(np.array(found, np.int64))

    def learn(self, parts: list[str]) -> None:
        """Encode parts that are not known. A line end before a part keeps the second tokenizer from adding a space; it is two tokens of its own."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        if self.in_parts:
            b = [ids[2:] for ids in self.b.encode([f"\n{p}" for p in parts], num_threads=1)]
        else:
            b = self.b.encode([p[1:] for p in parts], num_threads=1)  # parts are whole texts, with the space before them
        for part, x, y in zip(parts, a, b, strict=True):
            self.known[part] = np.array([*x, *(i | SIDE_B for i in y)], "<u4").tobytes()
            data = part.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) != data or b"".join(map(self.b_bytes.__getitem__, y)) != data:
                self.odd.add(part)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of a space and each text; None where the bytes do not come back."""
        cut = [PARTS.findall(f" {t}") if self.in_parts else [f" {t}"] for t in texts]
        new = self.known.unknown(p for parts in cut for p in parts)
        self.learn(new)
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, parts in zip(texts, cut, strict=True):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")
            of_b = ids >= SIDE_B
            a, b = ids[~of_b].astype(np.int64), ids[of_b].astype(np.int64) - SIDE_B
            whole = f" {text}".encode()
            if self.odd and not self.odd.isdisjoint(parts) and any(b"".join(x[i] for i in ids) != whole for x, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                out.append(None)
            else:
                out.append((a, b))
        self.known.age([p for p in new if len(p) > KEPT_LENGTH])
        self.odd = {p for p in self.odd if p in self.known or p in self.known.old} if self.odd else self.odd
        return out


@functools.lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def gallop(wanted: np.ndarray, among: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each wanted number the first place in the ascending `among` that holds as much or more, looked for from the place `near` (all at once)."""
    n = len(among)
    near = np.minimum(near, n - 1)
    up = among[near] < wanted
    low, high = np.where(up, near, -1), np.where(up, n, near)
    step, open_ = 1, np.arange(len(wanted))
    while len(open_):
        rising, at = up[open_], near[open_]
        probe = np.where(rising, np.minimum(at + step, n), np.maximum(at - step, -1))
        inside = (probe >= 0) & (probe < n)
        less = np.where(inside, among[np.clip(probe, 0, n - 1)] < wanted[open_], ~rising & (probe < 0))
        low[open_[less]] = probe[less]
        high[open_[~less]] = probe[~less]
        open_ = open_[inside & (less == rising)]
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = among[middle] < wanted[open_]
        low[open_[less]] = middle[less]
        high[open_[~less]] = middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(short: np.ndarray, short_n: np.ndarray, long: np.ndarray, long_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common numbers in two ascending lists, each of them the lists of several texts (of short_n and long_n numbers) one after the other."""
    own = np.arange(len(short)) - np.repeat(np.cumsum(short_n) - short_n, short_n)
    near = np.repeat(np.cumsum(long_n) - long_n, short_n) + own * np.repeat(long_n, short_n) // np.repeat(np.maximum(short_n, 1), short_n)
    place = gallop(short, long, near)
    hit = np.flatnonzero((place < len(long)) & (long[np.minimum(place, len(long) - 1)] == short))
    return hit, place[hit]


class Aligned:
    """Groups of several texts, one after the other: the last token of each group on both sides, and the digest's bytes."""

    def __init__(self, t: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.a_n, self.b_n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        a_ends, b_ends = np.cumsum(t.a_length[self.a]), np.cumsum(t.b_length[self.b])
        if len(self.a) <= len(self.b):
            self.a_last, self.b_last = common_ends(a_ends, self.a_n, b_ends, self.b_n)
        else:
            self.b_last, self.a_last = common_ends(b_ends, self.b_n, a_ends, self.a_n)
        #: Number of groups of each text: both sides of a text end together, so its last tokens close a group.
        upto = np.searchsorted(self.a_last, np.cumsum(self.a_n) - 1, side="right")
        self.groups_n = np.diff(np.concatenate([[0], upto]))
        self.t = t

    def digests(self) -> list[str]:
        """sha256 of the groups of each text, written as ids of A, '|', ids of B, with ';' between groups."""
        t = self.t
        in_a, in_b = (np.diff(np.concatenate([[-1], last])) for last in (self.a_last, self.b_last))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        a_code, b_code = self.a * 2, (self.b + len(t.a_bytes)) * 2
        a_code[self.a_last] += 1
        b_code[self.b_last] += 1
        codes[np.arange(len(self.a)) + np.repeat(self.b_last + 1 - in_b, in_a)] = a_code
        codes[np.arange(len(self.b)) + np.repeat(self.a_last + 1, in_b)] = b_code
        text = memoryview(t.signs[codes].tobytes().translate(None, b"\0"))
        length = np.concatenate([[0], np.cumsum(t.signs_n[codes])])
        ends = np.concatenate([[0], np.cumsum(self.a_n + self.b_n)])
        cuts = length[ends]
        return [hashlib.sha256(text[cuts[k] : cuts[k + 1] - 1]).hexdigest() for k in range(len(self.a_n))]

    def links(self) -> np.ndarray:
        """Each link's place among the linkable pairs."""
        return np.searchsorted(self.t.pairs, self.a[self.a_last] * len(self.t.b_bytes) + self.b[self.b_last]).astype(np.int32)

    def ranges(self) -> list[np.ndarray]:
        """For each text its groups as rows (first and last token of A, first and last token of B), counted from 0 in the text."""
        first_a, first_b = (np.concatenate([[0], last[:-1] + 1]) for last in (self.a_last, self.b_last))
        base_a, base_b = (np.repeat(np.cumsum(n) - n, self.groups_n) for n in (self.a_n, self.b_n))
        every = np.stack([first_a - base_a, self.a_last - base_a, first_b - base_b, self.b_last - base_b], axis=1)
        return np.split(every, np.cumsum(self.groups_n)[:-1])


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0


def _aligned(texts: list[str | None], t: Tokenizers) -> Iterator[tuple[list[int], Aligned]]:
    """Places of the texts that have tokens, and their alignment: those with fewer tokens on side A apart from the others, so that the shorter list drives."""
    here = [k for k, x in enumerate(texts) if x]
    ids = dict(zip(here, t.encode([texts[k] for k in here]), strict=True))
    there = [k for k in here if ids[k] is not None]
    for own in ([k for k in there if len(ids[k][0]) <= len(ids[k][1])], [k for k in there if len(ids[k][0]) > len(ids[k][1])]):
        if own:
            yield own, Aligned(t, [ids[k][0] for k in own], [ids[k][1] for k in own])


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and each link's place among the linkable pairs, of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for first, end in _portions(every):
                m = end - first
                n_a, n_b, n_groups = (np.zeros(m, np.int64) for _ in range(3))
                sha, links = [""] * m, [np.zeros(0, np.int32)] * m
                for own, x in _aligned(every[first:end], t):
                    n_a[own], n_b[own], n_groups[own] = x.a_n, x.b_n, x.groups_n
                    for k, digest, part in zip(own, x.digests(), np.split(x.links(), np.cumsum(x.groups_n)[:-1]), strict=True):
                        sha[k], links[k] = digest, part
                columns = [batch.column(0)[first:end], pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(sha, pa.string()), pa.array(links, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids and the groups (first and last token of both sides) of every row of docs; null lists where a text has no tokens.

    The tokens of a group overlap one after the other: a group of m and n tokens has m + n - 1 overlapping pairs.
    """
    kinds = [("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pa.list_(pa.struct([(f, pa.int32()) for f in ("a_first", "a_last", "b_first", "b_last")])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for first, end in _portions(every):
                out = [[None] * (end - first) for _ in kinds]
                for own, x in _aligned(every[first:end], t):
                    a, b = np.split(x.a, np.cumsum(x.a_n)[:-1]), np.split(x.b, np.cumsum(x.b_n)[:-1])
                    for k, p, q, r in zip(own, a, b, x.ranges(), strict=True):
                        out[0][k], out[1][k] = p, q
                        out[2][k] = [dict(zip(("a_first", "a_last", "b_first", "b_last"), g, strict=True)) for g in r.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], *(pa.array(v, kind) for v, (_, kind) in zip(out, kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_first:int,a_last:int,b_first:int,b_last:int>>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(counts))
        found[: len(counts)] += counts
        counts = found
    own = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["pair", "links"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (its place among the linkable pairs) and how many links of the corpus hold it."""
    return rows.select("links").mapInArrow(_counted, "pair int, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    rows = materialize(linked(docs, a_path, b_path), "alignment")
    t = tokenizers(a_path, b_path)
    b_of = t.pairs % len(t.b_bytes)
    counts = np.zeros(len(t.pairs), np.int64)
    found = pair_counts(rows).toPandas()  # as many rows as there are linkable pairs at most
    counts[found["pair"]] = found["links"]
    most = np.zeros(len(t.b_bytes), np.int64)
    np.maximum.at(most, b_of, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == most[b_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = batch.column(5)
            at, place = np.diff(links.offsets.to_numpy()), links.flatten().to_numpy()
            upto = np.concatenate([[0], np.cumsum(at)])
            n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[upto]) for x in (best, counts))
            columns = [*batch.columns[:4], pa.array(at.astype(np.int64)), pa.array(n_best), pa.array(count_sum), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
