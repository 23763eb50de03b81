"""Byte-level BPE by tree reduction.

A piece is encoded by halving it until it is short, merging the short parts directly, and joining neighbours: the last
tokens of the left part and the first of the right are encoded again as one window, which grows until it stands.

Why it may stop: a sequence of tokens is the encoding of its bytes exactly if each two neighbours, encoded together,
come out as themselves. Inside either part every pair is such already, so only the pairs in the new window and
the two at its edges can fail. The window's own pairs stand as it was encoded; the two at its edges are looked at,
and as long as one fails the window takes in more tokens on that side.

Decoding concatenates bytes up the same tree. A text is the concatenation of its pieces (the matches of the split
pattern), so its ids are the pieces' ids in order.

Ids follow the rank file: a piece that is a token as a whole is that token, otherwise the neighbours whose
concatenation has the lowest rank merge first, the leftmost of equals.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are read whole, though a single piece of
very many bytes (a megabyte of one sign) is one task's work; repeated rows get equal results; columns of other names are not looked at;
an empty table gives an empty one. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LEAF = 24
CACHE = 700_000
SHIFT, NONE = 20, 1 << 60


class Pieces(dict):
    """Ids of pieces, encoded when first asked for. Emptied when full; long pieces are not kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks of a vocabulary file, and what is derived from them. One for each worker process and file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        #: (left, right) as one number -> the token that the two make
        self.merged = {self.ranks[t[:i]] << SHIFT | self.ranks[t[i:]]: rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.piece)
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merges from single bytes, lowest rank first, the leftmost of equals."""
        single, merged = self.single, self.merged.get
        ids = [single[c] for c in data]
        costs = [merged(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while costs:
            least = min(costs)
            if least == NONE:
                break
            i = costs.index(least)
            ids[i] = least
            del ids[i + 1], costs[i]
            if i:
                costs[i - 1] = merged(ids[i - 1] << SHIFT | least, NONE)
            if i < len(costs):
                costs[i] = merged(least << SHIFT | ids[i + 1], NONE)
        return ids

    def stands(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens come out as themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encoded neighbours."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.leaf(self.decode(left[len(left) - a :]) + self.decode(right[:b]))
            before = a == len(left) or self.stands(left[len(left) - a - 1], window[0])
            after = b == len(right) or self.stands(window[-1], right[b])
            if before and after:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if before else 2 * a, b if after else 2 * b

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = text.encode()
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.tree(data), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids, joined up the tree."""
        if len(ids) > 4096:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs and, if asked for, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                encoded = [v.encode(t or "") for t in texts[at : at + 512]]
                numbers = [np.frombuffer(e, "<u4") for e in encoded]
                columns = [
                    keys[at : at + 512],
                    pa.array([len(n) for n in numbers], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                    pa.array([hashlib.sha256(v.decode(n.tolist())).hexdigest() for n in numbers]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([n.astype(np.int32) for n in numbers], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (bytes that are not UTF-8 become the replacement sign) of a table with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            texts = [v.decode(x or []).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
