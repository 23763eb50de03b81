"""Quality classifier: supervised subword embeddings.

A text is the mean of the vectors of its words and of the n-grams inside them (of 3 and 4 bytes, so that letters outside ASCII count as two or more, with the white
space around a word as its border), all hashed into fixed tables; a word that repeats the one before adds a slot of its own four times, a feature for
stuttered text. A linear layer with softmax over the two classes
stands on the mean; vectors and layer are learned together by stochastic gradient descent in numpy.

The model is fitted on a bounded sample of labelled rows: TRAIN_ROWS rows, those with the smallest hash of doc_id among the rows
that may be learned from. Rows with crc32(doc_id) mod 5 = 0 are never learned from. Every whole text is then scored
in the executors; the broadcast model has a fixed size (SLOTS floats), as the linear layer is folded into the vectors.

Defined results: null and empty texts get the score of the layer's bias alone; rows of documents without a label are
scored like any other; of two labels of one doc_id the smaller counts; a null doc_id is never held out and never learned from; without two classes to learn from, the score is the
share of good rows (0.5 without any); repeated rows get equal scores; an
empty table gives an empty one; texts of any length are read whole.
score does not look at other columns, whatever their names, and keep_good keeps them as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 6000
WORD_SLOTS, GRAM_SLOTS = 1 << 16, 1 << 17
SLOTS = WORD_SLOTS + GRAM_SLOTS + 1  # the last one stands for a word that repeats the one before
DIM, EPOCHS, RATE = 8, 6, 0.5
GRAMS = (3, 4)
CACHE = 500_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class WordSlots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        slot = self[word] = zlib.crc32(word) % WORD_SLOTS
        return slot


def gram_slots(data: bytes, lengths: tuple[int, ...], slots: int) -> list[np.ndarray]:
    """Hashed slots (below `slots`) of the byte n-grams that have no white space but at their ends."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    inner = ~SPACE[b]
    b = np.where(inner, b, np.uint8(32)).astype(np.uint32)
    out = []
    for n in lengths:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h, whole = np.zeros(m, np.uint32), np.ones(m, bool)
        for i in range(n):
            h = (h ^ b[i : i + m]) * np.uint32(0x01000193)
            if 0 < i < n - 1:
                whole &= inner[i : i + m]
        h ^= h >> np.uint32(15)
        out.append(h[whole].astype(np.int64) % slots)
    return out


def slots(data: bytes, words: WordSlots) -> np.ndarray:
    """Slots of all words and n-grams of a text, repeats included; a word that repeats the one before adds the slot of such pairs."""
    found = data.split()
    own = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    if not found:
        return own
    twice = np.full(int((own[1:] == own[:-1]).sum()), SLOTS - 1, np.int64)
    return np.concatenate([own, twice, twice, twice, twice] + [g + WORD_SLOTS for g in gram_slots(data, GRAMS, GRAM_SLOTS)])


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Slot weights and bias: the log-odds of class 1 are the mean weight of a text's slots plus the bias."""
    rng = np.random.default_rng(seed)
    words = WordSlots()
    docs = []
    for t in texts:
        ids, n = np.unique(slots((t or "").encode(), words), return_counts=True)
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.asarray(labels)
    steps, total = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # a slot's gradient is its share of the text; the step is scaled by the number of slots, as each holds one part of the mean
            vectors[ids] = own - np.outer(share * rate * min(len(ids), 400), back)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the ids are chosen from the narrow label table: at most `rows` ids are broadcast and at most that many texts come back
    chosen = known.select(F.col("doc_id").alias("known_id"), F.col(column).cast("int").alias("known_label")).groupBy("known_id").agg(F.min("known_label").alias("known_label")).orderBy(F.xxhash64("known_id"), "known_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).select("known_id", "known_label", "text")
    sample = found.orderBy(F.xxhash64("known_id"), "known_id", "text").limit(rows).toPandas()
    share = float(sample["known_label"].mean()) if len(sample) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 0.001), 0.999)
        return np.zeros(SLOTS, np.float32), float(np.log(share / (1 - share)))
    return train(sample["text"].tolist(), sample["known_label"].tolist())


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        weights = weights.astype(np.float64)
        words = WordSlots()
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                ids = slots((t or "").encode(), words)
                z = bias + (float(weights[ids].mean()) if len(ids) else 0.0)
                out.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text the classifier does not reject. Decided by text, so rows need no key."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    floor = float(np.log(threshold / (1 - threshold)))
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        weights = weights.astype(np.float64)
        words = WordSlots()
        for batch in batches:
            good = []
            for t in batch.column(columns.index("text")).to_pylist():
                ids = slots((t or "").encode(), words)
                good.append(bias + (float(weights[ids].mean()) if len(ids) else 0.0) >= floor)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)
