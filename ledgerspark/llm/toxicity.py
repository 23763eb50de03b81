"""Toxicity classifier: non-negative positive-unlabelled learning.

Learned from confirmed toxic texts (P) and unlabelled ones (U) alone. With the share of toxic rows (the class prior) known,
the risk on negatives is the risk of U counted as negative less the prior times the risk of P counted as negative; where a
batch makes that estimate negative, which it cannot be, the step goes the other way, so that the model does not
learn U by heart. The classifier is linear over hashed n-grams (4 and 5 bytes inside words, their borders included), each counted once a text; weights are fitted in numpy with
adaptive steps and an L1 penalty, which clears slots that tell nothing; slots whose share of
texts hardly differs between P and U are left out beforehand.

P is a bounded sample of labelled rows: the `positive_rows` confirmed toxic rows with the smallest hash of doc_id. U is every row of documents whose
crc32(doc_id) mod 5 is not 0, however many there are: their n-grams are counted in the executors, each text is cut down to its telling
slots, blocks of about `block_rows` texts are learned from by a task each, and the blocks' weights are averaged. The cut comes from the scores of
all of U. What reaches the driver has a fixed size: SLOTS counts, the weights, BINS numbers and the telling slots of P. The prior is the share of
toxic rows among the labelled rows that may be learned from.

Defined results: null and empty texts get the score of the bias alone; a null doc_id is never held out and never
learned from; without confirmed toxic rows every score is 0; repeated rows get equal scores; an empty table gives an empty one; texts of any length
are read whole.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import gram_slots, held_out

#: Bound of the labelled sample, and rows of U that one task learns from.
POSITIVE_ROWS, BLOCK_ROWS = 4000, 8000
SLOTS = 1 << 19
GRAMS = (4, 5)
EPOCHS, RATE, L1, SCREEN, BATCH = 12, 0.15, 2e-4, 6, 64
#: Scores of U are counted in BINS steps of 1 / STEPS around 0 to find the cut.
BINS, STEPS = 4096, 64
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def slots(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct slots of the n-grams of a text, lower-cased and with ASCII marks and digits as white space; only those that are wanted, if given."""
    found = gram_slots((text or "").lower().encode().translate(LETTERS), GRAMS, SLOTS)
    if not found:
        return np.zeros(0, np.int32)
    every = np.concatenate(found).astype(np.int32)
    return np.unique(every if wanted is None else every[wanted[every]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have each slot; slot -1 counts the texts."""
    counts, texts = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts[slots(text)] += 1
            texts += 1
    own = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1).astype(np.int32)), pa.array(np.append(counts[own], texts))], ["slot", "texts"])


def slot_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts with each slot, and of texts."""
    found = docs.select("text").mapInArrow(_counted, "slot int, texts long").groupBy("slot").agg(F.sum("texts").alias("texts")).toPandas()  # SLOTS + 1 rows at most
    counts = np.zeros(SLOTS + 1, np.int64)
    counts[found["slot"]] = found["texts"]
    return counts[:-1], int(counts[-1])


def screen(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Whether the share of texts with a slot differs between P and U by SCREEN standard errors at least."""
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    return np.abs(in_p / n_p - in_u / n_u) >= SCREEN * np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))


def told(docs: DataFrame, telling: np.ndarray) -> DataFrame:
    """place: for every text the places of its slots among the telling ones; nth: a hash of doc_id and text, which orders the rows alike in any layout."""
    shared = docs.sparkSession.sparkContext.broadcast(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.cumsum(shared.value).astype(np.int32) - 1
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([rank[slots(t, shared.value)] for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["nth", "place"])

    return docs.select("text", F.xxhash64("doc_id", "text").alias("nth")).mapInArrow(run, "nth long, place array<int>")


def train(p: list[np.ndarray], u: list[np.ndarray], width: int, prior: float, seed: int = 11) -> np.ndarray:
    """Weights of `width` slots from texts given as arrays of distinct slots."""
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(width, np.float64), np.full(width, 1e-3)
    bias, seen_b = 0.0, 1e-3
    n_steps = max(1, len(u) // BATCH)

    def flat(rows):
        return np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows])

    def outputs(ids, n):
        return np.add.reduceat(np.append(w[ids], 0.0), np.minimum(np.cumsum(n) - n, len(ids))) * (n > 0) + bias

    for _ in range(EPOCHS):
        order_u, order_p = rng.permutation(len(u)), rng.integers(0, len(p), n_steps * BATCH)
        for s in range(n_steps):
            ids_p, n_p = flat([p[i] for i in order_p[s * BATCH : (s + 1) * BATCH]])
            ids_u, n_u = flat([u[i] for i in order_u[s * BATCH : (s + 1) * BATCH]])
            g_p, g_u = (1 / (1 + np.exp(-np.clip(outputs(*x), -30, 30))) for x in ((ids_p, n_p), (ids_u, n_u)))
            # logistic loss: as positive log(1 + e^-z), slope g - 1; as negative log(1 + e^z), slope g
            negative = np.mean(-np.log1p(-np.minimum(g_u, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(g_p, 1 - 1e-12)))
            if negative >= 0:
                d_p, d_u = (prior * (g_p - 1) - prior * g_p) / len(g_p), g_u / len(g_u)
            else:
                d_p, d_u = prior * g_p / len(g_p), -g_u / len(g_u)
            ids = np.concatenate([ids_p, ids_u])
            own, place = np.unique(ids, return_inverse=True)
            grad = np.bincount(place, np.concatenate([np.repeat(d_p, n_p), np.repeat(d_u, n_u)]), len(own))
            seen[own] += grad * grad
            rate = RATE / np.sqrt(seen[own])
            moved = w[own] - rate * grad
            w[own] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            grad_b = d_p.sum() + d_u.sum()
            seen_b += grad_b * grad_b
            bias -= RATE / np.sqrt(seen_b) * grad_b
    return w


def score_bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * STEPS) + BINS // 2, 0, BINS - 1).astype(np.int64)


def cut(bins_p: np.ndarray, bins_u: np.ndarray, prior: float) -> float:
    """The cut with the least non-negative risk in errors: missed P by the prior, plus what U has above the cut beyond P's part. The middle of the best stretch.

    bins_p and bins_u: number of texts by score bin.
    """
    above_p, above_u = (1 - np.concatenate([[0], np.cumsum(b)]) / b.sum() for b in (bins_p, bins_u))
    risk = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return (best[len(best) // 2] - BINS // 2) / STEPS


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", positive_rows: int = POSITIVE_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights of all slots and the bias."""
    free = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.filter(free & F.col(column).isin(0, 1)).select(F.col("doc_id").alias("known_id"), F.col(column).alias("known_label"))
    prior = known.agg(F.avg("known_label")).first()[0]
    if not prior:
        return None
    prior = min(max(float(prior), 0.001), 0.9)
    chosen = known.filter("known_label = 1").select("known_id").distinct().orderBy(F.xxhash64("known_id"), "known_id").limit(positive_rows)  # these ids are broadcast
    positive = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id"))
    positive = materialize(positive.orderBy(F.xxhash64("known_id"), "known_id", "text").limit(positive_rows).select("doc_id", "text"), "pu-positive")
    unlabelled = docs.filter(free).select("doc_id", "text")
    (in_p, n_p), (in_u, n_u) = slot_counts(positive), slot_counts(unlabelled)
    if not n_p or not n_u:
        return None
    telling = screen(in_p, n_p, in_u, n_u)
    width = int(telling.sum())
    p = [np.array(x, np.int32) for x in told(positive, telling).toPandas().sort_values("nth", kind="stable")["place"]]
    compact = materialize(told(unlabelled, telling), "pu-unlabelled")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(p)

    def learn(block: pd.DataFrame) -> pd.DataFrame:
        w = train(shared.value, [np.asarray(x, np.int32) for x in block.sort_values("nth")["place"]], width, prior)
        own = np.flatnonzero(w)
        return pd.DataFrame({"place": own.astype(np.int32), "part": w[own] * len(block)})

    block = F.pmod(F.xxhash64("nth"), F.lit(max(1, -(-n_u // block_rows))))
    learned = compact.withColumn("block", block).groupBy("block").applyInPandas(learn, "place int, part double")
    learned = learned.groupBy("place").agg(F.sum(F.round(F.col("part") * (1 << 20)).cast("long")).alias("part")).toPandas()  # whole numbers add up alike in any order
    w = np.zeros(width)
    w[learned["place"]] = learned["part"] / (1 << 20) / n_u
    weights = context.broadcast(w)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            rows = batch.column(0)
            n = np.diff(rows.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            z = np.bincount(owner, weights.value[rows.flatten().to_numpy()], len(n)) if len(owner) else np.zeros(len(n))
            bins += np.bincount(score_bin(z), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(bins)], ["bin", "texts"])

    bins_u = np.zeros(BINS, np.int64)
    found = compact.select("place").mapInArrow(binned, "bin int, texts long").groupBy("bin").agg(F.sum("texts").alias("texts")).toPandas()
    bins_u[found["bin"]] = found["texts"]
    bins_p = np.bincount(score_bin(np.array([w[x].sum() for x in p])), minlength=BINS)
    out = np.zeros(SLOTS, np.float32)
    out[telling] = w
    return out, -cut(bins_p, bins_u, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value or (np.zeros(SLOTS, np.float32), -np.inf)
        used = w != 0
        for batch in batches:
            z = [bias + float(w[slots(t, used)].sum(dtype=np.float64)) for t in batch.column(1).to_pylist()]
            out = [0.0 if x == -np.inf else 1 / (1 + np.exp(-min(max(x, -50.0), 50.0))) for x in z]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
