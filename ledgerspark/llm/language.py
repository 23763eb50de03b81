"""Language identification of texts that may hold several languages.

A text is a bag of byte n-grams, each drawn from one of the text's languages; expectation-maximisation estimates the share of every language from
the n-grams' likelihoods. Languages are then taken in by falling share as long as the penalised likelihood of the set grows: the gain in
log-likelihood, counted once a byte (n-grams overlap), has to beat half the log of the number of n-grams, so chance n-grams of other languages do not
count. The shares within the selected set are estimated anew; the language with the largest is the text's.

Learned from the text and language of every row that may be learned from: the executors count hashed n-grams of each language, Spark adds the
counts, and the model is one number for each language and slot (256 KB a language), whatever the number of rows.

Defined results: `und` with score 0 where the text is null or has no letter, or where no language was learned; of equal shares the language that sorts first; rows with a null
language or doc_id are not learned from, and a null doc_id is never held out; repeated rows count each and get equal results; texts of any length are read
whole; other columns, whatever their names, are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import gram_slots, held_out

SLOTS, GRAM = 1 << 16, 3
#: Pseudo-count of a slot, most rounds of the estimate and the change of shares at which it ends, and languages counted at once by a task.
SMOOTH, ROUNDS, STILL, AT_ONCE = 0.1, 40, 1e-3, 64
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = "und"


class Model(NamedTuple):
    """languages in order, and for each the likelihood of every slot."""

    languages: list[str]
    likelihood: np.ndarray


def slots(text: str) -> np.ndarray:
    """Slots of the byte n-grams of a lower-cased text, repeats included; ASCII marks and digits count as white space."""
    found = gram_slots(text.lower().encode().translate(LETTERS), (GRAM,), SLOTS)
    return found[0] if found else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        own = [(lang, np.flatnonzero(c)) for lang, c in counts.items()]
        langs = [lang for lang, at in own for _ in range(len(at))]
        places = [at for _, at in own] or [np.zeros(0, np.int64)]
        grams = [counts[lang][at] for lang, at in own] or [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(grams))], ["language", "slot", "grams"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                if len(counts) >= AT_ONCE:
                    yield out()
                    counts.clear()
                counts[lang] = np.zeros(SLOTS, np.int64)
            counts[lang] += np.bincount(slots(text), minlength=SLOTS)
    yield out()


def fit(docs: DataFrame, column: str = "lang") -> Model | None:
    """Likelihoods from all rows that may be learned from; None without any."""
    lang = F.col(f"`{column}`")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & lang.isNotNull() & F.col("text").isNotNull()).select(lang.alias("language"), "text")
    found = known.mapInArrow(_counted, "language string, slot int, grams long").groupBy("language", "slot").agg(F.sum("grams").alias("grams")).toPandas()  # languages * SLOTS rows at most
    languages = sorted(found["language"].unique())
    if not languages:
        return None
    counts = np.full((len(languages), SLOTS), SMOOTH)
    counts[found["language"].map({x: k for k, x in enumerate(languages)}), found["slot"]] += found["grams"]
    return Model(languages, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def estimate(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of likelihood) in n-grams of which n were found each, and the log-likelihood at these shares."""
    total = n.sum()
    share = np.full(len(likelihood), 1 / len(likelihood))
    for _ in range(ROUNDS if len(likelihood) > 1 else 0):
        new = share * (likelihood @ (n / (share @ likelihood))) / total
        change = np.abs(new - share).max()
        share = new
        if change < STILL:
            break
    return share, float(n @ np.log(share @ likelihood))


def mixture(text: str | None, model: Model) -> list[tuple[str, float]]:
    """The selected languages of a text with their shares, the largest first; [] where none can be told."""
    if not text or not regex.search(r"\p{L}", text):
        return []
    own, n = np.unique(slots(text), return_counts=True)
    likelihood = model.likelihood[:, own].astype(np.float64)
    n = n.astype(np.float64)
    order = np.argsort(-estimate(likelihood, n)[0], kind="stable")
    price = GRAM * np.log(n.sum() + 1) / 2
    single = int(np.argmax(np.log(likelihood) @ n))
    chosen = [single]
    share, level = estimate(likelihood[chosen], n)
    for k in order:
        if k == single:
            continue
        more, gained = estimate(likelihood[[*chosen, k]], n)
        if gained - level <= price:
            break
        chosen, share, level = [*chosen, int(k)], more, gained
    return sorted(((model.languages[k], float(min(s, 1.0))) for k, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the mixture (language, share) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [mixture(t, m) if m else [] for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()),
                pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()),
                pa.array([[{"language": a, "share": b} for a, b in x] for x in found], kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "mixture"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<language:string,share:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
