"""Operator 7: FTRL-proximal logistic regression for toxicity."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bytes_of, pieces, remainder
from .quality import training_sample

DIMENSIONS = 1 << 20
#: Letters and digits of ASCII and every other byte make words; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_memo = WordHashes(seed=7)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of every hashed word, pair of neighbours, and pair with one word between, occurrence by occurrence."""
    lists = [t.translate(FOLD).split() for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter((_memo[w] for ws in lists for w in ws), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(lists)), lengths)
    parts = [(owner, h)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            inside = owner[gap:] == owner[:-gap]
            mixed = (h[:-gap] * np.uint64(salt)) ^ (h[gap:] + np.uint64(salt >> 7))
            mixed ^= mixed >> np.uint64(29)
            parts.append((owner[:-gap][inside], (mixed * np.uint64(0xBF58476D1CE4E5B9))[inside]))
    docs = np.concatenate([p[0] for p in parts])
    return docs, (np.concatenate([p[1] for p in parts]) >> np.uint64(44)).astype(np.int64)


@dataclass
class Weights:
    """The coordinates that L1 left, ascending, and their weights."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        out[self.index] = self.weight
        return out


def scores(texts: list[bytes], bias: float, dense: np.ndarray) -> np.ndarray:
    """A feature counts once a text, however often it occurs."""
    docs, index = grams(texts)
    hit = np.flatnonzero(dense[index])
    key = np.unique(docs[hit] * DIMENSIONS + index[hit])
    margin = bias + np.bincount(key // DIMENSIONS, dense[key % DIMENSIONS], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, seed: int = 7) -> Weights:
    """FTRL-proximal: every coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients)).

    The default L1 strength grows with the root of the number of rows, as the noise in a coordinate's sum does.
    """
    l1 = 0.042 * len(rows) ** 0.5 if l1 is None else l1
    z, n, rng = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.random.default_rng(seed)
    bias, g_bias = 0.0, 1.0
    if len(labels):
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for d in rng.permutation(len(rows)):
            at = rows[d]
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - labels[d]
            sigma = (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / alpha
            z[at] += error - sigma * w
            n[at] += error * error
            g_bias += error * error
            bias -= 0.05 * error / np.sqrt(g_bias)
    w = weights(slice(None))
    kept = np.flatnonzero(w)
    return Weights(float(bias), kept, w[kept].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, most: int = 14_000) -> Weights:
    """Fit on at most `most` labelled documents; executors hash the n-grams, the driver sees distinct indices."""

    def sparse(batches):
        for b in batches:
            texts = bytes_of(b.column("text"))
            for i, j in pieces(texts):
                owner, index = grams(texts[i:j])
                key = np.unique(owner * DIMENSIONS + index)
                ends = np.cumsum(np.bincount(key // DIMENSIONS, minlength=j - i))
                lists = pa.array(np.split((key % DIMENSIONS).astype(np.int32), ends[:-1]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("label").slice(i, j - i).cast(pa.float64()), lists], ["doc_id", "label", "index"])

    sample = training_sample(docs, labels, "toxic", modulus, held, most, ["text"])
    got = sample.mapInArrow(sparse, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label double, index array<int>").toArrow().sort_by("doc_id")
    lists = got["index"].combine_chunks()
    rows = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    return ftrl(rows, got["label"].to_numpy())


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 14_000) -> DataFrame:
    """Score every whole text: `doc_id`, `held_out`, `score`, `predicted`.

    Inputs of a score are the hashed n-grams and skip-grams of the text alone. Training takes at most `most` labelled
    documents (and MOST_BYTES of text) whose crc32(doc_id) mod 4 is not 2 (repeated labels of a document: the smallest; several rows of one doc_id: one of them). Null and empty texts score
    the bias, long ones are read whole. A null doc_id is scored and not held out. Repeated rows are scored each; empty
    tables give no rows; other columns are ignored; without labels all scores are 0.5. The broadcast weights are at most DIMENSIONS floats, few after L1.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most=most))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = model.value.dense()
        for text in batches:
            texts = bytes_of(text)
            out = [scores(texts[i:j], model.value.bias, dense) for i, j in pieces(texts)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
