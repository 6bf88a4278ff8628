"""Operator 4: factorisation machine for document quality."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bytes_of, least_hashed, materialise, pieces, remainder

#: Bytes of text in a training sample.
MOST_BYTES = 1 << 26
#: Hashed words take the indices below WORDS; every statistic then has BINS one-hot indices.
WORDS, BINS, RANK = 1 << 15, 16, 8
SYMBOLS, MARKS, DIGITS = b"#*$%&|<>", b".,;:!?", b"0123456789"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
STATISTICS = ("symbols", "marks", "digits", "upper", "lower", "bars", "shouts", "lines", "repeats", "distinct", "word_length", "words", "recorded_chars")
DIMENSIONS = WORDS + BINS * len(STATISTICS)
_memo = WordHashes(seed=4)


def share_bin(share: float) -> int:
    """Bins 0 to 15 of a share, on a logarithmic scale between 0.001 and 1."""
    return 0 if share <= 0 else int(min(15, max(1, 15 + np.log(min(share, 1.0)) * 2.05)))


def size_bin(n: float) -> int:
    return int(min(15, np.log2(n + 1)))


def statistics(text: bytes, words: list[bytes], distinct: int, repeats: int, recorded: int | None) -> list[int]:
    """The bin of each of STATISTICS; a missing recorded length has bin 15."""
    n, size = max(1, len(words)), max(1, len(text))

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    return [
        share_bin(share(SYMBOLS)), share_bin(share(MARKS)), share_bin(share(DIGITS)), share_bin(share(UPPER)), share_bin(share(LOWER)), share_bin(share(b"|")),
        share_bin(text.count(b"!!") / n), share_bin(text.count(b"\n") / n), share_bin(repeats / n), share_bin(distinct / n),
        min(15, size // n), size_bin(len(words)), 15 if recorded is None else min(14, size_bin(max(0, recorded))),
    ]


@dataclass
class Rows:
    """Sparse rows: row r has the entries ends[r-1] to ends[r]; none is empty, as every text has its statistics."""

    ends: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])


def features(texts: list[bytes], recorded: list[int | None]) -> Rows:
    """Hashed words with values sqrt(count / words), and the one-hot statistics with a common small value."""
    lists = [t.split() for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((_memo[w] for ws in lists for w in ws), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(lists)), lengths)
    key, counts = np.unique(owner * WORDS + (flat % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    doc, index = key // WORDS, key % WORDS
    distinct = np.bincount(doc, minlength=len(lists))
    same = np.flatnonzero((flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])) if len(flat) else np.zeros(0, np.int64)
    repeats = np.bincount(owner[same], minlength=len(lists))
    bins = np.array([statistics(t, ws, d, r, n) for t, ws, d, r, n in zip(texts, lists, distinct.tolist(), repeats.tolist(), recorded)], np.int64).reshape(-1, len(STATISTICS))
    hot = (WORDS + np.arange(len(STATISTICS)) * BINS + bins).ravel()
    docs = np.concatenate([doc, np.repeat(np.arange(len(lists)), len(STATISTICS))])
    order = np.argsort(docs, kind="stable")
    value = np.concatenate([np.sqrt(counts / lengths[doc]), np.full(len(hot), 0.5)])
    ends = np.cumsum(np.bincount(docs, minlength=len(lists)))
    return Rows(ends, np.concatenate([index, hot])[order], value[order].astype(np.float32))


@dataclass
class Machine:
    """bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: Rows) -> np.ndarray:
        """The pairs in linear time: half of (square of the sum - sum of the squares), factor by factor."""
        x = rows.value
        scaled = self.factors[rows.index] * x[:, None]
        sums = np.add.reduceat(scaled, rows.starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, rows.starts, axis=0)
        linear = np.add.reduceat(self.linear[rows.index] * x, rows.starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows).astype(np.float64), -30, 30)))


def fit(rows: Rows, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, penalty: float = 1e-4, seed: int = 4) -> Machine:
    """Logistic loss by Adagrad over shuffled mini-batches. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(DIMENSIONS, np.float32), rng.normal(0, 0.05, (DIMENSIONS, RANK)).astype(np.float32))
    if not len(labels):
        return Machine(0.0, m.linear, np.zeros_like(m.factors))
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    g_bias, g_linear, g_factors = 1e-6, np.full(DIMENSIONS, 1e-6, np.float32), np.full((DIMENSIONS, RANK), 1e-6, np.float32)
    starts, ends = rows.starts, rows.ends
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for chosen in np.array_split(order, -(-len(order) // batch)):
            at = np.concatenate([np.arange(starts[d], ends[d]) for d in chosen])
            own = Rows(np.cumsum(ends[chosen] - starts[chosen]), rows.index[at], rows.value[at])
            x, doc = own.value, np.repeat(np.arange(len(chosen)), ends[chosen] - starts[chosen])
            error = ((m.scores(own) - labels[chosen]) / len(chosen)).astype(np.float32)
            v = m.factors[own.index]
            sums = np.add.reduceat(v * x[:, None], own.starts, axis=0)
            used, where = np.unique(own.index, return_inverse=True)
            step = np.zeros((len(used), RANK + 1), np.float32)
            pull = error[doc] * x
            np.add.at(step, where, np.concatenate([pull[:, None], pull[:, None] * (sums[doc] - v * x[:, None])], axis=1))
            step[:, 0] += penalty * m.linear[used]
            step[:, 1:] += penalty * m.factors[used]
            g_linear[used] += step[:, 0] ** 2
            g_factors[used] += step[:, 1:] ** 2
            m.linear[used] -= rate * step[:, 0] / np.sqrt(g_linear[used])
            m.factors[used] -= rate * step[:, 1:] / np.sqrt(g_factors[used])
            g_bias += error.sum() ** 2
            m.bias -= float(rate * error.sum() / np.sqrt(g_bias))
    return m


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int, most: int, columns: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """At most `most` labelled documents for training, with `label`: those with the smallest hashes of doc_id, a row each.

    Documents whose remainder is `held` never enter. The sample's size is the bound that lets it be broadcast to the scan.
    Of the rows of one doc_id the one with the smallest hash of its text serves, found by partial aggregates, so that an
    id with many rows counts as one. Texts of more than a sixteenth of `most_bytes` are left out, and so are the last
    documents by hash if all have more than `most_bytes`. The first of `columns` is the text.
    """
    text, mark = F.octet_length(F.coalesce(columns[0], F.lit(""))), F.xxhash64("doc_id")
    wanted = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & (remainder(F.col("labelled_id"), modulus) != held))
    chosen = least_hashed(wanted.groupBy("labelled_id").agg(F.min("label").alias("label")), most, "labelled_id")
    rows = docs.select("doc_id", *columns).where(text <= most_bytes // 16).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    least = F.min(F.struct(F.xxhash64(columns[0]).alias("h"), *columns, "label")).alias("least")
    sample = materialise(rows.groupBy("doc_id").agg(least).select("doc_id", *[f"least.{c}" for c in (*columns, "label")]), "training-sample")
    sizes = sample.select(mark.alias("mark"), text.alias("bytes")).toArrow().sort_by("mark")  # at most `most` rows of two numbers
    fit_in = int((np.cumsum(sizes["bytes"].to_numpy().astype(np.int64)) <= most_bytes).sum())
    return sample if fit_in == len(sizes) else sample.where(mark < sizes["mark"][fit_in].as_py())


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, most: int = 6000) -> Machine:
    """Fit the machine on at most `most` labelled documents; executors hash the texts, the driver sees sparse rows."""

    def sparse(batches):
        for b in batches:
            texts, recorded, label = bytes_of(b.column("text")), b.column("n_chars").to_pylist(), b.column("label")
            for i, j in pieces(texts):
                r = features(texts[i:j], recorded[i:j])
                entries = [pa.array(np.split(a, r.ends[:-1]), pa.list_(t)) for a, t in ((r.index.astype(np.int32), pa.int32()), (r.value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), label.slice(i, j - i).cast(pa.float64()), *entries], ["doc_id", "label", "index", "value"])

    sample = training_sample(docs, labels, "quality", modulus, held, most, ["text", "n_chars"])
    got = sample.mapInArrow(sparse, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label double, index array<int>, value array<float>").toArrow().sort_by("doc_id")
    index, value = got["index"].combine_chunks(), got["value"].combine_chunks()
    sizes = np.diff(index.offsets.to_numpy()) if len(index) else np.zeros(0, np.int64)
    return fit(Rows(np.cumsum(sizes), index.values.to_numpy(), value.values.to_numpy()), got["label"].to_numpy())


def scorer(docs: DataFrame, machine: Machine):
    """A column function (text, n_chars) -> score; the machine is DIMENSIONS x (RANK + 1) floats, whatever the input."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        texts, recorded = bytes_of(text), n_chars.to_pylist()
        out = [model.value.scores(features(texts[i:j], recorded[i:j])) for i, j in pieces(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 6000) -> DataFrame:
    """Score every whole text: `doc_id`, `held_out`, `score`, `predicted`.

    Inputs of a score are hashed words, structure statistics and the recorded length `n_chars`; never labels, lang,
    source or doc_id. Training takes at most `most` labelled documents (and MOST_BYTES of text) whose crc32(doc_id) mod 5
    is not 0 (repeated labels of a document: the smallest; several rows of one doc_id: one of them). Null and empty texts, and null n_chars, are scored like others. A null doc_id is
    scored and not held out. Repeated rows are scored each, long texts whole; empty tables give no rows; other columns
    are ignored; no labels: all scores 0.5.
    """
    score = scorer(docs, train(docs, labels, most=most))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), F.col("n_chars").cast("long")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 6000) -> DataFrame:
    """The documents that the machine accepts, with their own columns.

    Scores are those of `quality_scores`, whose cases apply: null, empty and long texts and rows with a null doc_id are
    judged like others, repeated rows each alike; without labels all stay. Empty tables give no rows.
    """
    score = scorer(docs, train(docs, labels, most=most))
    keep: Column = score(F.col("text"), F.col("n_chars").cast("long")) >= threshold
    return docs.where(keep)
