"""Operator 11: importance resampling towards a target distribution of hashed word n-grams.

Every piece of text that a task holds gets an integer dictionary of its distinct words; its n-grams are tuples of these
integers, each distinct tuple is put back into bytes and hashed once, and the bucket goes back to all its occurrences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise, own, pieces

#: Letters and digits of ASCII and every other byte make words; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text for which one dictionary is made.
PIECE = 4_000_000


class Dictionary(dict):
    """Word -> number, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def grams(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of 1 to `longest` words: the text each is of, and its bucket; and the number of words of each text."""
    numbers = Dictionary()
    lists = [[numbers[w] for w in t.translate(FOLD).split()] for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for ws in lists for i in ws), np.int64, int(lengths.sum()))
    words, owner = list(numbers), np.repeat(np.arange(len(lists)), lengths)
    # the distinct runs of each length, by number: the run without its last word, then the last word
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    run, owners, found = ids, [owner], [crc[ids] % buckets]
    texts_of_runs = words
    for n in range(2, longest + 1):
        if len(ids) < n:
            break
        same = owner[n - 1 :] == owner[: len(ids) - n + 1]
        key = run[:-1] * len(words) + ids[n - 1 :]
        distinct, where = np.unique(key[same], return_inverse=True)
        first, last = distinct // len(words), distinct % len(words)
        texts_of_runs = [texts_of_runs[a] + b" " + words[b] for a, b in zip(first.tolist(), last.tolist())]
        crc = np.fromiter(map(zlib.crc32, texts_of_runs), np.int64, len(distinct))
        owners.append(owner[: len(ids) - n + 1][same])
        found.append(crc[where] % buckets)
        run = np.full(len(key), -1)  # runs past the end of a text have no number, and are not met again
        run[same] = where
    return np.concatenate(owners), np.concatenate(found), lengths


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """`bucket`, `n`: occurrences of n-grams by bucket; tasks add up arrays of fixed size first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            held = bytes_of(b.column(0))
            for i, j in pieces(held, PIECE):
                total += np.bincount(grams(held[i:j], longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """The gain of every bucket, in whole thousandths: `buckets` numbers, whatever the input."""
    source, wanted = (bucket_counts(t, longest, buckets) for t in (docs, target))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]).toPandas()
    s, t = both["s"].to_numpy(np.float64), both["t"].to_numpy(np.float64)
    out = np.zeros(buckets, np.int64)
    out[both["bucket"].to_numpy()] = np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))))
    return out


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, from the first 32 bits of a SHA-256 of seed and id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row `doc_id`, `n_words`, `n_features`, `weight`, `score`, stored."""
    rows = docs.select(own(docs, text_col).cast("string").alias("text"), own(docs, id_col).alias("doc_id"))
    known = docs.sparkSession.sparkContext.broadcast(gains(rows.select("text"), target.select(own(target, target_col).cast("string").alias("text")), longest, buckets))

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(text: pa.Array) -> pa.Array:
        out, texts = [], bytes_of(text)
        for i, j in pieces(texts, PIECE):
            owner, bucket, n_words = grams(texts[i:j], longest, buckets)
            n = np.bincount(owner, minlength=j - i)
            # sums of whole numbers below 2^53, which doubles hold exactly
            total = np.bincount(owner, known.value[bucket], minlength=j - i).astype(np.int64)
            out.append((n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
        columns = [pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    scored = rows.select("doc_id", weigh("text").alias("w")).select("doc_id", "w.*")
    return materialise(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance")


def ranked(rows: DataFrame, drawn: Column) -> DataFrame:
    """Number the rows that are drawn from 1 by descending score, then ascending doc_id (null last), over range-sorted parts.

    Rows equal in score and id get neighbouring ranks; a random last key lets many of them be sorted by several tasks.
    """
    chosen = rows.where(drawn).withColumn("tie", F.rand(11))
    keys = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))
    placed = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "importance-ranks")  # a row's part and its place in it
    part = F.shiftright("at", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a task
    before, rows_before = 0, []
    for p, n in counts:
        rows_before.append((p, before))
        before += n
    begun = placed.sparkSession.createDataFrame(rows_before, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(begun), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, "rank")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draw `percent` of the documents with at least `least` words, without replacement, towards the target's n-grams.

    Per row of docs: `doc_id`, `n_features`, `weight`, `score`, `rank` (null if not drawn), `n_words`. Highest scores first,
    ties to the smaller doc_id; a null doc_id is hashed as an empty one and comes last among ties; repeated rows are each
    weighed, and may each be drawn, in any order among themselves. Null and empty texts have no features and weight 0, long
    ones are read whole, piece by piece of about PIECE bytes (a longer text is a piece). An empty target gives every bucket
    the gain of one that was never seen; empty docs give no rows. Other columns are ignored.

    Two scans of the texts, of which none is exchanged: counts of `buckets` buckets leave each task, then a narrow row a
    document. Scores are whole thousandths within a fixed range, so a histogram of them (some ten thousand rows) says which rows
    can be drawn; only these are sorted.
    """
    rows = weighed(docs, target, longest, buckets, seed, id_col, text_col, target_col)
    fit = F.col("n_words") >= least
    histogram = sorted(((r.score, r.n) for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota = percent * sum(n for _, n in histogram) // 100
    lowest, above = None, 0
    for score, n in histogram:
        if above >= quota:
            break
        lowest, above = score, above + n
    out = ("doc_id", "n_features", "weight", "score", "rank", "n_words")
    none = F.lit(None).cast("long")
    if lowest is None:
        return rows.withColumn("rank", none).select(*out)
    can = fit & (F.col("score") >= lowest)
    first = ranked(rows, can).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return first.unionByName(rows.where(~can).withColumn("rank", none)).select(*out)
