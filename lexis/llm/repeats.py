"""Operator 8: passages that repeat across documents, by a sparse suffix array over minimisers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Once, WordHashes, bitmap, bytes_of, inside, materialise, own, pieces

#: Words whose hash selects a suffix, and the number of consecutive candidates of which the least one is retained.
SEED, REACH = 8, 24
_memo = WordHashes(seed=8)
_PRIME = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every n consecutive values, put together from runs of doubling length."""
    out, done, run, size = None, 0, h, 1
    while True:
        if n & size:
            power = np.uint64(pow(_PRIME, size, 1 << 64))
            if out is None:
                out = run
            else:
                shifted = run[done:]
                out = out[: len(shifted)] * power + shifted
            done += size
        if done == n:
            return mixed(out)
        power = np.uint64(pow(_PRIME, size, 1 << 64))
        run = run[: max(0, len(run) - size)] * power + run[size:]
        size *= 2


def least_ahead(h: np.ndarray, reach: int) -> np.ndarray:
    """For each position with `reach` values ahead, the position of the least of them; the first of equal ones."""
    n = len(h) - reach + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size < reach:
        step = min(size, reach - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        size += step
    return at[:n]


def anchors(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of `length` words its retained position, and for each position the hash of the suffix's first
    words, of which every passage on it holds length - REACH + 1."""
    common = length - REACH + 1
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    seeds = run_hashes(h, SEED)
    return least_ahead(seeds[: len(words) - common + 1], REACH)[: len(words) - length + 1], run_hashes(h, common)


def long_texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of each text of `length` words or more."""
    texts = bytes_of(batch.column(1))
    for i, j in pieces(texts):
        for k in range(i, j):
            words = texts[k].split()
            if len(words) >= length:
                yield k, words


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """`prefix`, `doc_id` of each retained suffix; equal ones of a row come once."""

    def scan(batches):
        for b in batches:
            owner, prefix = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, words in long_texts(b, length):
                chosen, firsts = anchors(words, length)
                own = np.unique(firsts[np.unique(chosen)])
                owner.append(np.full(len(own), k))
                prefix.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix).view(np.int64)), b.column(0).take(pa.array(np.concatenate(owner)))], ["prefix", "doc_id"])

    return docs.mapInArrow(scan, f"prefix long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def shared_prefixes(docs: DataFrame, length: int) -> DataFrame:
    """`h`: the prefixes that suffixes of several documents have, by comparing neighbours of the sorted suffixes.

    The sort is by prefix and document over ranges of both, so a prefix of very many documents spans several tasks; the
    first and last suffix of each task are compared once more, among the tasks.
    """
    ordered = materialise(suffixes(docs, length), "repeat-suffixes").repartitionByRange("prefix", "doc_id").sortWithinPartitions("prefix", "doc_id")

    def compare(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                yield pa.RecordBatch.from_arrays([*b.slice(0, 1).columns, pa.array([True])], names)
            joined = pa.Table.from_batches([*([] if last is None else [last]), b]).combine_chunks()
            prefix, doc = joined["prefix"].combine_chunks(), joined["doc_id"].combine_chunks()
            differ = pc.and_(pc.equal(prefix[1:], prefix[:-1]), pc.not_equal(doc[1:], doc[:-1]))
            found = pc.unique(prefix[1:].filter(differ))
            last = b.slice(b.num_rows - 1)
            yield pa.RecordBatch.from_arrays([found, pa.nulls(len(found), doc.type), pa.array([False] * len(found), pa.bool_())], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([True])], names)

    names = ["prefix", "doc_id", "border"]
    compared = materialise(ordered.mapInArrow(compare, f"prefix long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, border boolean"), "repeat-neighbours")
    across = compared.where("border").groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return materialise(compared.where("not border").select("prefix").unionByName(across.select("prefix")).distinct().withColumnRenamed("prefix", "h"), "repeat-prefixes")


def extended(docs: DataFrame, length: int, among: Broadcast, passages: bool = False) -> DataFrame:
    """The suffixes whose prefix is in the bitmap `among`, extended left and right by the words of the text to all passages
    on their position: `prefix`, `stretch` (128 bits of the words from the first passage to the end of the last, and of
    the position in it) and `doc_id`, `begin` (of the first passage), `n` (of passages); or, with `passages`, 64 bits of
    the words of each, once for each stretch that a task meets.
    """
    schema = [("prefix", pa.int64()), ("stretch", pa.binary()), ("begin", pa.int32()), ("n", pa.int32()), ("passages", pa.list_(pa.int64()))]
    schema = [x for x in schema if x[0] in (("prefix", "stretch", "passages") if passages else ("prefix", "stretch", "begin", "n"))]

    def scan(batches):
        met = Once()
        for b in batches:
            for part in range(0, b.num_rows, 500):
                some = b.slice(part, 500)
                owner, rows = [], []
                for k, words in long_texts(some, length):
                    chosen, firsts = anchors(words, length)
                    at, begins, counts = np.unique(chosen, return_index=True, return_counts=True)
                    hit = inside(among.value, firsts[at])
                    if not hit.any():
                        continue
                    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    starts, ends = [0, *ends[:-1].tolist()], (ends - 1).tolist()
                    for p, begin, n in zip(at[hit].tolist(), begins[hit].tolist(), counts[hit].tolist()):
                        key = xxhash.xxh3_128_digest(line[starts[begin] : ends[begin + n + length - 2]] + b" %d" % (p - begin))
                        row = (int(firsts[p].view(np.int64)), key)
                        if not passages:
                            rows.append((*row, begin, n))
                            owner.append(k)
                        elif met.new(key):
                            own = [xxhash.xxh3_64_intdigest(line[starts[x] : ends[x + length - 1]]) for x in range(begin, begin + n)]
                            rows.append((*row, np.array(own, np.uint64).view(np.int64)))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(schema), schema)]
                ids = [] if passages else [some.column(0).take(pa.array(owner, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *ids], [n for n, _ in schema] + ["doc_id"] * len(ids))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, "prefix long, stretch binary, passages array<long>" if passages else f"prefix long, stretch binary, begin int, n int, doc_id {kind}")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Maximal runs of words, each of whose stretches of `length` words stands in another document too.

    1. Suffixes are retained at minimiser positions only: of every REACH consecutive words, where the hash of the next
       SEED words is least. Every passage of `length` words holds such a position, at the same place in each copy, with
       at least length - REACH + 1 of its words from there on.
    2. The suffixes are sorted by these words, and neighbours of different documents compared (`shared_prefixes`).
    3. Those that agree are extended left and right by the words of the text to all passages on their position
       (`extended`). Equal stretches collapse; where different ones share a prefix, their passages are compared, by the
       prefix and their own words, 128 bits in all.

    Nothing is lost by the sparseness, and a stretch costs one row however many documents share it. Returns
    `doc_id`, `begin`, `end` (words, end exclusive), `n_words`, `other_doc_id` (the smallest document with a part of
    the span, or the largest if this is the smallest). Words are runs without ASCII white space. Documents without
    repeats have no row. Null and short texts have none, long ones are read whole; rows of one doc_id count as one
    document, and rows without doc_id are left out. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(own(docs, id_col).alias("doc_id"), own(docs, text_col).alias("text")).where("doc_id is not null")
    share = docs.sparkSession.sparkContext.broadcast
    members = materialise(extended(rows, length, share(bitmap(shared_prefixes(rows, length)))), "repeat-members")
    stretches = materialise(members.groupBy("prefix", "stretch").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n").alias("n")), "repeat-stretches")
    several = materialise(stretches.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "repeat-several")
    lone = stretches.join(several, "prefix", "left_anti").where("least < most")
    alone = lone.select("prefix", "stretch", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), F.array(F.struct("least", "most")).alias("ends"))
    # Stretches that share their prefix with others are compared passage by passage.
    lists = extended(rows, length, share(bitmap(several.withColumnRenamed("prefix", "h"))), True).groupBy("prefix", "stretch").agg(F.first("passages").alias("passages"))
    mixed = materialise(stretches.join(several, "prefix").drop("n").join(lists, ["prefix", "stretch"]), "repeat-mixed")
    each = mixed.select("prefix", "stretch", "least", "most", F.posexplode("passages").alias("i", "passage"))
    known = materialise(each.groupBy("prefix", "passage").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most"), "repeat-shared")
    met = each.select("prefix", "stretch", "i", "passage").join(known, ["prefix", "passage"])
    # The passages of a stretch lie so close that those in between are covered too.
    runs = met.groupBy("prefix", "stretch").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.collect_set(F.struct("least", "most")).alias("ends"))
    runs = materialise(alone.unionByName(runs), "repeat-runs")
    other = F.array_min(F.transform("ends", lambda x: F.when(x["least"] == F.col("doc_id"), x["most"]).otherwise(x["least"])))
    matches = members.drop("n").join(runs, ["prefix", "stretch"]).select("doc_id", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high")).alias("last"), other.alias("other"))
    by_place = Window.partitionBy("doc_id").orderBy("begin")
    before = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.withColumn("opens", F.when(F.col("begin") <= before + length, 0).otherwise(1)).withColumn("span", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        spans.groupBy("doc_id", "span")
        .agg(F.min("begin").alias("begin"), (F.max("last") + length).alias("end"), F.min("other").alias("other_doc_id"))
        .select(F.col("doc_id").alias(id_col), "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "other_doc_id")
    )
