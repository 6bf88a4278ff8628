"""Operator 5: SimHash near-duplicates with pivot distance tables."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bytes_of, materialise, own
from .components import components

#: A bucket with more members than this is linked through shared neighbours instead of pair by pair.
BUCKET = 64
#: Reference fingerprints: 16 fixed pseudo-random 64-bit values.
PIVOTS = tuple(int(x) for x in np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 16))
_LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit; lane b of the k-th shifted sum counts bit 8 b + k."""
    out = np.zeros(64, np.int64)
    for k in range(8):
        lanes = (h >> np.uint64(k)) & _LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))  # at most 255 in a lane of eight bits
        out[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out


def fingerprint(text: bytes, width: int = 3) -> int:
    """The signed 64-bit SimHash of the shingles of lower-cased words; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64)
    bits = np.flatnonzero(2 * bit_counts(h) > len(h))
    value = sum(1 << int(b) for b in bits)
    return value - (1 << 64) if value >> 63 else value


@F.arrow_udf(LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in bytes_of(text)], pa.int64())


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(fp: Column) -> Column:
    """Six keys: each pair of the four 16-bit blocks, with its number. Of four blocks, two bits leave two untouched."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    return F.array(*[F.shiftleft(block[i], 16).bitwiseOR(block[j]).bitwiseOR(F.shiftleft(F.lit(n).cast("long"), 32)) for n, (i, j) in enumerate(pairs)])


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (`a`, `b`, a < b) among the distinct fingerprints `fp` (column `id`: the class) that connect all pairs within two bits.

    The table of distances to PIVOTS is computed once for each fingerprint and stored. Fingerprints meet in buckets of
    two equal 16-bit blocks, which no pair within two bits escapes. In a bucket of at most `bucket` members, all pairs
    are candidates. Members of larger buckets, which clusters make, meet through common neighbours: two fingerprints
    lie within two bits just if some value lies within one bit of both, so each is sent to its 65 such values and is a
    candidate with the smallest one there. That is linear in the bucket and connects all that its pairs would. Every
    candidate then passes the same test: discarded if any pivot coordinate differs by more than two (the triangle
    inequality), else verified by the exact distance.
    """
    pivots = F.array(*[distance(F.col("fp"), F.lit(p).cast("long")).cast("byte") for p in PIVOTS])
    table = materialise(prints.select("id", "fp", pivots.alias("pivots")), "simhash-pivots")
    keyed = table.select("id", "fp", "pivots", F.explode(block_keys(F.col("fp"))).alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    met = materialise(keyed.join(sizes, "key"), "simhash-members")
    small = met.where(F.col("n") <= bucket).select("key", "id", "fp", "pivots")
    pairs = close(small.toDF("key", "a", "fa", "pa").join(small.toDF("key", "b", "fb", "pb"), "key").where("a < b"))
    hot = met.where(F.col("n") > bucket).select("id", "fp").distinct()
    values = F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)]))
    near = hot.select("id", F.explode(values).alias("value"))
    centres = materialise(near.groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most").drop("most"), "simhash-centres")
    through = near.join(centres, "value").where("a < id").select("a", F.col("id").alias("b")).distinct()
    known = through.join(table.toDF("a", "fa", "pa"), "a").join(table.toDF("b", "fb", "pb"), "b")
    return pairs.unionByName(close(known)).distinct()


def close(pairs: DataFrame) -> DataFrame:
    """The candidate pairs (`a`, `b`, fingerprints `fa`, `fb`, pivot distances `pa`, `pb`) within two bits."""
    spread = F.greatest(*[F.abs(F.get("pa", F.lit(i)) - F.get("pb", F.lit(i))) for i in range(len(PIVOTS))])
    return pairs.where(spread <= 2).where(distance(F.col("fa"), F.col("fb")) <= 2).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Fingerprint and component of every row: `doc_id`, `fingerprint` (16 hexadecimal digits), `component_id`.

    Texts with equal fingerprints are one class; classes within two bits link; `component_id` is the smallest id that
    links reach. Null, empty and blank texts have fingerprint zero and are linked like any other; long ones are read
    whole. Repeated rows get equal results. A class without any id (all null) links to nothing and has no component. An
    empty table gives no rows; other columns are ignored. Only classes meet in buckets, so copies cost one row, and no bucket is capped.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")), "simhash-rows")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    links = near_links(prints.where("id is not null"), bucket)
    roots = components(links)
    classes = prints.join(roots, prints["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    named = rows.join(classes, "fp")
    return named.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, that with the smallest doc_id (null is last).

    Texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more (`similar`). Rows
    are told apart by 96 bits of hashes of all their columns: a null id is judged like any other, rows that share an id
    each by its own text, and of equal rows one stays; between rows of one id and component a hash decides. Null, empty
    and blank texts make up one component. Long texts are compared whole. Empty tables give no rows; the columns are
    those of `docs`, whatever their names.

    No document is copied or exchanged before the last step, where rows meet the keys of those that stay. Keys of which
    a thousandth of all rows are equal copies, at most 1000, are broadcast there, and their copies collapse in each
    task before they meet.
    """
    from .similar import similar_roots, sketch

    whole = docs.select(F.struct(*[own(docs, c) for c in docs.columns]).alias("doc"))
    rows = whole.select("doc", F.xxhash64(hashable(whole)).alias("k1"), F.hash(hashable(whole)).alias("k2"))
    marked = rows.select("k1", "k2", F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), sketch(F.col("doc.text")).alias("s"))
    marked = materialise(marked.select("k1", "k2", "unnamed", "doc_id", "s.id", "s.fp"), "simhash-rows")
    keys = materialise(marked.groupBy(*marked.columns).agg(F.count("*").alias("n")), "simhash-keys")
    roots = similar_roots(rows.select(F.col("doc.text").alias("text")), keys.select("id", "fp").distinct(), bucket)
    placed = keys.join(roots, keys["id"] == roots["node"], "left").select("k1", "k2", "unnamed", "doc_id", "n", F.coalesce("root", "id").alias("root"))
    first = F.min(F.struct("unnamed", "doc_id", "k1", "k2", "n")).alias("first")
    kept = materialise(placed.groupBy("root").agg(first).select("first.k1", "first.k2", "first.n"), "simhash-kept")
    most = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / 1000
    hot = keys.where((F.col("n") > 1) & (F.col("n") >= most)).select("k1", "k2")
    copied = rows.join(F.broadcast(kept.join(F.broadcast(hot), ["k1", "k2"], "left_semi")), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("doc").alias("doc")).select("doc")
    met = rows.join(F.broadcast(hot), ["k1", "k2"], "left_anti").join(kept, ["k1", "k2"])
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("n"))  # sorted by the join already
    single = met.withColumn("nth", nth).where("nth = 1").select("doc")
    return single.unionByName(copied).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def hashable(rows: DataFrame) -> Column:
    """`doc` in a form that can be hashed: as text if it holds maps."""
    return F.to_json("doc") if "map<" in rows.schema["doc"].dataType.simpleString() else F.col("doc")
