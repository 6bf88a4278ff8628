"""Pairs of texts with similar sets of word shingles, for the near-dedup stage of the corpus pipeline."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .common import Once, WordHashes, bitmap, bytes_of, inside, materialise
from .components import components
from .simhash import BUCKET, fingerprint, near_links

#: Words in a shingle, and the least Jaccard similarity of near-duplicates as a fraction.
WIDTH, OVER, UNDER = 5, 4, 5
#: Bands of a MinHash signature and values in a band. A pair of similarity s shares a band but for a chance of
#: (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above.
BANDS, ROWS = 32, 4
#: Longs in the parity sketch of a set.
LONGS = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SCALE, _SHIFT = (np.random.default_rng(k).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (51, 52))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of runs of WIDTH lower-cased words; a shorter text is one run, one without words none."""
    words = text.lower().split()
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = min(WIDTH, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = out * _FACTOR + h[k : k + len(out)]
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is at least OVER / UNDER; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def digest(text: bytes) -> bytes:
    """128 bits for a text in lower case; all blank ones share theirs."""
    low = text.lower()
    return xxhash.xxh3_128_digest(low) if low and not low.isspace() else bytes(16)


@F.arrow_udf(StructType([StructField("id", BinaryType()), StructField("fp", LongType())]))
def sketch(text: pa.Array) -> pa.Array:
    """The digest of a text and its five-word SimHash."""
    texts = bytes_of(text)
    ids, prints = [digest(t) for t in texts], [fingerprint(t, WIDTH) for t in texts]
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(prints, pa.int64())], ["id", "fp"])


def tag(key: bytes) -> int:
    """64 bits of a digest, as xxhash64() makes them of the column."""
    return xxhash.xxh64_intdigest(key, 42)


def signature(own: np.ndarray, step: int = 128) -> np.ndarray:
    """For each of BANDS * ROWS hash functions the least value of a set."""
    least, held = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.empty((step, BANDS * ROWS), np.uint64)
    for k in range(0, len(own), step):
        some = own[k : k + step, None]
        values = np.multiply(some, _SCALE, out=held[: len(some)])
        values += _SHIFT
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(texts: DataFrame) -> DataFrame:
    """`h` (64 bits of a band's number and values) and `tag` (64 bits of the digest) for each band of every text; texts
    without words have none."""

    def scan(batches):
        hashes, met = WordHashes(), Once()
        for batch in batches:
            keys, tags = [], []
            for text in bytes_of(batch.column(0)):
                key = digest(text)
                if met.new(key) and len(own := shingles(text, hashes)):
                    line = signature(own).reshape(BANDS, ROWS)
                    keys += [xxhash.xxh3_64_intdigest(values.tobytes(), seed=i) for i, values in enumerate(line)]
                    tags += [tag(key)] * BANDS
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (keys, tags)], ["h", "tag"])

    return texts.select("text").mapInArrow(scan, "h long, tag long")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`id`, `text` of the texts in the pairs (and the few that share their bits in a bitmap); only these are exchanged."""
    ids = pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("h"))
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(ids))

    def scan(batches):
        met = Once()
        for batch in batches:
            column = batch.column(0)
            keys = [digest(t) for t in bytes_of(column)]
            held = np.flatnonzero(inside(wanted.value, np.fromiter(map(tag, keys), np.uint64, len(keys)))).tolist()
            taken = [i for i in held if met.new(keys[i])]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in taken], pa.binary()), column.take(pa.array(taken, pa.int64()))], ["id", "text"])

    return materialise(texts.select("text").mapInArrow(scan, "id binary, text string").groupBy("id").agg(F.first("text").alias("text")), "similar-texts")


def parities(own: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: bit b says whether an odd number of its members falls into slot b.

    The sketches of two sets differ in at most as many bits as the sets have members apart.
    """
    slots = (own * _FACTOR >> np.uint64(64 - (64 * LONGS - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64)


def sketches_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """`id`, `size` of the set of shingles and its parity sketch `s0`, `s1`, ... for the texts with these ids (and the few that
    share their bits in a bitmap)."""
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("h"))))
    names = ["size", *[f"s{k}" for k in range(LONGS)]]

    def scan(batches):
        hashes, met = WordHashes(), Once()
        for batch in batches:
            keys, rows = [], [np.zeros((0, 1 + LONGS), np.int64)]
            for text in bytes_of(batch.column(0)):
                key = digest(text)
                if inside(wanted.value, np.array([tag(key)], np.uint64))[0] and met.new(key):
                    own = shingles(text, hashes)
                    keys.append(key)
                    rows.append(np.concatenate([[len(own)], parities(own)])[None])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, np.concatenate(rows).T)], ["id", *names])

    return texts.select("text").mapInArrow(scan, "id binary, " + ", ".join(f"{n} long" for n in names)).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) whose texts are alike."""

    @F.arrow_udf(BooleanType())
    def near(one: pa.Array, other: pa.Array) -> pa.Array:
        hashes = WordHashes()
        return pa.array([alike(shingles(x, hashes), shingles(y, hashes)) for x, y in zip(bytes_of(one), bytes_of(other))], pa.bool_())

    chosen = texts_of(pairs, texts)
    left, right = chosen.select(F.col("id").alias("a"), F.col("text").alias("one")), chosen.select(F.col("id").alias("b"), F.col("text").alias("other"))
    return pairs.join(right, "b").join(left, "a").where(near("one", "other")).select("a", "b")


def similar_roots(texts: DataFrame, prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`node`, `root` for every text that has another one with a Jaccard similarity of OVER / UNDER or more.

    `texts` has `text`, `prints` the distinct `id` (digest) and `fp` (SimHash) of them. Texts meet where SimHash finds
    them within two bits and where they share a band of their MinHash signatures, and are linked if the whole sets
    of shingles, compared exactly, are similar enough. In a bucket, three steps link them: each text with the one smallest
    text that it meets anywhere; then, of each component in a bucket, the smallest text with the bucket's smallest;
    then all texts of a bucket that are still apart. The first two are linear in a cluster of near copies. The third
    leaves out the pairs that parity sketches tell apart: sets of a similarity of OVER / UNDER differ in a ninth of their two
    sizes at most, and so their sketches in no more bits. No similar pair is lost by that.
    """
    firsts = materialise(prints.groupBy("fp").agg(F.min("id").alias("id")), "similar-firsts")
    equal = prints.join(firsts.withColumnRenamed("id", "a"), "fp").where("a < id").select("a", F.col("id").alias("b"))
    keyed = materialise(bands(texts), "similar-bands")
    shared = materialise(keyed.groupBy("h").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high").select("h"), "similar-shared")
    names = prints.select(F.xxhash64("id").alias("tag"), "id")
    met = materialise(keyed.join(shared, "h").distinct().join(names, "tag").select("h", "id"), "similar-members")
    centres = materialise(met.groupBy("h").agg(F.min("id").alias("a")), "similar-centres")
    nearest = met.join(centres, "h").where("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    tried = materialise(near_links(firsts, bucket).unionByName(equal).unionByName(nearest).distinct(), "similar-tried")
    links = materialise(verified(tried, texts), "similar-links")
    open_ = apart(met, components(links))
    heads = materialise(open_.groupBy("h", "root").agg(F.min("id").alias("id")), "similar-heads")
    least = materialise(heads.groupBy("h").agg(F.min("id").alias("a")), "similar-least")
    second = heads.join(least, "h").where("a < id").select("a", F.col("id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    second = materialise(second, "similar-second")
    links = materialise(links.unionByName(verified(second, texts)), "similar-more")
    rest = apart(open_.drop("root"), components(links))
    rest = materialise(rest.join(materialise(sketches_of(rest.select("id").distinct(), texts), "similar-sketches"), "id"), "similar-rest")
    left, right = (rest.toDF(*[c if c == "h" else f"{c}_{x}" for c in rest.columns]) for x in "ab")
    differ = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(LONGS)), F.lit(0))
    near = differ * (OVER + UNDER) <= (F.col("size_a") + F.col("size_b")) * (UNDER - OVER)
    pairs = left.join(right, (left["h"] == right["h"]) & (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & near)
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    third = materialise(pairs.join(tried.unionByName(second), ["a", "b"], "left_anti"), "similar-third")
    return components(links.unionByName(verified(third, texts)))


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """`h`, `id`, `root` of the buckets whose texts are not all in one component yet."""
    placed = met.join(roots.withColumnRenamed("node", "id"), "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))
    placed = materialise(placed, "similar-placed")
    several = materialise(placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h"), "similar-several")
    return materialise(placed.join(several, "h"), "similar-apart")
