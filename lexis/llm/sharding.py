"""Operator 3: minimax contiguous partition of atomic groups into shards."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bits of the group key that the first histogram resolves, and by how many more each later one does.
FIRST_BITS, MORE_BITS = 12, 6


def greedy(ends: list[int], start: int, capacity: int, most: int) -> list[int] | None:
    """Fill shards up to `capacity` from prefix value `start`; the cut values, or None if `most` shards do not do."""
    cuts, at = [], start
    while at < ends[-1]:
        if len(cuts) == most:
            return None
        nxt = ends[bisect_right(ends, at + capacity) - 1]
        if nxt <= at:
            return None
        cuts.append(nxt)
        at = nxt
    return cuts


def smallest_capacity(ends: list[int], shards: int, low: int) -> int:
    """Binary search for the least capacity at which the greedy check needs at most `shards` shards."""
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, 0, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts within `capacity`, each as near as possible to an even share of what is left."""
    least, at = [], ends[-1]
    for _ in range(shards - 1):  # from the end: the earliest cuts after which the rest still fits
        i = next_at_least(ends, at - capacity)
        at = i
        least.append(at)
    least.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        share = at + (ends[-1] - at) / (shards - k)
        i = bisect_right(ends, share)
        ahead = [v for v in ends[max(i - 1, 0) : i + 1] if v > at] or [at]  # a group beyond its share still fills a shard of its own
        near = min(ahead, key=lambda v: (abs(v - share), v))
        furthest = ends[bisect_right(ends, at + capacity) - 1]
        at = max(at, min(max(near, least[k]), furthest))
        cuts.append(at)
    return cuts


def next_at_least(ends: list[int], value: int) -> int:
    """The first boundary that is not below value."""
    i = bisect_right(ends, value - 1)
    return ends[min(i, len(ends) - 1)]


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[list[int], int]:
    """Cut keys (a shard begins at each) and the least possible largest shard.

    `groups` has one row (`h` long, `size` long) per atomic group, ordered by h. The driver sees a histogram over
    prefixes of h only: 2^first_bits bins at first, then finer bins where a cut can still fall, until each of these
    holds a single group. Its size does not grow with the groups; the number of rounds grows with their logarithm.
    """
    def bins(frame: DataFrame, bits: int) -> list[tuple]:
        b = F.shiftright("h", 64 - bits)
        rows = frame.groupBy(b.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m"), F.min("h").alias("h")).collect()
        return [(r.h, r.s, r.n, r.m, r.b, bits) for r in rows]

    segments = sorted(bins(groups, first_bits))
    if not segments:
        return [], 0
    largest = max(s[3] for s in segments)
    while True:
        ends = [0]
        for s in segments:
            ends.append(ends[-1] + s[1])
        total = ends[-1]
        low = max(largest, -(-total // shards))
        high = smallest_capacity(ends, shards, low)
        open_ = set()
        if high > low:
            under = 0
            for k in range(1, shards):  # the k-th greedy cut of any capacity from low to high lies in this range
                under = ends[bisect_right(ends, under + low) - 1]
                first = max(0, bisect_right(ends, under) - 2)
                last = min(len(segments), bisect_right(ends, min(total, k * high)))
                open_ |= {i for i in range(first, last) if segments[i][2] > 1 and segments[i][5] < 64}
        if not open_:
            return [segments[ends.index(c)][0] if c < total else None for c in even_cuts(ends, shards, high)], high
        by_bits: dict[int, list[int]] = {}
        for i in open_:
            by_bits.setdefault(segments[i][5], []).append(segments[i][4])
        finer = []
        for bits, values in by_bits.items():
            wanted = groups.sparkSession.createDataFrame([(v,) for v in values], "b long")
            inside = groups.withColumn("b", F.shiftright("h", 64 - bits)).join(F.broadcast(wanted), "b", "left_semi")  # at most 2^first_bits values
            finer += bins(inside, min(64, bits + more_bits))
        segments = sorted([s for i, s in enumerate(segments) if i not in open_] + finer)


def minimax_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, buckets: int = 1024) -> DataFrame:
    """Assign every row to one of `shards` contiguous shards of the order by text hash, under the law `bytes`.

    The atomic groups are the equal texts (equal 64-bit hashes): they never part. The largest shard is as small as
    any contiguous partition allows; under that capacity the cuts lie as near to even shares as the groups let them.
    No text is moved: a row's shard follows from its hash and the at most `shards - 1` cuts. Slots are numbered in
    `buckets` parts per shard, dealt by a hash of id and text, so a large group of copies does not meet in one task.

    Returns id, `size` (UTF-8 bytes + 1), `text_crc32`, `law`, `shard`, `slot` (gapless from 0 in each shard),
    `grown_shard` (null under this law) and `capacity` (the minimax bound). A null text has size 1 and crc32 0, and
    all null texts are one group apart from the empty ones; long texts are read whole. Repeated rows each get a slot. An empty table gives no
    rows; other columns of `docs` are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("h"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    cuts, capacity = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts if c is not None), F.lit(0)).cast("int")
    rows = rows.select("*", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")
    numbered = rows.withColumn("at", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])  # shards x buckets rows at most
    return numbered.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )
