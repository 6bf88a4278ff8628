import random
import zlib
from collections import defaultdict

import pytest
import xxhash

from lexis.llm import sharding

from .data import documents, frame, messy


def best_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    n = len(sizes)
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = [0] + [float("inf")] * n
    for _ in range(shards):
        best = [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(n + 1)]
    return best[n]


def groups(spark, sizes, seed=1):
    rng = random.Random(seed)
    keys = sorted(rng.getrandbits(64) - (1 << 63) for _ in sizes)
    return keys, spark.createDataFrame(list(zip(keys, sizes)), "h long, size long")


@pytest.mark.parametrize("seed,n,shards", [(1, 200, 8), (2, 37, 5), (3, 6, 8), (4, 120, 3)])
def test_capacity_is_minimal(spark, seed, n, shards):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 50, 400]) for _ in range(n)]
    keys, df = groups(spark, sizes, seed)
    cuts, capacity = sharding.minimax_cuts(df, shards, first_bits=3, more_bits=2)
    assert capacity == best_capacity(sizes, shards)
    loads = defaultdict(int)
    for k, s in zip(keys, sizes):
        loads[sum(c is not None and k >= c for c in cuts)] += s
    assert max(loads.values()) <= capacity


def test_neighbouring_keys_are_resolved(spark):
    rows = [(k, 10) for k in range(50)]
    cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(rows, "h long, size long"), 5, 4, 10)
    assert capacity == 100 and cuts == [10, 20, 30, 40]


def test_one_huge_group(spark):
    sizes = [1] * 20 + [1000] + [1] * 20
    keys, df = groups(spark, sizes)
    cuts, capacity = sharding.minimax_cuts(df, 8)
    loads = [0] * 8
    for k, s in zip(keys, sizes):
        loads[sum(c is not None and k >= c for c in cuts)] += s
    assert capacity == max(loads) == 1000 and min(loads) > 0


def signed_hash(text):
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_rows(spark):
    docs = documents(5, 120) + [(500 + i, "the same text", "en", "s0", 1) for i in range(60)]
    got = sharding.minimax_shards(frame(spark, docs)).collect()
    text = {d[0]: d[1] for d in docs}
    assert {r.doc_id for r in got} == set(text) and len(got) == len(docs)
    sizes, slots, by_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        by_text[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    own = defaultdict(int)
    for d in docs:
        own[signed_hash(d[1])] += len(d[1].encode()) + 1
    assert got[0].capacity == best_capacity([own[k] for k in sorted(own)], 8) and max(sizes.values()) <= got[0].capacity
    again = sharding.minimax_shards(frame(spark, docs).repartition(7)).collect()
    assert sorted(map(tuple, ((*r[:6],) for r in got))) == sorted(map(tuple, ((*r[:6],) for r in again)))


def test_awkward_rows(spark):
    got = sharding.minimax_shards(frame(spark, messy(), extra=True))
    rows = got.collect()
    assert len(rows) == len(messy()) and got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 100} == {(1, 0)}
    assert sharding.minimax_shards(frame(spark, [])).count() == 0
    assert [r.slot for r in sharding.minimax_shards(frame(spark, [(1, None, None, None, None)])).collect()] == [0]
