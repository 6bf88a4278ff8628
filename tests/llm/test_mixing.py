import re

import pytest

from lexis.llm import mixing
from lexis.llm.common import WORD

from .data import documents, frame, messy


def brute_targets(sizes):
    """Share, cap, and share the excess again until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def words(text):
    return len(re.findall(WORD, text or ""))


def test_targets_and_takes(spark):
    docs = documents(3, 60) + [(900 + i, "x y z " * 3, "en", "tiny", 1) for i in range(2)] + [(950, "a b c d e", "en", None, 1)]
    got = {r.doc_id: r for r in mixing.curriculum_mix(frame(spark, docs), digits=1).collect()}
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + words(d[1])
    targets = brute_targets(sizes)
    taken, longest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for d in docs:
        r = got[d[0]]
        assert r["size"] == words(d[1]) and r.source_size == sizes[d[3]]
        assert r.target == pytest.approx(targets[d[3]], rel=1e-12)
        assert r.taken == r["size"] * r.copies and r.taken <= 3 * r["size"] and len(r.positions) == r.copies
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= sum(sizes.values()) for p in r.positions)
        taken[d[3]] += r.taken
        longest[d[3]] = max(longest[d[3]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 for s in sizes)


def test_rerun_and_order(spark):
    docs = documents(4, 50)
    a = [tuple(map(str, r)) for r in mixing.curriculum_mix(frame(spark, docs)).collect()]
    b = [tuple(map(str, r)) for r in mixing.curriculum_mix(frame(spark, docs[::-1]).repartition(5)).collect()]
    assert a == b
    firsts = [r.positions[0] for r in mixing.curriculum_mix(frame(spark, docs)).collect() if r.copies]
    assert firsts == sorted(firsts)


@pytest.mark.parametrize("schedule", [(3.0, 2.0, 1.0), (1.0, 1.0), (1.0, 4.0, 0.5, 2.0)])
def test_inversion(spark, schedule):
    """The inverted share agrees with the integral taken by small steps."""
    steps = 20_000
    n = len(schedule) - 1

    def rate(t):
        i = min(int(t * n), n - 1)
        return schedule[i] + (schedule[i + 1] - schedule[i]) * (t * n - i)

    areas = [0.0]
    for k in range(steps):
        areas.append(areas[-1] + rate((k + 0.5) / steps) / steps)
    shares = [0.0, 0.1, 0.333, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r.t for r in df.select(mixing.time_of(df.s, schedule).alias("t")).collect()]
    for s, t in zip(shares, got):
        k = next(i for i, a in enumerate(areas) if a >= s * areas[-1] - 1e-12)
        assert t == pytest.approx(k / steps, abs=2e-4)


def test_mixed_documents(spark):
    docs = documents(6, 40)
    mixed = mixing.mixed_documents(frame(spark, docs, extra=True))
    assert mixed.columns == frame(spark, docs, extra=True).columns
    counts = {r.doc_id: r.copies for r in mixing.curriculum_mix(frame(spark, docs)).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in counts.items() if v}


def test_awkward_rows(spark):
    got = mixing.curriculum_mix(frame(spark, messy(), extra=True)).collect()
    assert len(got) == len(messy())
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert {r["size"] for r in got if r.doc_id in (100, 101, 102)} == {0}
    assert mixing.curriculum_mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.curriculum_mix(frame(spark, [(1, None, None, None, None)])).collect()] == [0]
    mixing.mixed_documents(frame(spark, messy())).collect()
