"""Operator 11 against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

from lexis.llm import importance

from .data import documents, frame, messy


def features(text, longest=2):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20, longest=2, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in features(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text, *_ in docs:
        n_words, fs = features(text, longest)
        weight = sum(gain(bucket(g)) for g in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = can[: percent * len(can) // 100]
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(out + [(*r, None) for r in rest.elements()], key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_equals_brute_force(spark):
    docs = documents(3, 120)
    wanted = [d[1][:300] for d in docs[:10]] + [None, "", "Überall naïve ĉu x"]
    assert result(importance.importance_resample(frame(spark, docs, extra=True).repartition(6), target(spark, wanted))) == brute(docs, wanted)


def test_messy_rows(spark):
    docs, wanted = messy() * 3, ["one two", "word word word"]
    got = result(importance.importance_resample(frame(spark, docs, extra=True).repartition(3), target(spark, wanted), percent=60, least=2))
    assert got == brute(docs, wanted, percent=60, least=2)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in got) + 1))


def test_one_row_repeated_fills_many_tasks(spark):
    docs = [(None, "same words " * 15, "en", "s", 1)] * 400 + documents(4, 10)
    got = result(importance.importance_resample(frame(spark, docs).repartition(7), target(spark, ["same words"]), percent=100))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + sum(features(d[1])[0] >= 20 for d in docs)))


def test_empty_tables(spark):
    docs = documents(5, 8)
    assert result(importance.importance_resample(frame(spark, docs), target(spark, []))) == brute(docs, [])
    assert result(importance.importance_resample(frame(spark, []), target(spark, ["a b"]))) == []


def test_longer_runs_and_several_pieces(spark, monkeypatch):
    docs, wanted = documents(6, 30), ["one two three", documents(6, 2)[1][1]]
    monkeypatch.setattr(importance, "PIECE", 500)
    assert result(importance.importance_resample(frame(spark, docs), target(spark, wanted), longest=4, buckets=300)) == brute(docs, wanted, longest=4, buckets=300)
