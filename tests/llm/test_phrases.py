"""Operator 13 against counts of every phrase by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexis.llm import phrases

from .data import frame, messy


def brute(rows, least, longest=5, most=2000):
    f, n = {k: Counter() for k in range(1, longest + 1)}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in f:
                f[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    kept = {p: a for k in range(2, longest + 1) for p, a in f[k].items() if a >= least}
    out = {}
    for p, a in kept.items():
        lang, w = p[0], p[1:]
        inside = (q for q in kept if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1)))
        if any(100 * kept[q] >= 100 * a for q in inside):
            continue
        cuts = []
        for k in range(1, len(w)):
            x, y = f[k][(lang, *w[:k])], f[len(w) - k][(lang, *w[k:])]
            cuts.append((1000 * a * n[lang] // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:most]))


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "red", "rod", "a\x1cb", "ĉu", "x-y", "(z)"] + [f"w{i}" for i in range(12)]
    set_phrases = ["in the New york city", "red rod of the", "one-off", "go go go go"]
    rows = []
    for i in range(n):
        parts = [rng.choice(set_phrases) if rng.random() < 0.2 else rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "de", None]), "s", 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed) + [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, " . \t\n", "en", "s", 0)]
    assert result(phrases.collocations(frame(spark, rows, extra=True).repartition(5), least=8)) == brute(rows, 8)


def test_messy_and_empty(spark):
    rows = messy() * 2
    assert result(phrases.collocations(frame(spark, rows, extra=True), least=3)) == brute(rows, 3)
    assert result(phrases.collocations(frame(spark, []))) == []
    assert result(phrases.collocations(frame(spark, texts(3, 2)))) == []  # nothing occurs often enough


def test_full_bitmap_and_slices_change_nothing(spark, monkeypatch):
    rows = texts(4)
    wanted = brute(rows, 6)
    monkeypatch.setattr(phrases, "likely", lambda ids, least: np.full(1 << 20, 2**64 - 1, np.uint64))
    assert result(phrases.collocations(frame(spark, rows), least=6)) == wanted
    monkeypatch.setattr(phrases, "SLICE", 50)  # many slices
    assert len(phrases.perfect(phrases.with_cells(spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 7 + 1).alias("s"))))) == 10
    assert result(phrases.collocations(frame(spark, rows).repartition(4), least=6)) == wanted


def test_a_forgetful_memo_changes_nothing(spark, monkeypatch):
    rows = texts(6)
    monkeypatch.setattr(phrases, "MEMO", 7)
    monkeypatch.setattr(phrases, "FLUSH", 50)  # many flushes in a task
    assert result(phrases.collocations(frame(spark, rows).repartition(2), least=6)) == brute(rows, 6)


def test_a_pair_is_sent_once_by_a_task(monkeypatch):
    p, s = np.arange(1, 101, dtype=np.uint64), np.full(100, 9, np.uint64)
    h = phrases.mixed(p, s)
    sent = phrases.Sent()
    assert sent.new(p, s, h).all() and not sent.new(p, s, h).any()
    assert sent.new(s, p, phrases.mixed(s, p)).sum() == 99  # (9, 9) is known
    monkeypatch.setattr(phrases, "MEMO", 1)
    one = phrases.Sent()
    assert one.new(p, s, h).all() and one.new(p, s, h).sum() == 99


def test_a_candidate_is_sent_from_one_part(spark):
    rows = texts(7, 400)
    docs = frame(spark, rows).repartition(8).selectExpr("coalesce(lang, 'und') lang", "text")
    salt = phrases.unmistakable(phrases.word_counts(docs), 6)
    ids = phrases.encoded(docs, salt, np.full(1 << 20, 2**64 - 1, np.uint64))  # all words
    hashes = phrases.frequent_hashes(ids, 6)
    assert ids.select("part").distinct().count() == 8 and hashes.select("part").distinct().count() == 8
    owned, all_ = (phrases.candidates(ids, phrases.likely(hashes, o), o) for o in (True, False))
    assert hashes.count() <= owned.distinct().count() <= owned.count() <= 1.01 * hashes.count()
    assert all_.count() > 1.5 * owned.count()  # a local task reads several parts
    assert owned.distinct().join(all_.distinct(), ["p", "s"], "left_semi").count() == owned.distinct().count()


def test_candidates_that_their_part_does_not_send_are_asked_of_all(spark, monkeypatch):
    rows, send, asked = texts(8), phrases.candidates, []

    def fewer(ids, hashes, owned):
        asked.append(owned)
        return send(ids, hashes, owned).where("p % 3 != 0" if owned else "true")

    monkeypatch.setattr(phrases, "candidates", fewer)
    assert result(phrases.collocations(frame(spark, rows).repartition(3), least=6)) == brute(rows, 6)
    assert False in asked
    asked.clear()
    monkeypatch.setattr(phrases, "candidates", lambda ids, hashes, owned: asked.append(owned) or send(ids, hashes, owned))
    assert result(phrases.collocations(frame(spark, rows).repartition(3), least=6)) == brute(rows, 6) and all(asked)


def test_most_is_taken_by_language(spark):
    rows = texts(5)
    assert result(phrases.collocations(frame(spark, rows), least=6, most=3)) == brute(rows, 6, most=3)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    p, s = rng.integers(1, 1 << 62, 20_000).astype(np.uint64), rng.integers(1, 50, 20_000).astype(np.uint64)
    made = phrases.PerfectHash(p, s)
    slots = made.slots(p, s, phrases.mixed(p, s))
    assert sorted(slots.tolist()) == list(range(20_000))  # minimal and perfect
    assert (made.p[slots] == p).all() and (made.s[slots] == s).all()
    other = rng.integers(1 << 62, 1 << 63, 20_000).astype(np.uint64)
    assert (made.slots(other, s, phrases.mixed(other, s)) == -1).all()
    assert sum(b.nbytes for _, b, _ in made.levels) < 20_000  # under a byte of bits a key


def test_keys_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(phrases, "mixed", lambda p, s: p)
    p, s = np.array([5, 5, 6], np.uint64), np.array([1, 2, 1], np.uint64)
    made = phrases.PerfectHash(p, s)
    assert sorted(made.slots(p, s, p).tolist()) == [0, 1, 2]
    assert made.slots(np.array([5], np.uint64), np.array([3], np.uint64), np.array([5], np.uint64)).tolist() == [-1]


def test_large_numbers_are_exact(spark):
    a, n, x, y = 7_000_000_000_000, 90_000_000_000_000, 8_000_000_000_001, 9_000_000_000_003
    df = spark.createDataFrame([("en", "p q", a, n, [x], [y])], "lang string, phrase string, a long, n long, heads array<long>, tails array<long>")
    assert phrases.scored(df).first().score == 1000 * a * n // (x * y)


def test_tree_sum_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", 3)
    one = np.arange(phrases.BLOCK, dtype=np.int64)
    parts = spark.createDataFrame([(0, b, t, (one * (b + 1)).tobytes()) for b in range(2) for t in range(20)], phrases.PARTS)
    got = {r.block: np.frombuffer(r["counts"], np.int64) for r in phrases.tree_sum(parts).collect()}
    assert (got[0] == 20 * one).all() and (got[1] == 40 * one).all()


def test_batches_are_bounded_in_bytes(spark):
    """Neither a batch of ids or counts that Python gets nor a row of ids grows with the input: executors keep their memory."""
    wide = spark.range(0, 800, 1, 1).selectExpr("transform(sequence(1, 8192), x -> x + id) ids")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    with phrases.small_batches(spark):
        most = max(r.n for r in wide.mapInArrow(sizes, "n long").collect())
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= phrases.ROWS
    assert most <= 8 << 20
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before
    assert 8 * phrases.BLOCK * phrases.ROWS <= 8 << 20 and 8 * phrases.ROW * phrases.ROWS <= 8 << 20
