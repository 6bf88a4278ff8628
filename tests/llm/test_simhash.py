import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexis.llm import similar, simhash
from lexis.llm.components import components

from .data import documents, frame, messy


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB éß\n\t.ſİ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(str(i % 700) for i in range(5000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


def roots_of(prints):
    """Smallest id reachable through pairs within two bits, by brute force."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin((prints[i] ^ prints[j]) % (1 << 64)).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {}
    for i in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        out[i] = v - (1 << 64) if v >> 63 else v
    return out


def test_links_connect_what_pairs_do(spark):
    prints = clustered(1, 300)
    firsts = {}
    for i, v in prints.items():
        firsts.setdefault(v, i)
    df = spark.createDataFrame([(i, v) for v, i in firsts.items()], "id long, fp long")
    wanted = roots_of({i: v for v, i in firsts.items()})
    for bucket in (0, 8, 1000):  # through neighbours only, both ways, pairs only
        got = {r.node: r.root for r in components(simhash.near_links(df, bucket)).collect()}
        assert {i: got.get(i, i) for i in wanted} == wanted


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = [tuple(sorted(x)) for x in zip(order, order[1:])]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == n and {r.root for r in got} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    docs = documents(7, 60)
    long_text = " ".join(d[1] for d in docs[:12])
    docs += [(200, long_text, "en", "s", 1), (150, long_text.replace("the", "a") + " end", "en", "s", 1), (201, long_text.upper(), "en", "s", 1)]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    prints = {d[0]: brute_fingerprint(d[1]) for d in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == roots_of(prints)
    assert {r.doc_id for r in simhash.one_of_each(frame(spark, docs)).collect()} == set(roots_of(prints).values())


def test_awkward_rows(spark):
    got = simhash.near_duplicates(frame(spark, messy(), extra=True)).collect()
    assert len(got) == len(messy())
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (100, 101, 102)} == {("0" * 16, 100)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, messy(), extra=True)).columns == frame(spark, messy(), extra=True).columns


def near_copies(seed):
    """Texts of 60 words in clusters, with 0 to 6 words changed and a few cut off, and how any two sets of five-word runs compare."""
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(60)] = f"x{rng.randrange(400)}"
            texts.append(" ".join(own[: 60 - rng.randint(0, 6)]))
    return texts + ["", " ", "one two", "One TWO", "one two three"]


def jaccard_roots(texts):
    """Smallest index reachable through texts whose sets of five-word runs have a Jaccard similarity of 0.8, by brute force."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()})
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = min(root[i], root[j])
    return root


def test_similar_sets_share_a_band():
    """Sets of every size just at the similarity of 0.8 meet; those at 0.1 seldom do."""
    rng = np.random.default_rng(8)

    def shares(n, common):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        lines = [similar.signature(x).reshape(similar.BANDS, similar.ROWS) for x in (base[:n], base[n - common : 2 * n - common])]
        return bool((lines[0] == lines[1]).all(axis=1).any())

    assert all(shares(n, -(-8 * n // 9)) for n in (9, 45, 450, 1800) for _ in range(60))
    assert sum(shares(450, 82) for _ in range(200)) < 10


def test_a_cluster_is_linked_by_few_comparisons(spark):
    """Members of a large group of near copies are not compared pair by pair."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(own))
    compared = []
    verified = similar.verified

    def counted(pairs, texts):
        compared.append(pairs.count())
        return verified(pairs, texts)

    similar.verified = counted
    try:
        kept = simhash.one_of_each(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    finally:
        similar.verified = verified
    assert [r.doc_id for r in kept] == [0] and sum(compared) < 10 * len(texts)


def test_stage_links_what_jaccard_does(spark):
    texts = near_copies(4)
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    wanted = jaccard_roots(texts)
    three = roots_of({i: brute_fingerprint(t) for i, t in enumerate(texts)})
    assert set(wanted) < set(three.values())  # three-word fingerprints within two bits lose some
    for bucket in (0, 64):
        assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, docs), bucket).collect()) == sorted(set(wanted))


def test_one_row_of_each_stays(spark):
    rows = messy() + [(5, messy()[6][1], "en", "s0", 1), (107, None, "de", "s1", 2)]
    rows += [(None, "only here", "en", "s0", 9)] * 3 + [(3, messy()[3][1], "en", "s9", 1)]
    wanted, best = jaccard_roots([t or "" for _, t, *_ in rows]), {}
    for root, row in zip(wanted, rows):
        best[root] = min(best.get(root, (2, 0)), (row[0] is None, row[0] or 0))
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows, extra=True)).collect()]
    assert len(got) == len(best)
    roots = {(r[0], r[1]): root for r, root in zip(rows, wanted)}
    assert {roots[x]: (x[0] is None, x[0] or 0) for x in got} == best


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
        a, b = base[: rng.integers(1, 400)], base[rng.integers(0, 300) :]
        bits = sum(int(x ^ y).bit_count() for x, y in zip(similar.parities(a).view(np.uint64).tolist(), similar.parities(b).view(np.uint64).tolist()))
        assert bits <= len(np.setxor1d(a, b)) and not (similar.parities(a) ^ similar.parities(a)).any()
    one = np.array([5], np.uint64)
    assert sum(int(x).bit_count() for x in similar.parities(one).view(np.uint64).tolist()) == 1
