import random
from collections import defaultdict

import numpy as np
import pytest

from lexis.llm import repeats

from .data import documents, frame, messy, prose


def brute(docs, length):
    """Words inside a stretch of `length` words that stands in another document too, by document."""
    where = defaultdict(set)
    for i, text, *_ in docs:
        ws = (text or "").split()
        for a in range(len(ws) - length + 1):
            where[tuple(ws[a : a + length])].add(i)
    out = {}
    for i, text, *_ in docs:
        ws = (text or "").split()
        hit = {p for a in range(len(ws) - length + 1) if len(where[tuple(ws[a : a + length])]) > 1 for p in range(a, a + length)}
        if hit:
            out[i] = hit
    return out, where


def planted(seed):
    rng = random.Random(seed)
    docs = [list(d) for d in documents(seed, 40)]
    for n in (49, 50, 51, 60, 140):
        passage = prose(rng, n)
        for d in rng.sample(docs, 3):
            d[1] = " ".join([d[1], passage, prose(rng, rng.randint(0, 6))])
    base = prose(rng, 120).split()
    docs += [[300, " ".join(base), "en", "s", 1], [301, " ".join(base[:70] + ["changed"] + base[71:]), "en", "s", 1], [302, " ".join(base[30:81]), "en", "s", 1], [303, prose(rng, 60) + " " + prose(rng, 1) * 1, "en", "s", 1]]
    twice = prose(rng, 55)
    docs += [[304, twice + " between " + twice, "en", "s", 1], [305, "a " * 130, "en", "s", 1], [306, "a " * 90 + "b", "en", "s", 1]]
    return [tuple(d) for d in docs]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_every_stretch(spark, seed):
    docs = planted(seed)
    wanted, where = brute(docs, 50)
    got = defaultdict(set)
    text = {d[0]: d[1].split() for d in docs}
    for r in repeats.repeated_passages(frame(spark, docs)).collect():
        assert r.n_words == r.end - r.begin >= 50 and not got[r.doc_id] & set(range(r.begin, r.end))
        got[r.doc_id] |= set(range(r.begin, r.end))
        assert r.other_doc_id != r.doc_id
        assert any(r.other_doc_id in where[tuple(text[r.doc_id][a : a + 50])] for a in range(r.begin, r.end - 49))
    assert dict(got) == wanted


def test_pieces_of_the_index():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    h[100:150] = h[10:60]
    for n in (1, 5, 27, 50):
        runs = repeats.run_hashes(h, n)
        equal = {}
        for i in range(len(h) - n + 1):
            assert equal.setdefault(tuple(h[i : i + n]), runs[i]) == runs[i]
        assert len(set(runs.tolist())) == len(equal)
    h[5:9] = 0
    assert repeats.least_ahead(h, 24).tolist() == [i + int(np.argmin(h[i : i + 24])) for i in range(277)]


def test_awkward_rows(spark):
    rows = messy()
    got = repeats.repeated_passages(frame(spark, rows, extra=True)).collect()
    wanted, _ = brute([(i, t) for i, t, *_ in {(r[0], r[1]) for r in rows if r[0] is not None}], 50)
    assert {r.doc_id for r in got} == set(wanted)
    assert repeats.repeated_passages(frame(spark, [])).count() == 0
