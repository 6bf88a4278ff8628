import zlib
from itertools import combinations

import numpy as np
import pytest

from lexis.llm import quality, toxicity

from .data import documents, frame, labels, messy


def held(i, modulus, at):
    return zlib.crc32(str(i).encode()) % modulus == at


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.DIMENSIONS).astype(np.float32), rng.normal(size=(quality.DIMENSIONS, quality.RANK)).astype(np.float32))
    rows = quality.features([b"one two two three", b"", b"x"], [3, None, 5])
    got = m.margins(rows)
    for r, (a, b) in enumerate(zip(rows.starts, rows.ends)):
        idx, x = rows.index[a:b], rows.value[a:b].astype(float)
        pairs = sum(float(m.factors[idx[i]].astype(float) @ m.factors[idx[j]].astype(float)) * x[i] * x[j] for i, j in combinations(range(len(x)), 2))
        assert got[r] == pytest.approx(0.3 + float(m.linear[idx] @ x) + pairs, rel=1e-3, abs=1e-3)


def corpus(spark, bad):
    docs = [(i, t, *r) for i, t, *r in documents(11, 400)]
    docs = [(i, bad(i, t) if i % 4 == 0 else t, *r) for i, t, *r in docs]
    known = [(d[0], int(d[0] % 4 != 0), int(d[0] % 4 == 0)) for d in docs]
    return docs, known


def test_sample_is_bounded(spark):
    docs = documents(13, 60)
    hot = next(d for d in docs if not held(d[0], 5, 0))
    docs += [(hot[0], f"{hot[1]} {i % 3}", *hot[2:]) for i in range(300)]  # one labelled id has most of the rows
    long_one = (1000, "word " * 20_000, "en", "s", 7)
    rows = frame(spark, [*docs, long_one, (1001, None, "en", "s", None), (None, "x", "en", "s", 1)], extra=True)
    known = labels(spark, [(i, 1, 0) for i in {d[0] for d in docs}] + [(1000, 0, 1), (1001, 0, 0), (None, 1, 1)])
    sample = quality.training_sample(rows, known, "quality", 5, 0, 1000, ["text", "n_chars"], most_bytes=1 << 20)
    got = sample.orderBy("doc_id").collect()
    assert sample.columns == ["doc_id", "text", "n_chars", "label"]
    assert [r.doc_id for r in got] == sorted(i for i in {d[0] for d in docs} | {1001} if not held(i, 5, 0))
    assert next(r.text for r in got if r.doc_id == hot[0]) in {hot[1]} | {f"{hot[1]} {i}" for i in range(3)}
    few = quality.training_sample(rows, known, "quality", 5, 0, 1000, ["text", "n_chars"], most_bytes=20_000).collect()
    assert 0 < sum(len((r.text or "").encode()) for r in few) <= 20_000 and len(few) < len(got)
    assert {r.doc_id for r in few} <= {r.doc_id for r in got}
    assert quality.training_sample(rows, labels(spark), "quality", 5, 0, 1000, ["text", "n_chars"]).count() == 0
    assert quality.training_sample(frame(spark, []), known, "toxic", 4, 2, 1000, ["text"]).count() == 0


def shout(i, text):
    return " ".join(w.upper() + "!!" for w in text.split())


def insult(i, text):
    ws = text.split()
    return " ".join(ws[:9] + ["you", ("Idiot!", "moron,")[i % 8 == 0]] + ws[9:])


def test_quality_on_held_out_rows(spark):
    docs, known = corpus(spark, shout)
    got = {r.doc_id: r for r in quality.quality_scores(frame(spark, docs), labels(spark, known)).collect()}
    assert all(got[i].held_out == held(i, 5, 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i, *_ in docs)
    unseen = [i for i, *_ in docs if held(i, 5, 0)]
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in unseen]) > 0.95
    kept = {r.doc_id for r in quality.accepted(frame(spark, docs, extra=True), labels(spark, known)).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark):
    docs, known = corpus(spark, insult)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame(spark, docs), labels(spark, known)).collect()}
    assert all(got[i].held_out == held(i, 4, 2) for i, *_ in docs)
    unseen = [i for i, *_ in docs if held(i, 4, 2)]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in unseen]) > 0.95


def test_held_out_labels_have_no_influence(spark):
    docs, known = corpus(spark, insult)
    turned = [(i, 1 - q if held(i, 5, 0) else q, 1 - t if held(i, 4, 2) else t) for i, q, t in known]
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = (sorted((r.doc_id, r.score) for r in scores(frame(spark, docs), labels(spark, k)).collect()) for k in (known, turned))
        assert a == b


def test_lang_and_source_have_no_influence(spark):
    docs, known = corpus(spark, insult)
    other = [(i, t, "xx", None, n) for i, t, _, _, n in docs]
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = (sorted((r.doc_id, r.score) for r in scores(frame(spark, d), labels(spark, known)).collect()) for d in (docs, other))
        assert a == b


def test_ftrl_against_plain_updates():
    """The published per-coordinate update, coordinate by coordinate; and scores feature by feature."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(60)}" for _ in range(30)) + (" vile" if i % 3 == 0 else "") for i in range(40)]
    rows = [np.unique(toxicity.grams([t.encode()])[1]) for t in texts]
    labels_ = np.array([float(i % 3 == 0) for i in range(40)])
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.3, 0.5, 2
    got = toxicity.ftrl(rows, labels_, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n, order = {}, {}, np.random.default_rng(7)
    share = labels_.mean()
    bias, g_bias = float(np.log(share / (1 - share))), 1.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for d in order.permutation(40):
            margin = bias + sum(weight(i) for i in rows[d].tolist())
            error = 1 / (1 + np.exp(-margin)) - labels_[d]
            for i in rows[d].tolist():
                w, sigma = weight(i), ((n.get(i, 0.0) + error**2) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + error - sigma * w, n.get(i, 0.0) + error**2
            g_bias += error**2
            bias -= 0.05 * error / g_bias**0.5
    wanted = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(got.index.tolist(), got.weight.tolist())).keys() == wanted.keys() and got.bias == pytest.approx(bias)
    assert all(w == pytest.approx(wanted[i], rel=1e-4, abs=1e-6) for i, w in zip(got.index.tolist(), got.weight.tolist()))
    scored = toxicity.scores([t.encode() for t in [*texts, ""]], got.bias, got.dense())
    margins = [got.bias + sum(wanted.get(i, 0.0) for i in r.tolist()) for r in rows] + [got.bias]
    assert scored == pytest.approx(1 / (1 + np.exp(-np.array(margins))), rel=1e-4)


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 5000, 40), [7] if i % 3 == 0 else []]).astype(np.int64)) for i in range(600)]
    labels = np.array([float(i % 3 == 0) for i in range(600)])
    kept = [toxicity.ftrl(rows, labels, l1=l1) for l1 in (0.0, 1.5, 4.0)]
    sizes = [len(w.index) for w in kept]
    assert sizes[0] > 4500 and sizes[1] < sizes[0] / 2 and sizes[2] < sizes[1] / 4
    assert all(w.weight[list(w.index).index(7)] == max(w.weight) for w in kept)


def test_skip_grams():
    one, two, three = (set(toxicity.grams([t])[1].tolist()) for t in (b"a b c", b"A, b! C", b"a c b"))
    assert one == two and one != three and len(one) == 6
    assert len(toxicity.grams([b"a", b"b"])[1]) == 2


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_awkward_rows(spark, scores):
    odd = labels(spark, [(0, 1, 0), (0, 0, 1), (None, 1, 1), (3, None, None), (999, 1, 0)])
    got = scores(frame(spark, messy(), extra=True), odd).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 for r in got)
    assert scores(frame(spark, []), odd).count() == 0
    assert {r.score for r in scores(frame(spark, messy()), labels(spark)).collect()} == {0.5}
