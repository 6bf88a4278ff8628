"""Operator 12: rules against plain regular expressions, gradients against differences, added spans against planted ones."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from lexis.llm import pii

from .data import frame, messy, prose

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text, only = text or "", lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(only(m.group())) <= 19 and pii.luhn(only(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only(m.group())) <= 15]
    return sorted(out)


def planted(seed, n=60):
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    makers = [
        lambda: f"{prose(rng, 1).strip('.')}.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card,
        lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    ]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(5, 40)) + " " + (rng.choice(makers)() if rng.random() < 0.7 else digits(5)) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts) + " " + prose(rng, 5), "en", "s", 0))
    return rows


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_rules_equal_plain_expressions():
    rng = random.Random(12)
    for _ in range(20_000):
        text = "".join(rng.choice("1234.@a +-()9.@é\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("1" * 50_000, "a" * 50_000, "1." * 30_000, "a@" * 30_000, "+1" * 30_000, "1 " * 30_000):
        pii.base_spans(text)  # in linear time
    assert pii.base_spans("0" * 6000 + ".1.2.3") == [(0, 1, 6006)]
    assert pii.base_spans("4111-1111-1111-1111 x") == [(0, 2, 19)]


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, pii.CLASSES, (6, 3)), np.array([[0, 1, 0], [3, 2, 0], [4, 2, 5], [0, 0, 6], [7, 0, 0], [8, 1, 0]])
    tagger = pii.Tagger({k: v.astype(np.float64) for k, v in pii.Tagger.fresh(1).weights.items()})
    grads = tagger.loss(x, y)[1]
    for name, w in tagger.weights.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)] + [np.unravel_index(np.abs(grads[name]).argmax(), w.shape)]:
            before = w[at]
            w[at] = before + 1e-3
            up = tagger.loss(x, y)[0]
            w[at] = before - 1e-3
            down = tagger.loss(x, y)[0]
            w[at] = before
            assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, (name, at)


def test_viterbi_is_the_best_path():
    tagger = pii.Tagger.fresh(3)
    rng = np.random.default_rng(2)
    tagger.weights["moves"] = rng.normal(0, 1, tagger.weights["moves"].shape).astype(np.float32)
    x = rng.integers(0, pii.CLASSES, (3, 4))
    tags, _ = tagger.decode(x)
    both = np.concatenate([tagger.states(x, d) for d in "fb"], axis=2)
    e, moves = both @ tagger.weights["out"] + tagger.weights["out_bias"], tagger.weights["moves"] + pii.BARRED
    for n in range(4):
        value = lambda p, n=n: e[0, n, p[0]] + moves[pii.TAGS, p[0]] + sum(e[t, n, p[t]] + moves[p[t - 1], p[t]] for t in (1, 2))
        assert abs(max(map(value, product(range(pii.TAGS), repeat=3))) - value(tags[:, n])) < 1e-4


def test_reconciling_equals_all_choices():
    rng = random.Random(5)
    for _ in range(200):
        found = {(b, rng.randrange(4), b + rng.randint(1, 6)): rng.randint(1, 9) / 2 for b in (rng.randrange(20) for _ in range(7))}
        spans, best = list(found), 0.0
        for mask in range(1 << len(spans)):
            chosen = sorted((spans[i] for i in range(len(spans)) if mask >> i & 1))
            if all(a[2] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(found[s] for s in chosen))
        got = pii.reconciled(found)
        assert all(a[2] <= b[0] for a, b in zip(got, got[1:])) and abs(sum(found[s] for s in got) - best) < 1e-9


@pytest.fixture(scope="module")
def tagger():
    windows = [(w, i) for _, text, *_ in planted(1, 150) for _, w, i in pii.windows_of(text, pii.base_spans(text))]
    return pii.fit(pii.with_variants(windows[:700], 3))


def test_windows_skipped_hold_no_span(tagger, monkeypatch):
    texts = [t for _, t, *_ in planted(3, 20)]
    some = pii.spans_of(tagger, texts)
    monkeypatch.setattr(pii, "places", lambda text: list(range(0, max(1, len(text) - pii.STEP), pii.STEP)))
    assert pii.spans_of(tagger, texts) == some


def test_data_without_digit_or_at_is_found():
    rng, windows = random.Random(8), []
    name = lambda: prose(rng, 1).strip(".")

    def text(n):
        head, span = prose(rng, n), f"{name()}(at){name()}(dot)com"
        return f"{head} {span} {prose(rng, n)}", (len(head) + 1, 0, len(head) + 1 + len(span))

    for _ in range(600):
        t, span = text(rng.randint(2, 4))
        windows += [(t[: pii.WIDE], [span])] * (span[2] <= pii.WIDE) + [(prose(rng, 15)[: pii.WIDE], [])]
    tagger = pii.fit(windows, epochs=40)
    made = [text(rng.choice([5, 50, 1000])) for _ in range(40)]
    got = [{s[:3] for s in found} for found in pii.spans_of(tagger, [t for t, _ in made])]
    assert sum(span in g for (_, span), g in zip(made, got)) >= 32
    assert sum(len(g - {span}) for (_, span), g in zip(made, got)) <= 2


def test_every_character_is_read(monkeypatch):
    seen, tagger = [], pii.Tagger.fresh(1)
    texts = ["", "a", prose(random.Random(3), 900), "x y\n" * 2000, "ab " * 30]
    whole = pii.Tagger.emissions
    monkeypatch.setattr(pii.Tagger, "emissions", lambda self, x, sizes: seen.append((x, sizes)) or whole(self, x, sizes))
    pii.proposals(tagger, texts, batch=4)
    got = sorted(x[:n, i].tobytes() for x, sizes in seen for i, n in enumerate(sizes))
    assert got == sorted(pii.classes(t[a:b]).tobytes() for t in texts if t for a, b in pii.reads(len(t)))
    for n in (1, 40, pii.SHARED, pii.READ - 1, pii.READ, pii.READ + 1, 3 * pii.READ, 20_000):
        windows = list(pii.reads(n))
        assert windows[0][0] == 0 and windows[-1][1] == n and all(b - c == pii.SHARED for (_, b), (c, _) in zip(windows, windows[1:]))


def test_windows_left_out_of_viterbi_are_all_o():
    rng, spared = np.random.default_rng(0), 0
    for seed in range(40):
        tagger = pii.Tagger.fresh(seed)
        tagger.weights["moves"] = rng.normal(0, 1, tagger.weights["moves"].shape).astype(np.float32)
        tagger.weights["out_bias"][0] += seed / 6
        sizes = np.sort(rng.integers(1, 40, 50))[::-1]
        x = rng.integers(1, pii.CLASSES, (sizes[0] + 1, 50)).astype(np.int16)
        e = tagger.emissions(x, sizes)
        tags, _ = tagger.best(e)
        shut = np.setdiff1d(np.arange(50), tagger.open(e))
        assert not tags[:, shut].any()
        spared += len(shut)
        for i in (0, 20, 49):  # a window's tags do not depend on what else is in its batch
            alone = x[: sizes[i] + 1, i : i + 1]
            assert (tagger.best(tagger.emissions(alone, sizes[i : i + 1]))[0][:, 0] == tags[: sizes[i] + 1, i]).all()
            plain = np.concatenate([tagger.states(alone[:-1], d) for d in "fb"], axis=2) @ tagger.weights["out"] + tagger.weights["out_bias"]
            assert np.abs(plain[:, 0, 1:] - plain[:, 0, :1] - e[: sizes[i], i]).max() < 1e-4
    assert spared > 100


def test_other_ways_of_writing_are_found(tagger):
    rng, hit, wanted, extra = random.Random(9), 0, 0, 0
    for _, text, *_ in planted(7, 40):
        for begin, kind, end in pii.base_spans(text):
            other = pii.varied(kind, text[begin:end], rng)
            if pii.base_spans(other) or len(other) > pii.STEP - 2:
                continue
            head, tail = prose(rng, 30), prose(rng, 30)
            got = {s[:3] for s in pii.spans_of(tagger, [f"{head} {other} {tail}"])[0]}
            wanted += 1
            hit += (len(head) + 1, kind, len(head) + 1 + len(other)) in got
            extra += len(got - {(len(head) + 1, kind, len(head) + 1 + len(other))})
    assert wanted > 30 and hit / wanted >= 0.7 and extra / wanted <= 0.15, (hit, wanted, extra)


def test_query(spark):
    rows = planted(2, 40) + messy()[12:]
    df = pii.personal_data(frame(spark, rows, extra=True).repartition(4), most=200)
    found = {(r.doc_id, i): r for i, r in enumerate(sorted(pii.digests(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}
    assert len(found) == len(rows)
    for (doc_id, _), r in found.items():
        texts = [t for i, t, *_ in rows if i == doc_id]
        digests = {}
        for t in texts:
            base = brute(t)
            joined = ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in base)
            digests[hashlib.sha256(joined.encode()).hexdigest()] = (joined, [sum(s[1] == k for s in base) for k in range(4)])
        joined, counts = digests[r.base_sha256]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        keys = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert keys == sorted(keys)


def test_nothing_to_learn_from(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "no data 123", "en", "s", 0)]
    got = {r.doc_id: r.spans for r in pii.digests(pii.personal_data(frame(spark, rows))).collect()}
    assert got == {1: "", 2: "", 3: ""}
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_given_labels(spark):
    rows = planted(4, 80)
    spans = [(t, [{"begin": b, "kind": k, "end": e} for b, k, e in pii.base_spans(t)]) for _, t, *_ in rows]
    labelled = spark.createDataFrame(spans, "text string, spans array<struct<begin:int,kind:int,end:int>>")
    windows = pii.training_windows(labelled, 50, spans_col="spans")
    assert 0 < len(windows) <= 50 and windows == pii.training_windows(frame(spark, rows), 50)
    assert pii.personal_data(frame(spark, rows[:5]), most=50, labelled=labelled).count() == 5
