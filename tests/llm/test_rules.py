import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexis.llm import rules

from .data import documents, frame, labels, messy

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    lines, seen, dup, n = text.split("\n"), [], 0, 0
    for line in lines:
        if WORD.search(line):
            n += 1
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n, sum("A" <= c <= "Z" for c in text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab# \n\té\U0001f600\xa0Z", max_size=80))
def test_measure(text):
    assert rules.measure(text.encode()) == brute(text)


def test_many_words_do_not_overflow():
    words = [str(i).encode() for i in range(1_100_000)]
    assert rules.repeated_words(words) == 0
    assert rules.repeated_words(words + words[:4]) == 8


@pytest.mark.parametrize("k,n", [(0, 50), (3, 200), (40, 300), (7, 7)])
def test_exact_bound(k, n):
    level = 0.05
    bound = rules.upper_bound(k, n, level)
    tail = lambda p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    if k < n:
        assert tail(bound) == pytest.approx(level, rel=1e-6)
    else:
        assert bound == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(980, 1000), st.integers(0, 40)), max_size=8), st.integers(975, 999), st.sampled_from([0.02, 0.05, 0.2]))
def test_loosest_cutoff(counts, proposed, risk):
    """The lowest cutoff that every stricter one, itself included, passes: by binomial sums."""
    good = np.zeros(1001, np.int64)
    for v, n in counts:
        good[v] += n
    n, wanted = int(good.sum()), None
    for cut in range(1000, proposed - 1, -1):
        k = int(good[cut + 1 :].sum())
        at_risk = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        if k == n or at_risk > 0.1:  # so many or fewer would be no surprise at this rate
            break
        wanted = cut
    assert rules.loosest(good, proposed, risk, 0.1) == wanted


def test_verdicts_follow_the_cutoffs(spark):
    good = [(i, t + " " + t[::-1], *r) for i, t, *r in documents(10, 300)]
    bad = [(1000 + i, junk(i), "en", "s0", 1) for i in range(200)] + [(2000 + i, t.upper(), *r) for i, t, *r in documents(12, 120)]
    docs = frame(spark, good + bad)
    known = labels(spark, [(d[0], 1, 0) for d in good] + [(d[0], 0, 0) for d in bad])
    got = rules.rule_verdicts(docs, known, bands=(100,)).collect()
    cutoffs = {}
    for r in got:
        values = dict(zip(rules.RULES, (1000 * a / b if b else 0 for a, b in ((r.n_symbols, r.word_chars), (r.n_dup_lines, r.n_lines), (r.n_repeat_words, r.n_words), (r.n_capitals, r.word_chars)))))
        failed = set(r.failed_rules)
        for name, v in values.items():
            low, high = cutoffs.get((r.stratum, name), (-1, 1001))
            cutoffs[r.stratum, name] = (max(low, int(v)), high) if name not in failed else (low, min(high, int(v)))
        assert r.kept == (not r.base_failed and not failed) and r.stratum == ("below 100 words" if r.n_words < 100 else "long")
    assert all(low < high for low, high in cutoffs.values())  # one cutoff a rule and stratum explains all verdicts
    assert any(r.failed_rules for r in got)


def test_copies_are_no_trials(spark):
    """Four texts, copied two hundred times each, prove nothing about a risk."""
    docs = [(i, " ".join(f"a{i % 4}b{j}" for j in range(60)), "en", "s", 1) for i in range(800)] + [(900 + i, junk(i), "en", "s", 1) for i in range(200)]
    got = rules.rule_verdicts(frame(spark, docs), labels(spark, [(d[0], int(d[0] < 900), 0) for d in docs])).collect()
    assert all(r.kept for r in got)


def junk(i):
    return " ".join(f"w{i}x{j}###" for j in range(80))


def test_cutoffs_and_risk(spark):
    good = [(i, t + " " + t[::-1], *r) for i, t, *r in documents(9, 300)]
    good = [d for d in good if len(d[1].split()) >= 50]
    bad = [(1000 + i, junk(i), "en", "s0", 1) for i in range(120)]
    known = [(d[0], 1, 0) for d in good] + [(d[0], 0, 0) for d in bad[:100]]
    got = {r.doc_id: r for r in rules.rule_verdicts(frame(spark, good + bad), labels(spark, known)).collect()}
    assert all(not got[d[0]].kept for d in bad)
    rejected = [d for d in good if not got[d[0]].kept and not got[d[0]].base_failed]
    assert len(rejected) <= 0.05 * len(good)
    for d in good + bad:
        r = got[d[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(d[1])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_few_labels_prove_nothing(spark):
    docs = [(i, " ".join(f"a{i}b{j}" for j in range(60)), "en", "s", 1) for i in range(10)] + [(50 + i, junk(i), "en", "s", 1) for i in range(10)]
    got = rules.rule_verdicts(frame(spark, docs), labels(spark, [(d[0], int(d[0] < 50), 0) for d in docs])).collect()
    assert all(r.kept for r in got)


def test_risk_is_held_by_rejecting_nothing_more(spark):
    """Good and bad documents alike have symbols: no cutoff passes the bound."""
    docs = [(i, junk(i), "en", "s", 1) for i in range(400)]
    got = rules.rule_verdicts(frame(spark, docs), labels(spark, [(i, i % 2, 0) for i in range(400)])).collect()
    assert sum(not r.kept for r in got if r.doc_id % 2) <= 0.05 * 200


def test_awkward_rows(spark):
    rows = messy()
    got = rules.rule_verdicts(frame(spark, rows, extra=True), labels(spark, [(None, 1, None), (0, None, 1), (0, 1, 0), (0, 0, 0)])).collect()
    assert len(got) == len(rows)
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (100, 101, 102))
    assert {r.base_failed for r in got if r.doc_id == 103} == {True}
    assert rules.rule_verdicts(frame(spark, []), labels(spark)).count() == 0
