import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexis.llm import decontamination as dc

from .data import documents, frame, messy

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    """Hit positions and items, window by window."""
    own, hit, found = words(text), set(), set()
    for name, item in items:
        ws = words(item)
        if not ws:
            continue
        n = min(width, len(ws))
        for w in {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) == w:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(own), hit, found


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=24), max_size=5), st.text(alphabet="abc ", max_size=60), st.integers(2, 4))
def test_automaton(items, text, width):
    automaton = dc.Automaton(width).build([(str(i), dc.words_of(t.encode())) for i, t in enumerate(items)])
    spans, found = automaton.spans(dc.words_of(text.encode()))
    _, hit, wanted = brute(text, list(enumerate(items)), width)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == wanted


def fixture():
    rng = random.Random(8)
    docs = documents(8, 30)
    items = [(i, " ".join(words(docs[i][1])[3:25])) for i in range(6)] + [(20, "zeta eta"), (21, "!!"), (22, None), (23, "Über-Größe 12 naïve")]
    texts = [d[1] for d in docs]
    texts[10] = texts[10] + " ZETA, eta. " + texts[11]
    texts[12] = "x " + " ".join(words(texts[0])[5:15]).upper() + " y"
    texts[13] = "über größe 12 NAÏVE"
    rng.shuffle(docs)
    return [(d[0], texts[d[0]], *d[2:]) for d in docs], items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_rows_and_blocks(spark):
    docs, items = fixture()
    for block in (dc.BLOCK, 15):  # one automaton, and several
        got = {r.doc_id: r for r in dc.contamination(frame(spark, docs), bench(spark, items), block=block).collect()}
        assert len(got) == len(docs)
        for d in docs:
            n, hit, found = brute(d[1], items)
            r = got[d[0]]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_spans_are_cut(spark):
    docs, items = fixture()
    for block in (dc.BLOCK, 15):
        got = {r.doc_id: r for r in dc.cleaned(frame(spark, docs, extra=True), bench(spark, items), coverage=0.5, block=block).collect()}
        for d in docs:
            n, hit, _ = brute(d[1], items)
            if len(hit) > 0.5 * n:
                assert d[0] not in got
            elif not hit:
                assert tuple(got[d[0]][:5]) == d
            elif d[0] in got:
                assert not brute(got[d[0]].text, items)[1] and got[d[0]].n_chars == len(got[d[0]].text)
    strict = {r.doc_id for r in dc.cleaned(frame(spark, docs), bench(spark, items), coverage=0.0).collect()}
    assert strict == {d[0] for d in docs if not brute(d[1], items)[1]}


def test_awkward_rows(spark):
    docs, items = fixture()
    got = dc.contamination(frame(spark, messy(), extra=True), bench(spark, items)).collect()
    assert len(got) == len(messy())
    assert {(r.n_words, r.n_hit) for r in got if r.doc_id in (100, 101, 102)} == {(0, 0)}
    assert not any(r.contaminated for r in dc.contamination(frame(spark, docs), bench(spark, [])).collect())
    assert dc.contamination(frame(spark, []), bench(spark, items)).count() == 0
    assert dc.cleaned(frame(spark, messy()), bench(spark, items)).where("doc_id = 100 and text is null").count() == 1
    several = dc.contamination(frame(spark, messy()), bench(spark, items), block=15)
    assert several.count() == len(messy())


def test_a_long_benchmark_takes_one_scan(spark, tmp_path):
    """A million words of items in many automata: documents are read once."""
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(50_000)}" for _ in range(500))) for i in range(2000)]
    hit = " ".join(items[7][1].split()[100:112])
    docs = [(1, f"none here {hit} end", "en", "s", 1), (2, "nothing", "en", "s", 1), (3, " ".join([*items[1999][1].split()[:10], "x", *items[0][1].split()[-10:]]), "en", "s", 1)]
    frame(spark, docs).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    found = dc.hits(read, bench(spark, items), block=40_000)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {r.id: (r.n_words, [(s.begin, s.end) for s in r.spans], r["items"]) for r in found.collect()}
    assert got == {1: (15, [(2, 14)], ["7"]), 2: (1, [], []), 3: (21, [(0, 10), (11, 21)], ["0", "1999"])}


def test_blocks_judge_rows_alone(spark):
    _, items = fixture()
    hit, clean = items[0][1], " ".join(f"none{i}" for i in range(len(words(items[0][1]))))
    rows = messy() + [(i, t, "en", "s0", 1) for i in (None, 7) for t in (hit, clean, clean)]
    columns = lambda block: sorted(map(str, dc.contamination(frame(spark, rows, extra=True), bench(spark, items), block=block).collect()))
    assert columns(15) == columns(dc.BLOCK)
