"""Stored indexes: what they read, what they skip, and that they find what plain scans find."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexis.operators import examples, fulltext, headword, permuterm, probe, translation, wildcard
from lexis.plans.api import Lexicon
from lexis.sources import covering
from lexis.sources.lexicon import Tables

from . import lexicon_data as data


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The small lexicon, stored with every covering copy."""
    worth, covering.WORTH = covering.WORTH, 0
    folder = f"file://{tmp_path_factory.mktemp('lexicon')}"
    data.tables(spark).write(folder)
    covering.WORTH = worth
    return Tables.read(spark, folder)


def leaves(plan):
    """The scans of an executed plan, behind adaptive stages too."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from leaves(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from leaves(plan.plan())
    elif name == "FileSourceScanExec":
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from leaves(children.apply(i))


def files_read(df, table: str) -> int:
    df.collect()
    return sum(s.metrics().apply("numFiles").value() for s in leaves(df._jdf.queryExecution().executedPlan()) if f"/{table}" in s.relation().location().rootPaths().head().toString())


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, q string")


def batch(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "qid int, word string")


def test_files_read_grow_with_the_batch(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("key"), "id")
    buckets = covering.write_copy(df, "key", f"file://{tmp_path}/t.key", 100_000 * 64)
    copy = covering.read_copy(spark, f"file://{tmp_path}/t.key", df.schema, "key", buckets)
    assert buckets == 64

    def met(*keys):
        wanted = batch(spark, *keys)
        found = wanted.join(copy.near(wanted, "word"), F.col("word") == F.col("key"))
        assert "dynamicpruning" in found._jdf.queryExecution().toString()
        assert sorted(r.word for r in found.collect()) == sorted(list(keys) * 4)
        return files_read(found, "t.key")

    one, ten = met("k1"), met(*(f"k{i}" for i in range(10)))
    assert one == 1 and one < ten <= 10


def test_lookup_reads_no_whole_table(spark, stored):
    found = headword.exact(batch(spark, "amiko"), stored)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert 0 < files_read(found, "nodo.kap_norm") < stored.copies["nodo", "kap_norm"].frame.select(F.input_file_name()).distinct().count()
    assert files_read(headword.exact(batch(spark, "amiko"), stored), "nodo/") == 0


@pytest.mark.parametrize("search", ["eo", "translation", "examples", "family"])
def test_stored_equals_made_on_the_fly(spark, stored, search):
    plain, asked = data.tables(spark), queries(spark, "amiko", "hundeto", "amikojn", "ami", "friend", "a book", "abelojn", "nia", "%", "zzz", "malamiko")
    with_lang = asked.withColumn("lang", F.lit("en"))
    run = {
        "eo": lambda t: headword.headword_hits(asked, t, fts_fallback=True), "translation": lambda t: translation.lookup_translations(with_lang, t),
        "examples": lambda t: examples.lookup_examples(asked, t), "family": lambda t: Lexicon(spark, t).family(asked),
    }[search]
    rows = [sorted(map(str, run(t).collect())) for t in (plain, stored)]
    assert rows[0] == rows[1] and rows[0]


def test_wildcards_equal_like_on_fuzzed_patterns(spark, stored):
    rng = random.Random(3)
    patterns = ["*", "a*", "*o", "*i*", "a*o", "am*ik*o", "amiko", "%", "_", "a%b_c", "*\\*", "%i_o", "a*%_", "***", "Ĉ*", "*zz", "amiko*", "*amiko"]
    patterns += ["".join(rng.choice("amiko*%_ hund") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    asked = spark.createDataFrame(list(enumerate(patterns)), "qid int, pattern string")
    got = {(r.qid, r.kap_norm) for r in permuterm.matching(permuterm.globs(asked), stored).collect()}
    heads = {r.kap_norm for r in stored.nodo.select("kap_norm").collect()}

    def like(word, pattern):
        low = pattern.lower().replace("*", "%")
        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low), word, re.S) is not None

    assert got == {(i, w) for i, p in enumerate(patterns) for w in heads if like(w, p)}


def test_keys_of_patterns(spark):
    asked = spark.createDataFrame([(0, "%rod"), (1, "r%d"), (2, "%e%"), (3, "red%"), (4, "a%long%b"), (5, "x"), (6, "%")], "qid int, like string")
    found = {r.qid: r.key for r in permuterm.keys(asked).collect()}
    assert found == {0: "rod\x01", 1: "d\x01r", 2: "e", 3: "\x01red", 4: "long", 5: "\x01x", 6: "\x01"}


def test_pages_of_patterns(spark, stored):
    asked = spark.createDataFrame([(0, "*o"), (1, "*a*"), (2, "zz*")], "qid int, pattern string")
    heads = sorted({r.kap for r in stored.nodo.collect()}, key=lambda k: (len(k), k))
    for offset, limit in ((0, 2), (1, 3), (3, 100), (50, 5)):
        got = {}
        for r in sorted(wildcard.pages(asked, stored, limit, offset).collect(), key=lambda r: (r.qid, r.ord)):
            got.setdefault(r.qid, []).append((r.ord, r.kap))
        for qid, fits in ((0, lambda k: k.lower().endswith("o")), (1, lambda k: "a" in k.lower())):
            page = [k for k in heads if fits(k)][offset : offset + limit]
            assert got.get(qid, []) == list(enumerate(page, 1))
        assert 2 not in got


def corpus(spark, n=3000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        words = ["la"] * rng.randint(1, 3) + [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 12))]
        rng.shuffle(words)
        if i % 100 == 0:
            words[0:0] = ["rara", "la", "vorto"]
        rows.append((i, " ".join(words)))
    return rows, spark.createDataFrame(rows, "rid long, ekz_md string")


def indexed(spark, docs, rows):
    t = data.tables(spark)
    blocks = fulltext.blocks(docs, "ekz_md", rows).cache()
    own = fulltext.lengths(docs, "ekz_md")
    return Tables(t.nodo, t.var, t.traduko, t.referenco, t.uzo, docs, t.artikolo, ekz_blocks=blocks, ekz_terms=fulltext.terms(blocks).cache(), ekz_lengths=own, ekz_stats=fulltext.corpus_stats(own))


def count_of(words, phrase):
    return sum(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def test_phrases_start_at_the_rarest_term(spark):
    rows, docs = corpus(spark)
    t = indexed(spark, docs, 40_000)
    texts = ("rara la", "la vorto", "la", "aa la bb", "la la", "aa aa", "la zz", "rara la vorto")
    got = {(r.qid, r.rid, r.tf) for r in fulltext.phrase_hits(spark.createDataFrame(list(enumerate(texts)), "qid int, text string"), t, "ekz").collect()}
    assert got == {(n, i, c) for n, text in enumerate(texts) for i, x in rows if (c := count_of(x.split(), text.split()))}
    asked = fulltext.phrases(spark.createDataFrame([(0, "rara la", 0)], "qid int, text string, phrase int"))
    found = fulltext.known_terms(asked, t, "ekz")
    assert [(r.term, r.nth) for r in found.orderBy("nth").collect()] == [("rara", 1), ("la", 2)]
    seeds = fulltext.rarest_blocks(found, t, "ekz")
    assert seeds.agg(F.sum("block_rows")).first()[0] == 30  # of 3000 rows with "la" no others are met
    assert fulltext.hits_in(seeds, found, fulltext.other_blocks(found, t, "ekz")).count() == 30


def test_best_hits_skip_blocks(spark, monkeypatch):
    rows, docs = corpus(spark)
    t = indexed(spark, docs, 40_000)
    avgdl = t.ekz_stats.first().avgdl
    read = []
    real = fulltext.hits_in
    monkeypatch.setattr(fulltext, "hits_in", lambda seeds, *rest: (read.append(seeds), real(seeds, *rest))[1])
    for text, limit in (("la", 20), ("rara la", 7), ("aa bb", 10_000)):
        read.clear()
        got = [(r.rid, r.ord) for r in fulltext.best_phrase_hits(spark.createDataFrame([(0, text)], "qid int, text string"), t, "ekz", limit).orderBy("ord").collect()]
        scored = []
        for i, x in rows:
            if tf := count_of(x.split(), text.split()):
                dl = len(x.split())
                scored.append((-round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9), i))
        assert got == [(i, n) for n, (_, i) in enumerate(sorted(scored)[:limit], 1)], text
        if (text, limit) == ("la", 20):
            used, every = sum(s.count() for s in read), t.ekz_blocks.where("term = 'la'").count()
            assert used < every / 2, (used, every)


def test_prefixes_of_any_length(spark):
    rows, docs = corpus(spark, 300)
    t = indexed(spark, docs, 1000)
    texts = ("r", "ra", "rar", "rara", "l", "a", "zz")
    got = {(r.qid, r.rid, r.tf) for r in fulltext.prefix_hits(spark.createDataFrame(list(enumerate(texts)), "qid int, text string"), t, "ekz").collect()}
    assert got == {(n, i, c) for n, text in enumerate(texts) for i, x in rows if (c := sum(w.startswith(text) for w in x.split()))}


def test_substrings_need_every_piece(spark, stored):
    wanted = {"friend": {"friend"}, "mall d": {"small dog"}, "end": {"friend"}, "o r%ad": {"to read a book"}, "l_ner": {"loner"}, "frixnd": set(), "dog%z": set()}
    rows = translation.substring_rows(spark.createDataFrame([(i, w, "en") for i, w in enumerate(wanted)], "qid int, word string, lang string"), stored).collect()
    for i, (word, found) in enumerate(wanted.items()):
        assert {r.trd for r in rows if r.qid == i} == found, word


def test_a_hit_runs_no_further_tier(spark, stored):
    lex = Lexicon(spark, stored)
    for query, lang, tried in (("amiko", "eo", ["exact"]), ("amikojn", "eo", ["exact", "variant", "stem"]), ("a book", "en", ["exact", "phrase"])):
        p = probe.Probe()
        assert "##" in lex.request(query, lang, probe=p).first()["md"]
        assert [x for x in p.tried if x != "results"] == tried, query
        p.close()


def test_requests_equal_batches(spark, stored):
    lex = Lexicon(spark, stored)
    from lexis.operators import render

    for query in ("amikojn", "zzz"):
        asked = queries(spark, query)
        assert lex.handle_lookup(query) == render.render_results(asked, lex.lookup(asked)).first()["md"]
        assert lex.handle_lookup(query, "all") == render.render_results(asked, lex.lookup_all(asked)).first()["md"]
        with_lang = asked.withColumn("lang", F.lit("de"))
        assert lex.handle_lookup(query, "de") == render.render_results(asked, lex.lookup_translation(with_lang)).first()["md"]
    assert lex.handle_examples("abelojn") == render.render_examples(queries(spark, "abelojn"), lex.examples(queries(spark, "abelojn"))).first()["md"]
    assert "No results found" not in lex.handle_lookup("mohéli")  # falls back to examples


def test_manifest_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    assert covering.read_manifest(spark, path) is None
    covering.write_manifest(spark, path, {"a": 1})
    covering.write_manifest(spark, path, {"b": [2]})
    assert covering.read_manifest(spark, path) == {"b": [2]}
    with pytest.raises(ValueError):
        Tables.read(spark, f"file://{tmp_path}/nothing")
