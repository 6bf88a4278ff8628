import pytest

from lexis.operators import common, examples, family, headword, translation, wildcard
from lexis.plans.api import Lexicon

from .lexicon_data import tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def lex(spark, t):
    return Lexicon(spark, t)


def ask(spark, *rows):
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "qid int, q string" + (", lang string" if isinstance(rows[0], tuple) else ""))


def results(df):
    out = {}
    for r in df.orderBy("qid", "pos").collect():
        out.setdefault(r.qid, []).append((r.headword, r.mrk, r.matched_via))
    return out


def test_waterfall(spark, t):
    queries = ask(spark, "amiko", "hundeto", "amikojn", "hundi", "fantomo", "zzz", "  ", "Cxambro", "AMIKA", "am")
    got = results(headword.lookup_headwords(queries, t))
    assert got[0] == [("amiko", "amik.0o", None), ("amiko", "bel.0ul", None)]
    assert got[1] == [("hundo", "hund.0o", None)]
    assert {v for _, _, v in got[2]} == {"stem:amiko"}  # amik/ is no headword amik
    assert got[3] == [("hundido", "hund.0ido", "prefix:hundi")]
    assert 4 not in got and 5 not in got and 6 not in got  # a variant without node falls through to nothing
    assert got[7] == [("Ĉambro", "cambr.0o", None)] and got[8] == [("amika", "amik.0a", None)]
    assert [k for k, *_ in got[9]][0] == "amik/" and all(v == "prefix:am" for *_, v in got[9])


def test_wildcards_in_prefixes_are_live(spark, t):
    got = results(headword.lookup_headwords(ask(spark, "%mbr", "a%", "_und", "a\\"), t, 3))
    assert got[0][0][0] == "Ĉambro" and got[1] and got[2][0][0] == "hundo" and 3 not in got


def test_group_order_and_limit(spark, t):
    hits = headword.headword_hits(ask(spark, "amiko"), t)
    assert [r.mrk for r in hits.orderBy("ord").collect()] == ["amik.0o", "bel.0ul", "amik.0o.PERS", "amik.0o.KOMUNE"]
    assert common.group_by_drv(hits, 1).collect()[0].mrk == "amik.0o"


def test_token_prefix_tier(spark, t):
    off = headword.lookup_headwords(ask(spark, "BELA Ĉamb"), t)
    on = headword.lookup_headwords(ask(spark, "x camb"), t, fts_fallback=True)
    assert off.count() == 0 and results(on)[0] == [("Ĉambro", "cambr.0o", "fts:x camb")]


def test_translations(spark, t):
    queries = ask(spark, ("Friend", "en"), ("hund", "de"), ("österreich", "de"), ("spook", "en"), ("dog", "en"), ("read a", "en"), ("book rea", "en"), ("oun", "en"), ("pal", "en"), ("o\"d", "xx"), ("%", "ja"), ("", "en"))
    got = results(translation.lookup_translations(queries, t))
    assert got[0] == [("amiko", "amik.0o", "translation:en:friend")]
    assert got[1] == [("hundo", "hund.0o", "translation:de:Hund")]
    assert got[2] == [("bela", "bel.0a", "translation:de:Österreich")]  # not equal with A-Z folded: found by the phrase tier
    assert 3 not in got  # the tier is chosen before nodes are looked up
    assert got[4] == [("hundo", "hund.0o", "translation:en:dog")]
    assert got[5] == [("legi", "leg.0i", "translation:en:to read a book")]
    assert 6 not in got and 7 not in got and 11 not in got
    assert got[8] == [("amiko", "amik.0o", "translation:en:pal")]  # the result's own key has no such translation: the query as it came
    assert 9 not in got and got[10] == [("hundido", "hund.0ido", "translation:ja:子犬")]


def test_quotes(spark, t):
    words = translation.asked(ask(spark, 'read"a"book', 'read""a', 'r"ead', '"'))
    got = {(r.qid, r.phrase): r.text for r in translation.quoted_phrases(words).collect()}
    assert got == {(0, 0): "read", (0, 1): "a", (0, 2): "book", (1, 0): "read a"}
    assert {r.qid for r in translation.matching_rows(words, t).collect()} == {0, 1}


def test_cap_before_language(spark, t):
    rows = [(f"m{i}.0o", "fr", "x zz", i) for i in range(1, 121)] + [("amik.0o", "en", "a zz b", 500)]
    big = tables(spark)
    big.traduko = type(t).of(**{k: getattr(t, k) for k in ("nodo", "var", "referenco", "uzo", "ekzemplo", "artikolo")}, traduko=spark.createDataFrame(rows, "mrk string, lng string, trd string, rid bigint")).traduko
    q = ask(spark, ("zz b", "en"), ("zz", "en"))
    assert {r.qid for r in translation.translation_rows(q, big).where("tier = 2").collect()} == {0}
    assert {r.qid for r in translation.translation_rows(q, big, parity=False).where("tier = 2").collect()} == {0, 1}


def test_all_languages(spark, t):
    got = results(translation.lookup_all(ask(spark, "amiko", "dog", "ami", "small"), t))
    assert ("amiko", "amik.0o", None) in got[0]
    assert got[1] == [("hundo", "hund.0o", "translation:en:dog")]
    assert got[2][0][0] == "amik/" and ("amiko", "amik.0o", "translation:fr:ami") not in got[2]  # one result per key, headwords first
    assert got[3] == [("hundido", "hund.0ido", "translation:en:small dog")]


def test_examples(spark, t):
    got = {}
    for r in examples.lookup_examples(ask(spark, "amiko", "abelojn", "mohéli", "malamikojn", "zzz", "", "bona amiko"), t).orderBy("qid", "ord").collect():
        got.setdefault(r.qid, []).append((r.headword, r.ekz_md, r.matched_via))
    assert {e for _, e, _ in got[0]} == {"bona amiko &amp; kuzo", "nia amiko"} and got[0][0][1] == "nia amiko"  # shorter is better
    assert got[1] == [("hundo", "la abelojn de Mohéli", "example:abelojn")]
    assert got[2][0][:2] == ("hundo", "la abelojn de Mohéli")
    assert got[3] == [("malamiko", "malamikoj venis", "example-stem:malamik")]
    assert 4 not in got and 5 not in got and len(got[6]) == 1


def test_family(spark, t, lex):
    found = {r.qid: r.root for r in family.roots(ask(spark, "amik", "hundo", "hundojn", "zzz", "ĉambro"), t).collect()}
    assert found == {0: "amik", 1: "hund", 2: "hund"}  # capital Ĉ stays unreachable
    assert {r.root for r in family.roots(ask(spark, "ĉambro"), t, unicode_case=True).collect()} == {"cambr"}
    rows = lex.family(ask(spark, "amik")).orderBy("ord").collect()
    assert [(r.drv, r.headword) for r in rows] == [("amik.0a", "amika"), ("amik.0o", "amiko"), ("amik.mal0o", "malamiko")]
    assert [(x.lng, x.trd) for x in rows[1].translations] == [("de", "Freund"), ("en", "friend"), ("en", "pal"), ("en", "friend"), ("fr", "ami")]


def test_wildcard(t):
    assert wildcard.total(t, "*ami*").first().total == 4
    page = wildcard.lookup_compact(t, "*ami*", "en", 2, 1).orderBy("ord").collect()
    assert [(r.ord, r.kap, list(r.glosses)) for r in page] == [(1, "amika", []), (2, "amiko", ["friend", "friend"])]
    assert wildcard.page(t, "*ami*", 5, 50).count() == 0
    assert [r.headword for r in wildcard.lookup_wildcard(t, "hundet*").collect()] == ["hundo"]


def test_assembled(spark, lex):
    r = [x for x in lex.lookup(ask(spark, "amiko")).collect() if x.mrk == "amik.0o"][0]
    assert [(x.lng, x.trd) for x in r.translations] == [("en", "friend"), ("en", "friend"), ("fr", "ami"), ("de", "Freund"), ("en", "pal")]
    assert [s.num for s in r.senses] == ["1.", "a)", "3."] and list(r.usage_domains) == ["POL", "BIO"]
    assert [(x.target, x.target_kap) for x in r.cross_refs][:3] == [("hund.0o", "hundo"), ("bel.0a", "bela"), ("leg.0i", "legi")] and ("nowhere", None) in [(x.target, x.target_kap) for x in r.cross_refs]
    alone = lex.lookup(ask(spark, "solulo")).collect()[0]
    assert [x.trd for x in alone.translations] == ["loner", "solitude"] and alone.senses == []  # a key without dot: the whole article


def test_batch_is_single(spark, lex):
    words = ["amiko", "hundeto", "amikojn", "zzz", "am", "legi"]
    batch = {(r.qid, r.pos): r.mrk for r in lex.lookup(ask(spark, *words)).collect()}
    single = {(i, r.pos): r.mrk for i, w in enumerate(words) for r in lex.lookup(ask(spark, w)).collect()}
    assert batch == single
