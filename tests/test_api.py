import json
import sqlite3
from dataclasses import replace

import pytest

from lexis.operators import headword, html, render, translation, wildcard
from lexis.plans import sqlfuncs
from lexis.plans.api import Lexicon
from lexis.sources.lexicon import SCHEMAS, Tables
from lexis.sources.sqlite import read_lexicon
from lexis.streaming.requests import serve

from . import lexicon_data as data


@pytest.fixture(scope="module")
def lex(spark):
    return Lexicon(spark, data.tables(spark))


AMIKO = """## amiko
**Domain:** POL, BIO

### Translations
- **Angla** (en): friend, pal
- **Franca** (fr): ami
- **Germana** (de): Freund

### Definitions
**1.** Kara homo *(POL)*
  - *bona amiko & kuzo*
  - *nia amiko*

**a)** interna
  - *nia amiko*

**3.** komune


### See also
- See: hundo
- Synonym: bela
- zzz: Ĉambro
- Differs from: hundido
- Homonym: amika"""


def test_lookup_markdown(lex):
    assert lex.handle_lookup("amiko").split("\n\n---\n\n")[0] == AMIKO
    assert lex.handle_lookup("amikojn", show_languages=["fr"], limit=1).startswith("## amiko\n*Matched via: stem:amiko*\n**Domain:** POL, BIO\n\n### Translations\n- **Franca** (fr): ami\n\n### Definitions")
    assert lex.handle_lookup("qqq") == "No results found."
    assert lex.handle_lookup("Hund", lang="de").startswith("## hundo\n*Matched via: translation:de:Hund*")
    assert "translation:en:dog" in lex.handle_lookup("dog", lang="all")
    assert lex.handle_lookup("deux", lang="fr") == "No results found."


def test_fallback_to_examples(lex):
    assert lex.handle_lookup("kuzo") == "No dictionary entry for `kuzo`. Found 1 example sentence containing it:\n\n## amiko\n- bona amiko &amp; kuzo\n\n_Call `lookup` on any headword above for its full dictionary entry._"


def test_wildcard_markdown(lex):
    foot = "_Call `lookup` on any headword (without `*`) for full definition and translations._"
    assert lex.handle_lookup("zq*") == "No headwords match `zq*`."
    assert lex.handle_lookup("hund*") == f"Found 2 Esperanto headwords matching `hund*` (gloss: Angla).\n\n- **hundo** — dog\n- **hundido** — small dog\n\n{foot}"
    assert lex.handle_lookup("*ami*", show_languages=["fr"], limit=2, offset=1) == (
        f"Found 4 Esperanto headwords matching `*ami*` (gloss: Franca) (showing 2–3 of 4).\n\n- **amika**\n- **amiko** — ami\n\n_More results available. Call lookup again with `offset: 3` to get the next page._\n{foot}"
    )
    assert lex.handle_lookup("*ami*", offset=9) == f"Found 4 Esperanto headwords matching `*ami*` (gloss: Angla) (showing 10–9 of 4).\n\n\n{foot}"
    assert lex.handle_lookup("legi*").startswith("Found 1 Esperanto headword matching")


def test_other_handlers(lex):
    assert lex.handle_examples("zzz") == "No example sentences match `zzz`."
    assert lex.handle_examples("amiko").startswith("Found 2 example sentences matching `amiko`.\n\n## amiko\n- nia amiko\n- bona")
    assert lex.handle_root("hundojn") == "## Word family: hund\n- **hundido** — en: small dog\n- **hundo** — de: Hund | en: dog"
    assert lex.handle_root("amik", ["xx"]).endswith("- **malamiko** — (no translations)")
    assert lex.handle_root("zzz") == 'No word family found for "zzz".'
    table = lex.handle_languages().split("\n")
    assert table[0] == "## Available Languages (5 total)" and table[4] == "| en | Angla | 9 |"


@pytest.mark.parametrize("call", [lambda x: x.handle_lookup(""), lambda x: x.handle_lookup("a" * 201), lambda x: x.handle_lookup("a", limit=0), lambda x: x.handle_lookup("a", limit=501), lambda x: x.handle_lookup("a", offset=-1), lambda x: x.handle_examples("a", 101), lambda x: x.handle_root("a" * 101), lambda x: x.handle_lookup("a", limit=True)])
def test_validation(lex, call):
    with pytest.raises(ValueError):
        call(lex)


def test_fallback_without_hits(spark, lex):
    asked = lex.one("zzz")
    assert render.render_examples(asked, lex.examples(asked), True).first().md == "No dictionary entry for `zzz`, and no examples contain this word."


def test_render_all(spark, lex):
    heads = spark.createDataFrame([(i, r[2]) for i, r in enumerate(data.NODO)], "qid int, q string")
    kinds = {r.qid: r.kind for r in lex.render_all(heads).collect()}
    assert len(kinds) == len(data.NODO) and kinds[0] == "ok" and kinds[12] == "no-senses" and set(kinds.values()) <= {"ok", "no-senses", "empty"}


def test_failures_are_counted_and_reported(spark, lex, tmp_path):
    odd = spark.createDataFrame([("hund", 1, "<![x y]>"), ("amik", 2, data.ARTICLE)], "mrk string, rid long, txt string")
    broken = Lexicon(spark, replace(lex.tables, senses=html.parse_senses(odd), failures=html.failures(odd)))
    done = broken.failure_report(str(tmp_path / "report"))
    assert done.count() == len(data.NODO)
    report = [json.loads(line) for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()]
    crashed = [(r["kap"], r["message"]) for r in report if r["kind"] == "crash"]
    assert sorted(crashed) == [(k, "AssertionError: unknown status keyword 'x ' in marked section") for k in ("hundido", "hundo")]
    assert len(report) == done.where("kind <> 'ok'").count() and {r["kind"] for r in report} >= {"crash", "no-senses"}


def test_sql_functions(spark, lex):
    sqlfuncs.register(spark, lex.tables)
    assert spark.sql("SELECT h.mrk FROM VALUES ('Hundo'), ('zzz') q(w), LATERAL lexis_headword(q.w) h").collect()[0].mrk == "hund.0o"
    assert spark.sql("SELECT kap FROM lexis_variant('hundeto')").first().kap == "hundo"
    assert spark.sql("SELECT kap FROM lexis_headword('cxambro')").first().kap == "Ĉambro"
    assert spark.sql("SELECT headword, matched_via FROM lexis_translation('Hund', 'de')").first() == ("hundo", "translation:de:Hund")
    assert spark.sql("SELECT sum(count) n FROM lexis_languages()").first().n == len(data.TRADUKO)


WORDS = ("amiko", "Hundojn", " amikojn\t", "hundeto", "ami", "a%", "cxambro", "zzz", "", "österreich")


def test_sql_searches_are_those_of_the_interface(spark, lex):
    t = lex.tables
    sqlfuncs.register(spark, t)
    asked = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "qid int, q string" + ", lang string" * (len(rows[0]) - 1))

    def same(call: str, wanted, rows: list[tuple], names: str) -> None:
        asked(*rows).createOrReplaceTempView("asked")
        got = spark.sql(f"SELECT qid, h.* FROM asked, LATERAL {call} h").selectExpr("qid", *names.split(", ")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, wanted.selectExpr("qid", *names.split(", ")).collect()), key=str)

    results = "pos, headword, article, mrk, matched_via"
    one = [(w,) for w in WORDS]
    same("lexis_lookup(q)", headword.lookup_headwords(asked(*one), t), one, results)
    same("lexis_all(q, 3)", translation.lookup_all(asked(*one, ("dog",), ("small",)), t, 3), [*one, ("dog",), ("small",)], results)
    by_language = [("Hund", "de"), ("small", "en"), ('"a book"', "en"), ('read "a', "en"), ("o%k", "en"), ("end", "en"), ("zzz", "xx"), ("dog", "de")]
    same("lexis_translation(q, lang)", translation.lookup_translations(asked(*by_language), t), by_language, results)
    phrases = [("bona amiko",), ("abelojn",), ("mohéli",), ("malamikoj",), ("viron",), ("zzz",)]
    same("lexis_examples(q)", lex.examples(asked(*phrases)), phrases, "ord, art, drv_mrk, sense_mrk, headword, ekz_md, matched_via")
    roots = [("hundojn",), ("amik",), ("bela",), ("zzz",)]
    same("lexis_family(q)", lex.family(asked(*roots)), roots, "ord, root, drv, headword, translations")
    for pattern in ("hund*", "*ami*", "h*t*", "zq*"):
        got = spark.sql(f"SELECT * FROM lexis_wildcard('{pattern}')").collect()
        assert [tuple(r)[:5] for r in got] == [tuple(r) for r in wildcard.lookup_wildcard(t, pattern).select(*results.split(", ")).orderBy("pos").collect()]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "lex.db")
    db = sqlite3.connect(path)
    for name, rows in (("nodo", data.NODO), ("var", data.VAR), ("traduko", data.TRADUKO), ("referenco", data.REFERENCO), ("uzo", data.UZO), ("artikolo", [(m, x.encode() if x else x) for m, x in data.ARTIKOLO])):
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ") if not c.startswith("rid")]
        db.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    db.commit()
    db.close()
    tables = read_lexicon(spark, path, 3)
    assert [tuple(r) for r in tables.nodo.select("mrk", "art", "kap", "num").orderBy("rid").collect()] == data.NODO
    assert Lexicon(spark, tables).handle_lookup("amiko").split("\n\n---\n\n")[0] == AMIKO
    folder = str(tmp_path / "stored")
    tables.write(folder)
    assert Tables.read(spark, folder).nodo.count() == len(data.NODO)


def test_stream(spark, lex, tmp_path):
    for i, words in enumerate((["amiko", "zzz"], ["hundeto"])):
        spark.createDataFrame([(10 * i + j, w) for j, w in enumerate(words)], "qid int, q string").write.parquet(str(tmp_path / f"in/b{i}"))
    requests = spark.readStream.schema("qid int, q string").parquet(str(tmp_path / "in/*"))
    serve(requests, lex, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.qid, r.headword) for r in got.collect()} == {(0, "amiko"), (10, "hundo")}
