from lexis.operators import html

from .lexicon_data import ARTICLE


def test_derivations():
    found = {d["mrk"]: d for d in html.derivations(html.parse(ARTICLE))}
    assert list(found) == ["amik.0o", "amik.0a", "amik.mal0o", ""]
    first = found["amik.0o"]
    assert first["headword"] == "amiko"
    nums = [(s["mrk"], s["num"], s["definition"], s["domain"]) for s in first["senses"]]
    assert nums == [("amik.0o.PERS", "1.", "Kara homo", "POL"), (None, "a)", "interna", None), ("amik.0o.KOMUNE", "3.", "komune", None)]
    assert first["senses"][0]["examples"] == ["bona amiko & kuzo", "nia amiko"]  # the outer dd holds the inner one's too
    assert found["amik.0a"]["senses"] == [{"mrk": "amik.0a", "num": None, "definition": "sen numero", "examples": ["tre Amika virox"], "domain": None}]
    assert found["amik.mal0o"]["senses"] == [{"mrk": "amik.mal0o", "num": None, "definition": "kontraŭa", "examples": ["malamikoj venis"], "domain": None}]


def test_keys():
    keyed = html.keyed_senses(html.parse(ARTICLE))
    assert set(keyed) == {"amik.0o", "amik.0o.PERS", "x", "amik.0o.KOMUNE", "amik.0a", "amik.mal0o"}
    assert [s["definition"] for s in keyed["amik.0o.KOMUNE"]] == ["komune"]


def test_examples():
    assert html.article_examples(html.parse(ARTICLE)) == [
        ("amik.0o", "amik.0o.PERS", "bona amiko &amp; kuzo"), ("amik.0o", None, "nia amiko"), ("amik.0a", None, "tre **Amika** viro"), ("amik.mal0o", None, "malamikoj venis"),
    ]


def test_page_profile():
    page = "<nav><p>menu</p></nav><article><h1>Title &amp; more</h1><p>One  two</p><div class='ad'><p>buy</p></div><p><script>x</script></p></article>"
    assert html.page_examples(html.parse(page)) == [("Title & more", None, "One two")]


def test_lenient_parser():
    root = html.parse("<div><p>a<br>b</span></div>c &lt;&#65; <img/>")
    assert root.text() == "abc <A "
    assert html.parse("").text() == ""


def test_deep_pages(spark):
    deep = "<div>" * 3000 + '<section class="drv"><h2 id="k">w</h2><dd><span class="dif">d<i class="ekz">e <b class="nom">N</b></i></span></dd></section>'
    root = html.parse(deep)
    assert [d["headword"] for d in html.derivations(root)] == ["w"] and html.article_examples(root) == [("k", None, "e **N**")] and root.text().startswith("w")
    pages = spark.createDataFrame([("good", 1, deep), ("bad", 2, "<![x y]>"), ("closed", 3, "<p></p>" * 20_000 + deep), ("deeper", 4, "<div>" * 50_000 + "</b>" * 50_000 + deep)], "mrk string, rid long, txt string")
    assert sorted(r.art for r in html.parse_articles(pages).collect()) == ["closed", "deeper", "good"]
    assert [tuple(r) for r in html.failures(pages).collect()] == [("bad", "AssertionError: unknown status keyword 'x ' in marked section")]


def test_many_siblings_in_linear_time():
    n = 100_000
    page = '<section class="drv"><h2 id="k.0">w</h2><dl>' + "".join(f'<dt id="k.0.{i}">{i}.</dt><dd><i class="ekz">e{i}</i></dd>' for i in range(n)) + "</dl></section>"
    root = html.parse(page)
    found = html.article_examples(root)
    assert len(found) == n and found[-1] == ("k.0", f"k.0.{n - 1}", f"e{n - 1}")
    assert len(html.keyed_senses(root)["k.0"]) == n


def test_first_of_equal_keys_and_script_blanks():
    root = html.parse('<section class="drv"><h2 id="a.0">x</h2><dl><dt id="a.0.1"> \x1f1. \ufeff</dt></dl><p></p><dl><dt id="a.0.1">2.</dt><dd><span class="dif">d</span></dd></dl></section>')
    assert "a.0.1" not in html.keyed_senses(root)  # the first dt with this id has no dd beside it
    assert html.senses_of(root.first(("section", "drv")), "a.0")[0]["num"] == "2."
    assert html.trim("\ufeff \x1f1.\xa0") == "\x1f1."


def test_one_parse_gives_all(spark, monkeypatch):
    articles = spark.createDataFrame([("amik", 7, ARTICLE), ("bad", 8, "<![x y]>")], "mrk string, rid long, txt string")
    found = html.extracted(articles).cache()
    assert {r.key for r in html.senses_in(found).collect()} == set(html.keyed_senses(html.parse(ARTICLE)))
    assert [r.rid for r in html.examples_in(found).orderBy("position").collect()] == [(7 << 20) + i for i in range(4)]
    assert [r.art for r in html.failures_in(found).collect()] == ["bad"]


def test_frames(spark):
    articles = spark.createDataFrame([("amik", 1, ARTICLE), ("none", 2, None), ("empty", 3, "")], "mrk string, rid long, txt string")
    assert [(r.mrk, len(r.senses)) for r in html.parse_articles(articles).orderBy("position").collect()] == [("amik.0o", 3), ("amik.0a", 1), ("amik.mal0o", 1), ("", 1)]
    rows = html.build_examples(articles).orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1, 2, 3] and len({r.rid for r in rows}) == 4
    assert html.parse_senses(articles.where("mrk = 'none'")).count() == 0
