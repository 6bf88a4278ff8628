"""The lexicon made from the driver's tables: a search makes its own part of it, and finds what the stored indexes find."""

from pathlib import Path

import pytest

from lexis.operators import common, fulltext
from lexis.plans import catalog
from lexis.shared import shared_dir
from lexis.sources import covering, surrogate

NAMES = ("red rod", "blue cup", "red cup", "old rod")
TEXTS = ("In the house. The cup is in the attion\nun vent", "La maison. Un vent dans in the attic. tions", "tion in un the", None)


def folder_of(spark, path: Path) -> str:
    """A small copy of the driver's tables."""
    part = [(i, NAMES[i % 4], f"Brand#{i % 3}", f"TYPE {i % 2}", i % 9) for i in range(40)]
    docs = [(i, TEXTS[i % 4], ("en", "fr", "de")[i % 3]) for i in range(50)]
    lines = [(i, i % 40, (i * 7) % 40, "ANR"[i % 3]) for i in range(120)]
    for name, rows, schema in (
        ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("documents", docs, "doc_id long, text string, lang string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"), ("orders", [(i, f"{i % 5}-X") for i in range(120)], "o_orderkey long, o_orderpriority string"),
        ("pages", [(i, "<h1>a</h1>") for i in range(5)], "page_id long, html string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables twice: of the second, the lexicon is stored with every covering copy."""
    own, other = (folder_of(spark, tmp_path_factory.mktemp("tables")) for _ in range(2))
    worth, covering.WORTH = covering.WORTH, 0
    surrogate.store(spark, other)
    covering.WORTH = worth
    return own, other


def rows(spark, name: str, folder: str) -> list:
    out = sorted(map(repr, catalog.QUERIES[name](spark, folder).collect()))
    common.release()
    return out


def written(spark) -> set:
    return set(Path(shared_dir(spark).removeprefix("file://")).iterdir())


@pytest.mark.parametrize("name", ["drv_key", "fts_postings", "group_by_drv", "headword_stem", "trans_exact", "fts_phrase", "stem_candidates", "examples_stem_guard", "family_roots", "family_members"])
def test_a_search_stores_no_lexicon(spark, folders, name):
    before = written(spark)
    assert rows(spark, name, folders[0])
    assert written(spark) == before


@pytest.mark.parametrize(
    "name",
    ["lookup_eo", "trans_exact_all", "trans_substring", "trans_fts_quoted", "all_languages_merge", "family_translations", "fts_phrase", "fts_prefix", "examples_bm25", "examples_by_stem", "examples_grouped", "examples_headword", "lookup_examples", "bm25_stats", "render_family", "assemble_senses", "assemble_crossrefs"],
)
def test_what_is_not_stored_is_found_alike(spark, folders, name):
    assert rows(spark, name, folders[0]) == rows(spark, name, folders[1])


def test_only_blocks_of_asked_terms_are_made(spark, folders):
    t = surrogate.tables(spark, folders[0])
    asked = spark.createDataFrame([(0, 0, "house")], "qid int, phrase int, term string")
    assert {r.term for r in fulltext.narrowed(t, "ekz", asked).ekz_blocks.collect()} == {"house"}
    assert {r.term for r in fulltext.narrowed(t, "ekz", asked.selectExpr("'ti' || 'o' head"), "head").ekz_terms.collect()} == {"tion", "tions"}
    common.release()


def test_most_buckets_are_no_filter(spark):
    keys = spark.range(3 * covering.MOST).selectExpr("cast(id as string) k")
    assert covering.asked_for(keys, "k") is None
    some = covering.asked_for(keys.where("k < '1000'").limit(5), "k")
    assert keys.where(some(keys.k)).count() < keys.count() / 10
