import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexis.functions import fold, stems, text


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


X_SYSTEM = {
    "cx": "ĉ", "gx": "ĝ", "hx": "ĥ", "jx": "ĵ", "sx": "ŝ", "ux": "ŭ", "Cx": "Ĉ", "Gx": "Ĝ", "Sx": "Ŝ", "cxirkaux": "ĉirkaŭ", "gxardeno": "ĝardeno", "sxipo": "ŝipo", "jxauxdo": "ĵaŭdo",
    "hxoro": "ĥoro", "auxskulti": "aŭskulti", "Mi mangxas": "Mi manĝas", "Cxu vi parolas?": "Ĉu vi parolas?", "amiko": "amiko", "": "", "extra": "extra", "CX": "Ĉ", "cX": "cX",
}


def test_x_system(spark):
    assert values(spark, X_SYSTEM, text.from_x_system) == list(X_SYSTEM.values())
    assert values(spark, ["cxirkaux", "Cxu", "cX", "ĉirkaŭ", "extra"], text.has_x_system) == [True, True, True, False, False]


def test_normalize(spark):
    got = values(spark, ["  Amiko \n", "CXIELO", "\xa0Ĝoja﻿", "", "ŜIPO"], text.normalize_query)
    assert got == ["amiko", "ĉielo", "ĝoja", "", "ŝipo"]
    assert values(spark, [" a \xa0\t b　c ", "\n", "x"], text.clean_text) == ["a b c", "", "x"]


def model(word):
    """Stems by the plain reading of the rules."""
    low, found = word.lower(), {}
    found[low] = None
    for ending, instead in stems.rules():
        if low.endswith(ending) and len(low) > len(ending) + 2:
            found[low[: -len(ending)] + instead] = None
    return sorted(found, key=len)


WHOLE = {
    "amikojn": "amik amiko amika amikoj amikojn amikojo amikoja", "amikon": "amik amiko amika amikon amikoo amikoa", "grandaj": "grand grando granda grandaj", "manĝas": "manĝ manĝi manĝas",
    "leganta": "leg legi legant leganta", "manĝu": "manĝ manĝu", "la": "la",
}


def test_stems(spark):
    assert [" ".join(v) for v in values(spark, WHOLE, stems.stems)] == list(WHOLE.values())
    assert len(stems.rules()) == 47


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aeiounjstĉ", min_size=0, max_size=9), min_size=40, max_size=40))
def test_stems_follow_the_rules(spark, words):
    assert values(spark, words, stems.stems) == [model(w) for w in words]


def test_fold(spark):
    samples = ["ĈIRKAŬ", "Mohéli", "άй", "ǣ", "Straße", "éa", "Å", "µ", "ſ"]
    assert values(spark, samples, fold.fold) == ["cirkau", "moheli", "άй", "ǣ", "straße", "ea", "a", "μ", "s"]
    frm, to = fold.fold_table()
    assert len(to) < len(frm) and all(unicodedata.combining(c) for c in frm[len(to) :])
    assert values(spark, ["Mal'amik-o, ĉe_la  2x!", "", "--"], fold.tokens) == [["mal", "amik", "o", "ce", "la", "2x"], [], []]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(min_size=1, max_size=12).filter(lambda s: "\x00" not in s and not re.search("[\ud800-\udfff]", s)), min_size=20, max_size=20))
def test_fold_twice_is_fold_once(spark, rows):
    once = values(spark, rows, fold.fold)
    assert values(spark, once, fold.fold) == once


@pytest.mark.parametrize("pattern,matches", [("re%", "red"), ("r_d", "red"), ("RED", "red"), ("a\\b", "a\\b"), ("%\\", "x\\"), ("Ĉ", "Ĉ")])
def test_like(spark, pattern, matches):
    df = spark.createDataFrame([(matches, pattern)], "t string, p string")
    assert df.select(text.like(F.col("t"), F.col("p"))).first()[0]
    assert not df.select(text.like(F.lit("zz"), F.col("p"))).first()[0]


def test_keys_and_labels(spark):
    assert values(spark, ["amik.0o.KOMUNE", "a.b", "amik", "a.b.c.d"], text.drv_key) == ["amik.0o", "a.b", "amik", "a.b"]
    assert values(spark, ["amik.0o.X", "amik"], text.root_key) == ["amik", "amik"]
    assert values(spark, ["en", "xx", "sgn"], text.language_name) == ["Angla", "xx", "Signolingvo"]
    assert values(spark, ["vid", "malprt", "zzz"], text.ref_label) == ["See", "Contains", "zzz"]
