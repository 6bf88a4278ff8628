"""A small invented lexicon that holds every odd case."""

from lexis.operators.html import build_examples, parse_senses
from lexis.sources.lexicon import Tables

NODO = [
    ("amik.0o", "amik", "amiko", None), ("amik.0o.PERS", "amik", "amiko", "1"), ("amik.0o.PERS", "amik", "amiko", "1"), ("amik.0o.KOMUNE", "amik", "amiko", "2"), ("amik.0a", "amik", "amika", None),
    ("amik.mal0o", "amik", "malamiko", None), ("amik", "amik", "amik/", None), ("hund.0o", "hund", "hundo", None), ("hund.0ido", "hund", "hundido", None), ("bel.0a", "bel", "bela", None),
    ("bel.0ul", "bel", "amiko", None), ("cambr.0o", "cambr", "Ĉambro", None), ("xtra.0o", "xtra", "ekstra", None), ("leg.0i", "leg", "legi", None), ("solo", "solo", "solulo", None), ("perc.0o", "perc", "a%b_c", None),
]
VAR = [("hund.0o", "hundeto"), ("ghost.0o", "fantomo"), ("bel.0a", "bélä")]
TRADUKO = [
    ("amik.0o", "en", "friend"), ("amik.0o.PERS", "en", "pal"), ("amik.0o.PERS", "de", "Freund"), ("amik.0o", "fr", "ami"), ("amik.0o", "en", "friend"), ("hund.0o", "de", "Hund"), ("hund.0o", "en", "dog"),
    ("bel.0a", "de", "Österreich"), ("ghost.0o", "en", "spook"), ("hund.0ido", "en", "small dog"), ("hund.0ido", "ja", "子犬"), ("bel.0a", "xx", "odd"), ("leg.0i", "en", "to read a book"), ("solo", "en", "loner"), ("solo.0o", "en", "solitude"),
]
REFERENCO = [
    ("amik.0o", "hund.0o", "vid"), ("amik.0o.PERS", "bel.0a", "sin"), ("amik.0o", "leg.0i", "super"), ("amik.0o", "nowhere", "ant"), ("amik.0o", "cambr.0o", "zzz"), ("amik.0o", "hund.0ido", "dif"),
    ("amik.0o", "amik.0a", "hom"), ("amik.0o", "amik.mal0o", "prt"), ("amik.0o", "xtra.0o", "malprt"),
]
UZO = [("amik.0o", "POL"), ("amik.0o.PERS", "BIO"), ("amik.0o", "POL")]
ARTICLE = """<html><body>
<section class="drv"><h2 id="amik.0o"> amiko\n </h2><dl>
<dt id="amik.0o.PERS">1.</dt><dd><abbr class="uzo">POL</abbr><span class="dif">Kara\xa0 homo <span class="fntref">7</span><i class="ekz">bona <span class="ekztld">amiko</span> &amp; kuzo<sup class="fntref">1</sup></i></span>
  <dl><dt>a)</dt><dd><span class="dif">interna <i class="ekz">nia amiko</i></span></dd></dl></dd>
<dt class="lng">angle:</dt><dd lang="en">friend</dd>
<dt id="x">2.</dt><p>no dd</p>
<dt id="amik.0o.KOMUNE">3.</dt><dd><span class="dif">komune</span><i class="ekz">  </i></dd></dl></section>
<section class="drv"><h2 id="amik.0a">amika</h2><dd><span class="dif">sen numero <i class="ekz">tre <b class="nom">Amika</b> viro<span class="fnt">x</span></i></span></dd></section>
<section class="drv"><h2 id="amik.mal0o">malamiko</h2><dd lang="en">enemy</dd><p><span class="dif">kontraŭa</span><i class="ekz">malamikoj venis</i></p></section>
<section class="drv"><h2>no id</h2><dd>loose<i class="ekz">perdita</i></dd></section><section class="drv"><p>no head</p></section>
</body></html>"""
ARTIKOLO = [("amik", ARTICLE), ("hund", '<section class="drv"><h2 id="hund.0o">hundo</h2><dl><dd><span class="dif">besto</span><i class="ekz">la abelojn de Mohéli</i></dd></dl></section>'), ("bel", None), ("empty", "")]


def tables(spark) -> Tables:
    def frame(rows, schema):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], schema + ", rid bigint")

    articles = frame(ARTIKOLO, "mrk string, txt string")
    return Tables.of(
        nodo=frame(NODO, "mrk string, art string, kap string, num string"), var=frame(VAR, "mrk string, kap string"), traduko=frame(TRADUKO, "mrk string, lng string, trd string"),
        referenco=frame(REFERENCO, "mrk string, cel string, tip string"), uzo=frame(UZO, "mrk string, uzo string"), artikolo=articles, ekzemplo=build_examples(articles).cache(), senses=parse_senses(articles).cache(),
    )
