"""The query catalogue: every operator on the driver's tables, with DuckDB SQL for the same result."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold, stems, text
from ..operators import assemble, common, examples, family, fulltext, headword, html, render, translation, wildcard
from ..shared import materialise, new_path
from ..sources import surrogate
from ..sources.lexicon import Tables, with_keys
from .api import Lexicon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The statements take nothing from the code that they check: folding, endings and names are written out here again.
TOKENS = r"list_filter(string_split_regex(strip_accents(lower(%s)), '[^\p{L}\p{N}\p{Co}]+'), lambda t: t <> '')"
NAME_OF = "CASE %s WHEN 'de' THEN 'Germana' WHEN 'en' THEN 'Angla' WHEN 'es' THEN 'Hispana' WHEN 'fr' THEN 'Franca' ELSE %s END"
LABEL_OF = "CASE tip WHEN 'sin' THEN 'Synonym' WHEN 'vid' THEN 'See' WHEN 'super' THEN 'Broader' END"

#: Common table expressions, in order of dependence.
CTES = {
    "nodo": """SELECT concat_ws('.', p_brand, p_type, p_partkey::VARCHAR) mrk, p_brand art, p_name kap, p_size::VARCHAR num, p_partkey::BIGINT rid,
        lower(p_name) kap_norm, concat_ws('.', p_brand, p_type) drv_mrk, p_brand root_mrk FROM part""",
    "var": """SELECT mrk, concat_ws(' ', split_part(kap, ' ', 2), split_part(kap, ' ', 1)) kap, rid,
        lower(concat_ws(' ', split_part(kap, ' ', 2), split_part(kap, ' ', 1))) kap_norm FROM nodo""",
    "traduko": r"""SELECT n.mrk, d.lang lng, d.trd, concat_ws(chr(1), lpad(n.rid::VARCHAR, 12, '0'), d.trd) rid, n.drv_mrk, n.root_mrk FROM nodo n JOIN
        (SELECT DISTINCT doc_id, lang, trd FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) trd FROM documents UNION ALL
          SELECT doc_id, lang, array_to_string(l[1:3], ' ') FROM (SELECT doc_id, lang, list_filter(string_split_regex(s, '[^\p{L}\p{N}]+'), lambda w: w <> '') l FROM
            (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[.\n]+')) s FROM documents)) WHERE len(l) >= 3) WHERE trd <> '') d ON d.doc_id = n.rid""",
    "referenco": """SELECT a.mrk, b.mrk cel, l.tip, concat_ws(chr(1), a.mrk, b.mrk, l.tip) rid, a.drv_mrk, a.root_mrk FROM
        (SELECT DISTINCT l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'sin' WHEN 'N' THEN 'vid' ELSE 'super' END tip FROM lineitem) l
        JOIN nodo a ON a.rid = l_partkey JOIN nodo b ON b.rid = l_suppkey""",
    "uzo": """SELECT n.mrk, u.uzo, concat_ws(chr(1), n.mrk, u.uzo) rid, n.drv_mrk, n.root_mrk FROM
        (SELECT DISTINCT l_partkey, o_orderpriority uzo FROM lineitem JOIN orders ON o_orderkey = l_orderkey) u JOIN nodo n ON n.rid = u.l_partkey""",
    "ekzemplo": r"""SELECT n.art, n.drv_mrk, n.mrk sense_mrk, s.ekz_md, s.p position, s.doc_id * 100000 + s.p rid FROM
        (SELECT doc_id, unnest(l) ekz_md, generate_subscripts(l, 1) - 1 p FROM
          (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x)), lambda x: x <> '') l FROM documents)) s JOIN nodo n ON n.rid = s.doc_id""",
    "rules": """SELECT ending, instead, row_number() OVER (ORDER BY g, i, j) r FROM (SELECT g, i, es[i] ending, unnest(ins) instead, generate_subscripts(ins, 1) j FROM
        (SELECT g, es, ins, unnest(range(1, len(es) + 1)) i FROM (VALUES (1, ['anta', 'inta', 'onta', 'ata', 'ita', 'ota'], ['i', '']), (2, ['ojn', 'ajn'], ['', 'o', 'a']),
          (3, ['oj', 'aj', 'on', 'an'], ['', 'o', 'a']), (4, ['as', 'is', 'os', 'us'], ['i', '']), (5, ['o', 'a', 'e', 'i', 'u'], ['']), (6, ['n'], ['', 'o', 'a']), (7, ['j'], [''])) v(g, es, ins)))""",
    "posts": f"SELECT rid, unnest(l) term, generate_subscripts(l, 1) - 1 pos FROM (SELECT rid, {TOKENS % 'ekz_md'} l FROM ekzemplo)",
    "dl": "SELECT e.rid, count(p.term) dl FROM ekzemplo e LEFT JOIN posts p ON p.rid = e.rid GROUP BY e.rid",
    "nodo_first": "SELECT mrk, arg_min(art, rid) art, arg_min(kap, rid) kap, arg_min(num, rid) num, min(rid) rid FROM nodo GROUP BY mrk",
}


def sql(needs: str, body: str, **more: str) -> str:
    """A statement over the named common table expressions (and what these need), then `more`, then the body."""
    wanted = set(needs.split())
    if wanted & {"dl"}:
        wanted |= {"posts"}
    if wanted & {"posts"}:
        wanted |= {"ekzemplo"}
    if wanted & {"var", "traduko", "referenco", "uzo", "ekzemplo", "nodo_first"}:
        wanted |= {"nodo"}
    parts = {k: v for k, v in CTES.items() if k in wanted} | more
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + body


def query(oracle: str | None = None) -> Callable:
    """Register a function (lexicon tables) -> DataFrame under its name."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(surrogate.tables(spark, sf_dir))

        QUERIES[make.__name__] = run
        if oracle is not None:
            ORACLES[make.__name__] = oracle
        return make

    return add


def on_tables(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[make.__name__] = make
        if oracle is not None:
            ORACLES[make.__name__] = oracle
        return make

    return add


def asked(like: DataFrame, *rows: str | tuple[str, str]) -> DataFrame:
    """A batch of queries, numbered from 0."""
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return like.sparkSession.createDataFrame(data, "qid int, q string" + (", lang string" if isinstance(rows[0], tuple) else ""))


def words(like: DataFrame, *rows: str) -> DataFrame:
    return headword.normalised(asked(like, *rows))


def listed(column: str, *fields: str) -> Column:
    """A list of structs as text, so that results compare as plain values."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";").alias(column)


# Scans and text functions.


@query("SELECT page_id::VARCHAR mrk, html txt FROM pages")
def scan_articles(t: Tables) -> DataFrame:
    return t.artikolo.select("mrk", "txt")


@query(sql("nodo", "SELECT kap, art, mrk FROM nodo"))
def scan_headwords_ordered(t: Tables) -> DataFrame:
    return t.nodo.select("kap", "art", "mrk").orderBy("art", "mrk")


@query()
def sample_headwords(t: Tables) -> DataFrame:
    return t.nodo.select("kap", "art", "mrk").orderBy(F.rand(42)).limit(200)


@query(sql("nodo var", "SELECT mrk, kap, kap_norm FROM nodo UNION ALL SELECT mrk, kap, kap_norm FROM var"))
def norm_headwords(t: Tables) -> DataFrame:
    return t.nodo.select("mrk", "kap", "kap_norm").unionByName(t.var.select("mrk", "kap", "kap_norm"))


X_SQL = "text"
for _pair, _letter in zip("cx Cx CX gx Gx GX hx Hx HX jx Jx JX sx Sx SX ux Ux UX".split(), "ĉĈĈĝĜĜĥĤĤĵĴĴŝŜŜŭŬŬ"):
    X_SQL = f"replace({X_SQL}, '{_pair}', '{_letter}')"
#: The tables hold no white space beyond ASCII, for which \s does.
CLEAN_SQL = r"regexp_replace(regexp_replace(%s, '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
STRIP_SQL = r"regexp_replace(%s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


@on_tables(f"SELECT doc_id, md5({X_SQL}) digest FROM documents")
def xsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.from_x_system(F.col("text"))).alias("digest"))


@on_tables("SELECT doc_id, regexp_matches(text, '[cCgGhHjJsSuU][xX]') flag FROM documents")
def has_xsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.table(spark, sf_dir, "documents").select("doc_id", text.has_x_system(F.col("text")).alias("flag"))


@on_tables(f"SELECT doc_id, md5(lower({X_SQL.replace('text', STRIP_SQL % 'text', 1)})) digest FROM documents")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_query(F.col("text"))).alias("digest"))


@on_tables(f"SELECT doc_id, md5({CLEAN_SQL % 'text'}) digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


@query(sql("nodo", "SELECT mrk, drv_mrk, root_mrk FROM nodo"))
def drv_key(t: Tables) -> DataFrame:
    return t.nodo.select("mrk", "drv_mrk", "root_mrk")


STEMS_SQL = """SELECT w, st, min(r) rk FROM (SELECT w, w st, 0 r FROM ws UNION ALL
    SELECT w, left(w, length(w) - length(ending)) || instead, r FROM ws JOIN rules ON ends_with(w, ending) AND length(w) > length(ending) + 2) GROUP BY w, st"""


@query(
    sql(
        "nodo traduko rules", "SELECT w word, string_agg(st, ',' ORDER BY length(st), rk) stems FROM st GROUP BY w",
        ws="SELECT DISTINCT trd w FROM traduko", st=STEMS_SQL,
    )
)
def stem_candidates(t: Tables) -> DataFrame:
    return t.traduko.select(F.col("trd").alias("word")).distinct().select("word", F.array_join(stems.stems(F.col("word")), ",").alias("stems"))


@query(sql("nodo traduko", f"SELECT lng, {NAME_OF % ('lng', 'lng')} name FROM (SELECT DISTINCT lng FROM traduko)"))
def language_names(t: Tables) -> DataFrame:
    return t.traduko.select("lng").distinct().select("lng", text.language_name(F.col("lng")).alias("name"))


@query(sql("nodo referenco", f"SELECT tip, {LABEL_OF} label FROM (SELECT DISTINCT tip FROM referenco)"))
def ref_labels(t: Tables) -> DataFrame:
    return t.referenco.select("tip").distinct().select("tip", text.ref_label(F.col("tip")).alias("label"))


@query(sql("nodo traduko", "SELECT lng, count(*) count FROM traduko GROUP BY lng"))
def languages(t: Tables) -> DataFrame:
    return Lexicon(t.nodo.sparkSession, t).languages()


# Headword search.

NODES = "qid, mrk, art, kap, num, ord"


@query(sql("nodo", "SELECT 0 qid, mrk, art, kap, num, row_number() OVER (ORDER BY length(mrk), rid)::INT ord FROM nodo WHERE kap_norm = 'red rod'"))
def headword_exact(t: Tables) -> DataFrame:
    return headword.exact(words(t.nodo, "red rod"), t).selectExpr(*NODES.split(", "))


@query(sql("nodo", "SELECT 0 qid, mrk, art, kap, num, row_number() OVER (ORDER BY length(kap), kap, rid)::INT ord FROM nodo WHERE kap_norm LIKE 'red ro%' QUALIFY ord <= 25"))
def headword_prefix(t: Tables) -> DataFrame:
    return headword.prefix(words(t.nodo, "red ro"), t, 5).selectExpr(*NODES.split(", "))


@query(sql("nodo var", "SELECT 0 qid, mrk, art, kap, num, row_number() OVER (ORDER BY length(mrk), rid)::INT ord FROM nodo WHERE mrk IN (SELECT mrk FROM var WHERE kap_norm = 'rod red')"))
def variant_nodes(t: Tables) -> DataFrame:
    return headword.variant(words(t.nodo, "rod red"), t).selectExpr(*NODES.split(", "))


@query(
    sql(
        "nodo rules", "SELECT 0 qid, stem, mrk, art, kap, num, row_number() OVER (ORDER BY length(mrk), rid)::INT ord FROM hits WHERE rk = (SELECT min(rk) FROM hits)",
        ws="SELECT 'red rodn' w", st=STEMS_SQL,
        hits="SELECT st.stem, st.rk, n.* FROM (SELECT st stem, row_number() OVER (ORDER BY length(st), rk) rk FROM st WHERE st <> w) st JOIN nodo n ON n.kap_norm = st.stem",
    )
)
def headword_stem(t: Tables) -> DataFrame:
    return headword.stem(words(t.nodo, "red rodn"), t).select("qid", "stem", "mrk", "art", "kap", "num", "ord")


BATCH = ("red rod", "rod red", "red rodn", "red ro", "zzz")
WATERFALL = dict(
    ws="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(BATCH)) + ") b(qid, w)",
    st=STEMS_SQL,
    ranked="SELECT w, st, row_number() OVER (PARTITION BY w ORDER BY length(st), rk) rk FROM st",
    t1="SELECT qid, 1 tier, 0 rk, NULL via, n.*, row_number() OVER (PARTITION BY qid ORDER BY length(mrk), rid) ord FROM ws JOIN nodo n ON kap_norm = w",
    t2="SELECT qid, 2 tier, 0 rk, NULL via, n.*, row_number() OVER (PARTITION BY qid ORDER BY length(n.mrk), n.rid) ord FROM (SELECT DISTINCT qid, mrk FROM ws JOIN var ON kap_norm = w) v JOIN nodo n ON n.mrk = v.mrk",
    t3="SELECT qid, 3 tier, rk, 'stem:' || st via, n.*, row_number() OVER (PARTITION BY qid, rk ORDER BY length(mrk), rid) ord FROM ws JOIN ranked USING (w) JOIN nodo n ON kap_norm = st WHERE st <> w",
    t4="SELECT qid, 4 tier, 0 rk, 'prefix:' || w via, n.*, row_number() OVER (PARTITION BY qid ORDER BY length(kap), kap, rid) ord FROM ws JOIN nodo n ON kap_norm LIKE w || '%' QUALIFY ord <= 25",
    hits="SELECT * FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) QUALIFY tier = min(tier) OVER (PARTITION BY qid) AND rk = min(rk) OVER (PARTITION BY qid, tier)",
    firsts="SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, drv_mrk ORDER BY ord) = 1",
    results="SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord)::INT pos, kap headword, art article, drv_mrk mrk, via matched_via FROM firsts QUALIFY pos <= 5",
)


@query(sql("nodo var rules", "SELECT * FROM results", **WATERFALL))
def lookup_eo(t: Tables) -> DataFrame:
    return headword.lookup_headwords(asked(t.nodo, *BATCH), t)


@query(sql("nodo var rules", "SELECT qid, tier, mrk, ord::INT ord, via matched_via FROM hits", **WATERFALL))
def headword_tiers(t: Tables) -> DataFrame:
    return headword.headword_hits(asked(t.nodo, *BATCH), t).select("qid", "tier", "mrk", "ord", "matched_via")


@query(sql("nodo", "SELECT 0 qid, row_number() OVER (ORDER BY length(mrk), rid)::INT pos, kap headword, art article, drv_mrk mrk FROM (SELECT * FROM nodo WHERE kap_norm = 'red rod' QUALIFY row_number() OVER (PARTITION BY drv_mrk ORDER BY length(mrk), rid) = 1) QUALIFY pos <= 3"))
def group_by_drv(t: Tables) -> DataFrame:
    return common.group_by_drv(headword.exact(words(t.nodo, "red rod"), t).withColumn("matched_via", F.lit(None)), 3).drop("matched_via")


# Translations.

TRD = "qid, mrk, lng, trd, ord"


@query(sql("nodo traduko", "SELECT 0 qid, mrk, lng, trd, row_number() OVER (ORDER BY rid)::INT ord FROM traduko WHERE trd = 'in' AND lng = 'en' QUALIFY ord <= 50"))
def trans_exact(t: Tables) -> DataFrame:
    return translation.exact_rows(translation.asked(asked(t.nodo, ("in", "en"))), t, 50, True).selectExpr(*TRD.split(", "))


@query(sql("nodo traduko", "SELECT 0 qid, mrk, lng, trd, row_number() OVER (ORDER BY rid)::INT ord FROM traduko WHERE trd = 'in' QUALIFY ord <= 100"))
def trans_exact_all(t: Tables) -> DataFrame:
    return translation.exact_rows(translation.asked(asked(t.nodo, "in")), t, 100, False).selectExpr(*TRD.split(", "))


@query(sql("nodo traduko", "SELECT 0 qid, mrk, lng, trd, row_number() OVER (ORDER BY rid)::INT ord FROM traduko WHERE trd LIKE '%ent%' AND lng = 'fr' QUALIFY ord <= 50"))
def trans_substring(t: Tables) -> DataFrame:
    return translation.substring_rows(translation.asked(asked(t.nodo, ("ent", "fr"))), t).selectExpr(*TRD.split(", "))


FTS_TRD = f"SELECT *, row_number() OVER (ORDER BY rid)::INT ord FROM traduko WHERE list_contains({TOKENS % 'trd'}, 'un') QUALIFY ord <= 100"


@query(sql("nodo traduko", "SELECT 0 qid, mrk, lng, trd, ord FROM f", f=FTS_TRD))
def trans_fts_all(t: Tables) -> DataFrame:
    return translation.matching_rows(translation.asked(asked(t.nodo, "un")), t).selectExpr(*TRD.split(", "))


@query(sql("nodo traduko", "SELECT 0 qid, mrk, lng, trd, ord FROM f WHERE lng = 'fr'", f=FTS_TRD))
def trans_fts_lang(t: Tables) -> DataFrame:
    """The 100 rows come before the language is looked at."""
    return translation.matching_rows(translation.asked(asked(t.nodo, "un")), t).where("lng = 'fr'").selectExpr(*TRD.split(", "))


QUOTED_SQL = "SELECT {0} qid, mrk, lng, trd, row_number() OVER (ORDER BY rid)::INT ord FROM tt WHERE {1} QUALIFY ord <= 100"
QUOTED_BATCH = ('"the and" attion', 'the "and', 'the""and')


@query(sql("nodo traduko", QUOTED_SQL.format(0, "contains(line, ' the and ') AND contains(line, ' attion ')") + " UNION ALL " + QUOTED_SQL.format(2, "contains(line, ' the and ')"), tt=f"SELECT *, concat(' ', array_to_string({TOKENS % 'trd'}, ' '), ' ') line FROM traduko"))
def trans_fts_quoted(t: Tables) -> DataFrame:
    """Parts between marks must all stand; a stray mark finds nothing; doubled marks separate."""
    return translation.matching_rows(translation.asked(asked(t.nodo, *QUOTED_BATCH)), t).selectExpr(*TRD.split(", "))


TRD_NODES = dict(
    r="SELECT *, row_number() OVER (ORDER BY rid) ord FROM traduko WHERE trd = 'in' AND lng = 'en' QUALIFY ord <= 50",
    k="SELECT mrk, min(ord) ord FROM r GROUP BY mrk QUALIFY row_number() OVER (ORDER BY min(ord)) <= 15",
    n="SELECT k.mrk, k.ord, f.art, f.kap, f.num FROM k JOIN nodo_first f ON f.mrk = k.mrk",
)


@query(sql("nodo traduko nodo_first", "SELECT 0 qid, mrk, art, kap, num, ord::INT ord FROM n", **TRD_NODES))
def trans_nodes(t: Tables) -> DataFrame:
    rows = translation.exact_rows(translation.asked(asked(t.nodo, ("in", "en"))), t, 50, True)
    return common.nodes_of(rows, t, 5).selectExpr(*NODES.split(", "))


def translation_results(queries: str, rows: str, language: str) -> dict[str, str]:
    """Steps from translation rows (`qid`, `ord`, ...) to results."""
    return dict(
        qs=f"SELECT * FROM (VALUES {queries}) b(qid, q, lang)",
        **PHRASE_ROWS,
        r=rows,
        k="SELECT qid, mrk, min(ord) ord FROM r GROUP BY qid, mrk QUALIFY row_number() OVER (PARTITION BY qid ORDER BY min(ord)) <= 15",
        n="SELECT k.qid, k.ord, f.*, array_to_string(list_slice(string_split(k.mrk, '.'), 1, 2), '.') drv FROM k JOIN nodo_first f ON f.mrk = k.mrk",
        g="SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid, drv ORDER BY ord) = 1",
        trd_results=f"""SELECT g.qid, row_number() OVER (PARTITION BY g.qid ORDER BY g.ord)::INT pos, g.kap headword, g.art article, g.drv mrk,
            concat_ws(':', 'translation', {language}, coalesce(h.trd, qs.q)) matched_via
            FROM g JOIN qs ON qs.qid = g.qid LEFT JOIN (SELECT qid, mrk, arg_min(trd, ord) trd, arg_min(lng, ord) lng FROM r GROUP BY qid, mrk) h ON h.qid = g.qid AND h.mrk = g.drv QUALIFY pos <= 5""",
    )


#: The first 100 rows with the query's words in a row, in any language.
PHRASE_ROWS = dict(
    tt=f"SELECT *, concat(' ', array_to_string({TOKENS % 'trd'}, ' '), ' ') line FROM traduko",
    ph=f"SELECT qs.qid, qs.lang, tt.*, row_number() OVER (PARTITION BY qs.qid ORDER BY rid) ord FROM qs JOIN tt ON contains(line, concat(' ', array_to_string({TOKENS % 'q'}, ' '), ' ')) QUALIFY ord <= 100",
)
TRANSLATION_ROWS = """SELECT * FROM (
      SELECT qs.qid, 1 tier, t.*, row_number() OVER (PARTITION BY qs.qid ORDER BY rid) ord FROM qs JOIN traduko t ON t.trd = lower(trim(q)) AND lng = lang QUALIFY ord <= 50
      UNION ALL SELECT qid, 2, mrk, lng, trd, rid, drv_mrk, root_mrk, ord FROM ph WHERE lng = lang
      UNION ALL SELECT qs.qid, 3, t.*, row_number() OVER (PARTITION BY qs.qid ORDER BY rid) ord FROM qs JOIN traduko t ON contains(t.trd, lower(trim(q))) AND lng = lang QUALIFY ord <= 50)
    QUALIFY tier = min(tier) OVER (PARTITION BY qid)"""


@query(sql("nodo traduko nodo_first", "SELECT * FROM trd_results", **translation_results("(0, ' In ', 'en'), (1, 'ent', 'fr'), (2, 'zzzz', 'de'), (3, 'And attion', 'en')", TRANSLATION_ROWS, "qs.lang")))
def lookup_translation(t: Tables) -> DataFrame:
    return translation.lookup_translations(asked(t.nodo, (" In ", "en"), ("ent", "fr"), ("zzzz", "de"), ("And attion", "en")), t)


ALL_ROWS = """SELECT * FROM (SELECT qs.qid, 1 tier, t.*, row_number() OVER (PARTITION BY qs.qid ORDER BY rid) ord FROM qs JOIN traduko t ON t.trd = lower(trim(q)) QUALIFY ord <= 100
      UNION ALL SELECT qid, 2, mrk, lng, trd, rid, drv_mrk, root_mrk, ord FROM ph) QUALIFY tier = min(tier) OVER (PARTITION BY qid)"""
MERGED = dict(
    either="SELECT *, 0 src FROM results UNION ALL SELECT *, 1 FROM trd_results",
    kept="SELECT * FROM either QUALIFY row_number() OVER (PARTITION BY qid, mrk ORDER BY src, pos) = 1",
)


def merge_sql(queries: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(queries))
    three = ", ".join(f"({i}, '{q}', '')" for i, q in enumerate(queries))
    steps = WATERFALL | {"ws": f"SELECT qid, lower(w) w FROM (VALUES {rows}) b(qid, w)"} | translation_results(three, ALL_ROWS, "coalesce(h.lng, '?')") | MERGED
    body = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY src, pos)::INT pos, headword, article, mrk, matched_via FROM kept QUALIFY row_number() OVER (PARTITION BY qid ORDER BY src, pos) <= 5"
    return sql("nodo var traduko nodo_first rules", body.replace("pos)::INT pos", "kept.pos)::INT pos").replace("src, pos) <= 5", "src, kept.pos) <= 5"), **steps)


@query(merge_sql(("red rod", "in", "zzzz", "And attion")))
def lookup_all(t: Tables) -> DataFrame:
    return translation.lookup_all(asked(t.nodo, "red rod", "in", "zzzz", "And attion"), t)


@query(merge_sql(("la", "un")))
def all_languages_merge(t: Tables) -> DataFrame:
    return translation.lookup_all(asked(t.nodo, "la", "un"), t)


# Wildcards.


def _wildcard(pattern: str) -> None:
    like = pattern.replace("*", "%")

    def run(t: Tables) -> DataFrame:
        return wildcard.matching(t, pattern).select("mrk", "kap")

    run.__name__ = {"red*": "wildcard_prefix", "*rod": "wildcard_suffix", "*e*": "wildcard_infix", "r*d": "wildcard_both"}[pattern]
    query(sql("nodo", f"SELECT mrk, kap FROM nodo WHERE kap_norm LIKE '{like}'"))(run)


for _pattern in ("red*", "*rod", "*e*", "r*d"):
    _wildcard(_pattern)

PAGE = "SELECT kap, min(mrk) mrk, row_number() OVER (ORDER BY length(kap), kap)::INT - 5 ord FROM nodo WHERE kap_norm LIKE '%r%' GROUP BY kap QUALIFY ord BETWEEN 1 AND 20"


@query(sql("nodo", "SELECT count(DISTINCT kap) total FROM nodo WHERE kap_norm LIKE '%r%'"))
def wildcard_total(t: Tables) -> DataFrame:
    return wildcard.total(t, "*r*")


@query(sql("nodo", "SELECT kap, mrk, ord FROM p", p=PAGE))
def wildcard_page(t: Tables) -> DataFrame:
    return wildcard.page(t, "*r*", 20, 5)


GLOSSED = "SELECT ord, kap, p.mrk, coalesce(string_agg(trd, ', ' ORDER BY rid), '') glosses, count(trd) n FROM p LEFT JOIN (SELECT * FROM traduko WHERE lng = 'en') t ON t.mrk = p.mrk GROUP BY ord, kap, p.mrk"


@query(sql("nodo traduko", "SELECT ord, kap, mrk, glosses FROM g", p=PAGE, g=GLOSSED))
def wildcard_glosses(t: Tables) -> DataFrame:
    return wildcard.lookup_compact(t, "*r*", "en", 20, 5).withColumn("glosses", F.array_join("glosses", ", "))


@query(
    sql(
        "nodo var", "SELECT 0 qid, row_number() OVER (ORDER BY o)::INT pos, kap headword, art article, drv mrk, 'wildcard:*d r*' matched_via FROM g QUALIFY pos <= 20",
        u="SELECT mrk, art, kap, num, drv_mrk drv FROM nodo WHERE kap_norm LIKE '%d r%' UNION SELECT n.mrk, n.art, n.kap, n.num, n.drv_mrk FROM nodo n JOIN var v ON n.mrk = v.mrk WHERE v.kap_norm LIKE '%d r%'",
        o="SELECT *, row_number() OVER (ORDER BY length(kap), kap, mrk, num) o FROM u QUALIFY o <= 100",
        g="SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY drv ORDER BY o) = 1",
    )
)
def wildcard_full(t: Tables) -> DataFrame:
    return wildcard.lookup_wildcard(t, "*d r*")


# Families and subtrees.

FAMILY = dict(
    root="SELECT arg_min(art, rid) root FROM nodo WHERE kap_norm = 'red rod'",
    m="SELECT drv_mrk drv, root, min(mrk) mrk, arg_min(kap, mrk || chr(1) || kap) headword FROM nodo JOIN root ON art = root WHERE contains(mrk, '.') GROUP BY drv_mrk, root",
    members="SELECT 0 qid, root, drv, headword, row_number() OVER (ORDER BY mrk)::INT ord FROM m",
)
FAMILY_TRD = "string_agg(lng || ':' || trd, ';' ORDER BY lng, rid)"


@query(sql("nodo", "SELECT qid, root, drv, headword, ord FROM members", **FAMILY))
def family_members(t: Tables) -> DataFrame:
    return family.members(family.roots(asked(t.nodo, "red rod"), t), t)


@query(sql("nodo traduko", f"SELECT drv, md5(coalesce({FAMILY_TRD}, '')) digest, count(trd) n FROM members LEFT JOIN traduko t ON drv_mrk = drv GROUP BY drv", **FAMILY))
def family_translations(t: Tables) -> DataFrame:
    found = family.with_translations(family.members(family.roots(asked(t.nodo, "red rod"), t), t), t)
    return found.select("drv", F.md5(F.array_join(F.transform("translations", lambda x: F.concat_ws(":", x["lng"], x["trd"])), ";")).alias("digest"), F.size("translations").cast("bigint").alias("n"))


@query(
    sql(
        "nodo rules", "SELECT qid, root FROM (SELECT qid, coalesce(min(CASE WHEN rk = 0 THEN root END), arg_min(root, rk)) root FROM r GROUP BY qid)",
        b="SELECT * FROM (VALUES (0, 'red rod'), (1, 'red rodn'), (2, 'zzz')) b(qid, w)", ws="SELECT w FROM b", st=STEMS_SQL,
        ranked="SELECT w, st, row_number() OVER (PARTITION BY w ORDER BY length(st), rk) rk FROM st UNION ALL SELECT w, w, 0 FROM ws",
        r="SELECT qid, rk, arg_min(art, rid) root FROM b JOIN ranked USING (w) JOIN nodo ON lower(kap) = st GROUP BY qid, rk",
    )
)
def family_roots(t: Tables) -> DataFrame:
    return family.roots(asked(t.nodo, "red rod", "red rodn", "zzz"), t)


HIERARCHY = "SELECT concat_ws('.', n_regionkey::VARCHAR, n_nationkey::VARCHAR, c_custkey::VARCHAR) mrk, concat_ws('.', n_regionkey::VARCHAR, n_nationkey::VARCHAR) drv_mrk, n_regionkey::VARCHAR root_mrk FROM customer JOIN nation ON c_nationkey = n_nationkey"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = surrogate.table(spark, sf_dir, "nation")
    key = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    rows = surrogate.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(key.alias("mrk"))
    return rows.withColumns({"drv_mrk": text.drv_key(F.col("mrk")), "root_mrk": text.root_key(F.col("mrk"))})


@on_tables(f"WITH h AS ({HIERARCHY}), k AS (SELECT DISTINCT drv_mrk d FROM h UNION SELECT DISTINCT root_mrk FROM h) SELECT d drv, count(*) n FROM k JOIN h ON mrk = d OR (mrk >= d || '.' AND mrk < d || '/') GROUP BY d")
def subtree_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy(spark, sf_dir)
    keys = rows.select(F.col("drv_mrk").alias("drv")).union(rows.select("root_mrk")).distinct()
    return common.subtree(keys, rows).groupBy("drv").agg(F.count("*").alias("n"))


@on_tables(f"WITH h AS ({HIERARCHY}) SELECT mrk FROM h WHERE mrk = '1.1' OR (mrk >= '1.1.' AND mrk < '1.1/')")
def subtree_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(spark, sf_dir).where("mrk = '1.1' or (mrk >= '1.1.' and mrk < '1.1/')").select("mrk")


# Assembly.

SUBTREES = "SELECT DISTINCT drv_mrk drv FROM nodo UNION SELECT DISTINCT root_mrk FROM nodo"


def below(name: str) -> str:
    """Rows of a table joined to the keys whose subtree they are in."""
    return f"k JOIN (SELECT *, unnest([drv_mrk, root_mrk]) sub FROM {name}) x ON x.sub = k.drv"


def subtree_results(t: Tables) -> DataFrame:
    """Results for every derivation of every article, and for each article's own key."""
    keys = t.nodo.select("art", F.explode(F.array("drv_mrk", "root_mrk")).alias("mrk")).distinct()
    return keys.select(F.lit(0).alias("qid"), F.lit(1).alias("pos"), F.lit("x").alias("headword"), F.col("art").alias("article"), "mrk", F.lit(None).cast("string").alias("matched_via"))


@query(sql("nodo traduko", f"SELECT drv, md5(string_agg(lng || ':' || trd, ';' ORDER BY lng, rid)) digest FROM {below('traduko')} GROUP BY drv", k=SUBTREES))
def assemble_translations(t: Tables) -> DataFrame:
    return assemble.translations(subtree_results(t), t).select("drv", listed("translations", "lng", "trd")).select("drv", F.md5("translations").alias("digest"))


CROSS = dict(k=SUBTREES, x2=f"SELECT drv, x.rid, x.cel, x.tip, f.kap FROM {below('referenco')} LEFT JOIN nodo_first f ON f.mrk = x.cel")


@query(sql("nodo referenco nodo_first", "SELECT drv, md5(string_agg(concat_ws(':', cel, tip, kap), ';' ORDER BY rid)) digest FROM x2 GROUP BY drv", **CROSS))
def assemble_crossrefs(t: Tables) -> DataFrame:
    return assemble.cross_refs(subtree_results(t), t).select("drv", listed("cross_refs", "target", "type", "target_kap")).select("drv", F.md5("cross_refs").alias("digest"))


@query(sql("nodo referenco nodo_first", "SELECT drv, string_agg(concat_ws(':', cel, tip, kap), ';' ORDER BY rid) refs FROM (SELECT * FROM x2 WHERE tip <> 'super' AND kap <> '' QUALIFY row_number() OVER (PARTITION BY drv ORDER BY rid) <= 5) GROUP BY drv", **CROSS))
def crossrefs_meaningful(t: Tables) -> DataFrame:
    found = assemble.cross_refs(subtree_results(t), t).select("drv", render.meaningful(F.col("cross_refs")).alias("refs"))
    return found.select("drv", listed("refs", "target", "type", "target_kap"))


@query(sql("nodo uzo", f"SELECT drv, string_agg(uzo, ';' ORDER BY rid) domains FROM (SELECT drv, uzo, min(x.rid) rid FROM {below('uzo')} GROUP BY drv, uzo) GROUP BY drv", k=SUBTREES))
def assemble_domains(t: Tables) -> DataFrame:
    return assemble.usage_domains(subtree_results(t), t).select("drv", F.array_join("usage_domains", ";").alias("domains"))


SHOWN = dict(k=SUBTREES, s=f"SELECT drv, lng, trd, rid FROM {below('traduko')} WHERE lng IN ('en', 'es')")


@query(sql("nodo traduko", "SELECT drv, count(*) n FROM s GROUP BY drv", **SHOWN))
def show_languages(t: Tables) -> DataFrame:
    found = assemble.translations(subtree_results(t), t).select("drv", render.shown(F.col("translations"), ["en", "es"], ()).alias("s"))
    return found.select("drv", F.size("s").cast("bigint").alias("n")).where("n > 0")


GROUPED = """SELECT drv, lng, md5(string_agg(trd, ', ' ORDER BY r)) trds FROM (SELECT drv, lng, trd, min(rid) r FROM s GROUP BY drv, lng, trd) GROUP BY drv, lng"""


@query(sql("nodo traduko", GROUPED, **SHOWN))
def translations_grouped(t: Tables) -> DataFrame:
    found = assemble.translations(subtree_results(t), t).select("drv", F.explode(render.by_language(render.shown(F.col("translations"), ["en", "es"], ()))).alias("g"))
    return found.select("drv", "g.lng", F.md5("g.trds").alias("trds"))


# Full text.


@on_tables(f"SELECT lang, term, count(*) n FROM (SELECT lang, unnest({TOKENS % 'text'}) term FROM documents) GROUP BY lang, term")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = surrogate.table(spark, sf_dir, "documents")
    return docs.select("lang", F.explode(fold.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))


@query(sql("nodo var", f"SELECT rid, unnest(l) term, (generate_subscripts(l, 1) - 1)::INT pos FROM (SELECT rid, {TOKENS % 'kap'} l FROM (SELECT rid, kap FROM nodo UNION ALL SELECT rid, kap FROM var))"))
def fts_postings(t: Tables) -> DataFrame:
    return fulltext.postings(t.nodo.select("rid", "kap").unionByName(t.var.select("rid", "kap")), "kap")


PHRASE = "SELECT a.rid, count(*) tf FROM posts a JOIN posts b ON a.rid = b.rid AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the' GROUP BY a.rid"


def phrase(t: Tables, *texts: str) -> DataFrame:
    asked_for = words(t.nodo, *texts).withColumnRenamed("word", "text")
    return fulltext.phrase_hits(asked_for, t, "ekz")


@query(sql("posts", PHRASE))
def fts_phrase(t: Tables) -> DataFrame:
    return phrase(t, "in the").select("rid", "tf")


@query(sql("posts", "SELECT rid, count(*) tf FROM posts WHERE starts_with(term, 'tion') GROUP BY rid"))
def fts_prefix(t: Tables) -> DataFrame:
    return fulltext.prefix_hits(words(t.nodo, "tion").withColumnRenamed("word", "text"), t, "ekz").select("rid", "tf")


STATS = "SELECT count(*) n_docs, avg(dl) avgdl FROM dl"


@query(sql("dl", "SELECT n_docs, round(avgdl, 9) avgdl FROM stats", stats=STATS))
def bm25_stats(t: Tables) -> DataFrame:
    return fulltext.corpus_stats(t.indexed().ekz_lengths).withColumn("avgdl", F.round("avgdl", 9))


def bm25_sql(hits: str) -> dict[str, str]:
    """Steps from hits (`rid`, `tf`) to the best 20."""
    return dict(
        h=hits, stats=STATS, f="SELECT count(*) df FROM h",
        idf="SELECT CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END idf, avgdl FROM stats, f",
        ranks="SELECT h.rid, -(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS rank FROM h JOIN dl USING (rid), idf",
        best="SELECT rid, rank, row_number() OVER (ORDER BY round(rank, 9), rid)::INT ord FROM ranks QUALIFY ord <= 20",
    )


@query(sql("dl", "SELECT rid, round(rank, 9) AS rank FROM ranks", **bm25_sql("SELECT rid, count(*) tf FROM posts WHERE term = 'the' GROUP BY rid")))
def examples_bm25(t: Tables) -> DataFrame:
    return fulltext.bm25(phrase(t, "the"), t.indexed().ekz_stats).select("rid", F.round("rank", 9).alias("rank"))


@query(sql("dl", "SELECT rid, round(rank, 9) AS rank FROM ranks", **bm25_sql(PHRASE)))
def examples_phrase(t: Tables) -> DataFrame:
    return fulltext.bm25(phrase(t, "in the"), t.indexed().ekz_stats).select("rid", F.round("rank", 9).alias("rank"))


@query(sql("ekzemplo nodo_first", "SELECT e.rid, coalesce(f.kap, e.drv_mrk) headword, coalesce(g.kap, e.sense_mrk) sense_head FROM ekzemplo e LEFT JOIN nodo_first f ON f.mrk = e.drv_mrk LEFT JOIN nodo_first g ON g.mrk = e.sense_mrk"))
def examples_headword(t: Tables) -> DataFrame:
    own = examples.with_headword(t.ekzemplo, t).select("rid", "headword")
    deeper = examples.with_headword(t.ekzemplo.select("rid", F.col("sense_mrk").alias("drv_mrk")), t).select("rid", F.col("headword").alias("sense_head"))
    return own.join(deeper, "rid")


@query(sql("posts", "SELECT e.drv_mrk, min(e.rid) first_rid, count(*) n, md5(string_agg(e.ekz_md, '|' ORDER BY e.rid)) digest FROM h JOIN ekzemplo e ON e.rid = h.rid GROUP BY e.drv_mrk", h=PHRASE))
def examples_grouped(t: Tables) -> DataFrame:
    folded = fold.fold(F.col("ekz_md"))  # hits hold both words: other texts need not meet them
    found = phrase(t, "in the").join(t.ekzemplo.where(F.contains(folded, F.lit("in")) & F.contains(folded, F.lit("the"))), "rid")
    own = F.array_sort(F.collect_list(F.struct("rid", "ekz_md")))
    return found.groupBy("drv_mrk").agg(F.min("rid").alias("first_rid"), F.count("*").alias("n"), F.md5(F.array_join(F.transform(own, lambda x: x["ekz_md"]), "|")).alias("digest"))


@query(
    sql(
        "nodo traduko rules",
        r"SELECT w word, s stem FROM (SELECT w, arg_min(st, length(st) * 1000 + rk) s FROM st WHERE length(st) >= 3 GROUP BY w) WHERE s <> w AND regexp_matches(s, '^[\p{L}\p{N}]+$')",
        ws="SELECT DISTINCT trd w FROM traduko", st=STEMS_SQL,
    )
)
def examples_stem_guard(t: Tables) -> DataFrame:
    return examples.guarded_stems(t.traduko.select(F.col("trd").alias("word")).distinct())


EXAMPLE_BATCH = ("in the", "tionojn", "zzzz")
BY_PREFIX = bm25_sql("SELECT rid, count(*) tf FROM posts WHERE starts_with(term, 'tion') GROUP BY rid")


@query(sql("dl", "SELECT 1 qid, 'example-stem:tion' matched_via, count(*) n, round(sum(rank), 6) total FROM best", **BY_PREFIX))
def examples_by_stem(t: Tables) -> DataFrame:
    hits = fulltext.prefix_hits(words(t.nodo, "x", "tion").where("qid = 1").withColumnRenamed("word", "text"), t, "ekz")
    ranks = common.top(fulltext.bm25(hits, t.indexed().ekz_stats), 20, F.round("rank", 9), "rid")
    return ranks.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("rank"), 6).alias("total")).select("qid", F.lit("example-stem:tion").alias("matched_via"), "n", "total")


EXAMPLE_HITS = dict(
    ph=PHRASE,
    h="""SELECT 0 qid, 'example:in the' via, rid, tf FROM ph
      UNION ALL SELECT 1, 'example:tionojn', rid, count(*) FROM posts WHERE term = 'tionojn' GROUP BY rid
      UNION ALL SELECT 1, 'example-stem:tion', rid, count(*) FROM posts WHERE starts_with(term, 'tion') AND NOT EXISTS (SELECT 1 FROM posts WHERE term = 'tionojn') GROUP BY rid
      UNION ALL SELECT 2, 'example:zzzz', rid, count(*) FROM posts WHERE term = 'zzzz' GROUP BY rid""",
    stats=STATS,
    f="SELECT qid, CASE WHEN ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) END idf, any_value(avgdl) avgdl FROM h, stats GROUP BY qid, n_docs",
    ranks="SELECT h.*, -(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS rank FROM h JOIN dl USING (rid) JOIN f USING (qid)",
    best="SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), rid)::INT ord FROM ranks QUALIFY ord <= 20",
    shown="SELECT b.qid, b.ord, e.art, e.drv_mrk, e.sense_mrk, coalesce(n.kap, e.drv_mrk) headword, e.ekz_md, b.via matched_via FROM best b JOIN ekzemplo e USING (rid) LEFT JOIN nodo_first n ON n.mrk = e.drv_mrk",
)


@query(sql("dl nodo_first", "SELECT * FROM shown", **EXAMPLE_HITS))
def lookup_examples(t: Tables) -> DataFrame:
    return examples.lookup_examples(asked(t.nodo, *EXAMPLE_BATCH), t)


# Articles in HTML: dictionary articles are written from the tables, and parsed again.

def articles(t: Tables) -> DataFrame:
    """One article per brand: a section per derivation, a numbered sense per part, each with an example and a domain."""
    sense = F.concat(
        F.lit('<dt id="'), "mrk", F.lit('">'), "num", F.lit('.</dt>\n<dd><span class="dif">'), "kap", F.lit(' <span class="fntref">9</span>&amp; more <i class="ekz">A  '), "kap",
        F.lit(' &amp; <b class="nom">name</b></i></span><abbr class="uzo"> '), "num", F.lit(" </abbr></dd>"),
    )
    drvs = t.nodo.groupBy("art", "drv_mrk").agg(F.array_sort(F.collect_list(F.struct("rid", sense.alias("html")))).alias("own"), F.min("rid").alias("rid"))
    body = F.concat(F.lit('<section class="x drv"><h2 id="'), "drv_mrk", F.lit('"> the '), "drv_mrk", F.lit("\n</h2><dl>"), F.array_join(F.transform("own", lambda x: x["html"]), ""), F.lit("</dl></section>"))
    arts = drvs.groupBy("art").agg(F.array_sort(F.collect_list(F.struct("drv_mrk", body.alias("html")))).alias("own"), F.min("rid").alias("rid"))
    return arts.select(F.col("art").alias("mrk"), F.array_join(F.transform("own", lambda x: x["html"]), "\n").alias("txt"), "rid")


@query(sql("nodo", "SELECT art, drv_mrk mrk, 'the ' || drv_mrk headword, count(*) n FROM nodo GROUP BY art, drv_mrk"))
def html_articles(t: Tables) -> DataFrame:
    return html.parse_articles(articles(t)).select("art", "mrk", "headword", F.size("senses").cast("bigint").alias("n"))


SENSE_SQL = "mrk, num || '.' num, kap || ' & more' definition, 'A ' || kap || ' & name' examples, num AS domain"


@query(sql("nodo", f"SELECT art, drv_mrk, {SENSE_SQL} FROM nodo"))
def html_senses(t: Tables) -> DataFrame:
    found = html.parse_articles(articles(t)).select("art", F.col("mrk").alias("drv_mrk"), F.explode("senses").alias("s"))
    return found.select("art", "drv_mrk", "s.mrk", "s.num", "s.definition", F.array_join("s.examples", "|").alias("examples"), "s.domain")


@query(sql("nodo", f"SELECT art, mrk AS key, {SENSE_SQL} FROM nodo UNION ALL SELECT art, drv_mrk, {SENSE_SQL} FROM nodo"))
def html_by_key(t: Tables) -> DataFrame:
    found = html.parse_senses(articles(t)).select("art", "key", F.explode("senses").alias("s"))
    return found.select("art", "key", "s.mrk", "s.num", "s.definition", F.array_join("s.examples", "|").alias("examples"), "s.domain")


@query(sql("nodo", "SELECT art, drv_mrk, mrk sense_mrk, 'A ' || kap || ' &amp; **name**' ekz_md, (row_number() OVER (PARTITION BY art ORDER BY drv_mrk, rid) - 1)::INT position FROM nodo"))
def html_markdown(t: Tables) -> DataFrame:
    return html.build_examples(articles(t)).select("art", "drv_mrk", "sense_mrk", "ekz_md", "position")


@query(sql("nodo", "SELECT count(*) n, count(DISTINCT art) arts, 'A ' || min(kap) || ' & name' least FROM nodo"))
def html_examples(t: Tables) -> DataFrame:
    found = html.parse_articles(articles(t)).select("art", F.explode("senses").alias("s")).select("art", F.explode("s.examples").alias("e"))
    return found.agg(F.count("*").alias("n"), F.count_distinct("art").alias("arts"), F.min("e").alias("least"))


@query()
def build_examples(t: Tables) -> DataFrame:
    """The corpus of general web pages, by our own page profile."""
    return html.build_examples(t.artikolo, "page")


@query(sql("nodo", f"SELECT drv_mrk drv, {SENSE_SQL} FROM nodo"))
def assemble_senses(t: Tables) -> DataFrame:
    t.senses = html.parse_senses(articles(t))
    found = assemble.senses(subtree_results(t), t).select("drv", F.explode("senses").alias("s"))
    return found.select("drv", "s.mrk", "s.num", "s.definition", F.array_join("s.examples", "|").alias("examples"), "s.domain")


# Rendering.


LOOKUP_MD = dict(
    WATERFALL,
    trd="SELECT mrk, lng, string_agg(trd, ', ' ORDER BY r) trds FROM (SELECT x.mrk, lng, trd, min(t.rid) r FROM (SELECT DISTINCT mrk FROM results) x JOIN traduko t ON t.drv_mrk = x.mrk GROUP BY x.mrk, lng, trd) GROUP BY mrk, lng",
    a=f"SELECT mrk, string_agg('- **' || {NAME_OF % ('lng', 'lng')} || '** (' || lng || '): ' || trds, chr(10) ORDER BY lng) s FROM trd GROUP BY mrk",
    d="SELECT drv_mrk mrk, string_agg('**' || num || '.** ' || kap || ' & more *(' || num || ')*' || chr(10) || '  - *A ' || kap || ' & name*' || chr(10), chr(10) ORDER BY rid) s FROM nodo GROUP BY drv_mrk",
    u="SELECT mrk, string_agg(uzo, ', ' ORDER BY r) s FROM (SELECT drv_mrk mrk, uzo, min(rid) r FROM uzo GROUP BY drv_mrk, uzo) GROUP BY mrk",
    x="SELECT r.drv_mrk mrk, CASE tip WHEN 'sin' THEN 'Synonym' WHEN 'vid' THEN 'See' END label, f.kap, r.rid FROM referenco r JOIN nodo_first f ON f.mrk = r.cel WHERE tip <> 'super' QUALIFY row_number() OVER (PARTITION BY r.drv_mrk ORDER BY r.rid) <= 5",
    c="SELECT mrk, string_agg('- ' || label || ': ' || kap, chr(10) ORDER BY rid) s FROM x GROUP BY mrk",
    one="""SELECT r.qid, r.pos, '## ' || headword || coalesce(chr(10) || '*Matched via: ' || matched_via || '*', '') || coalesce(chr(10) || '**Domain:** ' || u.s, '') || coalesce(chr(10) || chr(10) || '### Translations' || chr(10) || a.s, '') ||
      coalesce(chr(10) || chr(10) || '### Definitions' || chr(10) || d.s, '') || coalesce(chr(10) || chr(10) || '### See also' || chr(10) || c.s, '') s
      FROM results r LEFT JOIN u ON u.mrk = r.mrk LEFT JOIN a ON a.mrk = r.mrk LEFT JOIN d ON d.mrk = r.mrk LEFT JOIN c ON c.mrk = r.mrk""",
)


@query(sql("nodo var rules traduko referenco uzo nodo_first", "SELECT qid, coalesce(string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos), 'No results found.') md FROM ws LEFT JOIN one USING (qid) GROUP BY qid", **LOOKUP_MD))
def render_lookup(t: Tables) -> DataFrame:
    t.senses = html.parse_senses(articles(t))
    queries = asked(t.nodo, *BATCH)
    return render.render_results(queries, Lexicon(t.nodo.sparkSession, t).lookup(queries))


def with_qid(requests: list[DataFrame]) -> DataFrame:
    """Requests, each asked for itself, numbered from 0."""
    out = None
    for i, one in enumerate(requests):
        one = one.select(F.lit(i).alias("qid"), "md")
        out = one if out is None else out.unionByName(one)
    return out


REQUESTS = "SELECT qid, coalesce(string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos), CASE WHEN w = 'zzz' THEN 'No results found.' END) md FROM ws LEFT JOIN one USING (qid) GROUP BY qid, w"


@query(sql("nodo var rules traduko referenco uzo nodo_first", REQUESTS, **LOOKUP_MD))
def request_lookup(t: Tables) -> DataFrame:
    """The same lookups through the dispatcher, each a request of its own whose tiers run until one has rows."""
    found = materialise(html.extracted(articles(t)), "request-articles")
    t.senses = html.senses_in(found)
    t.copies = {k: c for k, c in t.copies.items() if k[0] != "senses"}
    lex = Lexicon(t.nodo.sparkSession, t)
    return with_qid([lex.request(q) for q in BATCH])


WILDCARD_MD = """SELECT 'Found ' || (SELECT count(DISTINCT kap) FROM nodo WHERE kap_norm LIKE '%r%') || ' Esperanto headwords matching `*r*` (gloss: Angla) (showing 6–25 of ' ||
    (SELECT count(DISTINCT kap) FROM nodo WHERE kap_norm LIKE '%r%') || ').' || chr(10) || chr(10) ||
    string_agg(CASE WHEN n > 0 THEN '- **' || kap || '** — ' || glosses ELSE '- **' || kap || '**' END, chr(10) ORDER BY ord) || chr(10) || chr(10) ||
    '_More results available. Call lookup again with `offset: 25` to get the next page._' || chr(10) ||
    '_Call `lookup` on any headword (without `*`) for full definition and translations._' md FROM g"""


@query(sql("nodo traduko", WILDCARD_MD, p=PAGE, g=GLOSSED))
def render_wildcard(t: Tables) -> DataFrame:
    return render.render_wildcard(wildcard.lookup_compact(t, "*r*", "en", 20, 5), wildcard.total(t, "*r*"), "*r*", "en", 5)


REQUEST_PAGE = "SELECT kap, min(mrk) mrk, row_number() OVER (ORDER BY length(kap), kap)::INT - 3 ord FROM nodo WHERE kap_norm LIKE '%r%d%' GROUP BY kap QUALIFY ord BETWEEN 1 AND 100"
REQUEST_MD = """SELECT 0 qid, 'Found ' || total || ' Esperanto headword' || CASE WHEN total = 1 THEN '' ELSE 's' END || ' matching `*r*d*` (gloss: Franca) (showing 4–' || least(103, total) || ' of ' || total || ').' || chr(10) || chr(10) ||
    string_agg(CASE WHEN n > 0 THEN '- **' || kap || '** — ' || glosses ELSE '- **' || kap || '**' END, chr(10) ORDER BY ord) || chr(10) || chr(10) ||
    CASE WHEN total > 103 THEN '_More results available. Call lookup again with `offset: 103` to get the next page._' || chr(10) ELSE '' END ||
    '_Call `lookup` on any headword (without `*`) for full definition and translations._' md FROM g, (SELECT count(DISTINCT kap) total FROM nodo WHERE kap_norm LIKE '%r%d%') GROUP BY total"""


@query(sql("nodo traduko", REQUEST_MD, p=REQUEST_PAGE, g=GLOSSED.replace("'en'", "'fr'")))
def request_wildcard(t: Tables) -> DataFrame:
    """A wildcard through the dispatcher: a limit of 5 means 100."""
    return with_qid([Lexicon(t.nodo.sparkSession, t).request("*r*d*", show_languages=["fr"], limit=5, offset=3)])


@query(sql("nodo traduko", "SELECT qid, kap, mrk, ord FROM p", p=" UNION ALL ".join(f"SELECT * FROM (SELECT {i} qid, kap, min(mrk) mrk, row_number() OVER (ORDER BY length(kap), kap)::INT - 2 ord FROM nodo WHERE kap_norm LIKE '{like}' GROUP BY kap QUALIFY ord BETWEEN 1 AND 10)" for i, like in enumerate(("red%", "%rod", "r%d", "%e%", "%_d%r%", "%")))))
def wildcard_batch(t: Tables) -> DataFrame:
    """Pages of many patterns at once, by the permuterm index."""
    patterns = t.nodo.sparkSession.createDataFrame(list(enumerate(("red*", "*rod", "r*d", "*e*", "*_d*r*", "*"))), "qid int, pattern string")
    return wildcard.pages(patterns, t, 10, 2)


EXAMPLES_MD = dict(
    EXAMPLE_HITS,
    q="SELECT * FROM (VALUES (0, 'in the'), (1, 'tionojn'), (2, 'zzzz')) q(qid, q)",
    g="SELECT qid, min(ord) o, count(*) n, '## ' || any_value(headword) || chr(10) || string_agg('- ' || ekz_md, chr(10) ORDER BY ord) || chr(10) s FROM shown GROUP BY qid, drv_mrk",
    a="SELECT qid, sum(n)::BIGINT n, string_agg(s, chr(10) ORDER BY o) s FROM g GROUP BY qid",
)


@query(
    sql(
        "dl nodo_first",
        """SELECT qid, CASE WHEN n IS NULL THEN 'No example sentences match `' || q || '`.' ELSE 'Found ' || n || ' example sentence' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' matching `' || q || '`.' || chr(10) || chr(10) ||
        s || chr(10) || '_Call `lookup` on any headword above for its full dictionary entry._' END md FROM q LEFT JOIN a USING (qid)""",
        **EXAMPLES_MD,
    )
)
def render_examples(t: Tables) -> DataFrame:
    queries = asked(t.nodo, *EXAMPLE_BATCH)
    return render.render_examples(queries, examples.lookup_examples(queries, t))


LANGUAGE_ROWS = f"SELECT lng, count(*) c, {NAME_OF % ('lng', 'lng')} name FROM traduko GROUP BY lng"


@query(
    sql(
        "nodo traduko",
        """SELECT '## Available Languages (' || count(*) || ' total)' || chr(10) || chr(10) || '| Code | Language | Translations |' || chr(10) || '|------|----------|-------------|' || chr(10) ||
        string_agg('| ' || lng || ' | ' || name || ' | ' || format('{:,}', c) || ' |', chr(10) ORDER BY c DESC, lng) md FROM l""",
        l=LANGUAGE_ROWS,
    )
)
def render_languages(t: Tables) -> DataFrame:
    return render.render_languages(t.traduko)


FAMILY_MD = dict(
    FAMILY,
    tr="SELECT drv, lng, trd, min(rid) r FROM members JOIN traduko t ON drv_mrk = drv WHERE lng IN ('en', 'fr') GROUP BY drv, lng, trd",
    pl="SELECT drv, lng, lng || ': ' || string_agg(trd, ', ' ORDER BY r) s FROM tr GROUP BY drv, lng",
    pd="SELECT drv, string_agg(s, ' | ' ORDER BY lng) s FROM pl GROUP BY drv",
)


@query(sql("nodo traduko", "SELECT 0 qid, '## Word family: ' || any_value(root) || chr(10) || string_agg('- **' || headword || '** — ' || coalesce(s, '(no translations)'), chr(10) ORDER BY ord) md FROM members LEFT JOIN pd USING (drv)", **FAMILY_MD))
def render_family(t: Tables) -> DataFrame:
    queries = asked(t.nodo, "red rod")
    return render.render_family(queries, Lexicon(t.nodo.sparkSession, t).family(queries), ["en", "fr"])


# Every headword looked up and rendered, over a lexicon with a planted fault of each kind.

FAULTS = dict(
    n2="SELECT rid, kap, art, mrk, drv_mrk, kap_norm FROM nodo UNION ALL SELECT -1, ' ', 'blank', 'blank.0.-1', 'blank.0', ' '",
    f="SELECT kap_norm, arg_min(drv_mrk, o) drv, arg_min(art, o) art FROM (SELECT *, lpad(length(mrk)::VARCHAR, 6, '0') || lpad(rid::VARCHAR, 12, '0') o FROM nodo) GROUP BY kap_norm",
    ends="SELECT min(art) broken, max(art) bare FROM nodo",
    s="""SELECT n.kap, n.art, n.mrk, CASE WHEN trim(n.kap) = '' THEN 'empty' WHEN f.art = broken THEN 'crash' WHEN f.art = bare THEN 'no-senses' ELSE 'ok' END kind,
      CASE WHEN f.art = broken THEN 'AssertionError: unknown status keyword ''x '' in marked section' END message FROM n2 n LEFT JOIN f USING (kap_norm), ends""",
)


def faulty(t: Tables) -> Tables:
    """The lexicon with a blank headword, an article with a marked section that no parser knows (the first), and one without senses and
    translations (the last)."""
    first, last = t.nodo.agg(F.min("art"), F.max("art")).first()
    written = articles(t)
    text = F.when(F.col("mrk") == first, F.concat(F.lit("<![x y]>"), "txt")).when(F.col("mrk") == last, "").otherwise(F.col("txt"))
    found = materialise(html.extracted(written.select("mrk", "rid", text.alias("txt"))), "faulty-articles")
    blank = t.nodo.sparkSession.createDataFrame([("blank.0.-1", "blank", " ", "1", -1)], "mrk string, art string, kap string, num string, rid bigint")
    changed = {k: c for k, c in t.copies.items() if k[0] not in ("nodo", "traduko", "senses", "rotations")}
    return replace(t, copies=changed, rotations=None, heads=None, nodo=t.nodo.unionByName(with_keys("nodo", blank)), traduko=t.traduko.where(F.col("root_mrk") != last), senses=html.senses_in(found), failures=html.failures_in(found))


def rendered(t: Tables) -> DataFrame:
    """`kap`, `art`, `mrk`, `kind`, `message` of every node, read back from the report where they are failures."""
    spark = t.nodo.sparkSession
    folder = new_path(spark, "render-all-failures")
    done = Lexicon(spark, faulty(t)).failure_report(folder)
    failed = spark.read.schema("kap string, art string, mrk string, kind string, message string").json(folder)
    return done.where("kind = 'ok'").unionByName(failed)


@query(sql("nodo", "SELECT kind, count(*) n FROM s GROUP BY kind", **FAULTS))
def render_all_status(t: Tables) -> DataFrame:
    return rendered(t).groupBy("kind").agg(F.count("*").alias("n"))


@query(sql("nodo", "SELECT kap, art, mrk, kind, message FROM s WHERE kind <> 'ok'", **FAULTS))
def render_all_failures(t: Tables) -> DataFrame:
    """The failure report, as its JSON has it."""
    return rendered(t).where("kind <> 'ok'")


@query(sql("nodo", "SELECT message, count(*) n FROM s WHERE kind = 'crash' GROUP BY message", **FAULTS))
def render_all_top_failures(t: Tables) -> DataFrame:
    """The ten commonest messages of crashes."""
    return rendered(t).where("kind = 'crash'").groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(10)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of lookups, assembled and rendered."""
    return render_lookup(surrogate.tables(spark, sf_dir))
