"""Lexicon searches as SQL table functions, with the tiers, limits and order of the batch interface.

A query is a constant or, behind LATERAL, a column. Many queries at once run better through `Lexicon`, whose costly
tiers see only the queries that the others left; here every tier is part of one statement.
"""

import re

from pyspark.sql import SparkSession

from ..functions.fold import TOKEN_BREAK, fold_table
from ..functions.stems import rules
from ..functions.text import BLANKS, LOWER, UPPER, x_pairs
from ..operators.fulltext import K1, LEAST_IDF, B, posts_of
from ..sources.lexicon import Tables

VIEWS = ("nodo", "var", "traduko", "artikolo", "ekzemplo", "first", "trd_posts", "ekz_posts", "ekz_lengths", "ekz_stats")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _converted(text: str) -> str:
    for pair, letter in x_pairs():
        text = f"replace({text}, '{pair}', '{letter}')"
    return text


RULES = "array(" + ", ".join(f"named_struct('ending', '{e}', 'instead', '{s}')" for e, s in rules()) + ")"
MADE = f"transform(filter({RULES}, r -> endswith(lower(@), r.ending) AND length(@) > length(r.ending) + 2), r -> concat(left(lower(@), length(@) - length(r.ending)), r.instead))"
#: Expressions that the statements below name like functions; @ stands for the argument. They are put in as text, as
#: Spark does not take SQL functions in every place of another one's body.
MACROS = {
    "strip": f"regexp_replace(@, {_quoted(f'^[{BLANKS}]+|[{BLANKS}]+$')}, '')",
    "normalize": "lower(" + _converted("lexis_strip(@)") + ")",
    "fold": f"translate(@, '{UPPER}', '{LOWER}')",
    "pattern": r"replace(lexis_fold(@), '\\', '\\\\')",
    "tokens": f"filter(split(translate(@, {_quoted(fold_table()[0])}, {_quoted(fold_table()[1])}), {_quoted(TOKEN_BREAK)}), t -> t <> '')",
    "stems": f"transform(array_sort(transform(array_distinct(concat(array(lower(@)), {MADE})), (s, i) -> named_struct('n', length(s), 'i', i, 'stem', s))), x -> x.stem)",
}


def _expanded(sql: str) -> str:
    """The statement with every macro, from the last one on, replaced by its text."""
    while found := list(re.finditer(rf"lexis_({'|'.join(MACROS)})\(", sql)):
        begin, depth = found[-1].end(), 1
        end = begin
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: found[-1].start()] + MACROS[found[-1][1]].replace("@", sql[begin : end - 1]) + sql[end:]
    return sql


def _function(head: str, body: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {_expanded(body)}"


NODES = "TABLE (pos INT, headword STRING, article STRING, mrk STRING, matched_via STRING)"


def _by_drv(hits: str, limit: str) -> str:
    """The first node of each derivation, in the order `ord`."""
    return f"""SELECT pos, kap, art, drv, via FROM (SELECT *, row_number() OVER (ORDER BY ord) pos FROM
        (SELECT *, row_number() OVER (PARTITION BY drv ORDER BY ord) nth FROM (SELECT *, substring_index(mrk, '.', 2) drv FROM ({hits}))) WHERE nth = 1) WHERE pos <= {limit}"""


HEADWORD = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY if(tier = 4000, length(kap), length(mrk)), if(tier = 4000, kap, ''), rid) ord, min(tier) OVER () least FROM
      (SELECT tier, via, mrk, art, kap, num, min(rid) rid FROM
        (SELECT if(form = word, 1000, 3000 + rank) tier, if(form = word, NULL, concat('stem:', form)) via, n.mrk, n.art, n.kap, n.num, n.rid FROM
            (SELECT word, posexplode(forms) AS (rank, form) FROM (SELECT word, lexis_stems(word) forms FROM (SELECT lexis_normalize(query) word)) WHERE word <> '') f JOIN lexis_nodo n ON n.kap_norm = form
          UNION ALL SELECT 2000, NULL, n.mrk, n.art, n.kap, n.num, n.rid FROM (SELECT lexis_normalize(query) word) w JOIN lexis_var v ON v.kap_norm = word JOIN lexis_nodo n ON n.mrk = v.mrk
          UNION ALL SELECT 4000, concat('prefix:', word), n.mrk, n.art, n.kap, n.num, n.rid FROM (SELECT lexis_normalize(query) word) w JOIN lexis_nodo n ON left(n.kap_norm, 1) = left(word, 1) AND lexis_fold(n.kap_norm) LIKE lexis_pattern(concat(word, '%'))
            WHERE word <> '' AND left(word, 1) NOT IN ('%', '_')
          UNION ALL SELECT 4000, concat('prefix:', word), n.mrk, n.art, n.kap, n.num, n.rid FROM (SELECT lexis_normalize(query) word) w JOIN lexis_nodo n ON lexis_fold(n.kap_norm) LIKE lexis_pattern(concat(word, '%')) WHERE left(word, 1) IN ('%', '_'))
        GROUP BY tier, via, mrk, art, kap, num))
    WHERE tier = least AND (tier <> 4000 OR ord <= most * 5)"""

#: Translation rows in which all quoted phrases of the query stand, the first 100.
PHRASES = """SELECT t.mrk, t.lng, t.trd, t.rid, row_number() OVER (ORDER BY t.rid) ord FROM
      (SELECT rid FROM (SELECT phrase, rid, wanted FROM (SELECT phrase, n, wanted, p.rid, p.pos - i AS start, count(*) got FROM
          (SELECT phrase, n, wanted, posexplode(ts) AS (i, term) FROM
            (SELECT phrase, lexis_tokens(part) ts, size(lexis_tokens(part)) n, wanted FROM
              (SELECT wanted, posexplode(parts) AS (phrase, part) FROM
                (SELECT parts, size(filter(parts, x -> x RLIKE '[\\\\p{L}\\\\p{N}\\\\p{Co}]')) wanted FROM (SELECT split(replace(lower(lexis_strip(query)), '""', ' '), '"') parts) WHERE size(parts) % 2 = 1)))) q
          JOIN lexis_trd_posts p ON p.term = q.term GROUP BY phrase, n, wanted, p.rid, p.pos - i) WHERE got = n GROUP BY phrase, rid, wanted) GROUP BY rid, wanted HAVING count(*) = wanted) r
      JOIN lexis_traduko t ON t.rid = r.rid"""


def _translated(rows: str, language: str) -> str:
    """Results from translation rows (`mrk`, `lng`, `trd`, `ord`) of the first tier that has any, like those of the batch
    interface; `hit` is the first translation of a derivation's own key."""
    own = f"(SELECT *, min(tier) OVER () least, substring_index(mrk, '.', 2) own_drv FROM ({rows}))"
    hits = f"(SELECT *, min(if(mrk = own_drv, struct(ord, lng, trd), NULL)) OVER (PARTITION BY own_drv) hit FROM {own} WHERE tier = least)"
    keys = f"(SELECT mrk, hit, min(ord) ord, row_number() OVER (ORDER BY min(ord)) nth FROM {hits} GROUP BY mrk, hit)"
    via = f"concat_ws(':', 'translation', {language}, coalesce(k.hit.trd, query))"
    return _by_drv(f"SELECT f.mrk, f.art, f.kap, f.num, k.ord, {via} via FROM {keys} k JOIN lexis_first f ON f.mrk = k.mrk WHERE nth <= most * 3", "most")


ASKED = "(SELECT lower(lexis_strip(query)) word)"
ONE_LANGUAGE = f"""SELECT 1 tier, * FROM (SELECT mrk, lng, trd, rid, row_number() OVER (ORDER BY rid) ord FROM {ASKED} JOIN lexis_traduko t ON t.trd_fold = lexis_fold(word) WHERE word <> '' AND lng = language) WHERE ord <= 50
    UNION ALL SELECT 2, * FROM ({PHRASES}) WHERE ord <= 100 AND lng = language
    UNION ALL SELECT 3, * FROM (SELECT mrk, lng, trd, rid, row_number() OVER (ORDER BY rid) ord FROM {ASKED} JOIN lexis_traduko t ON lexis_fold(trd) LIKE lexis_pattern(concat('%', word, '%')) WHERE word <> '' AND lng = language) WHERE ord <= 50"""
ANY_LANGUAGE = f"""SELECT 1 tier, * FROM (SELECT mrk, lng, trd, rid, row_number() OVER (ORDER BY rid) ord FROM {ASKED} JOIN lexis_traduko t ON t.trd_fold = lexis_fold(word)) WHERE ord <= 100
    UNION ALL SELECT 2, * FROM ({PHRASES}) WHERE ord <= 100"""

GUARDED = "get(filter(lexis_stems(word), s -> length(s) >= 3), 0)"
EXAMPLES = f"""SELECT tier, via, rid, count(*) tf FROM
      (SELECT 1 tier, concat('example:', word) via, p.rid, p.pos - i AS start, count(*) got, n FROM
        (SELECT word, n, posexplode(ts) AS (i, term) FROM (SELECT word, lexis_tokens(word) ts, size(lexis_tokens(word)) n FROM (SELECT lexis_normalize(query) word))) q JOIN lexis_ekz_posts p ON p.term = q.term
        GROUP BY word, p.rid, p.pos - i, n HAVING count(*) = n
      UNION ALL SELECT 2, concat('example-stem:', stem), p.rid, p.pos, 1, 1 FROM
        (SELECT stem, element_at(lexis_tokens(stem), -1) begins FROM (SELECT word, {GUARDED} stem FROM (SELECT lexis_normalize(query) word)) WHERE stem <> word AND stem RLIKE '^[\\\\p{{L}}\\\\p{{N}}]+$') s
        JOIN lexis_ekz_posts p ON left(p.term, 3) = left(begins, 3) AND startswith(p.term, begins))
    GROUP BY tier, via, rid"""
RANKED = f"""SELECT *, row_number() OVER (ORDER BY round(-(idf * (tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl)))), 9), rid) ord FROM
      (SELECT h.*, l.dl, s.avgdl, if(ln((s.n_docs - df + 0.5D) / (df + 0.5D)) <= 0, {LEAST_IDF}D, ln((s.n_docs - df + 0.5D) / (df + 0.5D))) idf FROM
        (SELECT *, count(*) OVER () df FROM (SELECT *, min(tier) OVER () least FROM ({EXAMPLES})) WHERE tier = least) h JOIN lexis_ekz_lengths l ON l.rid = h.rid CROSS JOIN lexis_ekz_stats s)"""

#: The article of the query's root: the article of that name, else that of the first node with the word or a stem of it.
ROOT = """SELECT root FROM (SELECT root, tier, min(tier) OVER () least FROM
      (SELECT 0 tier, a.mrk root FROM (SELECT lexis_normalize(query) word) w JOIN (SELECT DISTINCT mrk FROM lexis_artikolo) a ON a.mrk = word
       UNION ALL SELECT i + 1, min_by(n.art, n.rid) FROM
         (SELECT posexplode(forms) AS (i, form) FROM (SELECT concat(array(word), lexis_stems(word)) forms FROM (SELECT lexis_normalize(query) word))) f JOIN lexis_nodo n ON lexis_fold(n.kap) = form GROUP BY i)) WHERE tier = least"""

MATCHING = "lexis_fold({0}.kap_norm) LIKE lexis_pattern(replace(lower(pattern), '*', '%'))"
FUNCTIONS = (
    _function("lexis_headword(query STRING) RETURNS TABLE (mrk STRING, art STRING, kap STRING)", "SELECT mrk, art, kap FROM lexis_nodo WHERE kap_norm = lexis_normalize(query)"),
    _function("lexis_variant(query STRING) RETURNS TABLE (mrk STRING, art STRING, kap STRING)", "SELECT n.mrk, n.art, n.kap FROM lexis_nodo n JOIN lexis_var v ON n.mrk = v.mrk WHERE v.kap_norm = lexis_normalize(query)"),
    _function(f"lexis_lookup(query STRING, most INT DEFAULT 5) RETURNS {NODES}", _by_drv(HEADWORD, "most")),
    _function(f"lexis_translation(query STRING, language STRING, most INT DEFAULT 5) RETURNS {NODES}", _translated(ONE_LANGUAGE, "language")),
    _function(f"lexis_any_translation(query STRING, most INT DEFAULT 5) RETURNS {NODES}", _translated(ANY_LANGUAGE, "coalesce(k.hit.lng, '?')")),
    _function(
        f"lexis_all(query STRING, most INT DEFAULT 5) RETURNS {NODES}",
        """SELECT place, headword, article, mrk, matched_via FROM (SELECT *, row_number() OVER (ORDER BY source, pos) place FROM (SELECT *, row_number() OVER (PARTITION BY mrk ORDER BY source, pos) nth FROM
          (SELECT 0 source, h.* FROM (SELECT query q, most m) w, LATERAL lexis_lookup(q, m) h UNION ALL SELECT 1, t.* FROM (SELECT query q, most m) w, LATERAL lexis_any_translation(q, m) t)) WHERE nth = 1) WHERE place <= most""",
    ),
    _function(
        f"lexis_wildcard(pattern STRING, most INT DEFAULT 20) RETURNS {NODES}",
        _by_drv(
            f"""SELECT *, concat('wildcard:', pattern) via FROM (SELECT *, row_number() OVER (ORDER BY length(kap), kap, mrk, num) ord FROM (SELECT mrk, art, kap, num FROM lexis_nodo n WHERE {MATCHING.format('n')} UNION
            SELECT n.mrk, n.art, n.kap, n.num FROM lexis_nodo n JOIN lexis_var v ON v.mrk = n.mrk WHERE {MATCHING.format('v')})) WHERE ord <= most * 5""",
            "most",
        ),
    ),
    _function(
        "lexis_examples(query STRING, most INT DEFAULT 20) RETURNS TABLE (ord INT, art STRING, drv_mrk STRING, sense_mrk STRING, headword STRING, ekz_md STRING, matched_via STRING)",
        f"SELECT ord, e.art, e.drv_mrk, e.sense_mrk, coalesce(f.kap, e.drv_mrk), e.ekz_md, via FROM ({RANKED}) r JOIN lexis_ekzemplo e ON e.rid = r.rid LEFT JOIN lexis_first f ON f.mrk = e.drv_mrk WHERE ord <= most",
    ),
    _function(
        "lexis_family(query STRING) RETURNS TABLE (ord INT, root STRING, drv STRING, headword STRING, translations ARRAY<STRUCT<lng: STRING, trd: STRING>>)",
        f"""SELECT ord, root, m.drv, headword, coalesce(ts, array()) FROM
          (SELECT root, drv, first.kap headword, row_number() OVER (ORDER BY first.mrk) ord FROM (SELECT root, substring_index(mrk, '.', 2) drv, min(struct(n.mrk, n.kap)) first FROM ({ROOT}) r JOIN lexis_nodo n ON n.art = root WHERE instr(n.mrk, '.') > 0 GROUP BY 1, 2)) m
          LEFT JOIN (SELECT drv_mrk, transform(array_sort(collect_list(struct(lng, rid, trd))), x -> struct(x.lng, x.trd)) ts FROM lexis_traduko GROUP BY drv_mrk) t ON t.drv_mrk = m.drv""",
    ),
    _function("lexis_languages() RETURNS TABLE (lng STRING, count BIGINT)", "SELECT lng, count(*) FROM lexis_traduko GROUP BY lng"),
)


def register(spark: SparkSession, tables: Tables) -> None:
    """Make the views and functions known to this session."""
    indexed = tables.indexed()
    posts = {"trd_posts": posts_of(indexed.trd_blocks), "ekz_posts": posts_of(indexed.ekz_blocks)}
    for name in VIEWS:
        (posts[name] if name in posts else getattr(indexed, name)).createOrReplaceTempView(f"lexis_{name}")
    for sql in FUNCTIONS:
        spark.sql(sql)
