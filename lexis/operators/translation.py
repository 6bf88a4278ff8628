"""Search by translation, in one language or all."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, like, strip
from ..sources.lexicon import Tables
from .common import first_tier, group_by_drv, kept, nodes_of, top
from .fulltext import hits_in, known_terms, narrowed, other_blocks, phrases, rarest_blocks
from .headword import lookup_headwords


def asked(queries: DataFrame) -> DataFrame:
    """`qid`, `q`, `word` and, if there, `lang`: trimmed and in lower case, but not taken for x-system."""
    return queries.withColumn("word", F.lower(strip(F.col("q"))))


def quoted_phrases(words: DataFrame) -> DataFrame:
    """`qid`, `phrase`, `text`: what the query means between quotation marks that are not escaped.

    Doubled marks separate like punctuation. One stray mark makes no valid query; pairs cut it into parts that all
    must match.
    """
    text = F.replace("word", F.lit('""'), F.lit(" "))
    cut = F.split(text, '"')
    valid = F.size(cut) % 2 == 1
    return words.where(valid).select("qid", F.posexplode(F.split(F.replace("word", F.lit('""'), F.lit(" ")), '"')).alias("phrase", "text"))


def matching_rows(words: DataFrame, tables: Tables, most: int | None = 100, same_language: bool = False) -> DataFrame:
    """The first `most` translation rows, over all languages, in which all phrases of the query stand.

    With `same_language`, only rows of the query's `lang` count.
    """
    parts = phrases(quoted_phrases(words))
    wanted = parts.select("qid", "phrase").distinct().groupBy("qid").agg(F.count("*").alias("all_phrases"))
    index = narrowed(tables, "trd", parts)
    found = known_terms(parts, index, "trd")
    whole = hits_in(rarest_blocks(found, index, "trd"), found, other_blocks(found, index, "trd")).groupBy("qid", "rid").agg(F.count("*").alias("got_phrases"))
    rids = whole.join(wanted, "qid").where("got_phrases = all_phrases").select("qid", "rid")
    if not same_language:
        rids = top(rids, most, "rid")
    rids = kept(rids)
    rows = rids.join(tables.near("traduko", "rid", rids, "rid", settled=True).select("rid", "mrk", "lng", "trd"), "rid")
    return top(rows.join(words.select("qid", "lang"), "qid").where("lng = lang"), most, "rid") if same_language else rows


def exact_rows(words: DataFrame, tables: Tables, most: int, same_language: bool) -> DataFrame:
    asked_for = words.withColumn("folded", ascii_fold(F.col("word")))
    on: Column = F.col("folded") == F.col("trd_fold")
    rows = tables.near("traduko", "trd_fold", asked_for, "folded").select("rid", "mrk", "lng", "trd", "trd_fold")
    if same_language:
        on = on & (F.col("lang") == F.col("lng"))
    return top(asked_for.join(rows, on).drop("folded"), most, "rid")


def substring_rows(words: DataFrame, tables: Tables, most: int = 50) -> DataFrame:
    """Translations of the language that contain the query, in which % and _ are wildcards.

    Queries with three characters in a row that are no wildcards ask for the rows that hold all such pieces of theirs: the
    rows of a piece come from its bucket, and a row must be there for each. Shorter ones go past all translations.
    """
    literals = F.filter(F.split(ascii_fold(F.col("word")), "[%_]"), lambda x: F.length(x) >= 3)
    each = F.flatten(F.transform(literals, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))))
    pieces = words.withColumn("pieces", F.array_distinct(each))
    long = pieces.where(F.size("pieces") > 0)
    asked_for = long.select("qid", F.col("lang").alias("lng"), F.size("pieces").alias("wanted"), F.explode("pieces").alias("gram"))
    shared = asked_for.join(tables.near("trd_grams", "gram", asked_for, "gram"), ["gram", "lng"]).groupBy("qid", "rid", "wanted").agg(F.count("*").alias("got"))
    rids = kept(shared.where("got = wanted").select("qid", "rid"))
    near = long.drop("pieces").join(rids, "qid").join(tables.near("traduko", "rid", rids, "rid", settled=True).select("rid", "mrk", "lng", "trd"), "rid")
    short = pieces.where(F.size("pieces") == 0).drop("pieces")
    every = tables.near("traduko", "lng", short, "lang").select("rid", "mrk", "lng", "trd")
    rows = near.unionByName(short.join(every, F.col("lang") == F.col("lng")))
    return top(rows.where(like(F.col("trd"), F.concat(F.lit("%"), "word", F.lit("%")))), most, "rid")


ROW = ("qid", "tier", "mrk", "lng", "trd", "rid", "ord")


def _tier(n: int, rows: DataFrame) -> DataFrame:
    return rows.withColumn("tier", F.lit(n)).select(*ROW)


def translation_rows(queries: DataFrame, tables: Tables, parity: bool = True) -> DataFrame:
    """Translation rows of the first tier that has any: exact, phrase, substring.

    With `parity`, the phrase tier takes its first 100 rows over all languages before it looks at the language;
    without, after.
    """
    words = asked(queries).where("word <> ''").select("qid", "lang", "word")
    if parity:
        phrase = matching_rows(words, tables).join(words.select("qid", "lang"), "qid").where("lng = lang")
    else:
        phrase = matching_rows(words, tables, same_language=True)
    found = kept(_tier(1, exact_rows(words, tables, 50, True)).unionByName(_tier(2, phrase)))
    left = kept(words.join(found.select("qid").distinct(), "qid", "left_anti"))
    return first_tier(found.unionByName(_tier(3, substring_rows(left, tables))))


def all_language_rows(queries: DataFrame, tables: Tables) -> DataFrame:
    """Translation rows in any language: exact, else phrase."""
    words = asked(queries).select("qid", "word")
    return first_tier(_tier(1, exact_rows(words, tables, 100, False)).unionByName(_tier(2, matching_rows(words, tables))))


def results_of(rows: DataFrame, queries: DataFrame, tables: Tables, limit: int, language: Column) -> DataFrame:
    """Results with `matched_via`: the first translation of the result's own key, else the query as it came."""
    rows = kept(rows)
    nodes = nodes_of(rows, tables, limit).withColumn("matched_via", F.lit(None).cast("string"))
    results = kept(group_by_drv(nodes, limit).drop("matched_via"))
    firsts = rows.groupBy("qid", "mrk").agg(F.min_by(F.struct("lng", "trd"), "ord").alias("hit"))
    via = results.join(firsts, ["qid", "mrk"], "left").join(queries, "qid")
    return via.select("qid", "pos", "headword", "article", "mrk", F.concat_ws(":", F.lit("translation"), language, F.coalesce("hit.trd", "q")).alias("matched_via"))


def lookup_translations(queries: DataFrame, tables: Tables, limit: int = 5, parity: bool = True) -> DataFrame:
    """Results of queries (`qid`, `q`, `lang`)."""
    return results_of(translation_rows(queries, tables, parity), queries, tables, limit, F.col("lang"))


def lookup_all(queries: DataFrame, tables: Tables, limit: int = 5) -> DataFrame:
    """Results of queries (`qid`, `q`) as headwords and, after those, as translations in any language; one per key."""
    as_headword = lookup_headwords(queries, tables, limit).withColumn("source", F.lit(0))
    as_translation = results_of(all_language_rows(queries, tables), queries, tables, limit, F.coalesce("hit.lng", F.lit("?"))).withColumn("source", F.lit(1))
    return merged(as_headword.unionByName(as_translation), limit)


def merged(results: DataFrame, limit: int) -> DataFrame:
    """First come, first kept: one result per query and key, renumbered and cut to the limit."""
    first = top(results, 1, "source", "pos", by=("qid", "mrk"), name="nth").drop("nth").withColumnRenamed("pos", "own_pos")
    return top(first, limit, "source", "own_pos", name="pos").select("qid", "pos", "headword", "article", "mrk", "matched_via")
