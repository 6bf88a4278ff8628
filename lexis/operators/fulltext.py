"""Full-text search: a term dictionary, blocks of postings, phrases, prefixes, BM25.

Rows are dealt to blocks by their length and a hash, so that all terms of a row stand in blocks of the same number. A
phrase starts from its rarest term; of the others only blocks of these numbers are met, and of these only the rows that
the rarest term has. A block knows the most that one of its rows can weigh.
"""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import tokens
from ..sources.covering import asked_for
from ..sources.lexicon import Tables
from .common import kept

#: Constants of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows for which a length class gets another block; characters by which a prefix finds its terms.
BLOCK_ROWS, HEAD = 4096, 3


def postings(docs: DataFrame, text: str) -> DataFrame:
    """`term`, `rid`, `pos` for every token."""
    return docs.select("rid", F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def lengths(docs: DataFrame, text: str) -> DataFrame:
    """`rid`, `dl`: tokens per row."""
    return docs.select("rid", F.size(tokens(F.col(text))).cast("bigint").alias("dl"))


def grams(rows: DataFrame, text: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """`lng`, `gram`, `rid`: the distinct pieces of three characters of every row's text, or those that `only` holds for."""
    pieces = F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(F.col(text), i, F.lit(3))))
    if only is None:
        return rows.select("lng", "rid", F.explode(F.array_distinct(pieces)).alias("gram"))
    return rows.where(F.exists(pieces, only)).select("lng", "rid", F.explode(F.array_distinct(pieces)).alias("gram")).where(only(F.col("gram")))


def corpus_stats(own_lengths: DataFrame) -> DataFrame:
    """One row: `n_docs`, `avgdl`."""
    return own_lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def blocks(docs: DataFrame, text: str, rows: int = 0, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """`term`, `block`, `n` (rows), `most` (occurrences in one), `least_dl`, `rows` (rid, dl, places), by one exchange.

    A common term has as many blocks as there are, so that none of its groups grows with the input (of `rows` rows). With `only`,
    of the terms for which it holds.
    """
    docs = docs if only is None else docs.where(F.exists(tokens(F.col(text)), only))
    cut = docs.select("rid", tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts").cast("bigint"))
    length_class = F.least(F.lit(31), F.floor(2 * F.log2(F.col("dl")))).cast("int")
    parts = rows // BLOCK_ROWS + 1
    block = length_class * parts + F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    each = cut.where("dl > 0").select("rid", "dl", block.alias("block"), F.posexplode("ts").alias("pos", "term"))
    each = (each if only is None else each.where(only(F.col("term")))).repartition("term", "block")
    of_rows = each.groupBy("term", "block", "rid", "dl").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return of_rows.groupBy("term", "block").agg(
        F.count("*").alias("n"), F.max(F.size("places")).alias("most"), F.min("dl").alias("least_dl"), F.array_sort(F.collect_list(F.struct("rid", "dl", "places"))).alias("rows")
    )


def terms(of_blocks: DataFrame) -> DataFrame:
    """The dictionary: `term`, `head` (its first characters), `df` (rows that have it)."""
    return of_blocks.groupBy("term").agg(F.sum("n").alias("df")).withColumn("head", F.left("term", F.lit(HEAD)))


def posts_of(of_blocks: DataFrame) -> DataFrame:
    """The postings of blocks one by one: `term`, `rid`, `pos`."""
    rows = of_blocks.select("term", F.explode("rows").alias("r"))
    return rows.select("term", "r.rid", F.explode("r.places").alias("pos"))


def phrases(queries: DataFrame) -> DataFrame:
    """`qid`, `phrase` (number), `i`, `term`, `n`: the tokens of each quoted phrase. Without tokens a phrase has no rows."""
    split = queries.select("qid", "phrase", tokens(F.col("text")).alias("ts"))
    return split.select("qid", "phrase", F.size("ts").alias("n"), F.posexplode("ts").alias("i", "term"))


def known_terms(asked: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Phrases (`qid`, `phrase`, `n`, `i`, `term`) all of whose terms occur, with `df` and `nth`: 1 for the rarest term."""
    headed = asked.withColumn("head", F.left("term", F.lit(HEAD)))
    found = headed.join(tables.near(f"{name}_terms", "head", headed, "head").select("term", "df"), "term").drop("head")
    of_phrase = Window.partitionBy("qid", "phrase")
    counted = found.withColumn("got", F.count("*").over(of_phrase)).withColumn("nth", F.row_number().over(of_phrase.orderBy("df", "i")))
    return kept(counted.where("got = n").drop("got"))


#: The tables and columns of which the indexes are.
TEXTS = {"trd": ("traduko", "trd"), "ekz": ("ekzemplo", "ekz_md")}


def narrowed(tables: Tables, name: str, asked: DataFrame, column: str = "term") -> Tables:
    """The tables for one search in an index that is not stored: with the blocks of the batch's terms (or of terms with its `head`s) alone.

    Rows without any are told by their text, where it is read, so that no join carries them; the blocks are kept, and one pass
    over the texts serves the whole search. Stored indexes stay as they are.
    """
    if not tables.unstored or name not in TEXTS:
        return tables
    (of, text), only = TEXTS[name], asked_for(asked, column)
    mine = only and (lambda term: only(F.left(term, F.lit(HEAD)) if column == "head" else term))
    own = kept(blocks(getattr(tables, of), text, tables.rows(of), mine))
    return replace(tables, **{f"{name}_blocks": own, f"{name}_terms": terms(own)}, heads=None)


def rarest_blocks(found: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The blocks of each phrase's rarest term."""
    rarest = found.where("nth = 1")
    return rarest.join(tables.near(f"{name}_blocks", "term", rarest, "term", settled=True).withColumnRenamed("n", "block_rows"), "term")


def other_blocks(found: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Blocks that the other terms of the phrases can have."""
    return tables.near(f"{name}_blocks", "term", found.where("nth > 1"), "term", settled=True).select("term", "block", "rows")


def hits_in(seeds: DataFrame, found: DataFrame, beside: DataFrame) -> DataFrame:
    """`qid`, `phrase`, `rid`, `dl`, `tf` of phrases, from blocks of their rarest terms (as `rarest_blocks` gives them) and of the others.

    The rows of the rarest term's blocks go to the blocks of the same number of the other terms, where all other rows are
    left out before any is exchanged.
    """
    own = seeds.select("qid", "phrase", "n", "i", F.explode("rows").alias("r"))
    own = own.select("qid", "phrase", "n", "i", "r.rid", "r.dl", "r.places")
    others = found.where("nth > 1").select("qid", "phrase", "n", "i", "term")
    wanted = seeds.where("n > 1").select("qid", "phrase", "block", F.transform("rows", lambda r: r["rid"]).alias("rids")).join(others, ["qid", "phrase"])
    met = wanted.join(beside, ["term", "block"]).select("qid", "phrase", "n", "i", F.explode(F.expr("filter(rows, r -> array_contains(rids, r.rid))")).alias("r"))
    both = own.unionByName(met.select("qid", "phrase", "n", "i", "r.rid", "r.dl", "r.places"))
    begins = F.collect_list(F.expr("transform(places, p -> p - i)")).alias("begins")
    aligned = both.groupBy("qid", "phrase", "rid", "dl", "n").agg(begins).where(F.size("begins") == F.col("n"))
    tf = F.size(F.aggregate("begins", F.get("begins", F.lit(0)), F.array_intersect)).cast("bigint")
    return aligned.select("qid", "phrase", "rid", "dl", tf.alias("tf")).where("tf > 0")


def phrase_hits(queries: DataFrame, tables: Tables, name: str) -> DataFrame:
    """`qid`, `rid`, `dl`, `tf`: rows of an index with the phrase, its tokens on consecutive positions, and how often. `queries`: `qid`, `text`."""
    asked = phrases(queries.withColumn("phrase", F.lit(0)))
    tables = narrowed(tables, name, asked)
    found = known_terms(asked, tables, name)
    return hits_in(rarest_blocks(found, tables, name), found, other_blocks(found, tables, name)).drop("phrase")


def heads(tables_by_name: dict[str, DataFrame]) -> DataFrame:
    """`of`, `begun`, `head`: which heads the tables (with a column `head`) have that begin so, for prefixes of any length."""
    out = None
    for name, df in tables_by_name.items():
        begun = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda n: F.left("head", n)))).alias("begun")
        own = df.select("head").distinct().select(F.lit(name).alias("of"), begun, "head")
        out = own if out is None else out.unionByName(own)
    return out


def headed(asked: DataFrame, tables: Tables, name: str, column: str) -> DataFrame:
    """The batch with the heads of a table that its prefixes can meet: one, or, for prefixes shorter than heads, some.

    Where nothing is stored, the table is not made to tell which heads it has, unless a prefix is so short.
    """
    if tables.unstored and (asked.agg(F.min(F.length(column))).first()[0] or HEAD) >= HEAD:
        return asked.withColumn("head", F.left(column, F.lit(HEAD)))
    own = tables.derived("heads").where(F.col("of") == name).select("begun", "head")
    return asked.withColumn("begun", F.left(column, F.lit(HEAD))).join(own, "begun").drop("begun")


def last_tokens(queries: DataFrame) -> DataFrame:
    """`qid`, `begins`: the query's last token, if it has any."""
    return queries.select("qid", F.element_at(F.concat(F.array(F.lit("")), tokens(F.col("text"))), -1).alias("begins")).where("begins <> ''")


def prefix_terms(queries: DataFrame, tables: Tables, name: str) -> DataFrame:
    """`qid`, `term`: the dictionary's terms that begin with the query's last token."""
    near = kept(headed(last_tokens(queries), tables, f"{name}_terms", "begins"))
    met = near.join(tables.near(f"{name}_terms", "head", near, "head", settled=True).select("head", "term"), "head")
    return met.where(F.startswith("term", "begins")).select("qid", "term")


def prefix_hits(queries: DataFrame, tables: Tables, name: str) -> DataFrame:
    """`qid`, `rid`, `dl`, `tf`: rows with tokens that begin with the query's one token, by the blocks of the terms that do."""
    if tables.unstored:
        tables = narrowed(tables, name, headed(last_tokens(queries), tables, f"{name}_terms", "begins"), "head")
    found = kept(prefix_terms(queries, tables, name))
    met = found.join(tables.near(f"{name}_blocks", "term", found, "term", settled=True).select("term", "rows"), "term").select("qid", F.explode("rows").alias("r"))
    return met.groupBy("qid", "r.rid", "r.dl").agg(F.sum(F.size("r.places")).alias("tf"))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a row counts besides its term's rarity: more with each occurrence, less with each token."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Add `rank` (smaller is better) to hits (`qid`, `rid`, `dl`, `tf`), by the statistics of all rows: a phrase or prefix counts as one term of which as many rows have it as hits."""
    found = hits.groupBy("qid").agg(F.count("*").alias("df")).withColumn("one", F.lit(1))
    idf = F.log((F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    own = hits.join(found.join(F.broadcast(stats.withColumn("one", F.lit(1))), "one").drop("one"), "qid")  # one row of statistics
    return own.withColumn("rank", -(idf * weight(F.col("tf"), F.col("dl"), F.col("avgdl")))).drop("df", "n_docs", "avgdl")


def best_phrase_hits(queries: DataFrame, tables: Tables, name: str, limit: int) -> DataFrame:
    """The `limit` best rows (`qid`, `rid`, `dl`, `tf`, `value`, `ord`) of each query's phrase: heaviest first, to nine digits, then by rid.

    A phrase's rarity is the same for all of its rows, so their weights alone order them. First the blocks are read that
    can weigh most and have some four times as many rows as are wanted; their `limit`-th row sets what a row must weigh,
    and of the other blocks only those are read whose most frequent, shortest row could reach it.
    """
    asked = phrases(queries.withColumn("phrase", F.lit(0)))
    tables = narrowed(tables, name, asked)
    found = known_terms(asked, tables, name)
    stats = F.broadcast(tables.derived("ekz_stats").select("avgdl").withColumn("phrase", F.lit(0)))  # one row of statistics
    bound = F.round(weight(F.col("most"), F.col("least_dl"), F.col("avgdl")), 9)
    rarest = found.where("nth = 1")
    mine = tables.near(f"{name}_blocks", "term", rarest, "term", settled=True)
    seeds = rarest.join(mine.select("term", "block", F.col("n").alias("block_rows"), "most", "least_dl"), "term").join(stats, "phrase").withColumn("bound", bound)
    beside = other_blocks(found, tables, name)
    before = Window.partitionBy("qid").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = kept(seeds.withColumn("rows_before", F.coalesce(F.sum("block_rows").over(before), F.lit(0))))
    sharp = F.col("rows_before") < 4 * limit

    def weighed(chosen: DataFrame) -> DataFrame:
        hits = hits_in(chosen.drop("avgdl").join(mine.select("term", "block", "rows"), ["term", "block"]), found, beside).join(stats, "phrase")
        return hits.withColumn("value", F.round(weight(F.col("tf"), F.col("dl"), F.col("avgdl")), 9)).select("qid", "rid", "dl", "tf", "value")

    order = Window.partitionBy("qid").orderBy(F.desc("value"), "rid")
    first = kept(weighed(numbered.where(sharp)))
    needed = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == limit).select("qid", F.col("value").alias("needed"))
    rest = numbered.where(~sharp).join(needed, "qid", "left").where("needed is null or bound >= needed").drop("needed")
    return first.unionByName(weighed(rest)).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= limit)
