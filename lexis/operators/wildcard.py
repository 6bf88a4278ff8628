"""Wildcard discovery of headwords."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drv_key
from ..sources.lexicon import Tables
from . import permuterm
from .common import group_by_drv, kept, top
from .headword import NODE


def one(tables: Tables, pattern: str) -> DataFrame:
    """A batch of a single pattern."""
    return permuterm.globs(tables.nodo.sparkSession.createDataFrame([(0, pattern)], "qid int, pattern string"))


def matching(tables: Tables, pattern: str) -> DataFrame:
    """The nodes whose headword the pattern matches."""
    return permuterm.nodes(one(tables, pattern), tables).drop("qid")


def totals(patterns: DataFrame, tables: Tables) -> DataFrame:
    """`qid`, `total` of patterns (`qid`, `pattern`) that match any headword."""
    return permuterm.nodes(permuterm.globs(patterns), tables).groupBy("qid").agg(F.count_distinct("kap").alias("total"))


def pages(patterns: DataFrame, tables: Tables, limit: int = 100, offset: int = 0) -> DataFrame:
    """`qid`, `kap`, `mrk` (the least) of a page of each pattern's distinct headwords, short ones first, numbered `ord` from the offset.

    Counts of the headwords of each length and first character say where the page lies; only the headwords of the lengths
    and characters that it touches are put into order.
    """
    heads = kept(permuterm.nodes(permuterm.globs(patterns), tables).groupBy("qid", "kap").agg(F.min("mrk").alias("mrk")))
    placed = heads.select("qid", "kap", "mrk", F.length("kap").alias("n"), F.left("kap", F.lit(1)).alias("c"))
    ranges = placed.groupBy("qid", "n", "c").agg(F.count("*").alias("count"))
    after = F.sum("count").over(Window.partitionBy("qid").orderBy("n", "c")).alias("after")
    touched = ranges.select("qid", "n", "c", "count", after).withColumn("before", F.col("after") - F.col("count")).where((F.col("after") > offset) & (F.col("before") < offset + limit))
    own = placed.join(touched.select("qid", "n", "c", "before"), ["qid", "n", "c"])
    within = F.row_number().over(Window.partitionBy("qid", "n", "c").orderBy("kap"))
    nth = own.withColumn("ord", (F.col("before") + within - offset).cast("int"))
    return kept(nth.where(F.col("ord").between(1, limit)).select("qid", "kap", "mrk", "ord"))


def glosses_of(tables: Tables, heads: DataFrame, language: str = "en") -> DataFrame:
    """Add `glosses`: the translations of exactly this key, in their order. The page comes first, the join after."""
    keyed = heads.withColumn("drv", drv_key(F.col("mrk")))
    own = tables.near("traduko", "drv_mrk", keyed, "drv", settled=True).where(F.col("lng") == language).select("mrk", "rid", "trd")
    met = heads.join(own, "mrk", "left").groupBy("qid", "ord", "kap", "mrk").agg(F.array_sort(F.collect_list(F.when(F.col("trd").isNotNull(), F.struct("rid", "trd")))).alias("g"))
    return met.select("qid", "ord", "kap", "mrk", F.transform("g", lambda x: x["trd"]).alias("glosses"))


def lookup_compacts(patterns: DataFrame, tables: Tables, language: str = "en", limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages of many patterns at once, with glosses."""
    return glosses_of(tables, pages(patterns, tables, limit, offset), language)


def hits_of(patterns: DataFrame, tables: Tables, limit: int = 20) -> DataFrame:
    """Nodes matched by headword or by variant, the `limit * 5` shortest headwords of each pattern first."""
    asked = permuterm.globs(patterns)
    own = permuterm.nodes(asked, tables).select("qid", *NODE)
    found = kept(permuterm.matching(asked, tables, of_variant=True))
    keys = kept(found.join(tables.near("var", "kap_norm", found, "kap_norm", settled=True).select("kap_norm", "mrk"), "kap_norm").select("qid", "mrk").distinct())
    both = own.unionByName(keys.join(tables.near("nodo", "mrk", keys, "mrk", settled=True), "mrk").select("qid", *NODE)).distinct()
    return top(both, limit * 5, F.length("kap"), "kap", "mrk", "num")


def lookup_wildcards(patterns: DataFrame, tables: Tables, limit: int = 20) -> DataFrame:
    """Results of patterns (`qid`, `pattern`)."""
    via = F.concat(F.lit("wildcard:"), "pattern").alias("matched_via")
    return group_by_drv(hits_of(patterns, tables, limit).join(patterns.select("qid", via), "qid"), limit)


# The same for one pattern.


def total(tables: Tables, pattern: str) -> DataFrame:
    return totals(one(tables, pattern), tables).agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))


def page(tables: Tables, pattern: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return pages(one(tables, pattern), tables, limit, offset).drop("qid")


def lookup_compact(tables: Tables, pattern: str, language: str = "en", limit: int = 100, offset: int = 0) -> DataFrame:
    return lookup_compacts(one(tables, pattern), tables, language, limit, offset).drop("qid")


def lookup_wildcard(tables: Tables, pattern: str, limit: int = 20) -> DataFrame:
    return lookup_wildcards(one(tables, pattern), tables, limit)
