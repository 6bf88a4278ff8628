"""Everything that belongs to a result: senses, translations, cross-references, usage domains."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexicon import Tables
from .common import kept, subtree_of
from .html import SENSE

EMPTY = {
    "senses": f"array<{SENSE}>", "translations": "array<struct<lng:string,trd:string>>",
    "cross_refs": "array<struct<target:string,type:string,target_kap:string>>", "usage_domains": "array<string>",
}


def _keys(results: DataFrame) -> DataFrame:
    return results.select(F.col("mrk").alias("drv")).distinct()


def translations(results: DataFrame, tables: Tables) -> DataFrame:
    """`drv`, `translations`: first those of the key itself, then those below, each by language."""
    rows = subtree_of(_keys(results), tables, "traduko")
    level = F.when(F.col("mrk") == F.col("drv"), 0).otherwise(1).alias("level")
    ordered = F.array_sort(F.collect_list(F.struct(level, "lng", "rid", "trd")))
    return rows.groupBy("drv").agg(F.transform(ordered, lambda x: F.struct(x["lng"].alias("lng"), x["trd"].alias("trd"))).alias("translations"))


def cross_refs(results: DataFrame, tables: Tables) -> DataFrame:
    """`drv`, `cross_refs`: targets with the headword of their first node, or none."""
    refs = kept(subtree_of(_keys(results), tables, "referenco").select("drv", "cel", "tip", "rid"))
    heads = tables.near("first", "mrk", refs, "cel", settled=True).select(F.col("mrk").alias("head_mrk"), F.col("kap").alias("target_kap"))
    rows = refs.join(heads, F.col("cel") == F.col("head_mrk"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("rid", "cel", "tip", "target_kap")))
    named = F.transform(ordered, lambda x: F.struct(x["cel"].alias("target"), x["tip"].alias("type"), x["target_kap"].alias("target_kap")))
    return rows.groupBy("drv").agg(named.alias("cross_refs"))


def usage_domains(results: DataFrame, tables: Tables) -> DataFrame:
    """`drv`, `usage_domains`: distinct ones, in the order in which they come first."""
    rows = subtree_of(_keys(results), tables, "uzo").groupBy("drv", "uzo").agg(F.min("rid").alias("rid"))
    return rows.groupBy("drv").agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "uzo"))), lambda x: x["uzo"]).alias("usage_domains"))


def senses(results: DataFrame, tables: Tables) -> DataFrame:
    """`article`, `drv`, `senses` from the parsed articles."""
    keys = results.select("article", F.col("mrk").alias("drv")).distinct()
    parsed = tables.near("senses", "art", keys, "article", settled=True).select(F.col("art").alias("article"), F.col("key").alias("drv"), "senses")
    return parsed.join(keys, ["article", "drv"], "left_semi")


def assemble(results: DataFrame, tables: Tables) -> DataFrame:
    """Complete results (`qid`, `pos`, `headword`, `article`, `mrk`, `matched_via`); missing parts are empty lists."""
    results = kept(results)
    own = results.withColumn("drv", F.col("mrk"))
    for part in (translations, cross_refs, usage_domains):
        own = own.join(part(results, tables), "drv", "left")
    if tables.senses is not None:
        own = own.join(senses(results, tables), ["article", "drv"], "left")
    else:
        own = own.withColumn("senses", F.lit(None).cast(EMPTY["senses"]))
    return own.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in EMPTY.items()}).drop("drv")
