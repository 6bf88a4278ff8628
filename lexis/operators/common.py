"""Pieces that several searches share."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drv_key
from ..sources.lexicon import Tables


_KEPT: list[DataFrame] = []
#: Characters of a plan's text, unless the session sets spark.sql.maxPlanStringLength itself. The plan of a kept step stands
#: in the text of each plan that reads it, which Spark writes anew with each adaptive change.
PLAN_TEXT = 50_000


def kept(df: DataFrame) -> DataFrame:
    """A step of a search on which several others build, kept in Spark's cache: it has some rows for each query of a batch.

    What an executor takes with it is computed again. `release` gives all of them up.
    """
    conf = df.sparkSession.conf
    if "spark.sql.maxPlanStringLength" not in conf.getAll:
        conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    _KEPT.append(df.persist())
    return df


def release() -> None:
    """Give up the steps of all searches so far; their results, read again, would be computed anew."""
    while _KEPT:
        _KEPT.pop().unpersist()


def ranked(df: DataFrame, *order: Column | str, by: tuple[str, ...] = ("qid",), name: str = "ord") -> DataFrame:
    """Number the rows of each query from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, k: int | Column | None, *order: Column | str, by: tuple[str, ...] = ("qid",), name: str = "ord") -> DataFrame:
    """The first k rows of each query (all, if k is None), numbered."""
    numbered = ranked(df, *order, by=by, name=name)
    return numbered if k is None else numbered.where(F.col(name) <= k)


def first_tier(hits: DataFrame) -> DataFrame:
    """Per query the rows of the first tier that has any."""
    least = F.min("tier").over(Window.partitionBy("qid"))
    return hits.withColumn("least_tier", least).where("tier = least_tier").drop("least_tier")


def group_by_drv(hits: DataFrame, limit: int | Column) -> DataFrame:
    """One result per query and derivation: its first node in hit order; the first `limit` results, numbered `pos`."""
    own = hits.withColumn("drv", drv_key(F.col("mrk")))
    first = top(own, 1, "ord", by=("qid", "drv"), name="within").drop("within")
    return top(first, limit, "ord", name="pos").select("qid", "pos", F.col("kap").alias("headword"), F.col("art").alias("article"), F.col("drv").alias("mrk"), "matched_via")


def subtree_of(keys: DataFrame, tables: Tables, name: str) -> DataFrame:
    """`subtree` of a table of the lexicon: the keys of derivations read their buckets of its copy by drv_mrk."""
    return subtree(keys, getattr(tables, name), lambda own, key: tables.near(name, key, own, "drv", settled=True))


def subtree(keys: DataFrame, rows: DataFrame, near: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows whose key equals or lies below `drv` of the left side.

    A dotted drv is a derivation's key, and its subtree the rows with that drv_mrk; a dotless one stands for a whole
    article, and its subtree has that root_mrk. So each kind meets a stored key by equality, where the range of strings
    would be a nested loop.
    """
    dotted = F.instr("drv", ".") > 0
    own, whole = keys.where(dotted), keys.where(~dotted)
    near = near or (lambda of, key: rows)
    return own.join(near(own, "drv_mrk"), F.col("drv") == F.col("drv_mrk")).unionByName(whole.join(near(whole, "root_mrk"), F.col("drv") == F.col("root_mrk")))


def nodes_of(trds: DataFrame, tables: Tables, limit: int) -> DataFrame:
    """First nodes of the first `limit * 3` distinct keys of translation rows (`qid`, `mrk`, `ord`); keys without node drop."""
    firsts = trds.groupBy("qid", "mrk").agg(F.min("ord").alias("ord"))
    keys = kept(top(firsts, limit * 3, "ord", name="nth").select("qid", "mrk", "ord"))
    return keys.join(tables.near("first", "mrk", keys, "mrk", settled=True), "mrk")
