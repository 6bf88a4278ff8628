"""A permuterm index of headwords: every rotation of each, so that any wildcard pattern becomes a prefix.

END marks where a headword ends. `*rod` is a prefix of rotations as `rod` END, `r*d` as `d` END `r`, `*e*` as `e`. What
begins so is then held against the whole pattern, so the index only has to lose nothing.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, like, like_pattern
from ..sources.lexicon import Tables
from .common import kept
from .fulltext import HEAD, headed

#: End of a headword; characters of a rotation that are kept.
END, KEPT = "\x01", 24


def rotations(nodo: DataFrame, var: DataFrame) -> DataFrame:
    """`head`, `rotation`, `kap_norm`, `of_variant`: of every distinct headword and of every distinct variant."""
    words = nodo.select("kap_norm", F.lit(False).alias("of_variant")).unionByName(var.select("kap_norm", F.lit(True).alias("of_variant"))).where("kap_norm is not null").distinct()
    ended = words.withColumn("ended", F.concat(ascii_fold(F.col("kap_norm")), F.lit(END)))
    turns = F.expr(f"transform(sequence(1, length(ended)), i -> left(concat(substring(ended, i), left(ended, i - 1)), {KEPT}))")
    turned = ended.select("kap_norm", "of_variant", F.explode(F.array_distinct(turns)).alias("rotation"))
    return turned.select(F.left("rotation", F.lit(HEAD)).alias("head"), "rotation", "kap_norm", "of_variant")


def keys(patterns: DataFrame) -> DataFrame:
    """Add `key` to patterns (`qid`, `like`): what a rotation of any match begins with.

    That is what stands after the last wildcard, END, and what stands before the first one, or the longest piece between
    two wildcards, if that is no shorter.
    """
    folded = ascii_fold(F.col("like"))
    pieces = F.split(folded, "[%_]")
    inner = F.when(F.size(pieces) > 2, F.expr("array_max(transform(slice(pieces, 2, size(pieces) - 2), x -> named_struct('n', length(x), 'x', x))).x")).otherwise("")
    around = F.when(F.size("pieces") == 1, F.concat(F.lit(END), F.get("pieces", F.lit(0)))).otherwise(F.concat(F.element_at("pieces", -1), F.lit(END), F.get("pieces", F.lit(0))))
    with_both = patterns.withColumn("pieces", pieces).withColumn("inner", inner).withColumn("around", around)
    return with_both.withColumn("key", F.left(F.when((F.length("inner") > 0) & (F.length("inner") >= F.length("around")), F.col("inner")).otherwise(F.col("around")), F.lit(KEPT))).drop("pieces", "inner", "around")


def matching(patterns: DataFrame, tables: Tables, of_variant: bool = False) -> DataFrame:
    """`qid`, `kap_norm`: the distinct headwords (or variants) that patterns (`qid`, `like`) match; % and _ are wildcards."""
    keyed = kept(headed(keys(patterns), tables, "rotations", "key"))
    met = keyed.join(tables.near("rotations", "head", keyed, "head", settled=True).where(F.col("of_variant") == of_variant), "head")
    whole = met.where(F.startswith("rotation", "key") & like(F.col("kap_norm"), F.col("like")))
    return whole.select("qid", "kap_norm").distinct()


def nodes(patterns: DataFrame, tables: Tables) -> DataFrame:
    """`qid` and the nodes whose headword the patterns match."""
    found = kept(matching(patterns, tables))
    return found.join(tables.near("nodo", "kap_norm", found, "kap_norm", settled=True), "kap_norm")


def globs(patterns: DataFrame) -> DataFrame:
    """`qid`, `pattern`, `like` of patterns with *."""
    return patterns.select("qid", "pattern", like_pattern(F.col("pattern")).alias("like"))
