"""Search by headword: exact, variant, stem, prefix."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stems
from ..functions.text import normalize_query
from ..sources.lexicon import Tables
from . import permuterm
from .common import first_tier, group_by_drv, kept, ranked, top
from .fulltext import prefix_hits

NODE = ("mrk", "art", "kap", "num")


def distinct_nodes(hits: DataFrame, *also: str) -> DataFrame:
    """Distinct nodes per query; `rid` is that of the first of equal ones."""
    return hits.groupBy("qid", *also, *NODE).agg(F.min("rid").alias("rid"))


def by_length(hits: DataFrame) -> DataFrame:
    return ranked(hits, F.length("mrk"), "rid")


def exact(words: DataFrame, tables: Tables) -> DataFrame:
    """Nodes whose headword is the word. `words` has `qid` and `word`, normalised."""
    return by_length(distinct_nodes(words.join(tables.near("nodo", "kap_norm", words, "word"), F.col("word") == F.col("kap_norm"))))


def variant(words: DataFrame, tables: Tables) -> DataFrame:
    """Nodes of which the word is a spelling variant; a variant without node yields nothing."""
    keys = kept(words.join(tables.near("var", "kap_norm", words, "word").select("mrk", "kap_norm"), F.col("word") == F.col("kap_norm")).select("qid", "mrk").distinct())
    return by_length(distinct_nodes(keys.join(tables.near("nodo", "mrk", keys, "mrk", settled=True), "mrk")))


def stem(words: DataFrame, tables: Tables) -> DataFrame:
    """Nodes of the first stem, other than the word itself, that is a headword."""
    tried = words.select("qid", "word", F.posexplode(stems(F.col("word"))).alias("rank", "stem")).where("stem <> word")
    hits = tried.join(tables.near("nodo", "kap_norm", tried, "stem"), F.col("stem") == F.col("kap_norm"))
    found = distinct_nodes(hits, "rank", "stem").withColumnRenamed("rank", "tier")
    return by_length(first_tier(found))


def prefix(words: DataFrame, tables: Tables, limit: int) -> DataFrame:
    """The `limit * 5` shortest headwords that begin with the word, in which % and _ are wildcards: by the rotations."""
    met = permuterm.nodes(words.withColumn("like", F.concat("word", F.lit("%"))).select("qid", "like"), tables)
    return top(distinct_nodes(met), limit * 5, F.length("kap"), "kap", "rid")


def token_prefix(words: DataFrame, tables: Tables, limit: int) -> DataFrame:
    """Nodes whose headword (or a variant) has tokens, of which one begins with the word's last one: by the index of headwords."""
    met = prefix_hits(words.select("qid", F.col("word").alias("text")), tables, "kap").select("qid", F.col("rid").alias("found"))
    nodes = met.join(tables.near("nodo", "kap_norm", met, "found", settled=True), F.col("found") == F.col("kap_norm"))
    kaps = top(nodes.groupBy("qid", "found").agg(F.min("rid").alias("first_rid")), limit, "first_rid", name="nth").select("qid", "nth", "found")
    return ranked(distinct_nodes(nodes.join(kaps, ["qid", "found"]), "nth"), "nth", F.length("mrk"), "rid").drop("nth")


def normalised(queries: DataFrame) -> DataFrame:
    return queries.select("qid", normalize_query(F.col("q")).alias("word")).where("word <> ''")


def headword_hits(queries: DataFrame, tables: Tables, limit: int = 5, fts_fallback: bool = False) -> DataFrame:
    """`qid`, node, `ord`, `tier`, `matched_via`: the rows of the first tier that finds nodes.

    The word and its stems meet the headwords in one join; the stems, in their order, come after the variants. The
    prefix tier, which compares many headwords, runs only on words that these did not find.
    """
    words = normalised(queries)
    forms = words.select("qid", "word", F.posexplode(stems(F.col("word"))).alias("rank", "form"))
    step = F.when(F.col("form") == F.col("word"), 1000).otherwise(3000 + F.col("rank"))
    via = F.when(F.col("form") != F.col("word"), F.concat(F.lit("stem:"), "form"))
    direct = distinct_nodes(forms.join(tables.near("nodo", "kap_norm", forms, "form"), F.col("form") == F.col("kap_norm")).select("qid", step.alias("tier"), via.alias("matched_via"), *NODE, "rid"), "tier", "matched_via")
    none = F.lit(None).cast("string")
    of_variants = variant(words, tables).drop("ord").select("qid", F.lit(2000).alias("tier"), none.alias("matched_via"), *NODE, "rid")
    keyed = kept(by_length(first_tier(direct.unionByName(of_variants))))
    left = kept(words.join(keyed.select("qid").distinct(), "qid", "left_anti"))
    found = keyed.unionByName(prefix(left, tables, limit).join(words, "qid").select(*NODE, "qid", "rid", "ord", F.lit(4000).alias("tier"), F.concat(F.lit("prefix:"), "word").alias("matched_via")))
    if fts_fallback:
        found = found.unionByName(token_prefix(left, tables, limit).join(words, "qid").select(*NODE, "qid", "rid", "ord", F.lit(5000).alias("tier"), F.concat(F.lit("fts:"), "word").alias("matched_via")))
        found = first_tier(found)
    return found.select("qid", F.floor(F.col("tier") / 1000).cast("int").alias("tier"), *NODE, "rid", "ord", "matched_via")


def lookup_headwords(queries: DataFrame, tables: Tables, limit: int = 5, fts_fallback: bool = False) -> DataFrame:
    """Results (`qid`, `pos`, `headword`, `article`, `mrk`, `matched_via`) of queries (`qid`, `q`)."""
    return group_by_drv(headword_hits(queries, tables, limit, fts_fallback), limit)
