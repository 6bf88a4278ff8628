"""The corpus pipeline: documents pass five stages, each written as Parquet and read again.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and extra columns of
any name; what becomes of them is said at each. All but the last return the columns of their input.
"""

from pyspark.sql import DataFrame, SparkSession

from lexis.llm import decontamination, mixing, quality, sharding, simhash
from lexis.shared import discard, materialise
from lexis.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go.

    Null and empty texts are scored like others, rows with a null id too, repeated rows each alike; without labels all stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that with the smallest id; null ids come last.

    Rows are judged by their own texts, whatever ids they share; null, empty and blank texts make up one component.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Matched spans are cut out; documents go whose spans exceed a fifth of the words. Items of fewer than five words are
    cut too, but condemn no document. Null and empty texts have no spans and stay; repeated rows are cut each."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"), coverage=0.2, least=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it, in the order of training positions.

    A null source is one of its own. Texts without words, null ones among them, are taken 0 times and go.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that the mix takes; each repeated row gets a slot of its own."""
    return sharding.minimax_shards(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL expresses neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)  # its successor is committed
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
