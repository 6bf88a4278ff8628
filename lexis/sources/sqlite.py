"""A SQLite file as a Spark data source, read in ranges of rowid."""

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import materialise
from .lexicon import SCHEMAS, Tables


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class SQLiteReader(DataSourceReader):
    """Each partition opens the file read-only and reads its rowids in order; the file must be visible to executors."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.parts, self.columns = options["path"], options["dbtable"], int(options.get("numpartitions", 8)), columns

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self.connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join("rowid" if c == "rid" else f'"{c}"' for c in self.columns)
        with self.connect() as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', partition.value):
                yield tuple(v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in row)


class SQLiteSource(DataSource):
    """format("lexis_sqlite"), options path, dbtable, numPartitions; a schema is required, `rid` stands for rowid."""

    @classmethod
    def name(cls) -> str:
        return "lexis_sqlite"

    def schema(self) -> str:
        return SCHEMAS[self.options["dbtable"]]

    def reader(self, schema) -> SQLiteReader:
        return SQLiteReader(self.options, schema.fieldNames())


def read_lexicon(spark: SparkSession, path: str, parts: int = 8) -> Tables:
    """All tables of a lexicon file, with keys; `ekzemplo` is built from the articles if the file has none."""
    from ..operators.html import examples_in, extracted, failures_in, senses_in

    spark.dataSource.register(SQLiteSource)

    def read(name: str):
        return spark.read.format("lexis_sqlite").option("path", path).option("dbtable", name).option("numPartitions", parts).load()

    articles = read("artikolo")
    found = materialise(extracted(articles), "articles")
    frames = {n: read(n) for n in ("nodo", "var", "traduko", "referenco", "uzo")}
    return Tables.of(**frames, artikolo=articles, ekzemplo=examples_in(found), senses=senses_in(found), failures=failures_in(found))
