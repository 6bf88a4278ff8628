"""Lookup requests as a stream, joined with the lexicon batch by batch.

The lexicon itself has no streaming operators; this is an addition. Searches need no state: each micro-batch runs the
batch engine, and a replayed batch overwrites its own output.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.api import Lexicon


def serve(requests: DataFrame, lexicon: Lexicon, folder: str, checkpoint: str, limit: int = 5, answer: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Answer a stream of (`qid`, `q`) into one Parquet folder per micro-batch."""
    answer = answer or (lambda queries: lexicon.lookup(queries, limit))

    def batch(queries: DataFrame, epoch: int) -> None:
        answer(queries).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
