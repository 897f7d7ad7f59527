"""Streaming use of the cache: each micro-batch of requests answers what the cache lacks and appends it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.generate import Generator, generate, misses
from ..sources.files import append_cache, read_cache


def start(requests: DataFrame, by_role: dict[str, Generator], cache_folder: str, checkpoint: str) -> StreamingQuery:
    """Starts on a stream of (role, query, key); stops once what is there is done."""

    def batch(df: DataFrame, _: int) -> None:
        todo = misses(df, read_cache(df.sparkSession, cache_folder)).persist()
        for g in by_role.values():
            append_cache(generate(todo, g), cache_folder)
        todo.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
