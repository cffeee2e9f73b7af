"""Append-only runs that resume: every id is written once, whatever was interrupted."""

from __future__ import annotations

import asyncio
import time
import zlib
from collections.abc import Awaitable, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Asks an endpoint for the answer to a prompt; None is a failure.
AsyncClient = Callable[[str, str], Awaitable[str | None]]

CAPTIONED = "id string, caption string, retry_attempts int, error string"


def with_retries(call: Callable[[str], str], prompt: str, most: int = 3, pause: float = 0.5) -> tuple[str | None, int, str | None]:
    """(answer, retries, error) with a pause of ``pause`` * (n + 1) seconds between attempts."""
    error = None
    for n in range(most + 1):
        try:
            return call(prompt), n, None
        except Exception as e:  # noqa: BLE001  the client's failures are results here
            error = str(e)
            if n < most:
                time.sleep(pause * (n + 1))
    return None, most, error


def caption_rows(prompts: DataFrame, call: Callable[[str], str], concurrency: int, most: int = 3, pause: float = 0.5) -> DataFrame:
    """Answers to ``prompts`` (id, prompt), ``concurrency`` partitions at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *with_retries(call, p, most, pause)) for i, p in zip(part["id"], part["prompt"])]
            yield pd.DataFrame(rows, columns=["id", "caption", "retry_attempts", "error"])

    return prompts.select("id", "prompt").repartition(concurrency).mapInPandas(run, CAPTIONED)


async def _asked(ask: AsyncClient, endpoints: Sequence[str], key: str, prompt: str, attempts: int, pause: float, timeout: float) -> tuple[str | None, int, str | None]:
    """(answer, attempts before it, error): every attempt goes to the next endpoint, from one that the key chooses, after a longer pause."""
    first, error = zlib.crc32(key.encode()), None
    for n in range(attempts):
        try:
            answer = await asyncio.wait_for(ask(endpoints[(first + n) % len(endpoints)], prompt), timeout)
            if answer is not None:
                return answer, n, None
            error = "no answer"
        except Exception as e:  # noqa: BLE001  the client's failures are results here
            error = str(e) or type(e).__name__
        if n < attempts - 1:
            await asyncio.sleep(pause * (n + 1))
    return None, attempts - 1, error


def ask_concurrently(prompts: DataFrame, ask: AsyncClient, endpoints: Sequence[str], at_once: int, tasks: int = 1, attempts: int = 3, pause: float = 0.5, timeout: float = 60.0) -> DataFrame:
    """CAPTIONED rows of ``prompts`` (id, prompt) from an asynchronous client.

    A task holds at most ``at_once`` calls open, also while some of them wait to try again, so the endpoints see ``at_once``
    times the tasks that run together (``tasks`` at most).  Answers leave in the order of the prompts, an Arrow batch at a time.
    Prompts that no attempt answers have a null caption and the last error; null prompts are not asked.
    """

    async def batch(keys: list[str], texts: list[str | None]) -> list[tuple[str | None, int, str | None]]:
        gate = asyncio.Semaphore(at_once)

        async def one(key: str, text: str | None) -> tuple[str | None, int, str | None]:
            if text is None:
                return None, 0, "no prompt"
            async with gate:
                return await _asked(ask, endpoints, key, text, attempts, pause, timeout)

        return await asyncio.gather(*(one(k, t) for k, t in zip(keys, texts)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys = part["id"].tolist()
            rows = [(k, *r) for k, r in zip(keys, asyncio.run(batch([str(k) for k in keys], part["prompt"].tolist())))]
            yield pd.DataFrame(rows, columns=["id", "caption", "retry_attempts", "error"], dtype=object)

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").repartition(tasks).mapInPandas(run, CAPTIONED)


def resume_captions(prompts: DataFrame, path: str, call: Callable[[str], str], concurrency: int = 8) -> int:
    """Caption what ``path`` does not hold yet; the number of new captions."""
    spark = prompts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = lambda: spark.read.schema(CAPTIONED).json(path).filter("caption is not null").select("id")
    before = 0
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        before = held().count()
        prompts = prompts.join(held(), "id", "left_anti")
    caption_rows(prompts, call, concurrency).filter("caption is not null").write.mode("append").json(path)
    return held().count() - before


def stream_records(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files_each: int = 100) -> StreamingQuery:
    """Copy new JSON records from a folder to Parquet exactly once, in batches of files; late repeats of an id within a day are dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(source)
    rows = rows.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id"])
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a CSV log with a header in each file."""
    rows.coalesce(1).write.mode("append").csv(path, header=True)
