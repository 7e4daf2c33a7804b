"""A feed of events as a streaming sink: what a micro-batch adds counts once it is committed.

Tasks write their rows to part files of their own; the driver then names a batch's parts in
one small file, put in place by a rename.  A batch that is replayed writes new parts and
replaces that file, so readers see every batch once; parts that no batch names are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tagloom.operators.events import EVENT_SCHEMA

FEED = "tagloom_feed"


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class FeedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _target(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, path = self._target()
        name = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if name is None:
                files.create_dir(f"{path}/parts", recursive=True)
                name = f"part-{uuid.uuid4().hex}.jsonl"
                out = files.open_output_stream(f"{path}/parts/{name}")
            lines = (json.dumps(row, ensure_ascii=False) for row in batch.to_pylist())
            out.write("".join(f"{line}\n" for line in lines).encode())
        if name is not None:
            out.close()
        return Part(name)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        files, path = self._target()
        for folder in ("batches", "parts"):
            files.create_dir(f"{path}/{folder}", recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        aside = f"{path}/_{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write((json.dumps({"batch": batchId, "parts": names}) + "\n").encode())
        files.move(aside, f"{path}/batches/{batchId:012d}.json")

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        """Nothing to undo: no batch names these parts."""


class FeedSource(DataSource):
    """``df.writeStream.format("tagloom_feed").option("path", …)`` for rows of events."""

    @classmethod
    def name(cls) -> str:
        return FEED

    def schema(self) -> str:
        return EVENT_SCHEMA

    def streamWriter(self, schema: StructType, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options["path"])


def register_feed(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, job_id, seq, event, data)`` of the batches that were committed."""
    batches = spark.read.schema("batch bigint, parts array<string>").json(f"{path}/batches")
    named = batches.select("batch", F.explode("parts").alias("_part"))
    parts = spark.read.schema(EVENT_SCHEMA).json(f"{path}/parts").withColumn("_part", F.col("_metadata.file_name"))
    return parts.join(named, "_part").select("batch", *[c.split()[0] for c in EVENT_SCHEMA.split(", ")])
