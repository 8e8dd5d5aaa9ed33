"""Push messages as landed files: streams of what a subscriber or a broker writes into a folder, wired to the decoders.

A process outside Spark (``sockets.land``, or a broker's file sink) holds the socket and lands every message: multipart frames as JSON lines
{topic, parts: [base64, ...]}, web-socket envelopes as text lines. Spark follows the folder, so a lost executor reads its
files again and no message is lost with a connection.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.sources import decoders, mappers

_FRAMES = "topic string, parts array<string>, received_at timestamp"


class Source(Protocol):
    """What the engine asks of a source: its name, the kind of its records, and a stream or table of them."""

    name: str
    kind: str

    def read(self, spark: SparkSession) -> DataFrame: ...

    def healthy(self, spark: SparkSession) -> bool: ...


class LandedFrames:
    """Messages of one topic (rawtx, rawblock or sequence), decoded; with ``stream`` as they land, else what has landed."""

    def __init__(self, path: str, topic: str, stream: bool = True) -> None:
        self.path, self.topic, self.stream = path, topic, stream
        self.name, self.kind = f"frames:{topic}", {"rawtx": "transaction", "rawblock": "block", "sequence": "sequence"}[topic]

    def frames(self, spark: SparkSession) -> DataFrame:
        """body and seq of the topic's valid frames."""
        rows = (spark.readStream if self.stream else spark.read).schema(_FRAMES).json(self.path)
        return decoders.frames(rows.filter(F.col("topic") == self.topic).select(F.transform("parts", F.unbase64).alias("parts")), self.topic)

    def read(self, spark: SparkSession) -> DataFrame:
        frames = self.frames(spark)
        return {"rawtx": decoders.transactions, "rawblock": decoders.blocks, "sequence": decoders.sequence_events}[self.topic](frames)

    def healthy(self, spark: SparkSession) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class LandedEnvelopes(LandedFrames):
    """Web-socket envelopes, one a line; read gives kind, pos and json of each observation in them."""

    def __init__(self, path: str, stream: bool = True) -> None:
        self.path, self.stream, self.name, self.kind = path, stream, "envelopes", "mixed"

    def read(self, spark: SparkSession) -> DataFrame:
        return mappers.websocket_messages((spark.readStream if self.stream else spark.read).text(self.path))
