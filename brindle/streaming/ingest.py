"""Streaming ingest of document files.

The file source remembers what it has read in its checkpoint.  Batches go into a
stored index, or as chunks into folders of their own number, which a batch that
is run again after a failure writes over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..plans.index import Index
from ..sources import embedding as emb, files


def _files(spark: SparkSession, folder: str, config: EngineConfig) -> DataFrame:
    glob = "*.{" + ",".join(f.lstrip(".") for f in config.supported_formats) + "}"
    return spark.readStream.format("binaryFile").schema(files.BINARY_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(files.literal_path(folder))


def index_stream(index: Index, checkpoint: str, name: str = "files", once: bool = True) -> StreamingQuery:
    """Follow the index' documents folder: each batch is a run, and can be searched when it ends.

    The version that a run publishes holds the batch's number, so a batch that
    comes again after a failure changes nothing.  ``name`` tells streams into
    one index apart; a new checkpoint needs a new name.
    """
    spark, config = index.spark, index.config

    def write(batch: DataFrame, number: int) -> None:
        index.add(files.parse(batch, config.documents, config), stream=name, number=number)

    writer = _files(spark, config.documents, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, config: EngineConfig = EngineConfig(), embedder: emb.Embedder | None = None, once: bool = True) -> StreamingQuery:
    """Follow a folder; ``once`` ends when all that is there has been read.  Chunks go to ``out/batch=<n>``."""
    source = _files(spark, folder, config)
    model = embedder or emb.HashingEmbedder(config.embedding_dim)

    def write(batch: DataFrame, number: int) -> None:
        chunks = emb.embed(files.chunk_rows(files.parse(batch, folder, config), config), "content", model)
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
