"""Export of text files as they land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.export import export_batch
from ..plans.spec import ExportSpec
from ..sources.profile import FILE_GLOB, escape_glob


_FILES = "path string, modificationTime timestamp, length long, content binary"


def export_arrivals(
    spark: SparkSession,
    folder: str,
    spec: ExportSpec,
    out: str,
    checkpoint: str,
    clean_source: str = "off",
    archive: str | None = None,
    files_per_batch: int = 1000,
    continuous: bool = False,
) -> StreamingQuery:
    """Export every new file of ``folder`` once, each micro-batch as one export job.

    Only file names travel through the stream; the files are read by the export itself. A batch has
    its own folder ``out/batch-<n>`` and run id, so a repeated batch replaces its outputs, and its
    manifest goes to ``out/manifest/batch-<n>``. ``clean_source`` deletes or archives files after
    their batch. Without ``continuous`` the query ends when the files at hand are done.
    """
    options = {
        "pathGlobFilter": FILE_GLOB,
        "recursiveFileLookup": "true",
        "maxFilesPerTrigger": str(files_per_batch),
        "cleanSource": clean_source,
    }
    if archive:
        options["sourceArchiveDir"] = archive
    arrivals = spark.readStream.format("binaryFile").schema(_FILES).options(**options).load(folder).select("path")

    def handle(batch: DataFrame, number: int) -> None:
        # As many names as the batch may have files.
        paths = [escape_glob(row.path) for row in batch.collect()]
        if paths:
            name = f"batch-{number}"
            done = export_batch(batch.sparkSession, paths, spec, f"{out}/{name}", name, mode="overwrite")
            done.write.mode("overwrite").parquet(f"{out}/manifest/{name}")

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
