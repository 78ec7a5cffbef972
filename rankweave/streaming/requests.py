"""Web search over a stream of requests (B10, R1-R4 per micro-batch).

Requests arrive as a stream and meet static tables: registry, source rows, pages
and outcomes. A request's answer depends on no other request, so every
micro-batch runs the batch search and adds its rows and sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.search import web_search
from . import counters, epochs

ROWS = ("query_id long, engine string, sec_pos long, rank long, doc_id long, title string, url string, snippet string, "
        "content string")
SECTIONS = "query_id long, engine string, sec_pos long, status string, message string, n_rows long"


def request_stream(spark: SparkSession, folder: str, file_glob: str, schema: str, max_files: int = 1) -> DataFrame:
    """Streaming rows of the parquet files in ``folder``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", max_files).parquet(folder))


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def run_searches(requests: DataFrame, registry: DataFrame, source_rows: DataFrame, pages: DataFrame, table: str,
                 checkpoint: str, trigger_once: bool = True, processing_time: str = "5 seconds", **options) -> StreamingQuery:
    """Answer (query_id, query, engines) requests; ``options`` go to
    :func:`web_search`. A batch run again replaces its own rows."""
    def add(batch: DataFrame, epoch: int) -> None:
        # the batch is read by several jobs of one search
        asked = batch.select("query_id", "query", "engines").persist()
        found = web_search(asked, registry, source_rows, pages, **options)
        epochs.write_epoch(found.rows.select(*_columns(ROWS)), f"{table}/rows", epoch)
        epochs.write_epoch(found.sections.select(*_columns(SECTIONS)), f"{table}/sections", epoch)
        asked.unpersist()

    writer = requests.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)
    return counters.start(writer, trigger_once, processing_time)


def answered_rows(spark: SparkSession, table: str) -> DataFrame:
    return epochs.read_epochs(spark, f"{table}/rows", ROWS).drop("epoch")


def answered_sections(spark: SparkSession, table: str) -> DataFrame:
    return epochs.read_epochs(spark, f"{table}/sections", SECTIONS).drop("epoch")
