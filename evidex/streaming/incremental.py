"""Incremental ingestion of a landing directory (K1)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidex.operators.embed import EmbeddingProvider
from evidex.plans.ingest import ingest_structured
from evidex.sources.files import jsonl_documents
from evidex.sources.sinks import read_corpus, run_record, write_corpus


def ingest_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    provider: EmbeddingProvider | None = None,
    source_name: str | None = None,
    max_files: int = 1000,
    unicode: bool = True,
) -> StreamingQuery:
    """Ingest the JSONL files that arrived since the last run, then stop.

    Each micro-batch reads the latest published corpus and publishes the next one. A batch
    replayed after a failure finds its documents unchanged, so delivery is idempotent. Lines and
    records that could not be taken stay readable under ``root``/_quarantine, by batch.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .load(landing)
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        numbered = batch.withColumn("seq", F.monotonically_increasing_id())
        documents, rejected = jsonl_documents(numbered, source_name)
        before = read_corpus(session, root)
        result = ingest_structured(
            before, documents, provider, rejected=rejected, unicode=unicode
        )
        result.quarantine.write.mode("overwrite").parquet(f"{root}/_quarantine/batch={batch_id}")
        row = run_record(
            result.report, f"batch-{batch_id}", "succeeded", datetime.now(timezone.utc)
        )
        runs = before.ingest_runs.filter(F.col("run_id") != f"batch-{batch_id}").unionByName(row)
        write_corpus(result.corpus.with_tables(ingest_runs=runs), session, root, before)

    return (
        lines.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
