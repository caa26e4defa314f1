"""Stateful ingestion of deliveries.

A delivery is what has arrived in the landing folder since the last run, in any supported format.
Its files are parsed once into a log of documents. A second stream takes their keys through
streaming state: under a document's id its accepted checksum, under a checksum the document that
owns it. The state answers what is stored of the keys of a batch, whose outcomes follow from these
answers alone; the corpus is not read. What the outcomes change goes back into the state as facts,
a second source of the same stream, before the next delivery. Accepted documents are merged into a
bucketed table, of which only the touched buckets are written.

Keys share state values by slots of their hash, so calls into the state grow with the slots and not
with the documents. Rows pass through one at a time, so a checksum that a large share of the rows has needs no
memory; the first owner within a delivery comes from an aggregate that combines before its shuffle.
Replayed batches overwrite their own folders and set equal facts again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidex.functions.text import checksum, row_id
from evidex.operators.resolve import classify, ingestion_report
from evidex.schemas import DOCUMENT, TABLES
from evidex.session import SMALL, cut_lineage, delete_path, passing_tables
from evidex.sources.buckets import BUCKETS, BucketTable
from evidex.sources.files import QUARANTINE, SUPPORTED_SUFFIXES, merge_documents, read_csv, read_json, read_jsonl, read_text

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FACT = "kind string, key string, value string, version long"
#: A payload that is the raw text again, as CSV rows have it, is not kept twice.
_LOG = DOCUMENT + ", delivery long, document_id string, checksum string, payload_is_text boolean"
_ANSWER = "kind string, key string, value string, version long, asked boolean, document_id string, checksum string, delivery long"


#: Parts of the key space, each one value of the state; fixed for a checkpoint. A call into the state takes
#: about a millisecond, so many keys share one; a part holds the facts of all its keys.
SLOTS = 1 << 15


class Facts(StatefulProcessor):
    """Per key of a slot the newest fact; a question is answered with the fact as of the batch's start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "facts string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        stored = self.slot.get()
        held = {(kind, name): (value, version) for kind, name, value, version in json.loads(stored[0])} if stored else {}
        newest: dict[tuple[str, str], tuple[str, int]] = {}
        for r in rows:
            own = (r.kind, r.key)
            value, version = held.get(own, (None, -1))
            if r.asked:
                yield Row(kind=r.kind, key=r.key, value=value, version=version, asked=True, document_id=r.document_id, checksum=r.checksum, delivery=r.delivery)
            elif r.version > newest.get(own, (value, version))[1]:
                newest[own] = (r.value, r.version)
        if newest:
            self.slot.update((json.dumps([[*own, *fact] for own, fact in (held | newest).items()]),))
        for (kind, name), (value, version) in newest.items():
            yield Row(kind=kind, key=name, value=value, version=version, asked=False, document_id=None, checksum=None, delivery=None)

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Delivery:
    """Folders of one ingestion below ``root``."""

    root: str

    @property
    def log(self) -> str:
        return f"{self.root}/log"

    @property
    def facts(self) -> str:
        return f"{self.root}/facts"

    @property
    def outcomes(self) -> str:
        return f"{self.root}/outcomes"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"


def read_files(spark: SparkSession, paths: Sequence[str], source_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and quarantine of the given files, each read by its suffix; others are quarantined."""
    by_suffix: dict[str, list[str]] = {}
    for path in sorted(paths):
        suffix = f".{path.rsplit('.', 1)[-1].lower()}"
        by_suffix.setdefault(suffix if suffix in SUPPORTED_SUFFIXES else "", []).append(path)
    unknown = [(None, None, p.rsplit("/", 1)[-1], "ValueError", f"Unsupported ingestion format: {p}") for p in by_suffix.pop("", [])]
    documents, rejected = [spark.createDataFrame([], DOCUMENT)], [spark.createDataFrame(unknown, QUARANTINE)]
    readers: dict[str, Callable] = {".json": read_json, ".jsonl": read_jsonl, ".txt": read_text, ".md": read_text}
    for suffix, own in sorted(by_suffix.items()):
        if suffix == ".csv":
            documents.append(read_csv(spark, own, source_name))
        else:
            good, bad = readers[suffix](spark, own, source_name)
            documents.append(good)
            rejected.append(bad)
    return merge_documents(documents), reduce(DataFrame.unionByName, rejected)


def _log_delivery(
    spark: SparkSession, landing: str, to: Delivery, checkpoint: str, source_name: str | None, max_files: int, clear: bool
) -> None:
    """New files of the landing folder into the log; a batch lists at most ``max_files`` paths."""
    logged: list[str] = []
    listing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .load(landing)
        .select("path")
    )

    def parse(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        documents, rejected = read_files(batch.sparkSession, paths, source_name)
        keyed = documents.withColumns(
            {
                "delivery": F.lit(batch_id).cast("long"),
                "document_id": row_id("document", F.col("source"), F.col("external_id")),
                "checksum": checksum(F.col("raw_text")),
                "payload_is_text": F.coalesce(F.col("payload") == F.col("raw_text"), F.lit(False)),
            }
        ).withColumn("payload", F.when(~F.col("payload_is_text"), F.col("payload")))
        rejected.write.mode("overwrite").parquet(f"{to.quarantine}/batch={batch_id}")
        keyed.write.mode("overwrite").options(**SMALL).parquet(f"{to.log}/batch={batch_id}")
        logged.extend(paths)

    query = listing.writeStream.foreachBatch(parse).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    for path in logged if clear else ():
        delete_path(spark, path)


def _read_log(spark: SparkSession, to: Delivery, deliveries: Sequence[int]) -> DataFrame:
    """The documents of some deliveries as they were parsed."""
    rows = spark.read.schema(_LOG).parquet(*[f"{to.log}/batch={d}" for d in deliveries])
    payload = F.when(F.col("payload_is_text"), F.col("raw_text")).otherwise(F.col("payload"))
    return rows.withColumn("payload", payload).drop("payload_is_text")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _answers(spark: SparkSession, to: Delivery) -> DataFrame:
    """The stream of answers: each document's keys asked, and the facts that were set."""
    none = F.lit(None).cast("string")
    log = spark.readStream.schema(_LOG).parquet(f"{to.log}/*")
    keys = F.array(
        F.struct(F.lit("document").alias("kind"), F.col("document_id").alias("key")),
        F.struct(F.lit("checksum").alias("kind"), F.col("checksum").alias("key")),
    )
    # A question carries its key alone: the stream's shuffle files stay longer than those of a query.
    asked = log.select(F.explode(keys).alias("k"), "delivery").select(
        "k.kind", "k.key", none.alias("value"), F.lit(None).cast("long").alias("version"),
        F.lit(True).alias("asked"), none.alias("document_id"), none.alias("checksum"), "delivery",
    )
    known = spark.readStream.schema(_FACT).parquet(f"{to.facts}/*").select(
        "kind", "key", "value", "version", F.lit(False).alias("asked"),
        none.alias("document_id"), none.alias("checksum"), F.lit(None).cast("long").alias("delivery"),
    )
    slotted = asked.unionByName(known).withColumn("slot", F.pmod(F.xxhash64("kind", "key"), F.lit(SLOTS)))
    return slotted.groupBy("slot").transformWithState(Facts(), _ANSWER, "append", "None")


def stored_facts(answers: DataFrame) -> DataFrame:
    """document_id, checksum, person_id of the stored documents that the keys of a batch concern."""
    newest = answers.groupBy("kind", "key").agg(F.max_by("value", "version").alias("value")).filter("value is not null")
    return newest.select(
        F.when(F.col("kind") == "document", F.col("key")).otherwise(F.col("value")).alias("document_id"),
        F.when(F.col("kind") == "document", F.col("value")).otherwise(F.col("key")).alias("checksum"),
        F.lit("").alias("person_id"),
    ).distinct()


def apply_outcomes(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``stored`` after the outcomes: each accepted document holds its last accepted checksum."""
    accepted = outcomes.filter(F.col("outcome").isin("created", "updated", "unchanged"))
    last = accepted.groupBy("document_id").agg(F.max_by("checksum", "seq").alias("checksum"))
    kept = stored.join(last, "document_id", "left_anti").select("document_id", "checksum", "person_id")
    return kept.unionByName(last.select("document_id", "checksum", F.lit("").alias("person_id")))


def new_facts(before: DataFrame, after: DataFrame, version: int) -> DataFrame:
    """What changes between two states: accepted checksums, owners, and checksums given up."""
    old = before.select("document_id", F.col("checksum").alias("old"))
    new = after.select("document_id", F.col("checksum").alias("new"))
    changed = new.join(old, "document_id", "left").filter("old is null or old <> new")
    taken = after.select("checksum")
    given_up = changed.filter("old is not null").select(F.col("old").alias("checksum")).join(taken, "checksum", "left_anti")
    facts = (
        changed.select(F.lit("document").alias("kind"), F.col("document_id").alias("key"), F.col("new").alias("value"))
        .unionByName(changed.select(F.lit("checksum").alias("kind"), F.col("new").alias("key"), F.col("document_id").alias("value")))
        .unionByName(given_up.select(F.lit("checksum").alias("kind"), F.col("checksum").alias("key"), F.lit(None).cast("string").alias("value")))
    )
    return facts.withColumn("version", F.lit(version).cast("long"))


def ingest_delivery(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    source_name: str | None = None,
    max_files: int = 1000,
    buckets: int = BUCKETS,
    on_changes: Callable[[DataFrame, int], None] | None = None,
    clear: bool = False,
) -> None:
    """Ingest what arrived in ``landing`` since the last run, then stop.

    Below ``root``: ``outcomes`` (delivery, document_id, seq, checksum, outcome), ``quarantine``,
    ``log`` (every document as parsed) and the bucketed table ``raw_documents``. ``on_changes`` gets
    the created and updated documents of a batch, with their outcome, for the steps that follow.
    With ``clear`` landed files are deleted when the log holds them.
    """
    to = Delivery(root.rstrip("/"))
    spark.createDataFrame([], _LOG).write.mode("ignore").parquet(f"{to.log}/batch=-1")
    spark.createDataFrame([], _FACT).write.mode("ignore").parquet(f"{to.facts}/batch=-1")
    _log_delivery(spark, landing, to, checkpoint, source_name, max_files, clear)
    table = documents_table(spark, root, buckets)

    def settle(batch: DataFrame, batch_id: int) -> None:
        with passing_tables(batch.sparkSession) as cut:
            settle_with(cut, batch, batch_id)

    def settle_with(cut: Callable[[DataFrame], DataFrame], batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        answers = cut(batch)  # the state is asked once
        deliveries = sorted(r.delivery for r in answers.filter("asked").select("delivery").distinct().collect())
        if not deliveries:
            return
        before = stored = cut(stored_facts(answers))
        parts = []
        for delivery in deliveries:
            outcomes = classify(_read_log(session, to, [delivery]), stored).withColumn("delivery", F.lit(delivery).cast("long"))
            parts.append(cut(outcomes))
            stored = cut(apply_outcomes(stored, parts[-1]))
        outcomes = reduce(DataFrame.unionByName, parts)
        accepted = outcomes.filter(F.col("outcome").isin("created", "updated"))
        last = cut(
            accepted.groupBy("document_id")
            .agg(F.max_by(F.struct("delivery", "seq", "outcome"), F.struct("delivery", "seq")).alias("a"))
            .select("document_id", "a.*")
        )
        changed = _read_log(session, to, deliveries).join(last, ["document_id", "delivery", "seq"])
        rows = changed.withColumn("person_id", F.lit(None).cast("string"))
        # Without a callback the merge alone reads them, and writes what it reads.
        rows = rows if on_changes is None else cut_lineage(rows)
        table.merge(rows)
        if on_changes is not None:
            on_changes(rows, batch_id)
        outcomes.write.mode("overwrite").options(**SMALL).parquet(f"{to.outcomes}/batch={batch_id}")
        facts = cut(new_facts(before, stored, batch_id))
        if facts.head(1):
            facts.write.mode("overwrite").options(**SMALL).parquet(f"{to.facts}/batch={batch_id}")

    with _rocksdb(spark):
        query = _answers(spark, to).writeStream.foreachBatch(settle).option("checkpointLocation", f"{checkpoint}/state").start()
        try:
            query.processAllAvailable()  # the facts of the last batch are a batch of their own
        finally:
            query.stop()


def documents_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(spark, f"{root.rstrip('/')}/raw_documents", TABLES["raw_documents"], ["document_id"], buckets)


def delivery_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """All outcomes so far: delivery, document_id, seq, checksum, outcome."""
    schema = "document_id string, seq long, checksum string, outcome string, delivery long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root.rstrip('/')}/outcomes")


def delivery_report(spark: SparkSession, root: str) -> DataFrame:
    """Counters over all deliveries (C14)."""
    failed = spark.read.schema(QUARANTINE).option("recursiveFileLookup", True).parquet(f"{root.rstrip('/')}/quarantine")
    return ingestion_report(delivery_outcomes(spark, root), failed)
