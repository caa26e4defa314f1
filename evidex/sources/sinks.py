"""Versioned table sinks and the run audit.

Parquet has no MERGE: a new state is written to a new version directory and the version is
published last, so a reader never sees a half-written state and a failed run changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.corpus import Corpus, empty_corpus
from evidex.schemas import TABLES

_MARK = "version long, tables map<string,long>"


def _published(spark: SparkSession, root: str) -> dict[int, dict[str, int]]:
    """Published versions: where each of their tables lies."""
    try:
        rows = spark.read.schema(_MARK).json(f"{root}/_published").collect()
    except Exception as error:  # noqa: BLE001 - a missing path means no version yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    return {r.version: dict(r.tables or {}) for r in rows}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions under a root, oldest first."""
    return sorted(_published(spark, root))


def _publish(spark: SparkSession, root: str, version: int, tables: Mapping[str, int]) -> None:
    pairs = [F.lit(x) for name, at in tables.items() for x in (name, at)]
    mark = spark.range(1).select(
        F.lit(version).cast("long").alias("version"),
        F.create_map(*pairs).cast("map<string,long>").alias("tables"),
    )
    mark.coalesce(1).write.mode("append").json(f"{root}/_published")


def write_corpus(
    corpus: Corpus, spark: SparkSession, root: str, previous: Corpus | None = None
) -> int:
    """The tables as the next version.

    ``previous`` is the corpus the new one grew out of, as read from the same root: a table
    taken over from it unchanged is not written again but referred to where it lies.
    """
    known = _published(spark, root)
    latest = max(known, default=0)
    places = dict(known.get(latest, {}))
    old = previous.tables() if previous is not None else {}
    for name, df in corpus.tables().items():
        if name in places and old.get(name) is df:
            continue
        df.write.mode("overwrite").parquet(f"{root}/v={latest + 1}/{name}")
        places[name] = latest + 1
    _publish(spark, root, latest + 1, places)
    return latest + 1


def read_corpus(spark: SparkSession, root: str, version: int | None = None) -> Corpus:
    """The given or latest version; an empty corpus when nothing is published."""
    known = _published(spark, root)
    places = known[max(known) if version is None else version] if known else {}
    if not set(TABLES) <= set(places):  # nothing published yet, or only a graph
        return empty_corpus(spark)
    return Corpus(
        **{
            name: spark.read.schema(ddl).parquet(f"{root}/v={places[name]}/{name}")
            for name, ddl in TABLES.items()
        }
    )


def write_graph(nodes: DataFrame, edges: DataFrame, spark: SparkSession, root: str) -> int:
    """Nodes and edges as the next version, edges partitioned by relation.

    The other tables of the latest version stay part of the new one, so a root may hold a
    corpus and its graph.
    """
    known = _published(spark, root)
    latest = max(known, default=0)
    version = latest + 1
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{root}/v={version}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{root}/v={version}/edges")
    _publish(spark, root, version, known.get(latest, {}) | {"nodes": version, "edges": version})
    return version


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the latest version that has them."""
    known = _published(spark, root)
    places = known[max(v for v, tables in known.items() if "nodes" in tables)]
    return tuple(spark.read.parquet(f"{root}/v={places[name]}/{name}") for name in ("nodes", "edges"))


def run_record(
    report: DataFrame,
    run_id: str,
    status: str,
    created_at: datetime,
    options: Mapping[str, str] | None = None,
    error: str | None = None,
) -> DataFrame:
    """One audit row of a run (A13). ``created_at`` is a run parameter, equal on retries."""
    if status not in ("queued", "running", "succeeded", "failed"):
        raise ValueError(f"Unknown run status: {status}")
    pairs = [x for c in report.columns for x in (F.lit(c), F.col(c).cast("long"))]
    chosen = [F.lit(x) for pair in (options or {}).items() for x in pair]
    return report.select(
        F.lit(run_id).alias("run_id"),
        F.lit(status).alias("status"),
        (F.create_map(*chosen) if chosen else F.create_map()).cast("map<string,string>").alias("options"),
        F.create_map(*pairs).alias("report"),
        F.lit(error).cast("string").alias("error"),
        F.lit(created_at).alias("created_at"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last state of each run."""
    return runs.groupBy("run_id").agg(
        F.max_by(F.struct(*[c for c in runs.columns if c != "run_id"]), "created_at").alias("r")
    ).select("run_id", "r.*")
