"""Tables merged in place: hash buckets, a manifest per version, vacuum.

A row lies in the bucket of its key's hash. A merge reads and writes only the buckets that its
changes touch; the manifest of the new version names, for each bucket, the version whose files hold
it. The manifest is written last and never over another one: a reader sees whole versions, a merge
that failed changes nothing, and of two writers of one version the second gets an error.

Keys are hashed, so the buckets are of like sizes; ``buckets`` bounds what one task writes and is
fixed when the table is made. The manifest has one row per bucket, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.corpus import Corpus
from evidex.schemas import TABLES
from evidex.session import SMALL, delete_path, passing_tables, shuffles_dropped

_MANIFEST = "version long, bucket int, place long"
_META = "keys array<string>, buckets int"
BUCKETS = 64
#: Parts in which a merge writes the buckets that it touches.
ROUNDS = 16
#: Key columns of the corpus tables; all of them where a table is a set of links.
KEYS = {
    "people": ("person_id",),
    "companies": ("company_id",),
    "skills": ("skill_id",),
    "skill_aliases": ("alias",),
    "technologies": ("technology_id",),
    "projects": ("project_id",),
    "universities": ("university_id",),
    "domains": ("domain_id",),
    "raw_documents": ("document_id",),
    "document_chunks": ("document_id",),
    "candidate_inferences": ("person_id", "inference_type", "claim", "peer_id"),
    "ingest_runs": ("run_id",),
}


@dataclass(frozen=True)
class Merge:
    """Version that a merge published, and the buckets it wrote."""

    version: int
    written: tuple[int, ...]


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


class BucketTable:
    """One table below ``path``; ``keys`` and ``buckets`` of an existing table must be the same."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = tuple(keys), buckets
        if buckets < 1 or not keys:
            raise ValueError("a table needs keys and at least one bucket")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def places(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """(version, bucket -> version whose files hold it) of the given or latest version; 0 if none."""
        try:
            rows = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{self.path}/manifest")
            latest = rows.agg(F.max("version")).first()[0] if version is None else version
        except Exception as error:  # noqa: BLE001 - a missing path means no version yet
            if not _missing(error):
                raise
            return 0, {}
        found = {r.bucket: r.place for r in rows.filter(F.col("version") == latest).collect()}
        if not found:
            raise ValueError(f"{self.path} has no version {latest}")
        return latest, {b: p for b, p in found.items() if b >= 0}

    def _check_layout(self) -> None:
        try:
            made = self.spark.read.schema(_META).json(f"{self.path}/layout").first()
        except Exception as error:  # noqa: BLE001
            if not _missing(error):
                raise
            self.spark.createDataFrame([(list(self.keys), self.buckets)], _META).coalesce(1).write.json(f"{self.path}/layout")
            return
        if (tuple(made.keys), made.buckets) != (self.keys, self.buckets):
            raise ValueError(f"{self.path} has keys {made.keys} in {made.buckets} buckets")

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a version, of the given buckets only if any are given."""
        _, places = self.places(version)
        chosen = [f"{self.path}/data/v={p}/bucket={b}" for b, p in sorted(places.items()) if buckets is None or b in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None) -> Merge:
        """Replace the rows of every key in ``changes``, and drop those of the keys in ``deleted``.

        A key may have several rows (the chunks of a document): all its rows are replaced. Rows with
        a null key are rows of the null key.
        """
        self._check_layout()
        names = self.spark.createDataFrame([], self.schema).columns
        latest, places = self.places()
        version = latest + 1
        with passing_tables(self.spark) as cut:
            fresh = cut(changes.select(*names).withColumn("bucket", self.bucket()))
            gone = fresh.select(*self.keys, "bucket")
            if deleted is not None:
                gone = gone.unionByName(deleted.select(*self.keys).withColumn("bucket", self.bucket()))
            gone = cut(gone.distinct())
            touched = sorted(r.bucket for r in gone.select("bucket").distinct().collect())
            # The rows of a few buckets are moved at a time, and their shuffle files go before the next.
            step = -(-len(touched) // ROUNDS) or 1
            for at in range(0, len(touched), step):
                self._rewrite(fresh, gone, touched[at : at + step], latest, places, "append" if at else "overwrite")
        left = {r.bucket for r in self._stored(version, touched)}
        now = {b: p for b, p in places.items() if b not in touched} | dict.fromkeys(left, version)
        mark = [(version, b, p) for b, p in sorted(now.items())] or [(version, -1, version)]
        self.spark.createDataFrame(mark, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/v={version}")
        return Merge(version, tuple(touched))

    def _rewrite(self, fresh: DataFrame, gone: DataFrame, buckets: Sequence[int], latest: int, places: Mapping[int, int], mode: str) -> None:
        """The given buckets as files of the version after ``latest``."""
        rows, gone = (df.filter(F.col("bucket").isin(*buckets)) for df in (fresh, gone))
        if set(buckets) & set(places):
            old = self.read(latest, buckets).withColumn("bucket", self.bucket())
            same = [old[k].eqNullSafe(gone[k]) for k in (*self.keys, "bucket")]
            condition = same[0]
            for c in same[1:]:
                condition = condition & c
            rows = old.join(gone, condition, "left_anti").unionByName(rows)
        dealt = rows.repartition(len(buckets), "bucket")
        with shuffles_dropped(self.spark):
            dealt.write.mode(mode).options(**SMALL).partitionBy("bucket").parquet(f"{self.path}/data/v={latest + 1}")

    def _stored(self, version: int, touched: Sequence[int]) -> list:
        """Buckets that a version's files hold: a touched bucket is empty if all its rows were deleted."""
        if not touched:
            return []
        try:
            files = self.spark.read.schema("bucket int").parquet(f"{self.path}/data/v={version}")
            return files.select("bucket").distinct().collect()
        except Exception as error:  # noqa: BLE001
            if not _missing(error):
                raise
            return []

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` versions uses, and older manifests; their number."""
        latest, _ = self.places()
        if not latest:
            return 0
        kept = range(max(1, latest - max(1, keep) + 1), latest + 1)
        used = {(p, b) for v in kept for b, p in self.places(v)[1].items()}
        removed = 0
        for folder in _children(self.spark, f"{self.path}/data"):
            version = int(folder.rsplit("v=", 1)[1])
            own = [c for c in _children(self.spark, folder) if "bucket=" in c]
            unused = [c for c in own if (version, int(c.rsplit("bucket=", 1)[1])) not in used]
            for child in [folder] if len(unused) == len(own) else unused:
                delete_path(self.spark, child)
            removed += len(unused)
        for folder in _children(self.spark, f"{self.path}/manifest"):
            if int(folder.rsplit("v=", 1)[1]) < kept[0]:
                delete_path(self.spark, folder)
        return removed


def _children(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return sorted(s.getPath().toString() for s in files.listStatus(place) if "=" in s.getPath().getName())


class CorpusStore:
    """The corpus tables as bucketed tables below one root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        links = {n: tuple(c.split()[0] for c in ddl.split(", ")) for n, ddl in TABLES.items() if n not in KEYS}
        self.tables = {
            name: BucketTable(spark, f"{root.rstrip('/')}/{name}", ddl, KEYS.get(name) or links[name], buckets)
            for name, ddl in TABLES.items()
        }

    def read(self) -> Corpus:
        return Corpus(**{name: table.read() for name, table in self.tables.items()})

    def merge(self, changes: Mapping[str, DataFrame]) -> dict[str, Merge]:
        """New rows by table; the rows of their keys are replaced, other buckets stay where they lie."""
        return {name: self.tables[name].merge(rows) for name, rows in changes.items()}

    def vacuum(self, keep: int = 1) -> int:
        return sum(table.vacuum(keep) for table in self.tables.values())
