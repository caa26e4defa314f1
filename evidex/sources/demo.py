"""Generated resume-shaped records (A10): a small demo, or a skewed load of any size.

Everything but the title and the city is drawn by hashing the record's number, so records are
the same in any partitioning, and popular values are as uneven as in real data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each title meets each city within the first 25 records.
TITLES = (
    "Senior Python Backend Engineer", "Platform Engineer", "Data Engineer", "ML Engineer",
    "Security Engineer",
)
CITIES = ("Москва", "Санкт-Петербург", "Казань", "Екатеринбург", "Новосибирск")
COUNTRY = "Россия"

SYLLABLES = ("ba", "do", "ki", "lo", "mar", "ne", "pol", "ri", "sa", "tul", "vo", "zen")
SKILLS = ("Go", "Rust", "Haskell", "COBOL", "Perl", "R", "Julia", "Lua", "Ada", "Fortran", "Prolog", "Scala")
TOOLS = ("Nginx", "Redis", "Ansible", "Jenkins", "Grafana", "Vault", "Helm", "Flink", "Presto", "Ceph")
FIELDS = ("shipping", "insurance", "farming", "mapping", "energy", "games", "libraries")
DEEDS = ("rewrote", "measured", "replaced", "tested", "moved", "taught", "audited")
THINGS = ("the billing run", "a fleet of sensors", "old reports", "the mail gateway", "a parts catalogue")


def _draw(what: str, n: int | Column) -> Column:
    """Uniform number below ``n``, fixed by the record's number and the purpose."""
    return F.pmod(F.xxhash64("id", F.lit(what)), F.lit(n) if isinstance(n, int) else n).cast("int")


def _pick(values: Sequence[str], what: str) -> Column:
    """One of the values; the first is the most frequent (smaller of two draws)."""
    place = F.least(_draw(what, len(values)), _draw(f"{what} again", len(values)))
    return F.element_at(F.array(*map(F.lit, values)), place + 1)


def _some(values: Sequence[str], what: str, most: int) -> Column:
    picked = F.array_distinct(F.array(*[_pick(values, f"{what} {i}") for i in range(most)]))
    return F.slice(picked, 1, _draw(f"{what} many", most) + 1)


def _word(what: str, syllables: int) -> Column:
    return F.initcap(F.concat(*[_pick(SYLLABLES, f"{what} {i}") for i in range(syllables)]))


def _job(number: int) -> Column:
    job = f"job {number}"
    begin = F.lit(2024 - 4 * number) - _draw(job, 3)
    return F.struct(
        F.concat(_word(job, 2), F.lit(" "), F.element_at(F.array(F.lit("Works"), F.lit("Lab")), _draw(f"{job} kind", 2) + 1)).alias("company"),
        F.when(F.lit(number == 0), F.col("current_title")).otherwise("Assistant").alias("title"),
        F.concat(begin.cast("string"), F.lit("-"), F.lpad((_draw(f"{job} month", 12) + 1).cast("string"), 2, "0")).alias("start_date"),
        (F.lit(None) if number == 0 else F.concat((begin + 3).cast("string"), F.lit("-12"))).cast("string").alias("end_date"),
        F.concat(F.lit("There "), _pick(DEEDS, f"{job} deed"), F.lit(" "), _pick(THINGS, f"{job} thing"), F.lit(".")).alias("description"),
        F.array(_pick(FIELDS, job)).alias("domains"),
        _some(TOOLS, f"{job} tools", 3).alias("technologies"),
    )


def demo_records(spark: SparkSession, n: int = 50) -> DataFrame:
    """``n`` records: columns of a structured candidate, all ids and names distinct."""
    i = F.col("id")

    def at(values: Sequence[str], place: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))

    titled = spark.range(n).withColumn("current_title", at(TITLES, i))
    return titled.select(
        F.concat(F.lit("demo-"), F.lpad(i.cast("string"), 12, "0")).alias("id"),
        F.concat_ws(" ", _word("given", 2), _word("family", 3), i.cast("string")).alias("full_name"),
        at(CITIES, F.floor(i / len(TITLES)).cast("long")).alias("location"),
        F.lit(COUNTRY).alias("country"),
        (F.lit(20) + _draw("age", 45)).alias("age"),
        "current_title",
        (_draw("years", 31) / 2).alias("years_experience"),
        F.concat(
            F.lit("Record "), i.cast("string"), F.lit(": "), _pick(DEEDS, "deed"), F.lit(" "),
            _pick(THINGS, "thing"), F.lit(" in "), _pick(FIELDS, "field"), F.lit("."),
        ).alias("summary"),
        _some(SKILLS, "skill", 5).alias("skills"),
        _some(TOOLS, "tool", 4).alias("technologies"),
        F.array(_pick(FIELDS, "field")).alias("domains"),
        F.slice(F.array(_job(0), _job(1), _job(2)), 1, _draw("jobs", 2) + 2).alias("experience"),
        F.array(
            F.struct(
                F.concat(F.lit("Project "), _word("project", 2)).alias("name"),
                F.concat(F.lit("It "), _pick(DEEDS, "project"), F.lit(" "), _pick(THINGS, "project"), F.lit(".")).alias("description"),
                _some(TOOLS, "project", 2).alias("technologies"),
                F.array(_pick(FIELDS, "project")).alias("domains"),
            )
        ).alias("projects"),
    )


def demo_documents(spark: SparkSession, n: int = 50, source: str = "demo") -> DataFrame:
    """The generated records as documents ready for ingestion."""
    record = F.to_json(F.struct("*"))
    rows = demo_records(spark, n).withColumn("record", F.to_json(F.parse_json(record)))
    return rows.select(
        F.lit(source).alias("source"),
        F.col("id").alias("external_id"),
        F.lit("json").alias("document_type"),
        F.col("record").alias("raw_text"),
        F.col("record").alias("payload"),
        F.create_map(F.lit("filename"), F.lit("demo")).alias("metadata"),
        F.lit("demo").alias("file"),
        F.monotonically_increasing_id().alias("seq"),
    )
