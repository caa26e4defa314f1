"""Profile export as labelled sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _general(number: Column) -> Column:
    """Six significant digits without trailing zeros, for values below one hundred."""
    rounded = F.when(number < 10, F.round(number, 5)).otherwise(F.round(number, 4))
    return F.regexp_replace(rounded.cast("string"), r"\.0$", "")


def profile_sections(profiles: DataFrame) -> DataFrame:
    """One row per non-blank section: person_id, section_no, label, value."""

    def section(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"))

    def listed(name: str) -> Column:
        return F.array_join(name, ", ")

    places = F.filter(F.array("location", "country"), lambda p: p.isNotNull() & (p != ""))
    rows = F.array(
        section(
            "Profile",
            F.coalesce(F.nullif("summary", F.lit("")), F.lit("No summary provided.")),
        ),
        section("Location", F.array_join(places, ", ")),
        section(
            "Experience",
            F.when(
                F.coalesce("years_experience", F.lit(0)) != 0,
                F.concat(_general(F.col("years_experience").cast("double")), F.lit(" years")),
            ),
        ),
        section("Age", F.concat(F.col("age").cast("string"), F.lit(" years"))),
        section("Skills", listed("skills")),
        section("Technologies", listed("technologies")),
        section("Domains", listed("domains")),
        section("Companies", listed("companies")),
        section("Projects", listed("projects")),
    )
    return (
        profiles.select("person_id", F.posexplode(rows).alias("section_no", "s"))
        .select("person_id", "section_no", "s.label", "s.value")
        .filter("coalesce(value, '') <> ''")
    )


def write_profiles(sections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of the sections."""
    sections.write.mode(mode).json(path)
