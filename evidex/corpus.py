"""The set of tables a search runs against."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from evidex.schemas import TABLES


@dataclass(frozen=True)
class Corpus:
    """One DataFrame per entity, bridge and document table (see ``schemas.TABLES``)."""

    people: DataFrame
    companies: DataFrame
    skills: DataFrame
    skill_aliases: DataFrame
    technologies: DataFrame
    projects: DataFrame
    universities: DataFrame
    domains: DataFrame
    person_companies: DataFrame
    person_skills: DataFrame
    person_technologies: DataFrame
    person_projects: DataFrame
    person_universities: DataFrame
    person_domains: DataFrame
    company_domains: DataFrame
    project_technologies: DataFrame
    project_domains: DataFrame
    raw_documents: DataFrame
    document_chunks: DataFrame
    candidate_inferences: DataFrame
    ingest_runs: DataFrame

    def with_tables(self, **tables: DataFrame) -> Corpus:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def empty_corpus(spark: SparkSession) -> Corpus:
    return Corpus(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})
