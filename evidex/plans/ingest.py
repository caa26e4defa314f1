"""Ingestion end to end."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.corpus import Corpus
from evidex.operators.chunk import (
    check_companies,
    chunk_records,
    document_states,
    embedding_report,
    upsert_chunks,
)
from evidex.operators.embed import EmbeddingProvider, embed_chunks
from evidex.operators.parse import Provider, extract_records, parse_records
from evidex.operators.resolve import (
    EntityNames,
    classify,
    ingestion_report,
    merge_entities,
    merge_people,
    merge_raw_documents,
    resolve_people,
)
from evidex.session import cut_lineage


@dataclass(frozen=True)
class IngestResult:
    corpus: Corpus
    report: DataFrame
    quarantine: DataFrame
    embeddings: DataFrame | None = None


def persist_records(
    corpus: Corpus,
    records: DataFrame,
    outcomes: DataFrame,
    aliases: Mapping[str, str] | None = None,
    unicode: bool = True,
) -> tuple[Corpus, DataFrame]:
    """Apply the created and updated documents of a batch: (corpus, changed records)."""
    labels = outcomes.filter(F.col("outcome").isin("created", "updated"))
    changes = records.join(labels.select("seq", "document_id", "checksum"), "seq")
    people = resolve_people(changes, corpus, unicode)
    assigned = cut_lineage(changes.join(people, "document_id"))
    merged = merge_entities(corpus, assigned, EntityNames(aliases, unicode))
    return (
        merged.with_tables(
            people=merge_people(corpus.people, assigned, unicode),
            raw_documents=merge_raw_documents(corpus.raw_documents, assigned),
        ),
        assigned,
    )


def refresh_chunks(
    corpus: Corpus,
    provider: EmbeddingProvider,
    mapping: Mapping[str, str] | None = None,
    max_characters: int = 2_000,
    batch_size: int = 128,
    unicode: bool = True,
) -> tuple[Corpus, DataFrame]:
    """Chunk and embed the structured documents whose chunks are stale."""
    documents = corpus.raw_documents.filter(
        F.col("person_id").isNotNull() & F.col("document_type").isin("csv", "json")
    ).withColumns({"payload": F.col("raw_text"), "file": F.lit(None).cast("string")})
    records, _ = parse_records(documents, mapping)
    fresh = check_companies(
        chunk_records(records, max_characters, unicode), corpus.person_companies
    )
    states = document_states(fresh, corpus.document_chunks, provider.model, provider.dimension)
    stale = states.filter("state <> 'unchanged'").select("document_id")
    wanted = fresh.join(stale, "document_id", "left_semi")
    embedded = cut_lineage(embed_chunks(wanted, provider, batch_size))
    failed = embedded.filter("not valid").select("document_id").distinct()
    good = embedded.join(failed, "document_id", "left_anti")
    chunks = upsert_chunks(corpus.document_chunks, good)
    return corpus.with_tables(document_chunks=chunks), embedding_report(states, failed)


def ingest_structured(
    corpus: Corpus,
    documents: DataFrame,
    provider: EmbeddingProvider | None = None,
    mapping: Mapping[str, str] | None = None,
    aliases: Mapping[str, str] | None = None,
    rejected: DataFrame | None = None,
    unicode: bool = True,
    max_characters: int = 2_000,
) -> IngestResult:
    """CSV/JSON documents into the corpus; ``provider=None`` leaves chunks alone."""
    records, failed = parse_records(documents, mapping, write_once=True)
    outcomes = cut_lineage(classify(records, corpus.raw_documents))
    merged, _ = persist_records(corpus, records, outcomes, aliases, unicode)
    quarantine = failed if rejected is None else failed.unionByName(rejected)
    report = ingestion_report(outcomes, quarantine)
    if provider is None:
        return IngestResult(merged, report, quarantine)
    chunked, embeddings = refresh_chunks(
        merged, provider, mapping, max_characters, unicode=unicode
    )
    return IngestResult(chunked, report, quarantine, embeddings)


def ingest_text(
    corpus: Corpus,
    documents: DataFrame,
    extractor: Provider,
    provider: EmbeddingProvider | None = None,
    aliases: Mapping[str, str] | None = None,
    unicode: bool = True,
    max_characters: int = 2_000,
) -> IngestResult:
    """Free-text documents through extraction, persistence and inline chunking.

    A document whose chunks cannot be embedded is not persisted.
    """
    extracted, failed = extract_records(documents, extractor)
    outcomes = cut_lineage(classify(extracted, corpus.raw_documents))
    if provider is None:
        merged, _ = persist_records(corpus, extracted, outcomes, aliases, unicode)
        return IngestResult(merged, ingestion_report(outcomes, failed), failed)

    live = outcomes.filter("outcome <> 'duplicate'").select("seq", "document_id")
    last = live.groupBy("document_id").agg(F.max("seq").alias("seq"))
    drafts = extracted.join(last, "seq").withColumn("person_id", F.lit(""))
    fresh = chunk_records(drafts, max_characters, unicode)
    states = document_states(fresh, corpus.document_chunks, provider.model, provider.dimension)
    stale = states.filter("state <> 'unchanged'").select("document_id")
    embedded = cut_lineage(
        embed_chunks(fresh.join(stale, "document_id", "left_semi"), provider)
    )
    broken = embedded.filter("not valid").select("document_id").distinct()
    kept = outcomes.join(broken, "document_id", "left_anti")
    lost = extracted.join(outcomes.select("seq", "document_id"), "seq").join(
        broken, "document_id", "left_semi"
    )
    quarantine = failed.unionByName(
        lost.select(
            "source", "external_id", "file",
            F.lit("EmbeddingValidationError").alias("error_type"),
            F.lit("Document could not be embedded").alias("message"),
        )
    )
    merged, _ = persist_records(corpus, extracted, kept, aliases, unicode)
    people = merged.raw_documents.select("document_id", F.col("person_id").alias("owner"))
    owned = embedded.join(broken, "document_id", "left_anti").join(people, "document_id")
    owned = owned.withColumn("person_id", F.col("owner")).withColumn(
        "metadata",
        F.map_concat(
            F.map_filter("metadata", lambda k, _: k != "person_id"),
            F.create_map(F.lit("person_id"), F.col("owner")),
        ),
    )
    checked = check_companies(owned, merged.person_companies)
    chunks = upsert_chunks(corpus.document_chunks, checked)
    return IngestResult(
        merged.with_tables(document_chunks=chunks),
        ingestion_report(kept, quarantine),
        quarantine,
        embedding_report(states, broken),
    )
