"""Named queries over the given tables, one per operator group.

The tables play the roles of the corpus: a customer is a person, a bought brand a skill, a
bought type a technology, a supplier a company, an order priority a project, a market segment
a domain and a nation a country. Documents are raw documents and evidence, embeddings are
chunk vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidex.corpus import empty_corpus
from evidex.functions import text as T
from evidex.functions.vectors import is_valid_vector
from evidex.operators import chunk as C
from evidex.operators import graph as G
from evidex.operators import infer as N
from evidex.operators import rank as R
from evidex.operators import structured as S
from evidex.operators.ann import build_index, recall_of
from evidex.operators.claims import accept_answers, check_claims, unique_evidence
from evidex.operators.embed import HashEmbedder, embed_chunks
from evidex.operators.export import profile_sections
from evidex.operators.parse import guard_text, parse_records, split_errors, string_list
from evidex.operators.resolve import (
    EntityNames,
    append_links,
    classify,
    collect_mentions,
    get_or_create,
    ingestion_report,
    merge_people,
    resolve_people,
)
from evidex.operators.team import (
    REQUEST,
    aggregate_score,
    check_requests,
    evidence_terms,
    role_queries,
    select_team,
    team_roles,
)
from evidex.operators.understand import (
    best_match,
    detect_vocabulary,
    enrich_intents,
    fuzzy_pairs,
    plain_intents,
)
from evidex.operators.vector import cosine_topk, cosine_topk_within, lsh_topk
from evidex.plans.ingest import IngestResult, ingest_structured
from evidex.session import cut_lineage, spread, work_folder
from evidex.sources.buckets import BucketTable
from evidex.sources.files import jsonl_documents, text_documents
from evidex.streaming.stateful import delivery_outcomes as told_outcomes
from evidex.streaming.stateful import documents_table, ingest_delivery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_LIST = "array<string>"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- the tables in their roles ---------------------------------------------------------


def people(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    return table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").cast("string").alias("person_id"),
        F.col("c_name").alias("full_name"),
        F.concat("country", F.lit(" "), "c_mktsegment").alias("location"),
        "country",
        F.col("c_mktsegment").alias("current_title"),
        (F.col("c_acctbal") / 1000).alias("years_experience"),
        (F.lit(20) + F.floor(F.abs("c_acctbal") / 200)).cast("int").alias("age"),
        F.concat(F.lit("Works in "), "c_mktsegment").alias("summary"),
    )


def bought(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").cast("string").alias("person_id"),
        "o_orderpriority",
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(
        orders, "l_orderkey"
    )


def part_links(spark: SparkSession, sf: str) -> DataFrame:
    """person_id with brand and type of everything bought, distinct."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"
    )
    return (
        bought(spark, sf).select("person_id", "l_partkey")
        .join(part, "l_partkey").select("person_id", "p_brand", "p_type").distinct()
    )


def supplier_links(spark: SparkSession, sf: str) -> DataFrame:
    return bought(spark, sf).select(
        "person_id", F.col("l_suppkey").cast("string").alias("company_id")
    ).distinct()


def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    """kind, person_id, entity_id of everything a customer has to do with, as often as it occurs."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    both = F.array(
        F.struct(F.lit("skill").alias("kind"), F.col("p_brand").alias("entity_id")),
        F.struct(F.lit("technology").alias("kind"), F.col("p_type").alias("entity_id")),
    )
    bought_parts = bought(spark, sf).select("person_id", "l_partkey").join(part, "l_partkey")
    parts = bought_parts.select("person_id", F.explode(both).alias("e")).select("e.kind", "person_id", "e.entity_id")
    rows = {
        "company": bought(spark, sf).select("person_id", F.col("l_suppkey").cast("string").alias("entity_id")),
        "project": table(spark, sf, "orders").select(
            F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderpriority").alias("entity_id")
        ),
        "domain": table(spark, sf, "customer").select(
            F.col("c_custkey").cast("string").alias("person_id"), F.col("c_mktsegment").alias("entity_id")
        ),
    }
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(k).alias("kind"), "person_id", "entity_id") for k, df in rows.items()],
        parts,
    )


def entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")

    def named(kind: str, df: DataFrame, key: Column, name: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), key.cast("string").alias("entity_id"), name.alias("name")
        ).distinct()

    def same(kind: str, df: DataFrame, column: str) -> DataFrame:
        return named(kind, df, F.col(column), F.col(column))

    rows = [
        same("skill", part, "p_brand"),
        same("technology", part, "p_type"),
        named("company", supplier, F.col("s_suppkey"), F.col("s_name")),
        same("project", table(spark, sf, "orders"), "o_orderpriority"),
        same("domain", table(spark, sf, "customer"), "c_mktsegment"),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn(
        "term", T.normalize_name(F.col("name"), unicode=False)
    )


def nation_queries(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    """One query per nation; ``columns`` set intent fields from n_nationkey, n_name, n_regionkey."""
    nation = table(spark, sf, "nation")
    base = nation.select(
        F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("query_id"),
        F.col("n_name").alias("text"),
        *[value.alias(name) for name, value in columns.items()],
    )
    return plain_intents(base)


def _k(n: int, plus: int = 0) -> Column:
    return (F.col("n_nationkey") % n + plus).cast("string")


def _segment(spark_key: Column) -> Column:
    names = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return F.element_at(names, (spark_key % 5 + 1).cast("int"))


def _type(spark_key: Column) -> Column:
    names = F.array(*[F.lit(s) for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return F.element_at(names, (spark_key % 6 + 1).cast("int"))


def _skilled(spark: SparkSession, sf: str) -> DataFrame:
    """Queries asking for two brands, a type and a segment."""
    return nation_queries(
        spark, sf,
        required_skills=F.array(
            F.concat(F.lit("brand#"), _k(25, 1)),
            F.concat(F.lit(" Brand "), ((F.col("n_nationkey") + 7) % 25 + 1).cast("string")),
        ),
        required_technologies=F.array(F.lower(_type(F.col("n_nationkey")))),
        required_domains=F.array(_segment(F.col("n_nationkey"))),
        preferred_skills=F.array(F.concat(F.lit("Brand#"), _k(25, 1)), F.lit("Brand#99")),
        role=F.concat(F.lit("Senior "), _segment(F.col("n_nationkey"))),
        min_years_experience=F.when(F.col("n_nationkey") > 12, F.lit(2.5)),
        semantic_query=F.lit(""),
    )


def _prepared(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    full = S.complete_queries(queries)
    terms = cut_lineage(S.query_terms(full, unicode=False))
    return cut_lineage(full.join(S.query_needs(terms), "query_id", "left")), terms


def _structured(spark: SparkSession, sf: str, queries: DataFrame, limit: int | None = None):
    prepared, terms = _prepared(queries)
    hits = cut_lineage(S.term_hits(terms, entity_rows(spark, sf), member_rows(spark, sf)))
    pairs = S.structured_pairs(prepared, people(spark, sf), hits, limit, unicode=False)
    return prepared, hits, pairs


# --- E: structured search ---------------------------------------------------------------


@query
def structured_all_of(spark: SparkSession, sf: str) -> DataFrame:
    """All-of filters over skills or technologies and domains, with years."""
    return _structured(spark, sf, _skilled(spark, sf))[2]


@query
def structured_companies(spark: SparkSession, sf: str) -> DataFrame:
    """All-of filters over companies and projects, lowest ids kept."""
    queries = nation_queries(
        spark, sf,
        companies=F.array(
            F.concat(F.lit("supplier "), F.lpad(_k(25), 9, "0")),
            F.concat(F.lit("Supplier#"), F.lpad(_k(25, 3), 9, "0")),
        ),
        projects=F.array(F.lit("1-urgent"), F.lit("5-LOW")),
    )
    return _structured(spark, sf, queries, limit=100)[2]


@query
def structured_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """Country equality with age range and years."""
    queries = nation_queries(
        spark, sf,
        country=F.when(F.col("n_regionkey") < 3, F.lower("n_name")),
        min_years_experience=(F.col("n_nationkey") % 7).cast("double"),
        min_age=F.lit(25),
        max_age=(F.lit(40) + F.col("n_nationkey")).cast("int"),
    )
    return _structured(spark, sf, queries)[2]


@query
def city_terms(spark: SparkSession, sf: str) -> DataFrame:
    """City alternatives as substrings of the location."""
    queries = nation_queries(
        spark, sf, cities=F.array(F.col("n_name"), F.concat(F.lit("N_"), _k(25, 1), F.lit(" BUI")))
    )
    return _structured(spark, sf, queries)[2]


@query
def profile_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted name lists per person."""
    names = S.profile_terms(member_rows(spark, sf).distinct(), entity_rows(spark, sf))

    def joined(kind: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))), ",")

    return names.groupBy("person_id").agg(
        joined("skill").alias("skills"), joined("technology").alias("technologies"),
        joined("domain").alias("domains"), joined("project").alias("projects"),
        F.count_if(F.col("kind") == "company").alias("n_companies"),
    )


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id")


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of the person named by their source."""
    return _documents(spark, sf).select(
        F.col("source").alias("person_id"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("doc_id").cast("int").alias("ordinal"),
        F.col("text").alias("content"),
        "lang",
    )


@query
def first_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """First five chunks per person."""
    rows = S.first_evidence(_document_chunks(spark, sf))
    return rows.select("person_id", "position", "chunk_id", "source", "score")


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values per kind."""
    persons = people(spark, sf)
    part = table(spark, sf, "part")
    return S.vocabulary(
        {
            "city": persons.select("location"),
            "country": persons.select("country"),
            "company": table(spark, sf, "supplier").select("s_name"),
            "skill": part.select("p_brand"),
            "technology": part.select("p_name"),
            "domain": persons.select("current_title"),
        }
    )


@query
def candidate_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Profile joined with first evidence for requested persons."""
    asked = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    wanted = _documents(spark, sf).join(asked, "doc_id", "left_semi").select(
        F.col("source").alias("person_id")
    ).distinct()
    shown = S.first_evidence(_document_chunks(spark, sf), wanted)
    profile = _documents(spark, sf).groupBy(F.col("source").alias("person_id")).agg(
        F.count("*").alias("n_documents"), F.min("lang").alias("first_lang")
    )
    return shown.join(profile, "person_id").select(
        "person_id", "n_documents", "first_lang", "position", "chunk_id"
    )


# --- A, B: sources, parsing, text -------------------------------------------------------


@query
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison keys of distinct names."""
    parts = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" (C++)")).alias("name")
    )
    names = parts.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    keyed = names.distinct()
    return keyed.select(
        "name",
        T.normalize_name(F.col("name")).alias("key"),
        T.canonical_key(F.col("name")).alias("canonical"),
    )


@query
def normalize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Normal form of whole multilingual texts: its length in words."""
    keyed = _documents(spark, sf).withColumn("norm", T.normalize_name(F.col("text")))
    return keyed.select("doc_id", F.size(T.split_words(F.col("norm"))).cast("long").alias("n_words"))


@query
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields out of JSON payloads."""
    value = F.try_parse_json("props")
    rows = table(spark, sf, "events").withColumn("v", value)
    return rows.select(
        "event_id",
        F.try_variant_get("v", "$.k", "string").try_cast("long").alias("k"),
        F.to_json("v").alias("raw_text"),
    )


@query
def jsonl_records(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines as documents, ids from the record's checksum."""
    lines = table(spark, sf, "events").select(
        F.lit("events.jsonl").alias("file"), F.col("props").alias("value"), F.col("event_id").alias("seq")
    )
    documents, _ = jsonl_documents(lines)
    return documents.select("seq", "source", "external_id", "document_type")


@query
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as documents."""
    files = table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("value")
    )
    documents, _ = text_documents(files)
    return documents.select("file", "source", "external_id", F.length("raw_text").alias("n_chars"))


def _customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON records, some of them invalid by their balance."""
    joined = people(spark, sf).join(
        table(spark, sf, "customer").select(
            F.col("c_custkey").cast("string").alias("person_id"), "c_mktsegment", "c_custkey"
        ),
        "person_id",
    )
    rows = cut_lineage(spread(joined, "c_custkey"))
    record = F.struct(
        F.col("person_id").alias("id"),
        F.when(F.col("age") > 24, F.col("full_name")).alias("name"),
        "country",
        F.col("current_title").alias("title"),
        F.col("years_experience").cast("decimal(10,5)").cast("string").alias("years_experience"),
        "age",
        F.concat("c_mktsegment", F.lit(" ; "), F.lower("country"), F.lit("| ,")).alias("skills"),
        F.concat(F.lit('["'), "c_mktsegment", F.lit('", "AWS"]')).alias("technologies"),
        F.array(F.struct(F.col("country").alias("employer"), F.col("c_mktsegment").alias("domains"))).alias(
            "experience"
        ),
    )
    return rows.select(
        F.lit("crm").alias("source"),
        F.col("person_id").alias("external_id"),
        F.lit("json").alias("document_type"),
        F.to_json(record).alias("raw_text"),
        F.to_json(record).alias("payload"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit("crm").alias("file"),
        F.col("c_custkey").alias("seq"),
    )


@query
def parse_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Record parsing with synonyms, list forms and quarantine."""
    good, bad = parse_records(_customer_documents(spark, sf), write_once=True)
    shown = good.select(
        "external_id",
        F.lit("ok").alias("outcome"),
        F.col("resume.full_name").alias("full_name"),
        F.array_join("resume.skills", ",").alias("skills"),
        F.array_join("resume.technologies", ",").alias("technologies"),
        F.concat_ws("/", F.col("resume.experience")[0]["company"], F.array_join(
            F.col("resume.experience")[0]["domains"], ",")).alias("job"),
        F.round("resume.years_experience", 5).alias("years"),
    )
    text = F.lit(None).cast("string")
    refused = bad.select(
        "external_id", F.col("error_type").alias("outcome"), text.alias("full_name"),
        text.alias("skills"), text.alias("technologies"), text.alias("job"),
        F.lit(None).cast("double").alias("years"),
    )
    return shown.unionByName(refused)


@query
def list_split(spark: SparkSession, sf: str) -> DataFrame:
    """List cells split on separators."""
    cell = F.concat("p_name", F.lit(" ; "), "p_brand", F.lit("|, "), F.lower("p_type"), F.lit(","))
    rows = table(spark, sf, "part").withColumn("v", F.try_parse_json(F.to_json(F.struct(cell.alias("cell")))))
    items = string_list(F.col("v"), "cell")
    return rows.select(
        "p_partkey", F.array_join(items, "/").alias("items"), F.size(items).cast("long").alias("n_items")
    )


@query
def unsafe_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Documents refused for a marker or their length."""
    documents = _documents(spark, sf).select(
        "source", F.col("doc_id").cast("string").alias("external_id"), F.lit("t").alias("file"),
        F.col("text").alias("raw_text"),
    )
    guarded = guard_text(documents, 20_000, ("license", "password", "der die"))
    return split_errors(guarded)[1].select("external_id", "error_type", "message")


# --- C: deduplication and resolution -----------------------------------------------------


@query
def checksum_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First document per normalised text and the number of copies."""
    keyed = _documents(spark, sf).select("doc_id", T.checksum(F.col("text")).alias("checksum"))
    return keyed.groupBy("checksum").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored labelled documents (first per text), and the incoming batch with edits."""
    docs = _documents(spark, sf)
    labels = table(spark, sf, "labels")
    labelled = docs.join(labels, "doc_id").withColumn("checksum", T.checksum(F.col("text")))
    first = labelled.groupBy("checksum").agg(F.min("doc_id").alias("doc_id"))
    stored = cut_lineage(
        first.select(
            T.row_id("document", F.lit("docs"), F.col("doc_id").cast("string")).alias("document_id"),
            "checksum",
            F.lit("someone").alias("person_id"),
        )
    )
    batch = docs.join(labels, "doc_id", "left").select(
        F.lit("docs").alias("source"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.when(F.col("toxic") == 1, F.concat("text", F.lit("\nedited")))
        .otherwise(F.concat("text", F.lit("  \r\n")))
        .alias("raw_text"),
        F.col("doc_id").alias("seq"),
    )
    return stored, batch


@query
def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every incoming document against the stored ones."""
    stored, batch = _snapshots(spark, sf)
    return classify(batch, stored).select(F.col("seq").alias("doc_id"), "checksum", "outcome")


@query
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Run counters (C14)."""
    stored, batch = _snapshots(spark, sf)
    failed = table(spark, sf, "events").filter("event_type = 'error'").select("event_id")
    return ingestion_report(classify(batch, stored), failed)


@query
def delivery_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of three deliveries, told from streaming state.

    Labelled documents arrive first, then all documents with the toxic ones edited, then the
    labelled ones as they first were from another source: held texts are duplicates, and those
    given up are free.
    """
    docs = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    labelled = docs.join(labels, "id").drop("toxic")
    edited = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    later = docs.join(labels, "id", "left").select("id", edited.alias("text"))
    root = f"{work_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    for number, (source, rows) in enumerate((("crawl", labelled), ("crawl", later), ("mirror", labelled))):
        rows.write.option("header", True).option("escape", '"').csv(f"{root}/landing/{number}")
        ingest_delivery(spark, f"{root}/landing", f"{root}/corpus", f"{root}/marks", source, clear=True)
        documents_table(spark, f"{root}/corpus").vacuum()
    sources = F.explode(F.array(F.lit("crawl"), F.lit("mirror")))
    names = docs.select("id", sources.alias("source")).withColumn(
        "document_id", T.row_id("document", F.col("source"), F.col("id"))
    )
    return told_outcomes(spark, f"{root}/corpus").join(names, "document_id").select(
        "delivery", "source", F.col("id").cast("long").alias("doc_id"), "outcome"
    )


def _delivered(spark: SparkSession, sf: str, provider: HashEmbedder | None = None) -> list[IngestResult]:
    """Two deliveries of customers through the whole ingestion, one after the other.

    First the customers with more than 2000 come. Then all come: some as they were, builders with
    another title, machinists with another skill and a text for their project, furnishers twice, as
    they were and with another title, and copies of the household records under other ids. Negative
    years are refused.
    """
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = cut_lineage(spread(table(spark, sf, "customer"), "c_custkey")).join(nation, "c_nationkey")
    segment = F.col("c_mktsegment")
    project = F.concat(F.lit("Project "), segment)

    def versions(of: DataFrame, number: int, changed: Column, prefix: str = "") -> DataFrame:
        def if_changed(*segments: str) -> Column:
            return changed & segment.isin(*segments)

        record = F.struct(
            F.col("c_custkey").cast("string").alias("id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            F.when(if_changed("BUILDING", "FURNITURE"), F.concat(F.lit("Lead "), segment))
            .otherwise(segment).alias("title"),
            F.floor(F.col("c_acctbal") / 1000).cast("int").alias("years_experience"),
            F.array(F.when(if_changed("MACHINERY"), "Google  Cloud").otherwise("GCP"), segment).alias("skills"),
            F.array(F.struct(F.col("n_name").alias("employer"), F.array(segment).alias("domains"))).alias("experience"),
            F.array(F.struct(
                F.concat(F.lit("University "), segment).alias("school"),
                F.when(F.col("c_nationkey") % 2 == 1, F.col("n_name")).alias("country"),
            )).alias("education"),
            F.array(F.struct(
                project.alias("project_name"),
                F.when(if_changed("MACHINERY"), F.concat(F.lit("Plan of "), segment)).alias("summary"),
            )).alias("projects"),
        )
        return of.select(
            F.lit("crm").alias("source"),
            F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("external_id"),
            F.lit("json").alias("document_type"),
            F.to_json(record).alias("raw_text"),
            F.to_json(record).alias("payload"),
            F.create_map().cast("map<string,string>").alias("metadata"),
            F.lit("crm").alias("file"),
            (F.col("c_custkey") * 4 + number).alias("seq"),
        )

    no, yes = F.lit(False), F.lit(True)
    first = versions(rows.filter("c_acctbal > 2000"), 0, no)
    parts = [
        versions(rows, 1, ~segment.isin("FURNITURE")),
        versions(rows.filter("c_mktsegment = 'FURNITURE'"), 2, yes),
        versions(rows.filter("c_mktsegment = 'HOUSEHOLD'"), 3, no, "copy-"),
    ]
    done = ingest_structured(empty_corpus(spark), first, provider, unicode=False)
    then = ingest_structured(done.corpus, reduce(DataFrame.unionByName, parts), provider, unicode=False)
    return [done, then]


@query
def ingest_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of documents and of chunked documents of two deliveries."""
    counts = []
    for number, done in enumerate(_delivered(spark, sf, HashEmbedder(16)), 1):
        for what, report in (("documents", done.report), ("chunks", done.embeddings)):
            counts.append(report.unpivot([], report.columns, "counter", "n").select(
                F.lit(number).alias("delivery"), F.lit(what).alias("what"), "counter", "n"
            ))
    return reduce(DataFrame.unionByName, counts)


@query
def ingest_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Named entities and learned aliases after two deliveries."""
    corpus = _delivered(spark, sf)[-1].corpus
    text = F.lit(None).cast("string")
    plain = {"skill": corpus.skills, "domain": corpus.domains}
    placed = {"company": corpus.companies, "university": corpus.universities}

    def shaped(kind: str, df: DataFrame, country: Column, description: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), "name", F.col("normalized_name").alias("key"),
            country.alias("country"), description.alias("description"),
        )

    aliases = corpus.skill_aliases.join(corpus.skills, "skill_id").select(
        F.col("alias").alias("name"), "normalized_name"
    )
    parts = [shaped(k, df, text, text) for k, df in plain.items()]
    parts += [shaped(k, df, F.col("country"), text) for k, df in placed.items()]
    parts += [shaped("project", corpus.projects, text, F.col("description")), shaped("alias", aliases, text, text)]
    return reduce(DataFrame.unionByName, parts)


@query
def ingest_people(spark: SparkSession, sf: str) -> DataFrame:
    """People and their links after two deliveries."""
    corpus = _delivered(spark, sf)[-1].corpus
    named = {
        "skills": (corpus.person_skills, corpus.skills, "skill_id"),
        "companies": (corpus.person_companies, corpus.companies, "company_id"),
        "universities": (corpus.person_universities, corpus.universities, "university_id"),
        "projects": (corpus.person_projects, corpus.projects, "project_id"),
    }
    shown = corpus.people.select(
        "person_id", F.col("source_id").alias("c_custkey"), "full_name", "current_title",
        F.col("years_experience").cast("int").alias("years"),
    )
    for kind, (links, entities, key) in named.items():
        names = links.join(entities, key).groupBy("person_id").agg(
            F.array_join(F.sort_array(F.collect_list("name")), ",").alias(kind)
        )
        shown = shown.join(names, "person_id", "left")
    return shown.drop("person_id")


@query
def ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the stored documents with the company that they cite."""
    corpus = _delivered(spark, sf, HashEmbedder(16))[-1].corpus
    cited = F.try_element_at("metadata", F.lit("company_id"))
    chunks = corpus.document_chunks.withColumn("company_id", cited)
    companies = corpus.companies.select("company_id", F.col("name").alias("company"))
    return chunks.join(companies, "company_id", "left").select(
        F.try_element_at("metadata", F.lit("external_id")).alias("external_id"), "ordinal", "section",
        "content", "company", F.size("embedding").alias("dimension"),
    )


@query
def corpus_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A bucketed table after a merge of changed and deleted keys, and a vacuum."""
    ddl = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
    names = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    customers = table(spark, sf, "customer").select(*names)
    orders = table(spark, sf, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n")
    )
    stored = BucketTable(spark, f"{work_folder(spark)}/merge-{uuid.uuid4().hex}", ddl, ["c_custkey"], 16)
    stored.merge(customers)
    changed = customers.join(urgent, "c_custkey").select(
        "c_custkey", F.concat("c_name", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("c_name"),
        "c_acctbal", "c_mktsegment",
    )
    idle = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    stored.merge(changed, idle)
    stored.vacuum()
    return stored.read()


@query
def resolve_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Person of each document by source, unique identity or creation."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))

    def named(df: DataFrame, source: str, key: str, nationkey: str, balance: str) -> DataFrame:
        return df.join(nation, F.col(nationkey) == F.col("n_nationkey")).select(
            F.lit(source).alias("source"),
            F.col(key).cast("string").alias("external_id"),
            F.concat(F.lit("Balance "), F.floor(F.col(balance) / 100).cast("string")).alias("full_name"),
            "country",
            F.col(key).alias("seq"),
        )

    suppliers = named(table(spark, sf, "supplier"), "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    customers = named(table(spark, sf, "customer"), "customer", "c_custkey", "c_nationkey", "c_acctbal")
    corpus = empty_corpus(spark).with_tables(
        people=suppliers.select(
            T.row_id("person", F.col("source"), F.col("external_id")).alias("person_id"),
            "source",
            F.col("external_id").alias("source_id"),
            T.identity_key(F.col("full_name"), F.col("country"), unicode=False).alias("normalized_identity"),
        )
    )
    batch = suppliers.unionByName(customers.withColumn("seq", F.col("seq") + F.lit(1 << 40)))
    changes = batch.withColumns(
        {
            "document_id": T.row_id("document", F.col("source"), F.col("external_id")),
            "resume": F.struct("full_name", "country"),
        }
    )
    found = resolve_people(changes, corpus, unicode=False)
    return changes.join(found, "document_id").select("source", "external_id", "person_id")


@query
def scalar_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Last non-null value per person field over many versions (C4)."""
    e = table(spark, sf, "events")

    def when(kind: str, value: str) -> Column:
        return F.when(F.col("event_type") == kind, F.col(value))

    text = F.lit(None).cast("string")
    changes = e.select(
        F.col("user_id").cast("string").alias("person_id"),
        F.col("event_id").alias("seq"),
        F.lit("events").alias("source"),
        F.col("user_id").cast("string").alias("external_id"),
        F.struct(
            F.col("event_type").alias("full_name"),
            when("click", "props").alias("location"),
            text.alias("country"),
            when("view", "props").alias("current_title"),
            when("purchase", "value").alias("years_experience"),
            when("signup", "event_id").cast("int").alias("age"),
            text.alias("summary"),
        ).alias("resume"),
    )
    merged = merge_people(empty_corpus(spark).people, changes, unicode=False)
    return merged.select(
        "person_id", "full_name", "location", "current_title", "years_experience", "age"
    )


@query
def entity_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Get-or-create of named entities; the first spelling names a new one."""
    part = table(spark, sf, "part")
    spelled = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    mentions = part.select(
        spelled.alias("canonical"),
        T.normalize_name(F.col("p_name"), unicode=False).alias("normalized"),
        F.col("p_partkey").alias("seq"),
        F.lit(0).alias("pos"),
    )
    known = part.filter("p_type = 'PROMO' and p_size = 7").select(
        T.normalize_name(F.col("p_name"), unicode=False).alias("normalized_name")
    ).distinct()
    existing = known.select(
        T.row_id("technology", F.col("normalized_name")).alias("technology_id"),
        F.concat(F.lit("Known "), "normalized_name").alias("name"),
        "normalized_name",
    )
    return get_or_create(existing, mentions, "technology")


@query
def entity_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and links collected from parsed records."""
    good, _ = parse_records(_customer_documents(spark, sf), write_once=True)
    changes = good.withColumn("person_id", F.col("external_id"))
    found = collect_mentions(changes, EntityNames(unicode=False))
    links = empty_corpus(spark)
    person_skills = append_links(
        links.person_skills, found.skills.withColumn("skill_id", F.col("normalized"))
    ).select("person_id", F.lit("skill").alias("kind"), F.col("skill_id").alias("entity"))
    technologies = append_links(
        links.person_technologies, found.technologies.withColumn("technology_id", F.col("normalized"))
    ).select("person_id", F.lit("technology").alias("kind"), F.col("technology_id").alias("entity"))
    second = found.company_domains.select(
        F.col("owner_normalized").alias("person_id"), F.lit("company_domain").alias("kind"),
        F.col("normalized").alias("entity"),
    ).distinct()
    return person_skills.unionByName(technologies).unionByName(second)


# --- D: chunks and vectors ----------------------------------------------------------------


@query
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing of whole documents into chunks of 600 characters."""
    header = F.concat(F.lit("DOCUMENT: "), F.col("doc_id").cast("string"))
    blocks = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda b: b != "")
    packed = _documents(spark, sf).select(
        "doc_id", F.posexplode(C.pack_blocks(header, blocks, 600)).alias("ordinal", "content")
    )
    return packed.select(
        "doc_id", "ordinal", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sum")
    )


@query
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Section chunks of parsed records."""
    good, _ = parse_records(_customer_documents(spark, sf))
    records = good.withColumns({"document_id": F.col("external_id"), "person_id": F.col("external_id")})
    return C.chunk_records(records, unicode=False).select("document_id", "ordinal", "section", "content")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.posexplode(F.split("text", "\n")).alias("ordinal", "line"),
    ).select("document_id", "ordinal", F.sha2("line", 256).alias("content_checksum"))


@query
def chunk_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents need new chunks."""
    fresh = _lines(spark, sf)
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("document_id"), "quality", "toxic"
    )
    changed = (F.col("toxic") == 1) & (F.col("ordinal") == 0)
    stored = fresh.join(labels, "document_id").select(
        "document_id",
        "ordinal",
        F.when(changed, "old").otherwise(F.col("content_checksum")).alias("content_checksum"),
        F.array(F.lit(0.0)).alias("embedding"),
        F.when(F.col("quality") == 1, "m").otherwise("older").alias("embedding_model"),
    )
    return C.document_states(fresh, stored, "m", 1)


@query
def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Replacing all chunks of the touched documents."""
    lines = _lines(spark, sf)
    touched = table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("document_id")
    )
    fresh = lines.join(touched, "document_id", "left_semi").filter("ordinal < 2").withColumn(
        "content_checksum", F.lit("new")
    )
    return C.upsert_chunks(lines, fresh)


@query
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Batched embedding of whole texts with the deterministic provider."""
    rows = _documents(spark, sf).select("doc_id", F.col("text").alias("content"))
    done = embed_chunks(rows, HashEmbedder(32))
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return done.select("doc_id", "valid", F.round(F.sqrt(length), 3).alias("norm"))


@query
def vector_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension and finiteness checks."""
    broken = (
        F.when(F.col("label") == 3, F.slice("embedding", 1, 63))
        .when(F.col("label") == 4, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")))))
        .otherwise(F.col("embedding"))
    )
    rows = table(spark, sf, "embeddings").withColumn("vector", broken)
    return rows.select("vec_id", "label", is_valid_vector(F.col("vector"), 64).alias("valid"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("vector_id"),
        F.col("label").cast("string").alias("person_id"),
        "embedding",
    )


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label as the query vectors."""
    spread = table(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x")
    )
    means = spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("embedding")
    )


@query
def cosine_top(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine top-20 over the whole corpus."""
    best = cosine_topk(_centroids(spark, sf), _vectors(spark, sf), 20)
    return best.select("query_id", "position", "vector_id", F.round("score", 6).alias("score"))


@query
def cosine_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine top-20 among allowed persons (F2)."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    others = F.array(*[(F.col("label") + n).cast("string") for n in (0, 1, 4)])
    allowed = labels.select(
        F.col("label").cast("string").alias("query_id"), F.explode(others).alias("person_id")
    )
    best = cosine_topk_within(
        _centroids(spark, sf), _vectors(spark, sf), allowed.filter("query_id <> '7'"), 20
    )
    return best.select("query_id", "position", "vector_id", F.round("score", 6).alias("score"))


@query
def cosine_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate cosine top-20."""
    best = lsh_topk(_centroids(spark, sf), _vectors(spark, sf), 20, tables=12, bits=4)
    return best.select("query_id", "position", "vector_id", F.round("score", 6).alias("score"))


@query
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the stored index against exact search, asked by every fiftieth vector.

    Every vector is indexed and searched; the queries are all ids that 50 divides.
    """
    vectors = _vectors(spark, sf)
    index = build_index(vectors, f"{work_folder(spark)}/index-{uuid.uuid4().hex}")
    asked = cut_lineage(
        table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(
            F.col("vec_id").cast("string").alias("query_id"), "embedding"
        )
    )
    exact = cut_lineage(cosine_topk(asked, vectors, 10))
    recall = recall_of(index.search(asked, 10), exact)
    return asked.agg(F.count("*").alias("n_queries")).select(
        "n_queries", F.lit(index.postings().count()).cast("long").alias("n_indexed"),
        F.lit(recall >= 0.9).alias("recall_reached"),
    )


@query
def ann_top(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index with all of its cells probed gives the exact top-20."""
    index = build_index(_vectors(spark, sf), f"{work_folder(spark)}/index-{uuid.uuid4().hex}")
    best = index.search(_centroids(spark, sf), 20, probes=len(index.centroids))
    return best.select("query_id", "position", "vector_id", F.round("score", 6).alias("score"))


# --- G: graph ------------------------------------------------------------------------------


def _customer_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers, suppliers, segments, priorities and the nations suppliers operate in."""
    persons = people(spark, sf)
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    worked = supplier_links(spark, sf)
    segments = persons.select("person_id", F.col("current_title").alias("domain_id"))
    projects = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderpriority").alias("project_id")
    ).distinct()
    homes = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("company_id"), F.col("n_name").alias("domain_id")
    )
    operates = G.second_level(homes, worked, "company_id")
    edges = reduce(
        DataFrame.unionByName,
        [
            G.make_edges(worked, "Person", "WORKED_AT", "Company", "person_id", "company_id", "person_id"),
            G.make_edges(segments, "Person", "SPECIALIZES_IN", "Domain", "person_id", "domain_id", "person_id"),
            G.make_edges(projects, "Person", "WORKED_ON", "Project", "person_id", "project_id", "person_id"),
            G.make_edges(operates, "Company", "OPERATES_IN", "Domain", "company_id", "domain_id", "owner"),
        ],
    )

    def node(kind: str, df: DataFrame, key: Column, name: Column) -> DataFrame:
        return df.select(
            key.cast("string").alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"),
            T.normalize_name(name, unicode=False).alias("key"),
        ).distinct()

    nodes = reduce(
        DataFrame.unionByName,
        [
            node("Person", persons, F.col("person_id"), F.col("full_name")),
            node("Company", supplier, F.col("s_suppkey"), F.col("s_name")),
            node("Domain", segments, F.col("domain_id"), F.col("domain_id")),
            node("Domain", nation, F.col("n_name"), F.col("n_name")),
            node("Project", projects, F.col("project_id"), F.col("project_id")),
        ],
    )
    return nodes, edges


@query
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge table with its evidence owner."""
    edges = _customer_graph(spark, sf)[1]
    return edges.select("src_type", "src", "rel", "dst_type", "dst", "evidence_person")


@query
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    """All-of search over companies, projects and domains by any route."""
    queries = nation_queries(
        spark, sf,
        companies=F.array(F.concat(F.lit("supplier#"), F.lpad(_k(25, 2), 9, "0"))),
        projects=F.array(F.lit("1-URGENT")),
        required_domains=F.array(F.lower("n_name")),
    )
    nodes, edges = _customer_graph(spark, sf)
    return G.graph_search(_prepared(queries)[1], nodes, edges)


def _home_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers linked to their segment and their nation."""
    persons = people(spark, sf)
    edges = G.make_edges(
        persons, "Person", "SPECIALIZES_IN", "Domain", "person_id", "current_title", "person_id"
    ).unionByName(
        G.make_edges(persons, "Person", "STUDIED_AT", "University", "person_id", "country", "person_id")
    )

    def node(kind: str, key: str, name: str) -> DataFrame:
        return persons.select(
            F.col(key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"),
            T.normalize_name(F.col(name), unicode=False).alias("key"),
        ).distinct()

    nodes = node("Person", "person_id", "full_name").unionByName(
        node("Domain", "current_title", "current_title")
    ).unionByName(node("University", "country", "country"))
    return persons, nodes, edges


@query
def graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    """First ten bounded paths of every person, hubs included."""
    persons, nodes, edges = _home_graph(spark, sf)
    paths = G.graph_paths(persons.select("person_id"), nodes, edges, 3, 10)
    return paths.select(
        "person_id", F.col("position").cast("long").alias("position"),
        F.col("hops").cast("long").alias("hops"),
        F.array_join("nodes", " → ").alias("claim"), F.array_join("relationships", ",").alias("relationships"),
        F.round("score", 6).alias("score"),
    )


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of every person to a node naming a requested term, the first of each length."""
    persons, nodes, edges = _home_graph(spark, sf)
    terms = table(spark, sf, "region").select(
        F.col("r_name").alias("query_id"),
        T.normalize_name(
            F.concat(F.lit("nation_1"), F.col("r_regionkey").cast("string")), unicode=False
        ).alias("term"),
    )
    region = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("country"), F.col("r_name").alias("query_id"))
    pool = persons.join(region, "country").select("query_id", "person_id")
    return G.relevant_paths(pool, terms, nodes, edges, 3, 1)


@query
def graph_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every person to a node naming a requested term."""
    return _relevant(spark, sf).groupBy("query_id", "person_id").agg(
        F.min("hops").cast("long").alias("hops"), F.round(F.max("score"), 6).alias("score")
    )


@query
def graph_relevant_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Every length at which a person reaches a node naming a requested term."""
    return _relevant(spark, sf).select(
        "query_id", "person_id", F.col("hops").cast("long").alias("hops"), F.round("score", 6).alias("score")
    )


# --- H: hybrid retrieval ------------------------------------------------------------------


@query
def hybrid_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Set logic of the candidate pool (H1-H3)."""
    nation = table(spark, sf, "nation").withColumn("query_id", F.concat(F.lit("q"), F.col("n_nationkey")))
    flags = nation.select(
        "query_id", (F.col("n_regionkey") < 3).alias("has_hard_filters"),
        (F.col("n_regionkey") == 1).alias("use_graph"),
    )
    own = table(spark, sf, "customer").select(
        F.concat(F.lit("q"), F.col("c_nationkey")).alias("query_id"),
        F.col("c_custkey").cast("string").alias("person_id"), "c_acctbal", "c_mktsegment",
    )
    pair = ["query_id", "person_id"]
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("person_id")
    )
    return R.candidate_pool(
        flags,
        own.filter("c_acctbal > 4000").select(*pair),
        own.filter("c_mktsegment = 'BUILDING' and query_id <> 'q4' and query_id <> 'q24'").select(*pair),
        own.join(urgent, "person_id", "left_semi").select(*pair),
    )


@query
def plan_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Hard filters and retrieval steps of one query per customer (H1)."""

    def listed(segment: str) -> Column:
        return F.when(F.col("c_mktsegment") == segment, F.array("c_mktsegment"))

    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("query_id"), F.col("c_name").alias("text"),
        F.when(F.col("c_nationkey") < 3, F.lit("")).when(F.col("c_nationkey") < 6, F.col("c_mktsegment")).alias("country"),
        F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal") / 1000).alias("min_years_experience"),
        F.when(F.col("c_acctbal") < -800, F.lit(30)).alias("max_age"),
        listed("FURNITURE").alias("cities"), listed("AUTOMOBILE").alias("required_skills"),
        listed("BUILDING").alias("required_domains"), listed("MACHINERY").alias("companies"),
        listed("HOUSEHOLD").alias("preferred_skills"),
        F.when(F.col("c_nationkey") > 12, F.col("c_name")).otherwise("").alias("semantic_query"),
    )
    return S.complete_queries(plain_intents(asked)).select(
        "query_id", "has_hard_filters", "use_vector", "use_graph",
        F.array_join(S.operations(F.col("use_vector"), F.col("use_graph")), ",").alias("strategy"),
    )


def _ranked(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    queries = _skilled(spark, sf)
    prepared, hits, pairs = _structured(spark, sf, queries)
    pairs = cut_lineage(pairs)
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("person_id")).agg(
        F.count("*").alias("n")
    )
    semantic = pairs.join(spent, "person_id").select(
        "query_id", "person_id", F.least(F.lit(1.0), F.col("n") / 20).alias("value")
    )
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("person_id")
    )
    graph = pairs.join(urgent, "person_id", "left_semi").withColumn("value", F.lit(0.5))
    scored = R.score_pool(pairs, prepared, people(spark, sf), hits, semantic, graph)
    return R.rank(scored, limit)


@query
def composite_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Seven features, weighted score and order per query."""
    rows = _ranked(spark, sf, 20)
    return rows.select(
        "query_id", "position", "person_id",
        *[F.round(name, 6).alias(name) for name in R.FEATURES], F.round("score", 6).alias("score"),
    )


@query
def rank_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features over a pool that meets requirements only in part, and the floor of open queries.

    Each nation's query ranks the customers of its region. Nations of odd key ask for brands, a type,
    a segment, a country, cities and years; the others only prefer brands and name a role.
    """
    key = F.col("n_nationkey")
    odd = key % 2 == 1
    brands = F.array(
        F.concat(F.lit("Brand#"), _k(25, 1)), F.concat(F.lit("Brand#"), ((key + 7) % 25 + 1).cast("string"))
    )
    queries = nation_queries(
        spark, sf,
        role=F.concat(F.lit("Senior "), _segment(key)),
        country=F.when(odd, F.col("n_name")),
        cities=F.when(odd, F.array(F.lit("nowhere"), _segment(key))),
        min_years_experience=F.when(odd, F.lit(2.5)),
        required_skills=F.when(odd, brands),
        required_technologies=F.when(odd, F.array(_type(key))),
        required_domains=F.when(odd, F.array(_segment(key))),
        preferred_skills=F.array(F.element_at(brands, 1), F.lit("Brand#99")),
    )
    prepared, terms = _prepared(queries)
    pair = ["query_id", "person_id"]
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").cast("string").alias("person_id")
    )
    near = customer.join(nation, "n_nationkey").select("n_regionkey", "person_id")
    asked = nation.select("n_regionkey", F.concat(F.lit("q"), key).alias("query_id"))
    pool = near.join(asked, "n_regionkey").select(*pair)
    # Every holder of a required term counts, not only those who meet all of them.
    hits = S.term_hits(terms, entity_rows(spark, sf), member_rows(spark, sf), pool)
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("person_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    bound = pool.join(spent, "person_id")
    semantic = bound.select(*pair, F.least(F.lit(1.0), F.col("n") / 20).alias("value"))
    graph = bound.select(*pair, (F.col("urgent") / F.col("n")).alias("value"))
    scored = R.score_pool(pool, prepared, people(spark, sf), hits, semantic, graph)
    return R.rank(scored, 200, minimum_score=0.2).select(
        *pair, "position", *[F.round(name, 6).alias(name) for name in R.FEATURES],
        F.round("score", 6).alias("score"),
    )


@query
def evidence_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Structured, vector and graph evidence in order, first path of a chunk kept (H4).

    Long documents are vector hits; toxic and low-quality ones lie on graph paths, some on both.
    """
    # Digests stand for the texts from here on: no text is sorted or joined.
    chunks = _document_chunks(spark, sf).withColumns(
        {"score": F.length("content") / 20000, "content": F.sha2("content", 256)}
    )
    pair = ["query_id", "person_id"]
    shown = chunks.select(F.col("lang").alias("query_id"), "person_id").distinct()
    first = S.first_evidence(chunks).join(shown, "person_id")
    longest = Window.partitionBy(*pair).orderBy(F.desc("score"), "ordinal")
    vector = chunks.select(
        F.col("lang").alias("query_id"), "person_id", "chunk_id", "ordinal", "content",
        F.lit("vector").alias("source"), "score",
    ).withColumn("position", F.row_number().over(longest)).filter("position <= 10")
    marked = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.explode(F.filter(
            F.array(F.when(F.col("quality") == 0, F.lit(2)), F.when(F.col("toxic") == 1, F.lit(1))),
            lambda p: p.isNotNull(),
        )).alias("position"),
    )
    graph = chunks.join(marked, "chunk_id").select(
        F.col("lang").alias("query_id"), "person_id", "chunk_id", "ordinal", "content", "position",
        F.lit("graph").alias("source"), (F.lit(1.0) / F.col("position")).alias("score"),
    )
    return R.fuse_evidence(first, vector, graph).select(
        *pair, "place.source_no", "place.position", "place.detail", "chunk_id", "source",
        F.col("content").alias("content_sum"), F.round("score", 6).alias("score"),
    )


def _segment_ranking(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("c_acctbal"), "person_id")
    rows = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("query_id"), F.col("c_custkey").cast("string").alias("person_id"),
        "c_acctbal",
    )
    return rows.withColumn("position", F.row_number().over(order)).filter("position <= 50")


@query
def rerank_contract(spark: SparkSession, sf: str) -> DataFrame:
    """An external order applied to the head of each ranking."""
    ranked = _segment_ranking(spark, sf)
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderkey").alias("place")
    )
    proposed = ranked.select("query_id", "person_id").join(orders, "person_id")
    done = R.rerank(ranked, proposed, 20)
    return done.select("query_id", "person_id", "position", "rerank_position")


def _marked_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    evidence = _document_chunks(spark, sf).select(
        F.col("lang").alias("query_id"), "person_id",
        F.col("ordinal").alias("place"), "chunk_id", "content",
    )
    words = F.array(F.lit("the"), F.lit("der die"), F.lit("License!"))
    queries = plain_intents(
        _documents(spark, sf).select(F.col("lang").alias("query_id")).distinct().select(
            "query_id", F.lit("t").alias("text"), words.alias("required_skills"),
            F.array(F.lit("les")).alias("required_domains"),
        )
    )
    return evidence, S.complete_queries(queries)


@query
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose whole text supports a requirement."""
    evidence, queries = _marked_words(spark, sf)
    found = R.requirement_reasons(evidence, queries, unicode=False)
    return found.select("query_id", "person_id", "claim", "chunk_id")


# --- Q: query understanding ---------------------------------------------------------------


def _utterances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"
    )


@query
def ngrams_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of one to three words and term containment (Q2, Q9)."""
    rows = _utterances(spark, sf).withColumn(
        "norm", T.normalize_name(F.col("text"), unicode=False)
    ).withColumn("words", T.split_words(F.col("norm")))
    return rows.select(
        "query_id",
        F.size(T.phrases(F.col("norm"))).cast("long").alias("n_phrases"),
        T.contains_term(F.col("words"), "ai").alias("has_ai"),
        T.contains_term(F.col("words"), "than").alias("has_than"),
        T.contains_term(F.col("words"), "of the").alias("has_of_the"),
    )


@query
def enrich_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic additions to free-form queries (Q10-Q13)."""
    done = enrich_intents(plain_intents(_utterances(spark, sf)), unicode=False)
    return done.select(
        "query_id", "semantic_query", F.array_join("preferred_technologies", ",").alias("preferred"),
        F.array_join("required_skills", ",").alias("skills"), "city", "min_age", "max_age",
    )


@query
def enrich_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Cities, requirements, companies and ages told by requests made of customers (Q9-Q13)."""

    def by(column: str, texts: dict) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col(column))

    rows = people(spark, sf).join(
        table(spark, sf, "customer").select(
            F.col("c_custkey").cast("string").alias("person_id"),
            (F.col("c_nationkey") % 4).alias("place"), (F.col("c_custkey") % 5).alias("form"),
        ),
        "person_id",
    )
    asked = by("current_title", {"AUTOMOBILE": "Питон!", "BUILDING": "ML-Engineer", "MACHINERY": "МТС,"})
    place = by("place", {0: "в Берлине", 1: "из Москвы", 2: "(Moscow, Лондон)"})
    before = by("form", {0: "старше", 1: "от", 2: "Младше", 3: "до"})
    age = F.when(before.isNotNull(), F.concat(before, F.lit(" "), F.col("age").cast("string"), F.lit("  лет.")))
    requests = rows.select(
        F.col("person_id").alias("query_id"), F.concat_ws(" ", F.lit("Нужен"), asked, place, age).alias("text"),
        F.array(F.lit("MLOps"), F.lit("Kafka")).alias("required_technologies"),
        F.lit(3.0).alias("min_years_experience"),
    )
    lists = (
        "cities", "required_skills", "required_technologies", "preferred_skills", "preferred_technologies", "companies",
    )
    return enrich_intents(plain_intents(requests)).select(
        "query_id", "semantic_query", "city", "min_age", "max_age", "min_years_experience",
        *[F.array_join(name, ",").alias(name) for name in lists],
    )


def _misspelt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    names = part.select("p_name").distinct()
    known = names.select(F.col("p_name").alias("value")).unionByName(
        part.select(F.col("p_type").alias("value")).distinct()
    )
    typed = names.select(
        F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 99)).alias("value")
    )
    return typed.unionByName(names.select(F.reverse("p_name").alias("value"))), known


@query
def fuzzy_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Misspelt names against the vocabulary by sequence similarity (Q3-Q5)."""
    typed, known = _misspelt(spark, sf)

    def key(df: DataFrame, name: str) -> DataFrame:
        return df.select(T.normalize_name(F.col("value"), unicode=False).alias(name)).distinct()

    return fuzzy_pairs(key(typed, "phrase"), key(known, "key")).select(
        "phrase", "key", F.round("ratio", 6).alias("ratio")
    )


@query
def best_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Best vocabulary value per misspelt name (Q6)."""
    typed, known = _misspelt(spark, sf)
    return best_match(typed, known, unicode=False)


@query
def detect_values(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary values named in free text: substring, alias or similar phrase (Q2, Q3, Q7)."""
    words = table(spark, sf, "benchmark").select(
        F.explode(T.split_words(T.normalize_name(F.col("text"), unicode=False))).alias("value")
    ).distinct()
    known = words.select(F.lit("skill").alias("kind"), "value")
    return detect_vocabulary(_utterances(spark, sf), known, unicode=False)


# --- M: teams ------------------------------------------------------------------------------


def _team(spark: SparkSession, sf: str) -> DataFrame:
    """One team per nation: two slots for every market segment, out of its customers."""
    customer = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("request_id"), "c_mktsegment",
        F.col("c_custkey").cast("string").alias("person_id"),
        F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000).alias("score"),
    )
    segments = customer.select("c_mktsegment").distinct()
    numbered = segments.withColumn(
        "role_no", F.floor(F.ascii("c_mktsegment") - F.lit(65)).cast("int")
    )
    roles = customer.select("request_id", "c_mktsegment").distinct().join(numbered, "c_mktsegment").select(
        "request_id", "role_no", F.concat_ws("|", "request_id", "c_mktsegment").alias("query_id"),
        F.col("c_mktsegment").alias("role"), F.lit(2).alias("count"),
        F.lit(20).alias("candidates_per_role"), F.lit(0.15).alias("diversity_weight"),
    )
    terms = part_links(spark, sf).groupBy("person_id").agg(
        F.array_distinct(F.concat(F.collect_set("p_brand"), F.collect_set("p_type"))).alias("terms")
    )
    candidates = customer.join(terms, "person_id", "left").select(
        F.concat_ws("|", "request_id", "c_mktsegment").alias("query_id"), "person_id", "score", "terms"
    )
    return select_team(roles, candidates)


@query
def team_select(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy, diverse team selection per request (M2-M5)."""
    return _team(spark, sf).select(
        "request_id", "role", "slot", "person_id", F.round("selection_score", 6).alias("selection_score")
    )


@query
def team_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Team scores and unfilled slots (M6)."""
    return aggregate_score(_team(spark, sf)).withColumn("aggregate_score", F.round("aggregate_score", 6))


def _team_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per customer: a role for every order priority, as often as ordered."""
    role = StructType.fromDDL(REQUEST)["roles"].dataType.elementType
    counted = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.count("*").cast("int").alias("count"), F.sort_array(F.collect_set("o_orderstatus")).alias("states")
    )
    given = {
        "role": F.col("o_orderpriority"), "count": F.col("count"), "required_skills": F.col("states"),
        "seniority": F.when(F.col("count") > 2, "senior"),
    }
    made = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in role.fields])
    roles = counted.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(made)).alias("roles"))
    return table(spark, sf, "customer").join(roles, "c_custkey").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")).otherwise("").alias("context"),
        F.when(F.col("c_nationkey") > 9, F.lit(30)).alias("candidates_per_role"),
        F.when(F.col("c_nationkey") > 14, F.col("c_acctbal") / 10000).alias("diversity_weight"),
        "roles",
    )


@query
def team_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of valid requests as search queries (M1)."""
    valid, _ = check_requests(_team_requests(spark, sf))
    roles = team_roles(valid)
    asked = role_queries(roles).select("query_id", "text", "semantic_query", "seniority")
    return asked.join(
        roles.select("query_id", "candidates_per_role", F.round("diversity_weight", 6).alias("diversity_weight")),
        "query_id",
    )


@query
def team_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Content words of each candidate's evidence (M3)."""
    evidence = _document_chunks(spark, sf).withColumnRenamed("lang", "query_id")
    return evidence_terms(evidence).select(
        "query_id", "person_id", F.size("terms").alias("n_terms"),
        F.sha2(F.array_join(F.array_sort("terms"), " "), 256).alias("terms_sum"),
    )


# --- N, V: inference and claims -------------------------------------------------------------


@query
def expertise(spark: SparkSession, sf: str) -> DataFrame:
    """Domains found in two or more of a person's first chunks."""
    chunks = _document_chunks(spark, sf)
    evidence = S.first_evidence(chunks)
    domains = chunks.select("person_id").distinct().select(
        "person_id", F.explode(F.array(*map(F.lit, ("the", "der", "les", "que")))).alias("domain")
    )
    found = N.infer_expertise(domains, evidence, unicode=False)
    return found.select(
        "person_id", "claim", F.round("confidence", 6).alias("confidence"),
        F.array_join("evidence_ids", ",").alias("evidence"), "status",
    )


def _word_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    words = _documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("person_id"),
        F.array_distinct(T.split_words(F.lower("text"))).alias("terms"),
    )
    return N.term_sets(words)


@query
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Term sets with Jaccard similarity of one half or more."""
    _, sets = _word_sets(spark, sf)
    pairs = N.similar_sets(sets)
    return pairs.select("set_a", "set_b", F.round("similarity", 6).alias("similarity"))


@query
def similar_members(spark: SparkSession, sf: str) -> DataFrame:
    """Persons per term set: with the set pairs, the whole similarity relation."""
    members, sets = _word_sets(spark, sf)
    return members.join(sets.select("set_id", "n_members"), "set_id").select(
        "person_id", "set_id", "n_members"
    )


@query
def shared_company(spark: SparkSession, sf: str) -> DataFrame:
    """Relationship by shared company, in factored form."""
    links = supplier_links(spark, sf).withColumnRenamed("company_id", "company")
    return N.shared_companies(links)


def _stored_inferences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labels, docs = table(spark, sf, "labels"), _documents(spark, sf)
    status = F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "reviewed").otherwise(
        "unverified"
    )

    def shaped(df: DataFrame, person: Column, claim: Column, confidence: Column, state: Column) -> DataFrame:
        return df.select(
            person.alias("person_id"), F.lit("expertise").alias("inference_type"), claim.alias("claim"),
            F.lit("").alias("peer_id"), confidence.alias("confidence"), F.lit("r").alias("reason"),
            F.array(F.lit("e")).alias("evidence_ids"), state.alias("status"),
        )

    key = F.col("doc_id").cast("string")
    stored = shaped(labels.join(docs, "doc_id"), F.col("source"), key, F.lit(0.5), status)
    proposed = shaped(
        docs.filter("lang <> 'fr'"), F.col("source"), key, F.lit(0.8), F.lit("unverified")
    )
    return stored, proposed


@query
def inference_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Stored inferences after a rebuild."""
    stored, proposed = _stored_inferences(spark, sf)
    done = N.sync_inferences(stored, proposed)
    return done.select("person_id", "claim", "confidence", "status")


@query
def inference_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Plain upsert of proposals."""
    stored, proposed = _stored_inferences(spark, sf)
    done = N.upsert_inferences(stored, proposed)
    return done.select("person_id", "claim", "confidence", "status")


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _documents(spark, sf)
    claims = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("claim_no"),
        F.when(F.col("source") == "src9", "stranger").otherwise(F.col("source")).alias("candidate_id"),
        F.lit("c").alias("claim"),
        F.when(F.col("quality") == 1, "fact").otherwise("inference").alias("kind"),
        F.when(F.col("toxic") == 1, F.lit(0.5)).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(F.col("source") == "src8", F.array().cast(_LIST))
        .when(F.col("source") == "src7", F.array(F.col("doc_id").cast("string"), F.lit("invented")))
        .otherwise(F.array(F.col("doc_id").cast("string")))
        .alias("evidence_ids"),
        F.when(F.col("source") > "src4", F.lit("because")).alias("reason"),
    )
    evidence = docs.select(
        F.col("lang").alias("query_id"), F.col("source").alias("person_id"),
        F.col("doc_id").cast("string").alias("chunk_id"),
    )
    return claims, evidence.select("query_id", "person_id").distinct(), evidence


@query
def claim_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim against the evidence its candidate really has (V2)."""
    checked = check_claims(*_claims(spark, sf))
    return checked.select("query_id", "claim_no", "candidate_id", "accepted", "violation")


@query
def answers_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """An answer stands only with all its claims (V3)."""
    return accept_answers(check_claims(*_claims(spark, sf)))


@query
def answer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """First twelve distinct chunks per candidate for the answer payload (V1)."""
    evidence = _document_chunks(spark, sf).select(
        F.col("lang").alias("query_id"), "person_id", F.col("ordinal").alias("place"), "chunk_id",
        "content", F.lit("structured").alias("source"),
    )
    repeated = evidence.unionByName(
        evidence.withColumn("place", F.col("place") + 5).withColumn("source", F.lit("vector"))
    )
    return unique_evidence(repeated).select("query_id", "person_id", "rank", "chunk_id", "source")


@query
def profile_export(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles as labelled sections."""
    skills = part_links(spark, sf).groupBy("person_id").agg(
        F.sort_array(F.collect_set("p_brand")).alias("skills")
    )
    empty = F.array().cast(_LIST)
    rows = people(spark, sf).join(skills, "person_id", "left").withColumns(
        {
            "summary": F.when(F.col("age") > 40, F.col("summary")),
            "years_experience": F.floor("years_experience").cast("double"),
            "skills": F.coalesce("skills", empty),
            "technologies": empty, "domains": F.array("current_title"), "companies": empty, "projects": empty,
        }
    )
    return profile_sections(rows).select("person_id", "label", "value")
