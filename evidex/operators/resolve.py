"""Document outcomes, person resolution and entity tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.corpus import Corpus
from evidex.functions.text import alias_table, checksum, identity_key, normalize_name, normalize_text
from evidex.functions.text import row_id, strip
from evidex.session import cut_lineage

_SCALARS = ("location", "country", "current_title", "years_experience", "age", "summary")


def previous_value(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key, computed block-wise.

    A key that holds a large share of the rows is split at the scan partition recorded in
    the upper bits of ``order``; only one row per key and block meets in the second pass.
    """
    block = F.shiftright(order, 33)
    blocked = df.withColumn("_block", block)
    inner = Window.partitionBy(key, "_block").orderBy(order)
    last = blocked.groupBy(key, "_block").agg(F.max_by(value, order).alias("_last"))
    carry = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))
    ).drop("_last")
    return (
        blocked.withColumn("_inner", F.lag(value).over(inner))
        .join(carry, [key, "_block"])
        .withColumn(out, F.coalesce("_inner", "_carry"))
        .drop("_inner", "_carry", "_block")
    )


def classify(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of every document of a batch (C1, C2): document_id, seq, checksum, outcome.

    The owner of a checksum is the stored document with it, else the first one in the
    batch; another document with that checksum is a duplicate. A version equal to the
    previous accepted version of its document is unchanged. Texts are read once; from
    their checksums on only narrow rows move.
    """
    events = cut_lineage(
        documents.select(
            row_id("document", F.col("source"), F.col("external_id")).alias("document_id"),
            "seq",
            checksum(F.col("raw_text")).alias("checksum"),
        )
    )
    first = events.groupBy("checksum").agg(F.min_by("document_id", "seq").alias("first_owner"))
    kept = stored.select("checksum", F.col("document_id").alias("stored_owner"))
    owners = first.join(kept, "checksum", "left").select(
        "checksum", F.coalesce("stored_owner", "first_owner").alias("owner")
    )
    owned = events.join(owners, "checksum")
    own = F.col("owner") == F.col("document_id")
    duplicates = owned.filter(~own).select(
        "document_id", "seq", "checksum", F.lit("duplicate").alias("outcome")
    )
    before = stored.select(
        "document_id",
        F.lit(True).alias("known"),
        F.when(F.col("person_id").isNotNull(), F.col("checksum")).alias("stored_checksum"),
    )
    accepted = previous_value(
        owned.filter(own).select("document_id", "seq", "checksum"),
        "document_id", "seq", "checksum", "previous",
    ).join(before, "document_id", "left")
    previous = F.coalesce("previous", "stored_checksum")
    outcome = (
        F.when(previous == F.col("checksum"), "unchanged")
        .when(F.col("previous").isNull() & F.col("known").isNull(), "created")
        .otherwise("updated")
    )
    return accepted.select("document_id", "seq", "checksum", outcome.alias("outcome")).unionByName(
        duplicates
    )


def ingestion_report(outcomes: DataFrame, failed: DataFrame) -> DataFrame:
    """Counters of a run (C14); ``skipped`` repeats unchanged and duplicates by design."""

    def n(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name)

    counts = outcomes.select("outcome").unionByName(
        failed.select(F.lit("failed").alias("outcome"))
    )
    return counts.agg(
        F.count("*").alias("total"),
        n("created"), n("updated"), n("unchanged"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome").isin("unchanged", "duplicate")).alias("skipped"),
        n("failed"),
    )


def resolve_people(changes: DataFrame, corpus: Corpus, unicode: bool = True) -> DataFrame:
    """Person of each changed document (C3): document_id, person_id.

    Cascade: the document's stored person, the person with its (source, source_id), the one
    person with the same name and country, else a new person. Documents of one batch with
    the same unseen identity share the person of the first of them.
    """
    identity = identity_key(F.col("resume.full_name"), F.col("resume.country"), unicode)
    documents = (
        changes.select("document_id", "seq", "source", "external_id", identity.alias("identity"))
        .groupBy("document_id")
        .agg(
            F.min("seq").alias("seq"),
            F.first("source").alias("source"),
            F.first("external_id").alias("external_id"),
            F.min_by(F.struct("identity"), "seq")["identity"].alias("identity"),
        )
    )
    by_document = corpus.raw_documents.filter("person_id is not null").select(
        "document_id", F.col("person_id").alias("document_person")
    )
    by_source = corpus.people.select(
        "source", F.col("source_id").alias("external_id"), F.col("person_id").alias("source_person")
    )
    by_identity = (
        corpus.people.filter("normalized_identity is not null")
        .groupBy(F.col("normalized_identity").alias("identity_key"))
        .agg(F.count("*").alias("holders"), F.min("person_id").alias("holder"))
    )
    # Documents without an identity get a key of their own, so they spread over the tasks.
    spread_key = F.coalesce("identity", F.concat(F.lit("\x1f"), "document_id"))
    found = (
        documents.withColumn("identity_key", spread_key)
        .join(by_document, "document_id", "left")
        .join(by_source, ["source", "external_id"], "left")
        .join(by_identity, "identity_key", "left")
        .withColumn(
            "known_person",
            F.coalesce(
                "document_person", "source_person", F.when(F.col("holders") == 1, F.col("holder"))
            ),
        )
        .withColumn("own_person", row_id("person", F.col("source"), F.col("external_id")))
    )
    founders = (
        found.filter("known_person is null and holders is null and identity is not null")
        .groupBy("identity_key")
        .agg(F.min_by("own_person", "seq").alias("founder"))
    )
    return found.join(founders, "identity_key", "left").select(
        "document_id",
        F.when(F.col("known_person").isNotNull(), F.col("known_person"))
        .when(F.col("holders").isNull(), F.coalesce("founder", "own_person"))
        .otherwise(F.col("own_person"))
        .alias("person_id"),
    )


def merge_people(people: DataFrame, changes: DataFrame, unicode: bool = True) -> DataFrame:
    """Scalar merge (C4): name and identity overwrite, other fields only with a value."""
    identity = identity_key(F.col("resume.full_name"), F.col("resume.country"), unicode)
    rows = changes.select(
        "person_id", "seq", "source", "external_id", identity.alias("identity"), "resume"
    )

    def last(name: str) -> Column:
        value = F.col(f"resume.{name}")
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(f"new_{name}")

    latest = rows.groupBy("person_id").agg(
        F.min_by("source", "seq").alias("new_source"),
        F.min_by("external_id", "seq").alias("new_source_id"),
        F.max_by("resume.full_name", "seq").alias("new_full_name"),
        F.max_by(F.struct("identity"), "seq").alias("new_identity"),
        *[last(name) for name in _SCALARS],
    )
    joined = people.join(latest, "person_id", "full_outer")
    return joined.select(
        "person_id",
        F.coalesce("source", "new_source").alias("source"),
        F.coalesce("source_id", "new_source_id").alias("source_id"),
        F.coalesce("new_full_name", "full_name").alias("full_name"),
        F.when(F.col("new_identity").isNotNull(), F.col("new_identity.identity"))
        .otherwise(F.col("normalized_identity"))
        .alias("normalized_identity"),
        *[F.coalesce(f"new_{name}", name).alias(name) for name in _SCALARS],
    )


def _nested(field: str, inner: str) -> Column:
    return F.flatten(F.transform(f"resume.{field}", lambda item: item[inner]))


@dataclass(frozen=True)
class Mentions:
    """Named mentions of a batch, one frame per entity kind, with order (seq, pos)."""

    skills: DataFrame
    technologies: DataFrame
    domains: DataFrame
    companies: DataFrame
    universities: DataFrame
    projects: DataFrame
    company_domains: DataFrame
    project_technologies: DataFrame
    project_domains: DataFrame


class EntityNames:
    """Canonical names under an alias dictionary."""

    def __init__(self, aliases: Mapping[str, str] | None = None, unicode: bool = True) -> None:
        table = alias_table(aliases)
        self.unicode = unicode
        self.names = _map_literal(table)
        self.keys = _map_literal({k: normalize_text(v) for k, v in table.items()})

    def add(self, df: DataFrame, name: str, prefix: str = "") -> DataFrame:
        """Add alias (own normal form), canonical and normalized columns for ``name``."""
        alias = prefix + "alias"
        return df.withColumn(alias, normalize_name(F.col(name), self.unicode)).withColumns(
            {
                prefix + "canonical": F.coalesce(
                    F.try_element_at(self.names, F.col(alias)), strip(F.col(name))
                ),
                prefix + "normalized": F.coalesce(
                    F.try_element_at(self.keys, F.col(alias)), F.col(alias)
                ),
            }
        )


def _map_literal(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def collect_mentions(changes: DataFrame, names: EntityNames) -> Mentions:
    """Explode the named entities of the changed records."""
    base = changes.select("person_id", "seq", "resume")

    def listed(values: Column) -> DataFrame:
        rows = base.select("person_id", "seq", F.posexplode(values).alias("pos", "name"))
        return names.add(rows, "name").filter("alias <> ''")

    def items(field: str) -> DataFrame:
        return base.select("person_id", "seq", F.posexplode(f"resume.{field}").alias("pos", "item"))

    def second(field: str, key: str, inner: str) -> DataFrame:
        rows = items(field).select(
            F.col(f"item.{key}").alias("owner"), F.explode(f"item.{inner}").alias("name")
        )
        return names.add(names.add(rows, "name").filter("alias <> ''"), "owner", "owner_")

    def flat(field: str, key: str, **extra: str) -> DataFrame:
        columns = [F.col(f"item.{source}").alias(out) for out, source in extra.items()]
        rows = items(field).select(
            "person_id", "seq", "pos", F.col(f"item.{key}").alias("name"), *columns
        )
        return names.add(rows, "name")

    return Mentions(
        skills=listed(F.col("resume.skills")),
        technologies=listed(
            F.concat(
                "resume.technologies",
                _nested("experience", "technologies"),
                _nested("projects", "technologies"),
            )
        ),
        domains=listed(
            F.concat(
                "resume.domains", _nested("experience", "domains"), _nested("projects", "domains")
            )
        ),
        companies=flat("experience", "company").withColumn("country", F.lit(None).cast("string")),
        universities=flat("education", "university", country="country"),
        projects=flat("projects", "name", description="description"),
        company_domains=second("experience", "company", "domains"),
        project_technologies=second("projects", "name", "technologies"),
        project_domains=second("projects", "name", "domains"),
    )


def entity_id(kind: str, normalized: str = "normalized", country: str | None = None) -> Column:
    parts = [F.col(normalized)] + ([F.col(country)] if country else [])
    return row_id(kind, *parts)


def get_or_create(
    existing: DataFrame, mentions: DataFrame, kind: str, with_country: bool = False
) -> DataFrame:
    """Entity table with the unseen names of a batch added.

    The first mention names the entity. Countries compare null-safe.
    """
    keys = ["normalized"] + (["country"] if with_country else [])
    first = mentions.groupBy(*keys).agg(
        F.min_by("canonical", F.struct("seq", "pos")).alias("name")
    )
    same = existing["normalized_name"] == first["normalized"]
    if with_country:
        same = same & existing["country"].eqNullSafe(first["country"])
    fresh = first.join(existing, same, "left_anti")
    created = fresh.select(
        entity_id(kind, country="country" if with_country else None).alias(f"{kind}_id"),
        "name",
        F.col("normalized").alias("normalized_name"),
        *(["country"] if with_country else []),
    )
    return existing.unionByName(created)


def merge_skills(
    skills: DataFrame, aliases: DataFrame, mentions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skills with learned aliases (C7): (skills, aliases, mentions with skill_id).

    A stored alias decides before the canonical name does.
    """
    known = mentions.join(
        aliases.select("alias", F.col("skill_id").alias("alias_skill")), "alias", "left"
    )
    resolved = known.withColumn("skill_id", F.coalesce("alias_skill", entity_id("skill")))
    unknown = resolved.filter("alias_skill is null")
    learned = unknown.select("alias", "skill_id").distinct()
    return get_or_create(skills, unknown, "skill"), aliases.unionByName(learned), resolved


def merge_projects(projects: DataFrame, mentions: DataFrame) -> DataFrame:
    """Projects; a description is filled only where none is stored."""
    order = F.struct("seq", "pos")
    first = mentions.groupBy("normalized").agg(
        F.min_by("canonical", order).alias("new_name"),
        F.min_by("description", F.when(F.col("description").isNotNull(), order)).alias("new_text"),
    )
    joined = projects.join(
        first, projects["normalized_name"] == first["normalized"], "full_outer"
    )
    return joined.select(
        F.coalesce("project_id", entity_id("project")).alias("project_id"),
        F.coalesce("name", "new_name").alias("name"),
        F.coalesce("normalized_name", "normalized").alias("normalized_name"),
        F.coalesce("description", "new_text").alias("description"),
    )


def append_links(existing: DataFrame, links: DataFrame) -> DataFrame:
    """Additive bridge: unseen key pairs are appended, none is removed."""
    fresh = links.select(*existing.columns).distinct()
    return existing.unionByName(fresh.join(existing, existing.columns, "left_anti"))


def merge_entities(corpus: Corpus, changes: DataFrame, names: EntityNames) -> Corpus:
    """Entity tables and bridges after a batch."""
    found = collect_mentions(changes, names)
    skills, aliases, skill_links = merge_skills(corpus.skills, corpus.skill_aliases, found.skills)

    def link(mentions: DataFrame, kind: str, country: str | None = None) -> DataFrame:
        return mentions.withColumn(f"{kind}_id", entity_id(kind, country=country))

    def second(mentions: DataFrame, owner: str, kind: str) -> DataFrame:
        owner_key = [F.col("owner_normalized")]
        return mentions.select(
            row_id(owner, *owner_key).alias(f"{owner}_id"), entity_id(kind).alias(f"{kind}_id")
        )

    return corpus.with_tables(
        skills=skills,
        skill_aliases=aliases,
        technologies=get_or_create(corpus.technologies, found.technologies, "technology"),
        domains=get_or_create(corpus.domains, found.domains, "domain"),
        companies=get_or_create(corpus.companies, found.companies, "company", True),
        universities=get_or_create(corpus.universities, found.universities, "university", True),
        projects=merge_projects(corpus.projects, found.projects),
        person_skills=append_links(corpus.person_skills, skill_links),
        person_technologies=append_links(
            corpus.person_technologies, link(found.technologies, "technology")
        ),
        person_domains=append_links(corpus.person_domains, link(found.domains, "domain")),
        person_companies=append_links(
            corpus.person_companies, link(found.companies, "company", "country")
        ),
        person_universities=append_links(
            corpus.person_universities, link(found.universities, "university", "country")
        ),
        person_projects=append_links(corpus.person_projects, link(found.projects, "project")),
        company_domains=append_links(
            corpus.company_domains, second(found.company_domains, "company", "domain")
        ),
        project_technologies=append_links(
            corpus.project_technologies, second(found.project_technologies, "project", "technology")
        ),
        project_domains=append_links(
            corpus.project_domains, second(found.project_domains, "project", "domain")
        ),
    )


def merge_raw_documents(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Raw documents after a batch: the last accepted version of each changed document."""
    columns = [c for c in stored.columns if c != "document_id"]
    latest = (
        changes.select("document_id", F.struct(*columns).alias("version"))
        .groupBy("document_id")
        .agg(F.max_by("version", "version.seq").alias("version"))
        .select("document_id", *[F.col(f"version.{c}").alias(c) for c in columns])
    )
    kept = stored.join(latest, "document_id", "left_anti")
    return kept.unionByName(latest.select(stored.columns))
