"""Unverified inferences: expertise, similarity, relationship, and their upkeep."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.bitmaps import Block, bitmap, possible_pairs
from evidex.functions.text import normalize_name
from evidex.operators.rank import supporting_chunks
from evidex.session import cut_lineage

KEY = ("person_id", "inference_type", "claim", "peer_id")
#: Longs of the bitmap of a term set of up to 511 terms, a power of two.
BITMAP = 16
#: Sets, and bytes of bitmaps, of a block; a task holds two blocks.
BLOCK, BLOCK_BYTES = 1 << 14, 1 << 24
#: Numbers of sets that are sent to all tasks at most.
SENT = 1 << 18


def infer_expertise(
    person_domains: DataFrame, evidence: DataFrame, unicode: bool = True
) -> DataFrame:
    """Domains named in two or more evidence chunks of a person.

    ``person_domains``: person_id, domain. ``evidence``: person_id, chunk_id, position,
    content (the first five chunks of ``first_evidence``).
    """
    shown = evidence.select(
        "person_id", "chunk_id", F.col("position").alias("place"),
        normalize_name(F.col("content"), unicode).alias("haystack"),
    )
    wanted = person_domains.select(
        "person_id", "domain", normalize_name(F.col("domain"), unicode).alias("needle")
    )
    support = supporting_chunks(shown, wanted, ["person_id"], ["person_id", "domain"])
    counted = (
        support.groupBy("person_id", "domain")
        .agg(
            F.count("*").alias("n"),
            F.sort_array(F.collect_list(F.struct("place", "chunk_id"))).alias("found"),
        )
        .filter("n >= 2")
    )
    return counted.select(
        "person_id",
        F.lit("expertise").alias("inference_type"),
        F.concat(F.lit("Likely has sustained expertise in "), "domain").alias("claim"),
        F.lit("").alias("peer_id"),
        F.least(F.lit(0.55) + F.col("n") * 0.08, F.lit(0.87)).alias("confidence"),
        F.concat(
            F.lit("The domain appears in "), F.col("n").cast("string"),
            F.lit(
                " independent evidence chunks; this is an inference, not a verified "
                "proficiency level."
            ),
        ).alias("reason"),
        F.transform("found", lambda f: f["chunk_id"]).alias("evidence_ids"),
        F.lit("unverified").alias("status"),
    )


def term_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group persons by equal term sets: members (person_id, set_id) and sets (set_id, terms,
    n_members, set_no).

    ``rows``: person_id, term; or person_id, terms, which moves whole lists. Copies of one set are
    compared once, whatever their number. Both results are read several times later on, so the
    sets are built and written once.
    """
    if "terms" in rows.columns:
        terms = F.sort_array(F.array_distinct(F.flatten(F.collect_list("terms"))))
    else:
        terms = F.sort_array(F.collect_set("term"))
    own = rows.groupBy("person_id").agg(terms.alias("terms")).filter(F.size("terms") > 0)
    keyed = cut_lineage(own.withColumn("set_id", F.sha2(F.array_join("terms", "\x1f"), 256)))
    sets = cut_lineage(
        keyed.groupBy("set_id")
        .agg(F.first("terms").alias("terms"), F.count("*").alias("n_members"))
        .withColumn("set_no", F.monotonically_increasing_id())
    )
    return keyed.select("person_id", "set_id"), sets


def similar_sets(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of different sets with Jaccard similarity at the threshold.

    Each set has a bitmap of its terms' hashes, as wide as its size class asks for: a bit of one set
    that the other has not is a term that the other has not, which bounds what both share. Blocks of
    sets whose sizes allow the threshold meet in tasks that hold two blocks of bitmaps, so neither
    sets nor pairs are moved to find the few pairs left; no term, however common, makes a task or a
    table larger. These pairs are verified exactly. Result: set_a < set_b, similarity.
    """
    # Terms stand as 64-bit hashes from here on: two terms of a pair of sets that fall together
    # by chance would need sets of billions of terms.
    hashes = F.transform("terms", lambda t: F.xxhash64(t))
    met = cut_lineage(_possible_pairs(sets.select("set_no", hashes.alias("terms")), threshold))
    numbers = met.select(F.explode(F.array("small", "large")).alias("set_no")).distinct()
    few = numbers.count() <= SENT
    some = sets.join(F.broadcast(numbers) if few else numbers, "set_no", "left_semi")

    def side(number: str, name: str, terms: str) -> DataFrame:
        return some.select(F.col("set_no").alias(number), F.col("set_id").alias(name), hashes.alias(terms))

    verified = met.join(side("small", "a_id", "a"), "small").join(
        side("large", "b_id", "b"), "large"
    )
    common = F.size(F.array_intersect("a", "b"))
    similarity = common / (F.size("a") + F.size("b") - common)
    return verified.select(
        F.least("a_id", "b_id").alias("set_a"),
        F.greatest("a_id", "b_id").alias("set_b"),
        similarity.alias("similarity"),
    ).filter(F.col("similarity") >= threshold)


def _longs(size_class: int) -> int:
    """Longs of the bitmaps of sets of 2 ** ``size_class`` terms and up to twice as many."""
    return BITMAP << max(0, size_class - 8)


def _possible_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(small, large): numbers of sets whose bitmaps leave a similarity at the threshold possible."""
    schema = "set_no long, n long, class int, b0 binary"  # b0: the bitmap from its first long on
    longs = [_longs(k) for k in range(32)]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, terms = batch.column("set_no"), batch.column("terms")
            sizes = [len(t) for t in terms]
            classes = [n.bit_length() - 1 for n in sizes]
            maps = [bitmap(t.values.to_numpy(), longs[k]) for t, k in zip(terms, classes, strict=True)]
            columns = [numbers.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int32()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_no", "n", "class", "b0"])

    maps = cut_lineage(sets.filter(F.size("terms") > 0).mapInArrow(mapped, schema))
    counts = {r["class"]: r["count"] for r in maps.groupBy("class").count().collect()}
    blocks = {k: -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * longs[k])))) for k, n in counts.items()}
    reach = math.ceil(1 + math.log2(1 / threshold) - 1e-9) - 1
    places = [
        ((k, i), (m, j)) for k in blocks for m in range(k, k + reach + 1) for i in range(blocks[k])
        for j in range(i if m == k else 0, blocks.get(m, 0))
    ]
    spread = F.lit(1)
    for k, n in blocks.items():
        spread = F.when(F.col("class") == k, n).otherwise(spread)
    dealt = maps.withColumn("block", F.pmod(F.xxhash64("set_no"), spread).cast("int"))

    def side(own: int) -> DataFrame:
        rows = [(t, *pair[own], pair[0] == pair[1]) for t, pair in enumerate(places)]
        tasks = sets.sparkSession.createDataFrame(rows, "task int, class int, block int, same boolean")
        # The blocks of one task meet themselves: they are sent once.
        tasks = tasks if own == 0 else tasks.filter("not same")
        names = [F.col(c).alias(f"{c}_{own}") for c in ("task", "same", "set_no", "n", "b0")]
        held = dealt.join(F.broadcast(tasks), ["class", "block"]).select(*names)
        return held.repartition(min(len(places), 1 << 10) or 1, f"task_{own}").groupBy(f"task_{own}")

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = (Block(*(c.to_pylist() for c in t.columns[2:])) if len(t) else None for t in (ours, theirs))
        b = a if a and ours.column(1)[0].as_py() else b
        found = [(a.numbers[i], b.numbers[j]) for i, j in possible_pairs(a, b, threshold)] if a and b else []
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
        return pa.table(dict(zip(("small", "large"), columns, strict=True)))

    return side(0).cogroup(side(1)).applyInArrow(compare, "small long, large long")


def _both_ids(own: str, peer: str) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(peer, none)))


def _evidence_lists(evidence: DataFrame) -> DataFrame:
    """First chunks per person as a short list: person_id, ids."""
    rows = F.sort_array(F.collect_list(F.struct("position", "chunk_id")))
    return evidence.groupBy("person_id").agg(F.transform(rows, lambda r: r["chunk_id"]).alias("ids"))


def _with_peers(pairs: DataFrame, people: DataFrame, evidence: DataFrame) -> DataFrame:
    lists = _evidence_lists(evidence)
    named = people.select(F.col("person_id").alias("peer_id"), F.col("full_name").alias("peer_name"))
    return (
        pairs.join(lists.withColumnRenamed("ids", "own_ids"), "person_id", "left")
        .join(lists.withColumnsRenamed({"person_id": "peer_id", "ids": "peer_ids"}), "peer_id", "left")
        .join(named, "peer_id")
        .withColumn("evidence_ids", _both_ids("own_ids", "peer_ids"))
        .filter(F.size("evidence_ids") > 0)
    )


def infer_similarity(
    subjects: DataFrame,
    members: DataFrame,
    sets: DataFrame,
    pairs: DataFrame,
    people: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """Similarity proposals for the subjects against everyone.

    ``members``/``sets`` from ``term_sets``, ``pairs`` from ``similar_sets``. Output grows with
    the subjects; for all persons the set-level pairs are the complete, compact result.
    """
    near = (
        pairs.select("set_a", "set_b", "similarity")
        .unionByName(pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"), "similarity"))
        .unionByName(
            sets.filter("n_members > 1 and size(terms) > 0").select(
                F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"),
                F.lit(1.0).alias("similarity"),
            )
        )
    )
    own = members.join(subjects.select("person_id").distinct(), "person_id", "left_semi")
    found = (
        own.join(near, F.col("set_id") == F.col("set_a"))
        .select("person_id", "set_b", "similarity")
        .join(
            members.select(F.col("person_id").alias("peer_id"), F.col("set_id").alias("set_b")), "set_b"
        )
        .filter("peer_id <> person_id")
    )
    return _with_peers(found, people, evidence).select(
        "person_id",
        F.lit("similarity").alias("inference_type"),
        F.concat(
            F.lit("Likely has a similar professional background to "), "peer_name"
        ).alias("claim"),
        "peer_id",
        F.least(F.lit(0.45) + F.col("similarity") * 0.4, F.lit(0.85)).alias("confidence"),
        F.format_string(
            "Jaccard overlap across recorded skills, technologies, and domains is %.2f.",
            F.col("similarity"),
        ).alias("reason"),
        "evidence_ids",
        F.lit("unverified").alias("status"),
    )


def shared_companies(person_companies: DataFrame) -> DataFrame:
    """Relationship in factored form (N3): company, person_id, n_peers, for companies shared.

    Two persons are related when they appear under one company. The result grows with the
    memberships, not with the pairs, and loses none.
    """
    links = person_companies.select("company", "person_id").distinct()
    sizes = links.groupBy("company").agg(F.count("*").alias("n")).filter("n > 1")
    return links.join(sizes, "company").select(
        "company", "person_id", (F.col("n") - 1).alias("n_peers")
    )


def infer_relationship(
    subjects: DataFrame, person_companies: DataFrame, people: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Relationship proposals for the subjects against everyone.

    ``person_companies``: person_id, company (normalised name).
    """
    links = person_companies.select("company", "person_id").distinct()
    own = links.join(subjects.select("person_id").distinct(), "person_id", "left_semi")
    peers = links.select("company", F.col("person_id").alias("peer_id"))
    found = (
        own.join(peers, "company")
        .filter("peer_id <> person_id")
        .groupBy("person_id", "peer_id")
        .agg(F.array_join(F.sort_array(F.collect_set("company")), ", ").alias("companies"))
    )
    return _with_peers(found, people, evidence).select(
        "person_id",
        F.lit("relationship").alias("inference_type"),
        F.concat(F.lit("May have shared a professional context with "), "peer_name").alias("claim"),
        "peer_id",
        F.lit(0.65).alias("confidence"),
        F.concat(
            F.lit("Both profiles reference the same company or organization ("),
            "companies",
            F.lit("), but employment-date overlap is not verified."),
        ).alias("reason"),
        "evidence_ids",
        F.lit("unverified").alias("status"),
    )


def sync_inferences(
    stored: DataFrame, proposals: DataFrame, subjects: DataFrame | None = None
) -> DataFrame:
    """Stored inferences after a rebuild.

    For the rebuilt subjects (all persons when not given): unverified rows no longer proposed
    go, reviewed and rejected rows stay as they are, the rest is written as proposed.
    """
    columns = stored.columns
    last = proposals.dropDuplicates(list(KEY))
    old = stored.select(*KEY, F.struct(*columns).alias("old"))
    new = last.select(*KEY, F.struct(*columns).alias("new"))
    joined = old.join(new, list(KEY), "full_outer")
    if subjects is None:
        joined = joined.withColumn("rebuilt", F.lit(True))
    else:
        mark = subjects.select("person_id").distinct().withColumn("rebuilt", F.lit(True))
        joined = joined.join(mark, "person_id", "left").withColumn(
            "rebuilt", F.coalesce("rebuilt", F.lit(False))
        )
    keeps_old = F.col("old").isNotNull() & (
        (F.col("old.status") != "unverified") | ~F.col("rebuilt")
    )
    row = F.when(keeps_old, F.col("old")).otherwise(F.col("new"))
    return joined.select(row.alias("row")).filter("row is not null").select("row.*")


def upsert_inferences(stored: DataFrame, proposals: DataFrame, order: str | None = None) -> DataFrame:
    """Plain upsert: the last proposal of a key wins (N6). ``order``: column giving the sequence."""
    columns = stored.columns
    picked = F.max_by(F.struct(*columns), order) if order else F.max(F.struct(*columns))
    latest = proposals.groupBy(*KEY).agg(picked.alias("row")).select("row.*")
    return stored.join(latest, list(KEY), "left_anti").unionByName(latest.select(*columns))


def list_inferences(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Inferences of the given persons, ordered by type and claim."""
    return stored.join(ids, "person_id", "left_semi").orderBy(
        "person_id", "inference_type", "claim"
    )


def rebuild_inferences(
    subjects: DataFrame,
    people: DataFrame,
    names: DataFrame,
    evidence: DataFrame,
    unicode: bool = True,
) -> DataFrame:
    """All proposals of the subjects against the whole population.

    ``names``: person_id, kind, name of ``profile_terms``; ``evidence`` of ``first_evidence``.
    """
    keyed = names.withColumn("term", normalize_name(F.col("name"), unicode))
    wanted = names.join(subjects.select("person_id").distinct(), "person_id", "left_semi")
    domains = wanted.filter("kind = 'domain'").select("person_id", F.col("name").alias("domain"))
    members, sets = term_sets(
        keyed.filter(F.col("kind").isin("skill", "technology", "domain")).select("person_id", "term")
    )
    companies = keyed.filter("kind = 'company'").select("person_id", F.col("term").alias("company"))
    return reduce(
        DataFrame.unionByName,
        [
            infer_expertise(domains, evidence, unicode),
            infer_similarity(subjects, members, sets, similar_sets(sets), people, evidence),
            infer_relationship(subjects, companies, people, evidence),
        ],
    )
