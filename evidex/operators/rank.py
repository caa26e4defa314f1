"""Pool, features, score, evidence and reasons of hybrid search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.constants import RANKING_WEIGHTS
from evidex.functions.text import normalize_name, split_words

FEATURES = tuple(RANKING_WEIGHTS)


def candidate_pool(
    flags: DataFrame, structured: DataFrame, vector: DataFrame, graph: DataFrame | None
) -> DataFrame:
    """(query_id, person_id) of each query's pool (H2, H3).

    With hard filters: the structured matches, also met by the graph where it is on; never
    the vector hits. Without: the vector hits, else the structured matches. ``flags``:
    query_id, has_hard_filters, use_graph.
    """
    pair = ["query_id", "person_id"]
    hard = structured.join(flags.filter("has_hard_filters"), "query_id").select(*pair, "use_graph")
    if graph is None:
        strict = hard.select(*pair)
    else:
        strict = (
            hard.filter("not use_graph")
            .select(*pair)
            .unionByName(hard.filter("use_graph").select(*pair).join(graph, pair, "left_semi"))
        )
    loose = flags.filter("not has_hard_filters").select("query_id")
    hits = vector.join(loose, "query_id", "left_semi").select(*pair).distinct()
    fallback = structured.join(loose, "query_id", "left_semi").join(
        hits.select("query_id"), "query_id", "left_anti"
    )
    return reduce(DataFrame.unionByName, [strict, hits, fallback.select(*pair)])


def ratio(found: Column, asked: Column) -> Column:
    """Share of requested terms present; 0 when nothing was requested."""
    return F.when(
        F.coalesce(asked, F.lit(0)) > 0, F.coalesce(found, F.lit(0)).cast("double") / asked
    ).otherwise(F.lit(0.0))


def _mean_of_given(*parts: Column) -> Column:
    given = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(given > 0, total / given).otherwise(F.lit(0.0))


def role_words(role: Column) -> Column:
    """Words of a role that a title is searched for."""
    return F.filter(split_words(F.lower(role)), lambda w: F.length(w) > 2)


def experience_score(
    role: Column, words: Column, seniority: Column, min_years: Column, title: Column, years: Column
) -> Column:
    """Mean of role ``words`` (``role_words``) in the title, seniority in the title and years met (H8)."""
    shown = F.lower(F.coalesce(title, F.lit("")))
    found = F.size(F.filter(words, lambda w: F.contains(shown, w)))
    by_role = F.when(
        F.coalesce(role, F.lit("")) != "",
        found.cast("double") / F.greatest(F.size(words), F.lit(1)),
    )
    by_level = F.when(
        F.coalesce(seniority, F.lit("")) != "", F.contains(shown, F.lower(seniority)).cast("double")
    )
    by_years = F.when(min_years == 0, F.lit(1.0)).when(
        min_years > 0,
        F.least(F.coalesce(years, F.lit(0)).cast("double") / min_years, F.lit(1.0)),
    )
    return _mean_of_given(by_role, by_level, by_years)


def location_score(country: Column, cities: Column, own_country: Column, place: Column) -> Column:
    """Mean of country equal and any city named in the location."""
    shown = F.lower(F.coalesce(place, F.lit("")))
    by_country = F.when(
        F.coalesce(country, F.lit("")) != "",
        (F.lower(F.coalesce(own_country, F.lit(""))) == F.lower(country)).cast("double"),
    )
    by_city = F.when(
        F.size(cities) > 0,
        F.exists(cities, lambda c: F.contains(shown, F.lower(c))).cast("double"),
    )
    return _mean_of_given(by_country, by_city)


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    full = dict(RANKING_WEIGHTS) | dict(weights)
    if set(full) != set(FEATURES) or any(not 0 <= w <= 1 for w in full.values()):
        raise ValueError("Weights must lie in [0, 1] and name ranking features")
    if sum(full.values()) <= 0:
        raise ValueError("At least one ranking weight must be positive")
    return full


def weighted_score(weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the seven feature columns, in [0, 1]."""
    full = check_weights(weights or {})
    total = reduce(lambda a, b: a + b, [F.col(n) * F.lit(w) for n, w in full.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(sum(full.values()))))


def score_pool(
    pool: DataFrame,
    queries: DataFrame,
    people: DataFrame,
    hits: DataFrame,
    semantic: DataFrame,
    graph: DataFrame | None,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Features and score of every pool member.

    ``queries``: completed queries with needs. ``semantic`` and ``graph``: query_id,
    person_id, value.
    """
    pair = ["query_id", "person_id"]
    joined = pool.join(hits, pair, "left").join(
        semantic.groupBy(*pair).agg(F.max("value").alias("semantic")), pair, "left"
    )
    if graph is None:
        joined = joined.withColumn("graph", F.lit(0.0))
    else:
        joined = joined.join(graph.groupBy(*pair).agg(F.max("value").alias("graph")), pair, "left")
    q = queries.select(
        "query_id", "role", "seniority", "has_hard_filters", "all_cities", "min_years_experience",
        role_words(F.col("role")).alias("role_words"),  # once per query, not per pair
        F.col("country").alias("q_country"), "w_skills", "w_domains", "w_preference",
    )
    p = people.select(
        "person_id", "full_name", "current_title", "location", "country", "years_experience"
    )
    features = joined.join(q, "query_id").join(p, "person_id").select(
        *pair, "full_name", "current_title", "location", "years_experience", "has_hard_filters",
        F.coalesce("semantic", F.lit(0.0)).alias("semantic"),
        ratio(F.col("skill_hits"), F.col("w_skills")).alias("skills"),
        ratio(F.col("domain_hits"), F.col("w_domains")).alias("domains"),
        experience_score(
            F.col("role"), F.col("role_words"), F.col("seniority"), F.col("min_years_experience"),
            F.col("current_title"), F.col("years_experience"),
        ).alias("experience"),
        F.coalesce("graph", F.lit(0.0)).alias("graph"),
        location_score(
            F.col("q_country"), F.col("all_cities"), F.col("country"), F.col("location")
        ).alias("location_match"),
        ratio(F.col("preference_hits"), F.col("w_preference")).alias("preference"),
    )
    place = features.withColumnsRenamed({"location": "place", "location_match": "location"})
    return place.withColumn("score", weighted_score(weights))


def rank(scored: DataFrame, limit: int, minimum_score: float = 0.15) -> DataFrame:
    """Best ``limit`` per query by score, name, id; then the floor for open queries."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.lower("full_name"), "person_id"
    )
    return (
        scored.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .filter(F.col("has_hard_filters") | (F.col("score") >= minimum_score))
    )


def rerank(
    ranked: DataFrame, proposed: DataFrame, top_n: int = 20, order_by: str = "score"
) -> DataFrame:
    """Apply an external order to the head of each ranking (H16): adds ``rerank_position``.

    ``proposed``: query_id, person_id, place. Unknown ids are dropped, the first place of a
    repeated id counts, missing ids follow in their old order and the tail stays. With
    ``order_by='score'`` (the default) the final ``position`` remains the score order.
    """
    if order_by not in ("score", "rerank"):
        raise ValueError("order_by must be 'score' or 'rerank'")
    first = proposed.groupBy("query_id", "person_id").agg(F.min("place").alias("place"))
    joined = ranked.join(first, ["query_id", "person_id"], "left")
    head = F.col("position") <= top_n
    order = Window.partitionBy("query_id").orderBy(
        (~head).cast("int"),
        F.when(head, F.col("place")).asc_nulls_last(),
        "position",
    )
    placed = joined.withColumn("rerank_position", F.row_number().over(order)).drop("place")
    if order_by == "rerank":
        return placed.withColumn("position", F.col("rerank_position"))
    return placed


def fuse_evidence(
    structured: DataFrame, vector: DataFrame, graph: DataFrame | None
) -> DataFrame:
    """Evidence of candidates in order (H4): query_id, person_id, place, chunk_id, source,
    content, score.

    ``place`` is an order key (source number, position, detail). Graph evidence keeps the
    first path of each chunk.
    """

    def shaped(df: DataFrame, number: int, position: Column, detail: Column) -> DataFrame:
        return df.select(
            "query_id",
            "person_id",
            F.struct(
                F.lit(number).alias("source_no"),
                position.cast("int").alias("position"),
                detail.cast("int").alias("detail"),
            ).alias("place"),
            "chunk_id", "source", "content", "score",
        )

    parts = [
        shaped(structured, 1, F.col("position"), F.lit(0)),
        shaped(vector, 2, F.col("position"), F.lit(0)),
    ]
    if graph is not None:
        numbered = shaped(graph, 3, F.col("position"), F.col("ordinal"))
        parts.append(
            numbered.groupBy("query_id", "person_id", "chunk_id")
            .agg(F.min_by(F.struct("place", "source", "content", "score"), "place").alias("kept"))
            .select("query_id", "person_id", "kept.place", "chunk_id", "kept.source",
                    "kept.content", "kept.score")
        )
    return reduce(DataFrame.unionByName, parts)


def requirement_reasons(
    evidence: DataFrame, queries: DataFrame, unicode: bool = True
) -> DataFrame:
    """Requirements backed by evidence (H14): query_id, person_id, reason_no, claim, kind,
    chunk_id, place; one row per supporting chunk."""
    skills = F.concat("required_skills", "required_technologies")
    asked = F.concat(
        F.transform(
            skills,
            lambda r: F.struct(
                F.lit("Evidence mentions required skill or technology: ").alias("text"),
                r.alias("name"),
            ),
        ),
        F.transform(
            "required_domains",
            lambda r: F.struct(
                F.lit("Evidence mentions required domain: ").alias("text"), r.alias("name")
            ),
        ),
    )
    requirements = queries.select(
        "query_id", F.posexplode(asked).alias("reason_no", "asked")
    ).select(
        "query_id", "reason_no",
        F.concat("asked.text", "asked.name").alias("claim"),
        normalize_name(F.col("asked.name"), unicode).alias("needle"),
    )
    return supporting_chunks(
        evidence.withColumn("haystack", normalize_name(F.col("content"), unicode)),
        requirements,
        ["query_id"],
        ["query_id", "person_id", "reason_no", "claim"],
    ).withColumn("kind", F.lit("fact"))


def supporting_chunks(
    evidence: DataFrame, needles: DataFrame, on: list[str], keys: list[str]
) -> DataFrame:
    """Distinct chunks whose normal form contains a needle, with their first place.

    ``evidence``: haystack, chunk_id, place; ``needles``: needle; joined on ``on``.
    """
    return (
        evidence.filter("chunk_id is not null")
        .join(needles, on)
        .filter(F.contains("haystack", F.col("needle")))
        .groupBy(*keys, "chunk_id")
        .agg(F.min("place").alias("place"))
    )
