"""Batch hybrid search (H1-H18): a table of queries against the corpus in one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.corpus import Corpus
from evidex.operators import graph as G
from evidex.operators import rank as R
from evidex.operators import structured as S
from evidex.operators.claims import generate_answers
from evidex.operators.embed import EmbeddingProvider, embed_queries
from evidex.operators.parse import Provider
from evidex.operators.team import (
    aggregate_score,
    check_requests,
    evidence_terms,
    role_queries,
    select_team,
    team_roles,
)
from evidex.operators.understand import understand
from evidex.functions.vectors import similarity_score
from evidex.operators.vector import cosine_topk, cosine_within, top_per_query
from evidex.session import cut_lineage

PAIR = ["query_id", "person_id"]


@dataclass(frozen=True)
class SearchConfig:
    """Settings of a search. ``pool_limit=None`` keeps every structured match."""

    limit: int = 10
    pool_limit: int | None = None
    open_limit: int = 100
    vector_limit: int = 100
    max_hops: int = 3
    paths_per_hop: int = 2
    minimum_score: float = 0.15
    evidence_per_person: int = 5
    rerank_top: int = 20
    order_by: str = "score"
    unicode: bool = True
    weights: Mapping[str, float] = field(default_factory=dict)
    aliases: Mapping[str, str] | None = None


@dataclass(frozen=True)
class SearchResult:
    """``candidates`` ranked per query; ``evidence`` and ``reasons`` in long form."""

    candidates: DataFrame
    evidence: DataFrame
    reasons: DataFrame
    strategies: DataFrame


def search(
    queries: DataFrame,
    corpus: Corpus,
    provider: EmbeddingProvider,
    graph: tuple[DataFrame, DataFrame] | None = None,
    config: SearchConfig = SearchConfig(),
    proposed: DataFrame | None = None,
) -> SearchResult:
    """Hybrid search (H17). ``queries`` as in ``schemas.QUERY``; ``graph``: (nodes, edges).

    ``proposed`` is an external rerank order (H16). Pool and vector hits are each computed
    once and cut from their lineage, as ranking, evidence and reasons all read them.
    """
    full = S.complete_queries(queries)
    terms = cut_lineage(S.query_terms(full, config.aliases, config.unicode))
    prepared = cut_lineage(full.join(S.query_needs(terms), "query_id", "left"))
    hits = cut_lineage(S.term_hits(terms, S.entities(corpus), S.memberships(corpus)))
    structured = cut_lineage(
        S.structured_pairs(
            prepared, corpus.people, hits, config.pool_limit, config.open_limit, config.unicode
        )
    )
    vector, semantic = _vector_hits(full, corpus, provider, structured, config)
    flags = full.select("query_id", "has_hard_filters", "use_graph")
    if graph is None:
        pool = cut_lineage(R.candidate_pool(flags, structured, vector, None))
        paths = None
    else:
        nodes, edges = graph
        reached = G.graph_search(terms, nodes, edges)
        pool = cut_lineage(R.candidate_pool(flags, structured, vector, reached))
        wanted = terms.filter(F.col("slot").isin("domain", "company", "project")).select(
            "query_id", "term"
        )
        on = pool.join(flags.filter("use_graph").select("query_id"), "query_id", "left_semi")
        paths = cut_lineage(
            G.relevant_paths(on, wanted.distinct(), nodes, edges, config.max_hops, config.paths_per_hop)
        )
    scored = R.score_pool(
        pool,
        prepared,
        corpus.people,
        hits,
        semantic,
        None if paths is None else paths.select(*PAIR, F.col("score").alias("value")),
        config.weights,
    )
    ranked = R.rank(scored, config.limit, config.minimum_score)
    if proposed is not None:
        ranked = R.rerank(ranked, proposed, config.rerank_top, config.order_by)
    ranked = cut_lineage(ranked)
    evidence, path_claims = _evidence(ranked, corpus, vector, paths, config)
    reasons = R.requirement_reasons(evidence, full, config.unicode)
    columns = [*PAIR, "reason_no", "claim", "kind", "chunk_id", "place"]
    reasons = reasons.select(*columns)
    if path_claims is not None:
        reasons = reasons.unionByName(path_claims.select(*columns))
    # The strategy of a query cut short for lack of structured matches is that step alone.
    alive = structured.select("query_id").distinct().withColumn("matched", F.lit(True))
    proceeds = ~F.col("has_hard_filters") | F.coalesce("matched", F.lit(False))
    strategies = full.join(alive, "query_id", "left").select(
        "query_id",
        S.operations(
            F.col("use_vector") & proceeds, F.col("use_graph") & proceeds & F.lit(graph is not None)
        ).alias("strategy"),
    )
    return SearchResult(ranked, evidence, reasons, strategies)


def _vector_hits(
    queries: DataFrame,
    corpus: Corpus,
    provider: EmbeddingProvider,
    structured: DataFrame,
    config: SearchConfig,
) -> tuple[DataFrame, DataFrame]:
    """Vector evidence per query, and (query_id, person_id, value) of the semantic feature.

    With hard filters every structured match is scored: the feature covers the whole pool, and
    ``vector_limit`` only cuts the evidence. Without, the best ``vector_limit`` chunks are the
    pool (H3) and their scores the feature.
    """
    vectors = corpus.document_chunks.select(
        F.col("chunk_id").alias("vector_id"), "person_id", "embedding"
    )
    asked = queries.filter("use_vector")
    open_queries = embed_queries(asked.filter("not has_hard_filters"), provider)
    hard_queries = embed_queries(asked.filter("has_hard_filters"), provider)
    allowed = structured.join(
        asked.filter("has_hard_filters").select("query_id"), "query_id", "left_semi"
    )
    whole = cut_lineage(cosine_topk(open_queries, vectors, config.vector_limit))
    scored = cut_lineage(cosine_within(hard_queries, vectors, allowed))
    within = top_per_query(scored, config.vector_limit)
    evidence = cut_lineage(whole.unionByName(within).withColumnRenamed("vector_id", "chunk_id"))
    best = scored.groupBy(*PAIR).agg(F.max(similarity_score(F.col("cosine"))).alias("value"))
    semantic = whole.select(*PAIR, F.col("score").alias("value")).unionByName(best)
    return evidence, semantic


def _evidence(
    ranked: DataFrame,
    corpus: Corpus,
    vector: DataFrame,
    paths: DataFrame | None,
    config: SearchConfig,
) -> tuple[DataFrame, DataFrame | None]:
    """Fused evidence of the ranked candidates and the claims of their paths."""
    shown = ranked.select(*PAIR)
    persons = shown.select("person_id").distinct()
    chunks = corpus.document_chunks.select("chunk_id", "person_id", "ordinal", "content")
    first = S.first_evidence(chunks, persons, config.evidence_per_person).join(shown, "person_id")
    hits = (
        vector.join(shown, PAIR, "left_semi")
        .join(chunks.select("chunk_id", "content"), "chunk_id")
        .withColumn("source", F.lit("vector"))
    )
    if paths is None:
        return R.fuse_evidence(first, hits, None), None
    walked = paths.join(shown, PAIR, "left_semi")
    backed = G.path_evidence(walked, chunks, PAIR)
    claims = walked.select(*PAIR, "position", F.array_join("nodes", " → ").alias("claim"), "score")
    cited = backed.join(claims, [*PAIR, "position"])
    items = cited.select(
        *PAIR, "position", "ordinal", "chunk_id", F.lit("graph").alias("source"),
        F.col("claim").alias("content"), "score",
    )
    reasons = cited.groupBy(*PAIR, "position", "claim", "chunk_id").agg(
        F.min(F.struct(
            F.lit(3).alias("source_no"),
            F.col("source_no").cast("int").alias("position"),
            F.col("ordinal").cast("int").alias("detail"),
        )).alias("place")
    ).select(
        *PAIR, (F.lit(1_000) + F.col("position")).cast("int").alias("reason_no"), "claim",
        F.lit("fact").alias("kind"), "chunk_id", "place",
    )
    return R.fuse_evidence(first, hits, items), reasons


@dataclass(frozen=True)
class Answered:
    intents: DataFrame
    result: SearchResult
    answers: DataFrame | None
    claims: DataFrame | None


def answer_queries(
    texts: DataFrame,
    corpus: Corpus,
    provider: EmbeddingProvider,
    graph: tuple[DataFrame, DataFrame] | None = None,
    config: SearchConfig = SearchConfig(),
    intent_provider: Provider | None = None,
    answer_provider: Provider | None = None,
    ground: bool = True,
) -> Answered:
    """Texts to answers (H18): intent, retrieval, optional generated answer with checked claims.

    A rejected answer becomes null and its candidates stay. ``texts``: query_id, text.
    """
    known = S.corpus_vocabulary(corpus) if ground else None
    intents = cut_lineage(understand(texts, known, intent_provider, config.unicode))
    result = search(intents, corpus, provider, graph, config)
    if answer_provider is None:
        return Answered(intents, result, None, None)
    answers, claims = generate_answers(
        result.candidates, result.evidence, intents, answer_provider
    )
    return Answered(intents, result, answers, claims)


def build_teams(
    requests: DataFrame,
    corpus: Corpus,
    provider: EmbeddingProvider,
    graph: tuple[DataFrame, DataFrame] | None = None,
    config: SearchConfig = SearchConfig(),
) -> tuple[DataFrame, DataFrame, SearchResult]:
    """Teams for all requests (M1-M6): (selection, aggregate scores, the search behind them)."""
    valid, _ = check_requests(requests)
    roles = team_roles(valid)
    wide = SearchConfig(**{**config.__dict__, "limit": 100})
    result = search(role_queries(roles), corpus, provider, graph, wide)
    terms = evidence_terms(result.evidence)
    candidates = result.candidates.select(*PAIR, "score").join(terms, PAIR, "left")
    settings = roles.select(
        "request_id", "role_no", "query_id", "candidates_per_role", "diversity_weight",
        F.col("r.role").alias("role"), F.coalesce("r.count", F.lit(1)).alias("count"),
    )
    selection = select_team(settings, candidates)
    return selection, aggregate_score(selection), result
