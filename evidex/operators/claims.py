"""Evidence payloads and claim checking (V1-V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.parse import Provider, complete
from evidex.session import cut_lineage

_ANSWER = (
    "struct<answer:string,claims:array<struct<candidate_id:string,claim:string,kind:string,"
    "confidence:double,evidence_ids:array<string>,reason:string>>,limitations:array<string>>"
)


def unique_evidence(evidence: DataFrame, limit: int = 12) -> DataFrame:
    """First distinct chunks per candidate (V1): query_id, person_id, rank, chunk_id, content, source."""
    first = evidence.filter("chunk_id is not null").groupBy(
        "query_id", "person_id", "chunk_id"
    ).agg(F.min_by(F.struct("place", "content", "source"), "place").alias("kept"))
    order = Window.partitionBy("query_id", "person_id").orderBy("kept.place", "chunk_id")
    return (
        first.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "person_id", "rank", "chunk_id", "kept.content", "kept.source")
    )


def answer_payloads(candidates: DataFrame, evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Prompt per query (V1): query text and its ranked candidates with evidence, as JSON.

    Bounded by the search limit times twelve chunks.
    """
    shown = unique_evidence(evidence).groupBy("query_id", "person_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("rank", F.col("chunk_id").alias("evidence_id"), "content", "source")
            )
        ).alias("evidence")
    )
    listed = (
        candidates.join(shown, ["query_id", "person_id"], "left")
        .groupBy("query_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "position", F.col("person_id").alias("candidate_id"),
                        F.col("full_name").alias("name"), "score", "evidence",
                    )
                )
            ).alias("candidates")
        )
    )
    return listed.join(queries.select("query_id", "text"), "query_id").select(
        "query_id", F.to_json(F.struct(F.col("text").alias("query"), "candidates")).alias("prompt")
    )


def check_claims(claims: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Judge claims against what their candidate's evidence really holds (V2).

    ``claims``: query_id, claim_no, candidate_id, claim, kind, confidence, evidence_ids,
    reason. ``candidates``: query_id, person_id. ``evidence``: query_id, person_id, chunk_id.
    Adds ``violation`` (null when accepted) and ``accepted``. The first broken rule is named.
    """
    key = ["query_id", "candidate_id"]
    known = candidates.select(
        "query_id", F.col("person_id").alias("candidate_id"), F.lit(True).alias("known")
    ).distinct()
    held = evidence.select(
        "query_id", F.col("person_id").alias("candidate_id"), F.col("chunk_id").alias("cited")
    ).distinct()
    unknown = (
        claims.select("query_id", "claim_no", "candidate_id", F.explode("evidence_ids").alias("cited"))
        .join(held, [*key, "cited"], "left_anti")
        .groupBy("query_id", "claim_no")
        .agg(F.count("*").alias("n_unknown"))
    )
    no_reason = F.coalesce(F.col("reason"), F.lit("")) == ""
    violation = (
        F.when(F.col("known").isNull(), "unknown candidate")
        .when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "no evidence")
        .when(F.col("n_unknown") > 0, "unknown evidence")
        .when((F.col("kind") == "fact") & (F.col("confidence") != 1), "fact without confidence 1")
        .when((F.col("kind") == "inference") & no_reason, "inference without reason")
    )
    return (
        claims.join(known, key, "left")
        .join(unknown, ["query_id", "claim_no"], "left")
        .withColumn("violation", violation)
        .withColumn("accepted", F.col("violation").isNull())
        .select(*claims.columns, "accepted", "violation")
    )


def accept_answers(checked: DataFrame) -> DataFrame:
    """An answer stands only if all its claims do (V3): query_id, accepted, n_claims."""
    return checked.groupBy("query_id").agg(
        F.bool_and("accepted").alias("accepted"), F.count("*").alias("n_claims")
    )


def generate_answers(
    candidates: DataFrame, evidence: DataFrame, queries: DataFrame, provider: Provider
) -> tuple[DataFrame, DataFrame]:
    """Answers of a provider, rejected whole on one bad claim (V3): (answers, checked claims).

    Queries without candidates get no answer; a rejected or unreadable answer is null.
    """
    prompts = answer_payloads(candidates, evidence, queries)
    raw = cut_lineage(prompts.withColumn("reply", complete(F.col("prompt"), provider)))
    parsed = raw.withColumn("a", F.from_json("reply", _ANSWER))
    claims = parsed.select(
        "query_id", F.posexplode("a.claims").alias("claim_no", "c")
    ).select("query_id", "claim_no", "c.*")
    checked = check_claims(claims, candidates, evidence)
    verdicts = accept_answers(checked).select("query_id", "accepted")
    shown = parsed.join(verdicts, "query_id", "left")
    stands = F.coalesce("accepted", F.lit(True)) & F.col("a.answer").isNotNull()
    answers = shown.select(
        "query_id",
        F.when(stands, F.col("a.answer")).alias("answer"),
        F.when(stands, F.col("a.limitations")).alias("limitations"),
        stands.alias("accepted"),
    )
    return answers, checked
