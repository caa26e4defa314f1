"""Team selection (M1-M6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import content_words
from evidex.operators.understand import plain_intents

REQUEST = (
    "request_id string, context string, candidates_per_role int, diversity_weight double, "
    "roles array<struct<role:string,count:int,seniority:string,country:string,city:string,"
    "cities:array<string>,min_years_experience:double,required_skills:array<string>,"
    "required_technologies:array<string>,required_domains:array<string>,"
    "preferred_skills:array<string>,preferred_domains:array<string>>>"
)
MAX_ROLES, MAX_COUNT, MAX_CANDIDATES, MAX_DIVERSITY = 20, 10, 100, 0.5
NO_CANDIDATE = "No remaining candidate satisfies the retrieval constraints"
BEYOND_LIMITS = "The role exceeds the limits of a request"

SELECTION = (
    "request_id string, role_no int, role string, slot int, person_id string, score double, "
    "selection_score double, reason string"
)


def check_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests within the limits of the request schema, and the others (M1)."""
    valid = (
        F.size("roles").between(1, MAX_ROLES)
        & F.forall("roles", lambda r: F.coalesce(r["count"], F.lit(1)).between(1, MAX_COUNT))
        & F.forall("roles", lambda r: F.length(r["role"]).between(2, 255))
        & F.coalesce("candidates_per_role", F.lit(20)).between(1, MAX_CANDIDATES)
        & F.coalesce("diversity_weight", F.lit(0.15)).between(0, MAX_DIVERSITY)
        & (F.coalesce(F.length("context"), F.lit(0)) <= 2_000)
    )
    ok = F.coalesce(valid, F.lit(False))
    filled = requests.withColumns(
        {
            "candidates_per_role": F.coalesce("candidates_per_role", F.lit(20)),
            "diversity_weight": F.coalesce("diversity_weight", F.lit(0.15)),
        }
    )
    return filled.filter(ok), requests.filter(~ok)


def team_roles(requests: DataFrame) -> DataFrame:
    """One row per role: request_id, role_no, query_id and the role's settings."""
    return requests.select(
        "request_id", "context", "candidates_per_role", "diversity_weight",
        F.posexplode("roles").alias("role_no", "r"),
    ).withColumn("query_id", F.concat_ws("|", "request_id", "role_no"))


def role_queries(roles: DataFrame) -> DataFrame:
    """Query table of the roles (M1)."""
    words = F.concat(
        F.array("r.role", "r.seniority"),
        *[
            F.coalesce(f"r.{f}", F.array().cast("array<string>"))
            for f in ("required_skills", "required_technologies", "required_domains")
        ],
        F.array("context"),
    )
    text = F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " ")
    fields = (
        "role", "seniority", "country", "city", "cities", "min_years_experience",
        "required_skills", "required_technologies", "required_domains", "preferred_skills",
        "preferred_domains",
    )
    return plain_intents(
        roles.select(
            "query_id",
            text.alias("text"),
            *[F.col(f"r.{f}").alias(f) for f in fields],
            F.coalesce(F.nullif("context", F.lit("")), "r.role").alias("semantic_query"),
        )
    )


def evidence_terms(evidence: DataFrame, pattern: str = "[a-z0-9+#.-]+") -> DataFrame:
    """Distinct content words per candidate of a query (M3): query_id, person_id, terms."""
    contents = evidence.select("query_id", "person_id", "content").distinct()
    words = contents.select(
        "query_id", "person_id", F.explode(content_words(F.col("content"), pattern)).alias("word")
    )
    return words.groupBy("query_id", "person_id").agg(F.collect_set("word").alias("terms"))


def select_team(roles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Greedy filling of the slots in role order (M2-M5).

    ``roles``: request_id, role_no, query_id, role, count, candidates_per_role,
    diversity_weight. ``candidates``: query_id, person_id, score, terms. The best remaining
    candidate by score minus the overlap penalty is taken; unfilled slots carry a reason.
    A request is at most 20 roles of 100 candidates by its schema, so a request fits a task, and
    requests run in parallel. A role beyond the schema is not filled: it gets one row without a
    person that says so.
    """
    within = F.coalesce(
        (F.col("role_no") < MAX_ROLES)
        & (F.col("count") <= MAX_COUNT)
        & (F.col("candidates_per_role") <= MAX_CANDIDATES),
        F.lit(False),
    )
    beyond = roles.filter(~within).select(
        "request_id", F.col("role_no").cast("int").alias("role_no"), "role", F.lit(1).alias("slot"),
        F.lit(None).cast("string").alias("person_id"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("selection_score"), F.lit(BEYOND_LIMITS).alias("reason"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "person_id")
    best = candidates.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= MAX_CANDIDATES
    )
    rows = roles.filter(within).join(best, "query_id", "left").filter(
        F.col("_n").isNull() | (F.col("_n") <= F.col("candidates_per_role"))
    )
    filled = rows.select(
        "request_id", "role_no", "role", "count", "diversity_weight", "person_id", "score", "terms"
    ).groupBy("request_id").applyInPandas(_fill_request, SELECTION)
    return filled.unionByName(beyond)


def _fill_request(rows: pd.DataFrame) -> pd.DataFrame:
    taken: set[str] = set()
    covered: set[str] = set()
    out = []
    for (role_no, role, count, weight), group in rows.groupby(
        ["role_no", "role", "count", "diversity_weight"], sort=True, dropna=False
    ):
        people = {
            r.person_id: (float(r.score), frozenset() if r.terms is None else frozenset(r.terms))
            for r in group.itertuples()
            if isinstance(r.person_id, str)
        }
        for slot in range(1, int(count) + 1):
            free = {p: v for p, v in people.items() if p not in taken}
            head = (rows["request_id"].iloc[0], int(role_no), role, slot)
            if not free:
                out.append((*head, None, None, None, NO_CANDIDATE))
                continue
            value = {p: _penalised(s, t, covered, weight) for p, (s, t) in free.items()}
            pick = max(free, key=lambda p: (value[p], free[p][0], p))
            taken.add(pick)
            covered |= free[pick][1]
            out.append((*head, pick, free[pick][0], value[pick], None))
    names = [f.split()[0] for f in SELECTION.split(", ")]
    return pd.DataFrame(out, columns=names)


def _penalised(score: float, terms: frozenset, covered: set, weight: float) -> float:
    together = len(terms | covered)
    overlap = len(terms & covered) / together if together else 0.0
    return max(0.0, score - weight * overlap)


def aggregate_score(selection: DataFrame) -> DataFrame:
    """Mean selection score per request, 0 without assignments (M6)."""
    return selection.groupBy("request_id").agg(
        F.coalesce(F.avg("selection_score"), F.lit(0.0)).alias("aggregate_score"),
        F.count("person_id").alias("assigned"),
        F.count_if(F.col("person_id").isNull()).alias("unfilled"),
    )
