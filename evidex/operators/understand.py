"""Query understanding over a query table (Q1-Q13)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import constants as K
from evidex.functions.sequences import similar_pairs
from evidex.functions.text import (
    bind,
    comparison_forms,
    contains_term,
    normalize_name,
    phrases,
    split_words,
)
from evidex.operators.parse import Provider, complete
from evidex.operators.structured import substrings_by_text, text_digest
from evidex.schemas import LIST_FIELDS, QUERY
from evidex.session import cut_lineage

_INTENT = (
    "struct<role:string,seniority:string,"
    "location:struct<country:string,city:string,cities:array<string>>,"
    "min_years_experience:double,min_age:int,max_age:int,"
    + ",".join(f"{f}:array<string>" for f in LIST_FIELDS if f != "cities")
    + ",semantic_query:string>"
)
_STRINGS = "array<string>"


def plain_intents(queries: DataFrame) -> DataFrame:
    """Query table from bare texts (query_id, text): empty intent, text as semantic query."""
    typed = {name: kind for name, kind in (f.strip().split(" ", 1) for f in QUERY.split(","))}
    given = set(queries.columns)
    return queries.select(
        *[
            F.col(name).cast(kind).alias(name) if name in given
            else F.coalesce(F.lit(None).cast(kind), F.col("text")).alias(name)
            if name == "semantic_query"
            else F.array().cast(kind).alias(name) if kind.startswith("array")
            else F.lit(None).cast(kind).alias(name)
            for name, kind in typed.items()
        ]
    )


def parse_intents(queries: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """Free text -> intent columns through a provider (Q1): (query table, failed queries).

    The provider answers each text with JSON of the intent schema.
    """
    answered = cut_lineage(queries.withColumn("answer", complete(F.col("text"), provider)))
    shaped = answered.withColumn("i", F.from_json("answer", _INTENT))
    ok = F.coalesce(F.startswith(F.to_json(F.try_parse_json("answer")), F.lit("{")), F.lit(False))
    ages = F.coalesce(
        (F.coalesce("i.min_age", F.lit(14)).between(14, 100))
        & (F.coalesce("i.max_age", F.lit(14)).between(14, 100))
        & (F.coalesce("i.min_years_experience", F.lit(0.0)) >= 0),
        F.lit(False),
    )
    good = shaped.filter(ok & ages)
    empty = F.array().cast(_STRINGS)
    lists = [
        F.coalesce("i.location.cities" if f == "cities" else f"i.{f}", empty).alias(f)
        for f in LIST_FIELDS
    ]
    table = good.select(
        "query_id", "text", "i.role", "i.seniority", "i.location.country", "i.location.city",
        "i.min_years_experience", "i.min_age", "i.max_age", *lists,
        F.coalesce("i.semantic_query", "text").alias("semantic_query"),
    )
    return plain_intents(table), shaped.filter(~(ok & ages)).select("query_id", "text")


#: Phrases and keys that a task compares at once. Forms of a pair of such blocks meet in one call.
PHRASES, KEYS = 1 << 14, 1 << 14


def similar_forms(left: DataFrame, right: DataFrame, threshold: float = K.FUZZY_RATIO) -> DataFrame:
    """(phrase, key, ratio) of the rows whose forms have a sequence similarity at the threshold (Q4).

    ``left``: phrase, left_form; ``right``: key, right_form. Both are dealt to blocks by hash, and each
    block of phrases meets each block of keys, so that a task holds two blocks whatever the tables'
    sizes. Within blocks lengths, letters and common subsequences leave few pairs to compare.
    """
    # Nearly all forms are the phrases themselves, which are written and moved once.
    other = F.nullif("left_form", "phrase").alias("other")
    asked = cut_lineage(left.filter("length(left_form) > 0").select("phrase", other))
    known = cut_lineage(right.filter("length(right_form) > 0"))
    parts = -(-asked.count() // PHRASES) or 1
    blocks = -(-known.count() // KEYS) or 1

    def block(n: int, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    ours = asked.withColumn("part", block(parts, "phrase", "other")).withColumn("block", every(blocks))
    theirs = known.withColumn("block", block(blocks, "key", "right_form")).withColumn("part", every(parts))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        phrases, keys = a["phrase"].to_pylist(), b["key"].to_pylist()
        forms = [form or phrase for form, phrase in zip(a["other"].to_pylist(), phrases, strict=True)]
        pairs = similar_pairs(forms, b["right_form"].to_pylist(), threshold)
        rows = [(phrases[i], keys[j], ratio) for i, j, ratio in pairs]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        types = (pa.string(), pa.string(), pa.float64())
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["phrase", "key", "ratio"]
        )

    together = ours.groupBy("part", "block").cogroup(theirs.groupBy("part", "block"))
    return together.applyInArrow(compare, "phrase string, key string, ratio double")


def fuzzy_pairs(
    asked: DataFrame, known: DataFrame, threshold: float = K.FUZZY_RATIO
) -> DataFrame:
    """(phrase, key, ratio): best similarity over the comparison forms of both (Q4, Q5).

    ``asked``: phrase; ``known``: key; both normalised.
    """
    left = asked.select("phrase", F.explode(comparison_forms(F.col("phrase"))).alias("left_form"))
    right = known.select("key", F.explode(comparison_forms(F.col("key"))).alias("right_form"))
    return similar_forms(left, right, threshold).groupBy("phrase", "key").agg(F.max("ratio").alias("ratio"))


def _alias_frame(df: DataFrame, aliases: Mapping[str, Mapping[str, str]]) -> DataFrame:
    rows = [(kind, a, t) for kind, table in aliases.items() for a, t in table.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, phrase string, key string")


DEFAULT_GROUNDING = {"city": K.GROUNDING_CITY_ALIASES, "company": K.GROUNDING_COMPANY_ALIASES}


def detect_vocabulary(
    queries: DataFrame,
    vocabulary: DataFrame,
    aliases: Mapping[str, Mapping[str, str]] = DEFAULT_GROUNDING,
    unicode: bool = True,
    threshold: float = K.FUZZY_RATIO,
) -> DataFrame:
    """Vocabulary values a query names (Q2, Q3): query_id, kind, value.

    A value is found as a substring of the normalised text, through an alias phrase, or by a
    phrase of four letters or more that is similar enough. Texts and their phrases grow with the
    queries and are many times what Spark guesses of them: they are written once, and joined by
    sorting, never sent through the driver. Each part is written as it is found, so that the shuffle
    files of one part are gone before the next.
    """
    dealt = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism, "query_id")
    texts = cut_lineage(dealt.select("query_id", normalize_name(F.col("text"), unicode).alias("norm")))
    known = cut_lineage(vocabulary.select(
        "kind", "value", normalize_name(F.col("value"), unicode).alias("key")
    ).filter("key <> ''"))
    spoken = cut_lineage(
        texts.withColumn("phrase", F.explode(phrases(F.col("norm")))).select("query_id", "phrase")
    )
    inside = (
        substrings_by_text(texts, known, "norm", "key")
        .join(texts.select("query_id", text_digest("norm").alias("digest")).hint("merge"), "digest")
        .select("query_id", F.explode("found").alias("key"))
        .join(known, "key")
    )
    parts = [inside]
    if any(aliases.values()):
        named = spoken.join(F.broadcast(_alias_frame(queries, aliases)), "phrase")
        parts.append(named.select("query_id", "kind", "key").join(known, ["kind", "key"]))
    long_enough = spoken.filter(F.length("phrase") >= K.FUZZY_MIN_LENGTH)
    close = cut_lineage(
        fuzzy_pairs(long_enough.select("phrase").distinct(), known.select("key").distinct(), threshold)
    )
    parts.append(
        long_enough.hint("merge").join(close, "phrase").select("query_id", "key").join(known, "key")
    )
    found = [p.select("query_id", "kind", "value") for p in parts]
    return reduce(DataFrame.unionByName, found).distinct()


def best_match(
    values: DataFrame,
    vocabulary: DataFrame,
    aliases: Mapping[str, str] | None = None,
    unicode: bool = True,
    threshold: float = K.FUZZY_RATIO,
) -> DataFrame:
    """Best vocabulary value per requested value (Q6): value, match (null without one)."""
    key = normalize_name(F.col("value"), unicode)
    asked = values.select("value").distinct().withColumn("plain", key)
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        phrase = F.coalesce(F.try_element_at(table, F.col("plain")), F.col("plain"))
    else:
        phrase = F.col("plain")
    asked = asked.withColumn("phrase", phrase)
    known = vocabulary.select(
        F.col("value").alias("choice"), normalize_name(F.col("value"), unicode).alias("key")
    )
    exact = asked.join(known, F.col("phrase") == F.col("key")).select(
        "value", "choice", F.lit(2.0).alias("ratio")
    )
    close = (
        fuzzy_pairs(asked.select("phrase").distinct(), known.select("key").distinct(), threshold)
        .join(known, "key")
        .join(asked, "phrase")
        .select("value", "choice", "ratio")
    )
    best = exact.unionByName(close).groupBy("value").agg(
        F.max_by("choice", F.struct("ratio", "choice")).alias("match")
    )
    return values.select("value").distinct().join(best, "value", "left")


def ground_intents(
    queries: DataFrame,
    vocabulary: DataFrame,
    aliases: Mapping[str, Mapping[str, str]] = DEFAULT_GROUNDING,
    unicode: bool = True,
) -> DataFrame:
    """Keep only constraints the corpus knows and the text names (Q7).

    Location and companies become the detected values; required lists are intersected with
    them. ``unmatched_terms`` lists requested values that were dropped.
    """
    found = detect_vocabulary(queries, vocabulary, aliases, unicode)

    def of(kind: str) -> Column:
        values = F.collect_list(F.when(F.col("kind") == kind, F.col("value")))
        return F.sort_array(values).alias(f"seen_{kind}")

    seen = found.groupBy("query_id").agg(*[of(k) for k in ("city", "country", "company")])
    lists = {
        "required_skills": "skill",
        "required_technologies": "technology",
        "required_domains": "domain",
    }
    asked = reduce(
        DataFrame.unionByName,
        [
            queries.select(
                "query_id", F.lit(field).alias("field"), F.lit(kind).alias("kind"),
                F.posexplode(field).alias("pos", "name"),
            )
            for field, kind in lists.items()
        ]
        + [
            queries.select(
                "query_id", F.lit("companies").alias("field"), F.lit("company").alias("kind"),
                F.posexplode("companies").alias("pos", "name"),
            )
        ],
    ).withColumn("key", normalize_name(F.col("name"), unicode))
    named = found.withColumn("key", normalize_name(F.col("value"), unicode)).groupBy(
        "query_id", "kind", "key"
    ).agg(F.max("value").alias("value"))
    matched = asked.join(named, ["query_id", "kind", "key"], "left")

    def kept(field: str) -> Column:
        rows = F.collect_list(
            F.when(
                (F.col("field") == field) & F.col("value").isNotNull(), F.struct("pos", "value")
            )
        )
        return F.array_distinct(
            F.transform(F.sort_array(rows), lambda r: r["value"])
        ).alias(f"kept_{field}")

    lost = F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("name"))))
    grounded = matched.groupBy("query_id").agg(
        *[kept(f) for f in lists], lost.alias("unmatched_terms")
    )
    empty = F.array().cast(_STRINGS)
    cities = F.coalesce("seen_city", empty)
    countries = F.coalesce("seen_country", empty)
    joined = queries.join(seen, "query_id", "left").join(grounded, "query_id", "left")
    columns = {
        "cities": cities,
        "city": F.get(cities, 0),
        "country": F.get(countries, 0),
        "companies": F.coalesce("seen_company", empty),
        "unmatched_terms": F.coalesce("unmatched_terms", empty),
        **{f: F.coalesce(f"kept_{f}", empty) for f in lists},
    }
    return joined.withColumns(columns).select(*queries.columns, "unmatched_terms")


def _any_term(words: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [contains_term(words, t) for t in terms])


def _listed(table: Mapping[str, tuple[str, ...]], words: Column) -> Column:
    """Values of all triggers found, in table order."""
    empty = F.array().cast(_STRINGS)
    return F.concat(
        *[
            F.when(contains_term(words, trigger), F.array(*map(F.lit, values))).otherwise(empty)
            for trigger, values in table.items()
        ]
    )


def _add(values: Column, *extra: str) -> Column:
    return F.array_distinct(F.concat(values, F.array(*map(F.lit, extra))))


def _age(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def enrich_intents(queries: DataFrame, unicode: bool = True) -> DataFrame:
    """Deterministic additions from the text (Q9-Q13): expansions, cities, requirements, ages."""
    prepared = queries.withColumn("_norm", normalize_name(F.col("text"), unicode)).withColumn(
        "_words", split_words(F.col("_norm"))
    )
    norm, words = F.col("_norm"), F.col("_words")
    flagged = prepared.withColumns(
        {
            "_more": _listed(K.SEMANTIC_EXPANSIONS, words),
            "_seen": F.array_distinct(_listed({a: (c,) for a, c in K.CITY_FORMS.items()}, words)),
            "_age": reduce(
                lambda a, b: a | b, [F.contains(norm, F.lit(m)) for m in K.AGE_MARKERS]
            ),
            "_mlops": _any_term(words, K.MLOPS_TERMS),
            "_python": _any_term(words, K.PYTHON_TERMS),
            "_mts": _any_term(words, K.MTS_TERMS),
        }
    )
    start = F.coalesce(F.nullif("semantic_query", F.lit("")), F.col("text"))
    cities = F.array_distinct(F.concat("cities", "_seen"))
    skills = F.when(F.col("_mlops"), _add(F.col("required_skills"), "MLOps")).otherwise(
        F.col("required_skills")
    )
    columns = {
        "semantic_query": F.array_join(F.array_distinct(F.concat(F.array(start), "_more")), " "),
        "preferred_technologies": F.when(
            F.size("_more") > 0, _add(F.col("preferred_technologies"), *K.EXPANSION_PREFERENCES)
        ).otherwise(F.col("preferred_technologies")),
        "cities": cities,
        "city": F.coalesce(F.nullif("city", F.lit("")), F.get(cities, 0)),
        "required_skills": F.when(F.col("_python"), _add(skills, "Python")).otherwise(skills),
        "required_technologies": F.when(
            F.col("_mlops"),
            F.filter(
                "required_technologies", lambda t: normalize_name(t, unicode=False) != "mlops"
            ),
        ).otherwise(F.col("required_technologies")),
        "preferred_skills": F.when(
            F.col("_mlops"), _add(F.col("preferred_skills"), "Machine Learning")
        ).otherwise(F.col("preferred_skills")),
        "companies": F.when(F.col("_mts"), _add(F.col("companies"), K.MTS_COMPANY)).otherwise(
            F.col("companies")
        ),
        "min_years_experience": F.when(~F.col("_age"), F.col("min_years_experience")),
        "min_age": F.coalesce(
            _age(norm, K.AGE_OLDER_THAN) + 1, _age(norm, K.AGE_FROM), F.col("min_age")
        ),
        "max_age": F.coalesce(
            _age(norm, K.AGE_YOUNGER_THAN) - 1, _age(norm, K.AGE_UP_TO), F.col("max_age")
        ),
    }
    return flagged.withColumns(columns).select(*queries.columns)


def understand(
    queries: DataFrame,
    vocabulary: DataFrame | None = None,
    provider: Provider | None = None,
    unicode: bool = True,
) -> DataFrame:
    """Texts to intents: provider or plain, then grounding, then enrichment.

    A text whose provider answer fails gets the plain intent, so no query is lost.
    """
    if provider is None:
        intents = plain_intents(queries)
    else:
        parsed, failed = parse_intents(queries, provider)
        plain = plain_intents(failed.select("query_id", "text"))
        intents = parsed.unionByName(plain.select(*parsed.columns))
    if vocabulary is not None:
        intents = ground_intents(intents, vocabulary, unicode=unicode).drop("unmatched_terms")
    return enrich_intents(intents, unicode)
