"""Records out of documents: field mapping, coercion, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidex.functions.constants import UNSAFE_MARKERS
from evidex.functions.text import blank_to_null, is_unsafe, strip
from evidex.schemas import ERROR, EXTRACTED
from evidex.session import cut_lineage, spread

FIELDS = (
    "full_name", "location", "country", "current_title", "years_experience", "age", "summary",
    "experience", "skills", "technologies", "education", "projects", "domains",
)
LIST_PATTERN = "\\s*[;,|]\\s*"
_INTEGER = "^[+-]?[0-9]+$"

Provider = Callable[[Sequence[str]], Sequence[str]]


def _path(dotted: str) -> str:
    return "$" + "".join(f"['{part}']" for part in dotted.split("."))


def text_at(value: Column, *paths: str) -> Column:
    """First non-blank text among dotted paths (B1, B2)."""
    found = [blank_to_null(F.try_variant_get(value, _path(p), "string")) for p in paths]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _error(condition: Column, kind: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        condition, F.struct(F.lit(kind).alias("error_type"), text.alias("message"))
    )


def _float(value: Column, path: str) -> tuple[Column, Column]:
    text = text_at(value, path)
    number = text.try_cast("double")
    return number, _error(
        text.isNotNull() & number.isNull(),
        "ValueError",
        F.concat(F.lit("could not convert string to float: "), text),
    )


def _integer(value: Column, path: str) -> tuple[Column, Column]:
    """JSON numbers are truncated; text must be a whole number."""
    text = text_at(value, path)
    kind = F.schema_of_variant(F.try_variant_get(value, _path(path), "variant"))
    number = F.when(
        kind == "STRING", F.when(F.rlike(text, F.lit(_INTEGER)), text.try_cast("int"))
    ).otherwise(text.try_cast("double").try_cast("int"))
    return number, _error(
        text.isNotNull() & number.isNull(),
        "ValueError",
        F.concat(F.lit("invalid literal for int(): "), text),
    )


def _items(value: Column, path: str) -> tuple[Column, Column]:
    """A list, or text holding a JSON list, as array<variant>; else failure."""
    at = _path(path)
    text = F.try_variant_get(value, at, "string")
    direct = F.try_variant_get(value, at, "array<variant>")
    encoded = F.try_variant_get(
        F.try_parse_json(F.when(F.startswith(strip(text), F.lit("[")), strip(text))),
        "$",
        "array<variant>",
    )
    return F.coalesce(direct, encoded), text


def string_list(value: Column, path: str) -> Column:
    """List, JSON-encoded list, separated text or scalar -> trimmed non-blank items."""
    items, text = _items(value, path)
    listed = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    divided = F.when(~F.startswith(strip(text), F.lit("[")), F.split(strip(text), LIST_PATTERN))
    whole = F.coalesce(listed, divided, F.array().cast("array<string>"))
    trimmed = F.transform(whole, strip)
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def _bad_string_list(value: Column, path: str) -> Column:
    items, text = _items(value, path)
    return _error(
        F.startswith(strip(text), F.lit("[")) & items.isNull(), "ValueError", "Expected a JSON list"
    )


def _object_list(
    value: Column, path: str, what: str, key: str, build: Callable[[Column], Column],
    names: Sequence[str],
) -> tuple[Column, Column]:
    """Objects with a required name (B5-B7) and the first failure among them."""
    items, text = _items(value, path)
    empty = text.isNull() | (text == "")
    built = F.coalesce(F.transform(items, build), F.array())
    not_object = F.exists(
        items,
        lambda x: ~F.coalesce(F.startswith(F.to_json(x), F.lit("{")), F.lit(False)),
    )
    nameless = F.exists(items, lambda x: text_at(x, *names).isNull())
    error = F.coalesce(
        _error(
            ~empty & items.isNull(), "ValueError", "Expected a list or a JSON-encoded list"
        ),
        _error(not_object, "ValueError", f"Every {what} item must be an object"),
        _error(nameless, "ValueError", f"{what.capitalize()} item has no {key}"),
    )
    return built, error


def _experience(item: Column) -> Column:
    return F.struct(
        text_at(item, "company", "company_name", "employer").alias("company"),
        text_at(item, "title", "role").alias("title"),
        text_at(item, "start_date", "start").alias("start_date"),
        text_at(item, "end_date", "end").alias("end_date"),
        text_at(item, "description", "summary").alias("description"),
        string_list(item, "domains").alias("domains"),
        string_list(item, "technologies").alias("technologies"),
    )


def _education(item: Column) -> Column:
    return F.struct(
        text_at(item, "university", "institution", "school").alias("university"),
        text_at(item, "country").alias("country"),
        text_at(item, "degree").alias("degree"),
        text_at(item, "field_of_study", "field").alias("field_of_study"),
    )


def _project(item: Column) -> Column:
    return F.struct(
        text_at(item, "name", "project_name").alias("name"),
        text_at(item, "description", "summary").alias("description"),
        string_list(item, "technologies").alias("technologies"),
        string_list(item, "domains").alias("domains"),
    )


def range_error(years: Column, age: Column) -> Column:
    """Range constraints of a record."""
    return F.coalesce(
        _error(
            (years < 0) | F.isnan(years), "ValidationError",
            "years_experience must be greater than or equal to 0",
        ),
        _error(
            (age < 14) | (age > 100), "ValidationError", "age must be between 14 and 100"
        ),
    )


def parse_records(
    documents: DataFrame, mapping: Mapping[str, str] | None = None, write_once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Structured documents -> (documents with ``resume``, quarantine).

    ``mapping`` replaces the dotted path of any of the 13 fields. No record raises: a
    failing one lands in quarantine with the first error of its checks. ``write_once``
    parses into a written table, for callers that read both results. Parsing is the longest
    step of an ingestion, so documents out of few files are dealt to all cores first.
    """
    documents = spread(documents, "external_id", "payload")
    at = {name: name for name in FIELDS} | dict(mapping or {})
    unknown = set(at) - set(FIELDS)
    if unknown:
        raise ValueError(f"Unknown mapping fields: {sorted(unknown)}")
    v = F.col("_v")
    name = text_at(v, at["full_name"], "name", "candidate_name")
    years, bad_years = _float(v, at["years_experience"])
    age, bad_age = _integer(v, at["age"])
    experience, bad_experience = _object_list(
        v, at["experience"], "experience", "company", _experience,
        ("company", "company_name", "employer"),
    )
    education, bad_education = _object_list(
        v, at["education"], "education", "university", _education,
        ("university", "institution", "school"),
    )
    projects, bad_projects = _object_list(
        v, at["projects"], "project", "name", _project, ("name", "project_name")
    )
    resume = F.struct(
        name.alias("full_name"),
        text_at(v, at["location"]).alias("location"),
        text_at(v, at["country"]).alias("country"),
        text_at(v, at["current_title"], "title", "job_title").alias("current_title"),
        years.alias("years_experience"),
        age.alias("age"),
        text_at(v, at["summary"], "profile", "about").alias("summary"),
        experience.alias("experience"),
        string_list(v, at["skills"]).alias("skills"),
        string_list(v, at["technologies"]).alias("technologies"),
        education.alias("education"),
        projects.alias("projects"),
        string_list(v, at["domains"]).alias("domains"),
    ).cast(EXTRACTED)
    error = F.coalesce(
        _error(
            name.isNull(), "ValueError",
            F.concat(F.lit("Resume "), F.col("external_id"), F.lit(" has no full name")),
        ),
        bad_years,
        bad_age,
        bad_experience,
        *[_bad_string_list(v, at[f]) for f in ("skills", "technologies")],
        bad_education,
        bad_projects,
        _bad_string_list(v, at["domains"]),
        range_error(years, age),
    ).cast(ERROR)
    parsed = (
        documents.withColumn("_v", F.try_parse_json("payload"))
        .withColumns({"resume": resume, "error": error})
        .drop("_v")
    )
    return split_errors(cut_lineage(parsed) if write_once else parsed)


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantine rows of a frame with an ``error`` struct."""
    valid = parsed.filter("error is null").drop("error")
    quarantine = parsed.filter("error is not null").select(
        "source", "external_id", "file", "error.error_type", "error.message"
    )
    return valid, quarantine


def guard_text(
    documents: DataFrame,
    max_characters: int = 200_000,
    markers: Sequence[str] | None = UNSAFE_MARKERS,
) -> DataFrame:
    """Add an ``error`` for over-long or unsafe text (B15, B16). ``markers=None`` skips the latter."""
    checks = [
        _error(
            F.length("raw_text") > max_characters,
            "ValueError",
            F.concat(
                F.lit("Resume text exceeds input limit ("), F.length("raw_text").cast("string"),
                F.lit(f" > {max_characters})"),
            ),
        )
    ]
    if markers:
        checks.append(
            _error(
                is_unsafe(F.col("raw_text"), markers),
                "ValueError",
                "Document was rejected: it contains prompt-injection-like instructions",
            )
        )
    return documents.withColumn("error", F.coalesce(*checks).cast(ERROR))


def complete(prompt: Column, provider: Provider) -> Column:
    """Answers of a text provider to a column of prompts, batch by batch.

    The provider gets a list of prompts and returns as many answers. An exception or a
    wrong count leaves the answers of that batch null; judging answers is left to Catalyst.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_answers(provider, batch.tolist()), dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())(prompt)


def _answers(provider: Provider, prompts: list[str]) -> list[str | None]:
    try:
        answers = list(provider(prompts))
    except Exception:  # noqa: BLE001 - one failing batch must not end the job
        return [None] * len(prompts)
    return answers if len(answers) == len(prompts) else [None] * len(prompts)


def extract_records(
    documents: DataFrame,
    provider: Provider,
    max_characters: int = 200_000,
    markers: Sequence[str] | None = UNSAFE_MARKERS,
) -> tuple[DataFrame, DataFrame]:
    """Free text -> records through an extraction provider.

    The provider returns JSON text of the record schema; provenance stays that of the
    document. Guarded documents never reach the provider.
    """
    safe, refused = split_errors(guard_text(documents, max_characters, markers))
    # Model calls are made once: the answers are cut from their lineage before being judged.
    joined = cut_lineage(safe.withColumn("answer", complete(F.col("raw_text"), provider)))
    resume = F.from_json("answer", EXTRACTED)
    closed = _unknown_keys(F.try_parse_json("answer"))
    record = joined.withColumn("resume", resume).withColumn("closed", closed)
    lists = ("experience", "skills", "technologies", "education", "projects", "domains")
    filled = record.withColumn(
        "resume",
        F.when(
            F.col("resume").isNotNull(),
            F.struct(
                strip(F.col("resume.full_name")).alias("full_name"),
                *[
                    F.coalesce(f"resume.{f}", F.array()).alias(f) if f in lists
                    else F.col(f"resume.{f}").alias(f)
                    for f in FIELDS[1:]
                ],
            ),
        ).cast(EXTRACTED),
    )
    error = F.coalesce(
        _error(
            F.try_parse_json("answer").isNull() | F.col("closed"),
            "ValidationError", "Provider output does not match the record schema",
        ),
        _error(
            blank_to_null(F.col("resume.full_name")).isNull(), "ValueError",
            F.concat(F.lit("Resume "), F.col("external_id"), F.lit(" has no full name")),
        ),
        range_error(F.col("resume.years_experience"), F.col("resume.age")),
    ).cast(ERROR)
    good, bad = split_errors(filled.withColumn("error", error).drop("answer", "closed"))
    return good, refused.unionByName(bad)


def _unknown_keys(value: Column) -> Column:
    """True when the provider's object has keys outside the closed schema."""
    keys = F.json_object_keys(F.to_json(value))
    return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, F.lit(True))
