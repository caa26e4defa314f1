"""Section chunks of a record and their upkeep (D1-D9, D13). All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.constants import WHITESPACE
from evidex.functions.text import checksum, normalize_name, row_id, split_words, strip

_WS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE) + "]"
_STRINGS = "array<string>"


def _label(label: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(strip(text) != "", F.concat(F.lit(f"{label}: "), text))


def _list_label(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def _date_range(start: Column, end: Column) -> Column:
    return F.when(
        start.isNotNull() | end.isNotNull(),
        F.concat(
            F.lit("Dates: "), F.coalesce(start, F.lit("unknown")),
            F.lit(" — "), F.coalesce(end, F.lit("present")),
        ),
    )


def _blocks(*values: Column) -> Column:
    trimmed = F.transform(F.array(*values), strip)
    return F.filter(trimmed, lambda b: b.isNotNull() & (b != ""))


def _section(name: str, header: Column, blocks: Column, key: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("section"),
        header.alias("header"),
        blocks.alias("blocks"),
        F.lit(key).alias("key"),
        value.cast("string").alias("value"),
    )


def sections(r: Column) -> Column:
    """Ordered section drafts of a record: header and labelled blocks."""
    none = F.lit(None)
    summary = _section(
        "summary",
        F.lit("SUMMARY"),
        _blocks(
            F.concat(F.lit("Candidate: "), r["full_name"]),
            _label("Current title", r["current_title"]),
            _label("Location", r["location"]),
            _label("Country", r["country"]),
            _label("Years of experience", r["years_experience"]),
            _label("Age", r["age"]),
            r["summary"],
        ),
        "",
        none,
    )
    experience = F.transform(
        r["experience"],
        lambda e: _section(
            "experience",
            F.concat(F.lit("EXPERIENCE: "), e["company"]),
            _blocks(
                _label("Title", e["title"]),
                _date_range(e["start_date"], e["end_date"]),
                e["description"],
                _list_label("Domains", e["domains"]),
                _list_label("Technologies", e["technologies"]),
            ),
            "company_name",
            e["company"],
        ),
    )
    project = F.transform(
        r["projects"],
        lambda p: _section(
            "project",
            F.concat(F.lit("PROJECT: "), p["name"]),
            _blocks(
                p["description"],
                _list_label("Domains", p["domains"]),
                _list_label("Technologies", p["technologies"]),
            ),
            "project_name",
            p["name"],
        ),
    )
    education = F.transform(
        r["education"],
        lambda e: _section(
            "education",
            F.concat(F.lit("EDUCATION: "), e["university"]),
            _blocks(
                _label("Country", e["country"]),
                _label("Degree", e["degree"]),
                _label("Field", e["field_of_study"]),
            ),
            "university_name",
            e["university"],
        ),
    )
    listed = _blocks(
        _list_label("Skills", r["skills"]),
        _list_label("Technologies", r["technologies"]),
        _list_label("Domains", r["domains"]),
    )
    skills = F.filter(
        F.array(_section("skills", F.lit("SKILLS AND EXPERTISE"), listed, "", none)),
        lambda s: F.size(s["blocks"]) > 0,
    )
    return F.concat(F.array(summary), experience, project, education, skills)


def _state(done: Column, current: Column) -> Column:
    return F.struct(done.alias("done"), current.alias("current"))


def _flush(state: Column) -> Column:
    return F.when(
        state["current"] != "", F.array_append(state["done"], state["current"])
    ).otherwise(state["done"])


def _join_greedily(tokens: Column, limit: Column) -> Column:
    """Join tokens with blanks up to ``limit``; a ``whole`` token stands on its own."""

    def step(state: Column, token: Column) -> Column:
        joined = F.when(state["current"] == "", token["text"]).otherwise(
            F.concat(state["current"], F.lit(" "), token["text"])
        )
        return (
            F.when(
                token["whole"], _state(F.array_append(_flush(state), token["text"]), F.lit(""))
            )
            .when(F.length(joined) <= limit, _state(state["done"], joined))
            .otherwise(_state(_flush(state), token["text"]))
        )

    start = _state(F.array().cast(_STRINGS), F.lit(""))
    return F.aggregate(tokens, start, step, _flush)


def _token(text: Column, whole: Column) -> Column:
    return F.struct(text.alias("text"), whole.alias("whole"))


def _split_long(sentence: Column, limit: Column) -> Column:
    """Words joined up to ``limit``; longer words are cut, full cuts standing alone."""

    def cuts(word: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(word) - 1) / limit).cast("int"))
        return F.transform(
            starts,
            lambda i: _token(
                F.substr(word, i * limit + 1, limit), (i + 1) * limit < F.length(word)
            ),
        )

    return _join_greedily(F.flatten(F.transform(split_words(sentence), cuts)), limit)


def split_block(block: Column, limit: Column) -> Column:
    """A block as pieces of at most ``limit`` characters, cut at sentence ends first."""

    def tokens(sentence: Column) -> Column:
        return F.when(
            F.length(sentence) > limit,
            F.transform(_split_long(sentence, limit), lambda t: _token(t, F.lit(True))),
        ).otherwise(F.array(_token(sentence, F.lit(False))))

    sentences = F.split(block, "(?<=[.!?])" + _WS + "+")
    pieces = _join_greedily(F.flatten(F.transform(sentences, tokens)), limit)
    return F.when(F.length(block) <= limit, F.array(block)).otherwise(pieces)


def pack_blocks(header: Column, blocks: Column, max_characters: int) -> Column:
    """Chunk texts of a section: header plus as many pieces as fit (D3)."""
    if max_characters < 200:
        raise ValueError("max_characters must be at least 200")
    limit = F.greatest(F.lit(max_characters - 2) - F.length(header), F.lit(1))
    pieces = F.flatten(F.transform(blocks, lambda b: split_block(b, limit)))
    gap = F.lit("\n\n")

    def step(state: Column, piece: Column) -> Column:
        joined = F.concat(state["current"], gap, piece)
        return F.when(F.length(joined) <= max_characters, _state(state["done"], joined)).otherwise(
            _state(_flush(state), F.concat(header, gap, piece))
        )

    return F.aggregate(pieces, _state(F.array().cast(_STRINGS), header), step, _flush)


def chunk_records(
    records: DataFrame, max_characters: int = 2_000, unicode: bool = True
) -> DataFrame:
    """Chunks of records (D1-D6): one narrow transformation, no shuffle.

    ``records``: document_id, person_id, source, external_id, resume.
    """
    drafts = F.flatten(
        F.transform(
            sections(F.col("resume")),
            lambda s: F.transform(
                pack_blocks(s["header"], s["blocks"], max_characters),
                lambda content, part: F.struct(
                    s["section"].alias("section"),
                    s["key"].alias("key"),
                    s["value"].alias("value"),
                    content.alias("content"),
                    part.alias("part"),
                ),
            ),
        )
    )
    rows = records.select(
        "document_id", "person_id", "source", "external_id",
        F.posexplode(drafts).alias("ordinal", "draft"),
    )
    is_company = F.col("draft.key") == "company_name"
    company = row_id("company", normalize_name(F.when(is_company, F.col("draft.value")), unicode))
    metadata = F.map_filter(
        F.create_map(
            F.lit("person_id"), F.col("person_id"),
            F.lit("document_id"), F.col("document_id"),
            F.lit("section"), F.col("draft.section"),
            F.lit("source"), F.col("source"),
            F.lit("external_id"), F.col("external_id"),
            F.when(F.col("draft.key") == "", F.lit("name")).otherwise(F.col("draft.key")),
            F.col("draft.value"),
            F.lit("company_id"), F.when(is_company, company),
            F.lit("section_part"), F.col("draft.part").cast("string"),
        ),
        lambda _, value: value.isNotNull(),
    )
    return rows.select(
        row_id("chunk", F.col("document_id"), F.col("ordinal").cast("string")).alias("chunk_id"),
        "document_id",
        "person_id",
        F.col("draft.section").alias("section"),
        "ordinal",
        F.col("draft.content").alias("content"),
        checksum(F.col("draft.content")).alias("content_checksum"),
        metadata.alias("metadata"),
    )


def check_companies(chunks: DataFrame, person_companies: DataFrame) -> DataFrame:
    """Keep ``company_id`` in chunk metadata only for a company linked to the person."""
    held = person_companies.select(
        "person_id", F.col("company_id").alias("held_company")
    )
    cited = F.try_element_at("metadata", F.lit("company_id"))
    joined = chunks.withColumn("cited", cited).join(
        held,
        (chunks["person_id"] == held["person_id"]) & (F.col("cited") == held["held_company"]),
        "left",
    ).drop(held["person_id"])
    kept = F.when(
        F.col("held_company").isNull(), F.map_filter("metadata", lambda k, _: k != "company_id")
    ).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", kept).select(chunks.columns)


def document_states(
    fresh: DataFrame, stored: DataFrame, model: str, dimension: int
) -> DataFrame:
    """Per chunked document: ``state`` unchanged, created or updated."""
    new = fresh.select("document_id", "ordinal", F.col("content_checksum").alias("new_sum"))
    old = stored.select(
        "document_id",
        "ordinal",
        F.col("content_checksum").alias("old_sum"),
        ((F.col("embedding_model") == model) & (F.size("embedding") == dimension)).alias("usable"),
    )
    joined = new.join(old, ["document_id", "ordinal"], "full_outer")
    same = F.coalesce((F.col("new_sum") == F.col("old_sum")) & F.col("usable"), F.lit(False))
    return (
        joined.groupBy("document_id")
        .agg(
            F.bool_and(same).alias("same"),
            F.count("old_sum").alias("n_old"),
            F.count("new_sum").alias("n_new"),
        )
        .filter("n_new > 0")
        .select(
            "document_id",
            F.when(F.col("same"), "unchanged")
            .when(F.col("n_old") == 0, "created")
            .otherwise("updated")
            .alias("state"),
        )
    )


def upsert_chunks(stored: DataFrame, embedded: DataFrame) -> DataFrame:
    """Replace all chunks of the embedded documents (D9); ids depend on document and ordinal."""
    touched = embedded.select("document_id").distinct()
    return stored.join(touched, "document_id", "left_anti").unionByName(
        embedded.select(stored.columns)
    )


def embedding_report(states: DataFrame, failed: DataFrame) -> DataFrame:
    """Counters of an embedding run (D13). ``failed``: ids of documents without vectors."""
    marked = states.join(
        failed.select("document_id", F.lit(True).alias("bad")).distinct(), "document_id", "left"
    )
    ok = F.col("bad").isNull()
    return marked.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(ok & (F.col("state") == s)).alias(s)
            for s in ("created", "updated", "unchanged")
        ],
        F.count_if(~ok).alias("failed"),
    )
