"""File sources (A1-A9). Every reader returns documents plus a quarantine table.

Documents have the columns of ``schemas.DOCUMENT``. ``seq`` is the order in which a batch
is applied: it grows along each file and is unique within one read.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import blank_to_null, strip

ID_FIELDS = ("external_id", "id", "email")
SUPPORTED_SUFFIXES = (".csv", ".json", ".jsonl", ".txt", ".md")
QUARANTINE = "source string, external_id string, file string, error_type string, message string"
_BOM = "\ufeff"


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _default_source(kind: str, source_name: str | None, file: Column) -> Column:
    return F.lit(source_name) if source_name else F.concat(F.lit(f"{kind}:"), file)


def external_id(fields: Sequence[Column], raw_text: Column) -> Column:
    """First non-blank id field, else a checksum of the record."""
    fallback = F.concat(F.lit("checksum:"), F.sha2(raw_text, 256))
    return F.coalesce(*[blank_to_null(f) for f in fields], fallback)


def stable_raw_text(json_text: Column) -> Column:
    """Canonical JSON: keys sorted, non-ASCII kept."""
    return F.to_json(F.try_parse_json(json_text))


def _quarantine(df: DataFrame, message: str) -> DataFrame:
    return df.select(
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("external_id"),
        F.col("file"),
        F.lit("ValueError").alias("error_type"),
        F.concat(F.lit(message + ": "), F.col("file")).alias("message"),
    )


def _json_documents(
    records: DataFrame, source_name: str | None, id_fields: Sequence[str], kind: str = "json"
) -> DataFrame:
    """``records``: file, seq, record_number, record (JSON object text, keys sorted)."""
    ids = [F.get_json_object("record", f"$.{name}") for name in id_fields]
    return records.select(
        _default_source(kind, source_name, F.col("file")).alias("source"),
        external_id(ids, F.col("record")).alias("external_id"),
        F.lit(kind).alias("document_type"),
        F.col("record").alias("raw_text"),
        F.col("record").alias("payload"),
        F.map_filter(
            F.create_map(
                F.lit("filename"), F.col("file"),
                F.lit("record_number"), F.col("record_number").cast("string"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        "file",
        "seq",
    )


def _headers(
    spark: SparkSession, paths: str | Sequence[str], encoding: str, options: Mapping[str, object]
) -> dict[str, list[str]]:
    """First line of each CSV file: header -> its files. One light scan, whatever the files' number."""
    lines = spark.read.options(**options).option("encoding", encoding).text(paths)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    first = (
        lines.select(F.col("_metadata.file_path").alias("path"), "value", place.alias("place"))
        .groupBy("path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    out: dict[str, list[str]] = {}
    for row in first.orderBy("path").collect():
        out.setdefault(row.header, []).append(unquote(row.path))
    return out


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    source_name: str | None = None,
    id_fields: Sequence[str] = ID_FIELDS,
    multi_line: bool = True,
    row_numbers: bool = False,
    encoding: str = "UTF-8",
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """CSV with a header (A1). Each file has its own; files with equal headers are read together.

    ``multi_line=False`` lets Spark split big files, for cells without line breaks.
    ``row_numbers`` adds the reference numbering (first record is row 2) from the smallest
    record position per file: an aggregate and a join, not a sort of the whole file.
    """
    groups = _headers(spark, paths, encoding, options or {})
    parts = [
        _read_one_header(spark, files, source_name, id_fields, multi_line, row_numbers, encoding)
        for _, files in sorted(groups.items())
    ]
    if not parts:
        raise ValueError(f"No CSV file with a header below {paths}")
    return parts[0] if len(parts) == 1 else merge_documents(parts)


def _read_one_header(
    spark: SparkSession,
    paths: Sequence[str],
    source_name: str | None,
    id_fields: Sequence[str],
    multi_line: bool,
    row_numbers: bool,
    encoding: str,
) -> DataFrame:
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", encoding)
        .csv(paths)
    )
    cells = [c for c in raw.columns if c.strip(_BOM)]
    named = raw.select(
        F.struct(*[F.col(f"`{c}`").alias(c.lstrip(_BOM)) for c in cells]).alias("cells"),
        _file_name().alias("file"),
        F.monotonically_increasing_id().alias("seq"),
    )
    names = [c.lstrip(_BOM) for c in cells]
    ids = [F.col(f"cells.`{f}`") for f in id_fields if f in names]
    text = stable_raw_text(F.to_json("cells"))
    rows = named.withColumn("record", text)
    number: Column = F.lit(None).cast("long")
    if row_numbers:
        first = rows.groupBy("file").agg(F.min("seq").alias("first_seq"))
        rows = rows.join(first, "file")
        number = F.col("seq") - F.col("first_seq") + 2
    return rows.select(
        _default_source("csv", source_name, F.col("file")).alias("source"),
        external_id(ids, F.col("record")).alias("external_id"),
        F.lit("csv").alias("document_type"),
        F.col("record").alias("raw_text"),
        F.col("record").alias("payload"),
        F.map_filter(
            F.create_map(
                F.lit("filename"), F.col("file"), F.lit("row_number"), number.cast("string")
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        "file",
        "seq",
    )


def json_records(files: DataFrame, records_key: str = "records") -> tuple[DataFrame, DataFrame]:
    """Split whole JSON files into records (A2).

    ``files``: file, value. Root list, an object with a list under ``records_key``, or one
    object. A file with another root or a record that is no object is quarantined whole.
    """
    parsed = files.select("file", F.try_parse_json("value").alias("root"))
    listed = F.coalesce(
        F.try_variant_get("root", "$", "array<variant>"),
        F.try_variant_get("root", f"$['{records_key}']", "array<variant>"),
    )
    is_object = F.startswith(F.to_json(F.col("root")), F.lit("{"))
    texts = (
        F.when(F.col("listed").isNotNull(), F.transform("listed", lambda r: F.to_json(r)))
        .when(is_object, F.array(F.to_json("root")))
    )
    shaped = parsed.withColumn("listed", listed).select("file", texts.alias("texts"))
    valid = F.coalesce(
        F.forall("texts", lambda t: F.coalesce(F.startswith(t, F.lit("{")), F.lit(False))),
        F.lit(False),
    )
    checked = shaped.withColumn("valid", valid)
    exploded = checked.filter("valid").select("file", F.posexplode("texts").alias("pos", "record"))
    records = exploded.select(
        "file",
        "record",
        (F.col("pos") + 1).alias("record_number"),
        F.monotonically_increasing_id().alias("seq"),
    )
    rejected = checked.filter(~F.col("valid"))
    return records, _quarantine(rejected, "Unsupported JSON root or record")


def read_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    source_name: str | None = None,
    id_fields: Sequence[str] = ID_FIELDS,
    records_key: str = "records",
) -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON (A2)."""
    files = spark.read.text(paths, wholetext=True).select(_file_name().alias("file"), "value")
    records, rejected = json_records(files, records_key)
    return _json_documents(records, source_name, id_fields), rejected


def jsonl_documents(
    lines: DataFrame, source_name: str | None = None, id_fields: Sequence[str] = ID_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """``lines``: file, value, seq; one object per non-blank line (A3)."""
    rows = lines.filter(strip(F.col("value")) != "").withColumn(
        "record", stable_raw_text(F.col("value"))
    )
    good = F.coalesce(F.startswith("record", F.lit("{")), F.lit(False))
    records = rows.filter(good).withColumn("record_number", F.lit(None).cast("long"))
    return (
        _json_documents(records, source_name, id_fields),
        _quarantine(rows.filter(~good), "Every JSON line must be an object"),
    )


def read_jsonl(
    spark: SparkSession,
    paths: str | Sequence[str],
    source_name: str | None = None,
    id_fields: Sequence[str] = ID_FIELDS,
) -> tuple[DataFrame, DataFrame]:
    """JSON lines (A3); files are splittable."""
    lines = spark.read.text(paths).select(
        _file_name().alias("file"), "value", F.monotonically_increasing_id().alias("seq")
    )
    return jsonl_documents(lines, source_name, id_fields)


def text_documents(
    files: DataFrame, source_name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``files``: file, value; one document per file, empty ones quarantined (A4)."""
    rows = files.withColumn("text", strip(F.col("value"))).withColumn(
        "seq", F.monotonically_increasing_id()
    )
    documents = rows.filter("text <> ''").select(
        _default_source("text", source_name, F.col("file")).alias("source"),
        external_id([], F.col("text")).alias("external_id"),
        F.lit("text").alias("document_type"),
        F.col("text").alias("raw_text"),
        F.to_json(F.struct("text")).alias("payload"),
        F.create_map(F.lit("filename"), F.col("file")).alias("metadata"),
        "file",
        "seq",
    )
    return documents, _quarantine(rows.filter("text = ''"), "Text resume is empty")


def read_text(
    spark: SparkSession, paths: str | Sequence[str], source_name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(paths, wholetext=True).select(_file_name().alias("file"), "value")
    return text_documents(files, source_name)


def merge_documents(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of several reads; ``seq`` keeps the given order of the parts."""
    numbered = [
        part.withColumn("seq", F.col("seq") + F.lit(index).cast("long") * F.lit(1 << 58))
        for index, part in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, numbered)


def read_directory(
    spark: SparkSession,
    path: str,
    source_name: str | None = None,
    recursive: bool = True,
    csv_multi_line: bool = True,
    csv_encoding: str = "UTF-8",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read every supported file below a directory by its suffix (A5).

    Returns documents, quarantine, and the skipped files with an unsupported suffix. The
    file listing is read without file content. Every CSV file is read by its own header.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    ).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
    present = {r.suffix for r in listing.select("suffix").distinct().collect()}

    def paths_of(suffix: str) -> dict[str, object]:
        return {"pathGlobFilter": f"*{_any_case(suffix)}", "recursiveFileLookup": recursive}

    documents: list[DataFrame] = []
    rejected: list[DataFrame] = []
    reader = spark.read
    if ".csv" in present:
        documents.append(
            read_csv(
                spark, path, source_name, multi_line=csv_multi_line, encoding=csv_encoding,
                options=paths_of(".csv"),
            )
        )
    if ".json" in present:
        files = reader.text(path, wholetext=True, **paths_of(".json"))
        records, bad = json_records(files.select(_file_name().alias("file"), "value"))
        documents.append(_json_documents(records, source_name, ID_FIELDS))
        rejected.append(bad)
    if ".jsonl" in present:
        lines = reader.text(path, **paths_of(".jsonl")).select(
            _file_name().alias("file"), "value", F.monotonically_increasing_id().alias("seq")
        )
        good, bad = jsonl_documents(lines, source_name)
        documents.append(good)
        rejected.append(bad)
    for suffix in (".txt", ".md"):
        if suffix in present:
            files = reader.text(path, wholetext=True, **paths_of(suffix))
            good, bad = text_documents(
                files.select(_file_name().alias("file"), "value"), source_name
            )
            documents.append(good)
            rejected.append(bad)
    if not documents:
        raise ValueError(f"No supported file below {path}")
    skipped = listing.filter(~F.col("suffix").isin(*SUPPORTED_SUFFIXES)).select("path")
    bad_rows = rejected or [spark.createDataFrame([], QUARANTINE)]
    return merge_documents(documents), reduce(DataFrame.unionByName, bad_rows), skipped


def _any_case(suffix: str) -> str:
    return "." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix[1:])


def read_archives(
    spark: SparkSession,
    paths: str | Sequence[str],
    max_file_mb: int = 25,
    max_members: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Members of ZIP archives.

    Returns ``members`` (file, archive, member, position, suffix, value) and ``skipped``
    (archive, member, reason). The limits apply to each archive: at most ``max_members``
    files and an unpacked size of four times the file limit. Archives are spread over the
    tasks; a broken one is reported, not raised.
    """
    limit = max_file_mb * 1024 * 1024
    suffixes = SUPPORTED_SUFFIXES

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "position", "suffix", "value", "reason"]
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows = _unpack_one(archive, content, limit, max_members, suffixes)
                for row in rows:
                    yield pd.DataFrame([row], columns=columns)

    schema = (
        "archive string, member string, position int, suffix string, value string, reason string"
    )
    files = (
        spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    )
    small = files.filter(F.col("length") <= limit).select("path", "content")
    unpacked = small.mapInPandas(unpack, schema)
    stem = F.regexp_extract("archive", r"([^/]*?)(\.[^./]*)?$", 1)
    members = unpacked.filter("reason is null").select(
        F.concat(
            F.lit("archive-"), F.substring(stem, 1, 60), F.lit("-"), F.col("position")
        ).alias("source"),
        F.col("member").alias("file"),
        "archive", "position", "suffix", "value",
    )
    too_big = files.filter(F.col("length") > limit).select(
        F.col("path").alias("archive"),
        F.lit(None).cast("string").alias("member"),
        F.lit("Archive is too large").alias("reason"),
    )
    skipped = unpacked.filter("reason is not null").select("archive", "member", "reason")
    return members, skipped.unionByName(too_big)


def _unpack_one(
    archive: str, content: bytes, limit: int, max_members: int, suffixes: Sequence[str]
) -> Iterator[tuple]:
    def refuse(member: str | None, reason: str) -> tuple:
        return (archive, member, None, None, None, reason)

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as opened:
            entries = [e for e in opened.infolist() if not e.is_dir()]
            if len(entries) > max_members or sum(e.file_size for e in entries) > limit * 4:
                yield refuse(None, "Archive contains too much data")
                return
            position = 0
            for entry in entries:
                dot = entry.filename.rfind(".")
                suffix = entry.filename[dot:].lower() if dot >= 0 else ""
                if suffix not in suffixes:
                    yield refuse(entry.filename, "Unsupported suffix")
                    continue
                position += 1
                text = opened.read(entry).decode("utf-8-sig", errors="replace")
                yield (archive, entry.filename, position, suffix, text, None)
            if position == 0:
                yield refuse(None, "Archive has no supported resume files")
    except zipfile.BadZipFile:
        yield refuse(None, "Invalid ZIP archive")


def archive_documents(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse archive members with the same readers as plain files (JSON, JSONL, text, CSV)."""
    of = {s: members.filter(F.col("suffix") == s) for s in SUPPORTED_SUFFIXES}
    tagged = F.concat_ws("\x1f", "source", "file")

    records, bad_json = json_records(of[".json"].select(tagged.alias("file"), "value"))
    json_docs = _json_documents(records, None, ID_FIELDS)
    lines = of[".jsonl"].select(
        tagged.alias("file"), F.explode(F.split("value", "\r?\n")).alias("value")
    ).withColumn("seq", F.monotonically_increasing_id())
    jsonl_docs, bad_lines = jsonl_documents(lines)
    texts = of[".txt"].unionByName(of[".md"]).select(tagged.alias("file"), "value")
    text_docs, bad_text = text_documents(texts)
    csv_docs = _csv_members(of[".csv"].select(tagged.alias("file"), "value"))
    documents = merge_documents([csv_docs, json_docs, jsonl_docs, text_docs])
    source = F.split_part("file", F.lit("\x1f"), F.lit(1))
    name = F.split_part("file", F.lit("\x1f"), F.lit(2))
    documents = documents.select(
        source.alias("source"),
        "external_id", "document_type", "raw_text", "payload",
        F.map_concat(
            F.map_filter("metadata", lambda k, _: k != "filename"),
            F.create_map(F.lit("filename"), name),
        ).alias("metadata"),
        name.alias("file"),
        "seq",
    )
    rejected = bad_json.unionByName(bad_lines).unionByName(bad_text).withColumn("file", name)
    return documents, rejected


def _csv_members(files: DataFrame) -> DataFrame:
    """CSV text per member: header and rows differ by member, so rows become maps."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import json

        for batch in batches:
            for file, value in zip(batch["file"], batch["value"]):
                reader = csv.DictReader(io.StringIO(value))
                texts = [
                    json.dumps({k: v for k, v in row.items() if k is not None and v})
                    for row in reader
                ]
                yield pd.DataFrame(
                    {"file": file, "value": texts, "number": range(2, len(texts) + 2)}
                )

    parsed = files.mapInPandas(rows, "file string, value string, number long")
    records = parsed.select(
        "file",
        stable_raw_text(F.col("value")).alias("record"),
        F.col("number").alias("record_number"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return _json_documents(records, None, ID_FIELDS, kind="csv")
