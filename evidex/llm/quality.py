"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts each byte of a text's UTF-8 from the ``ORDER`` - 1 bytes before it, one model per
language; a text starts after zero bytes. Grams are exact integers (one byte each), so orders are
shifts and masks. Documents are dealt once into groups of bounded size. Each group counts the grams
of its trusted texts and lists those of all its texts; the counts meet in shards, where DataFrame
joins of counts, context sums and lower orders give every gram of the corpus its probability;
shards answer each group for the grams it listed, and the group sums its documents.

A document is kept if its perplexity per byte is at most the ``QUANTILE`` of its language, taken
over trusted documents outside the training folds (over all trusted ones of a language without
such documents).

Defined cases: null text is empty; an empty text has perplexity 1 and is kept; a null language is a
language of its own; a language without trusted text has no threshold and keeps its documents
(perplexity 256, the uniform model); a row is trusted if any label row of its id says quality 1
and none says 0; null ids are never trusted; repeated rows each count; extra columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import cut_lineage

ORDER = 5
QUANTILE = 0.99
#: One fold of so many calibrates the thresholds, the others train.
FOLDS = 5
GROUP_BYTES = 8 << 20
#: Bytes of text whose grams a task looks at together.
CHUNK_BYTES = 1 << 20
#: A language's discounts are shipped to all tasks; more languages than this are refused.
MAX_LANGUAGES = 10_000
#: Shards per group: a shard holds the grams whose hash names it.
SHARDS_PER_GROUP = 0.5


def grams(data: bytes, order: int) -> np.ndarray:
    """Per byte: it and the ``order`` - 1 bytes before it, as one number."""
    padded = np.frombuffer(b"\0" * (order - 1) + data, dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(data), dtype=np.int64)
    for i in range(order):
        out = out << 8 | padded[i : i + len(data)]
    return out


def _chunks(texts: list[bytes]) -> list[list[int]]:
    out, size = [[]], 0
    for i, text in enumerate(texts):
        if size >= CHUNK_BYTES:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(text)
    return out


def _joined(texts: list[bytes], order: int) -> np.ndarray:
    return np.concatenate([grams(t, order) for t in texts]) if texts else np.zeros(0, dtype=np.int64)


#: What a group lists per shard (differences of sorted grams, their trusted counts), and the answer.
LISTED, ANSWERED = ("<i8", "<i8"), ("<f4",)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers (high bytes are alike), compressed."""
    raw = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.compress(b"".join(raw), 3)


def _unpack(data: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(types, widths, strict=True):
        part = raw[at : at + n * width].reshape(width, n).T
        out.append(np.ascontiguousarray(part).view(kind).ravel())
        at += n * width
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def _distinct(texts: list[bytes], order: int) -> np.ndarray:
    """The grams of some texts, sorted."""
    found = [pd.unique(_joined([texts[i] for i in chunk], order)) for chunk in _chunks(texts)]
    return np.unique(np.concatenate(found))


def _by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places) of sorted ``keys``; places of a shard ascend."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(keys) else []
    return [(int(shard[part[0]]), part) for part in parts]


def _shard(keys: np.ndarray | Column, shards: int) -> np.ndarray | Column:
    """Shard of grams, the same for numpy and for Spark."""
    return keys % 1_000_003 % shards


def _deal(rows: DataFrame, n: int) -> DataFrame:
    """Documents packed per (task, group) into compressed Arrow streams, then dealt by group."""

    def pack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            b = batch.column("b").to_numpy()
            order = np.argsort(b, kind="stable")
            sorted_rows = batch.take(pa.array(order)).select(["doc_id", "lang", "text"])
            starts = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0]) if len(b) else np.zeros(0, int)
            blobs = []
            for start, end in zip(starts, np.r_[starts[1:], len(b)], strict=False):
                out = io.BytesIO()
                options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
                with pa.ipc.new_stream(out, sorted_rows.schema, options=options) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([c.slice(start, end - start)]) for c in sorted_rows.columns],
                        schema=sorted_rows.schema,
                    ))
                blobs.append(out.getvalue())
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[order][starts], pa.int32()), pa.array(blobs, pa.binary())], ["b", "docs"]
            )

    return rows.mapInArrow(pack, "b int, docs binary").repartition(n, "b")


def _documents(group: pd.DataFrame) -> tuple[list, list[str], list[bytes]]:
    tables = [pa.ipc.open_stream(x).read_all() for x in group["docs"]]
    if not tables:
        return [], [], []
    table = pa.concat_tables(tables)
    ids, langs = table.column("doc_id").to_pylist(), table.column("lang").to_pylist()
    return ids, langs, [(t or "").encode() for t in table.column("text").to_pylist()]


def _by_language(langs: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        out.setdefault(lang, []).append(i)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts.

    Where those are too few, or give no discount between 0 and the count, the fixed one stands in:
    a discount of 0 would leave nothing for grams that a context has not seen.
    """
    fixed = (0.5, 1.0, 1.5)
    if not (n1 and n2 and n3 and n4):
        return fixed
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < i else f for i, (d, f) in enumerate(zip(found, fixed, strict=True), 1))


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, logp of every gram of ``counts`` (lang, gram, c; c = 0: seen in no trusted text).

    Order by order: p = (c - D(c)) / sum + gamma x p of the gram without its first byte, where c
    of lower orders counts distinct left neighbours and D is one of the three modified discounts.
    """
    spark = counts.sparkSession
    tables = {order: counts}
    for m in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")
        neighbours = F.sum((F.col("c") > 0).cast("long")).alias("c")
        tables[m] = cut_lineage(tables[m + 1].groupBy("lang", shorter).agg(neighbours))
    p: DataFrame | None = None
    for m in range(1, order + 1):
        of_count = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        found = tables[m].groupBy("lang").agg(*of_count).limit(MAX_LANGUAGES + 1).collect()
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        discount = spark.createDataFrame(
            [(r.lang, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in found], "lang string, d1 double, d2 double, d3 double"
        )
        table = tables[m].withColumn("context", F.shiftright("gram", 8))
        contexts = table.groupBy("lang", "context").agg(
            F.sum("c").alias("total"),
            F.sum((F.col("c") == 1).cast("long")).alias("n1"),
            F.sum((F.col("c") == 2).cast("long")).alias("n2"),
            F.sum((F.col("c") > 2).cast("long")).alias("n3"),
        )
        table = table.join(contexts, ["lang", "context"]).join(F.broadcast(discount), "lang")
        if p is None:
            table = table.withColumn("lower", F.lit(1 / 256))
        else:
            table = table.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1)))
            table = table.join(p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.greatest(F.col("c") - less, F.lit(0.0))
        spread = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
        seen = (own + spread * F.col("lower")) / F.col("total")
        p = cut_lineage(
            table.select("lang", "gram", F.when(F.col("total") > 0, seen).otherwise(F.col("lower")).alias("p"))
        )
    return p.select("lang", "gram", F.log("p").alias("logp"))


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, calibrates (trusted, outside the training folds), trusted."""
    if not 1 <= order <= 7:
        raise ValueError("a gram must fit a long")
    text = F.col("text").cast("string")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = int(-(-size // group_bytes)) or 1
    shards = max(1, int(n * SHARDS_PER_GROUP))

    def group_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b")

    number = F.col("doc_id").cast("long")
    dealt = _deal(
        docs.select(
            group_of(F.coalesce(number, F.xxhash64(text))), F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"),
        ), n,
    )
    trusted = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1")
        .select(group_of(F.col("doc_id")), "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0).alias("calibrates"))
    )

    def listed(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ids, langs, texts = _documents(group)
        train = set(known["doc_id"][~known["calibrates"].astype(bool)])
        out = []
        for lang, rows in _by_language(langs).items():
            own = [texts[i] for i in rows]
            keys = _distinct(own, order)
            c = np.zeros(len(keys), dtype=np.int64)
            trusted_texts = [texts[i] for i in rows if ids[i] in train]
            for chunk in _chunks(trusted_texts):
                g, n_g = np.unique(_joined([trusted_texts[i] for i in chunk], order), return_counts=True)
                c[np.searchsorted(keys, g)] += n_g
            for shard, part in _by_shard(keys, shards):
                out.append((int(group["b"].iloc[0]), shard, lang, _pack(_gaps(keys[part]), c[part])))
        return pd.DataFrame(out, columns=["b", "shard", "lang", "grams"])

    lists = (
        dealt.groupBy("b")
        .cogroup(trusted.groupBy("b"))
        .applyInPandas(listed, "b int, shard int, lang string, grams binary")
    )
    lists = cut_lineage(lists)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for lang, own in group.groupby("lang"):
            keys, counts = [], []
            for data in own["grams"]:
                gaps, c = _unpack(data, LISTED)
                keys.append(np.cumsum(gaps))
                counts.append(c)
            total = pd.Series(np.concatenate(counts), index=np.concatenate(keys)).groupby(level=0).sum()
            frames.append(pd.DataFrame({"lang": lang, "gram": total.index.to_numpy(), "c": total.to_numpy()}))
        return pd.concat(frames)

    counts = cut_lineage(lists.groupBy("shard").applyInPandas(summed, "lang string, gram long, c long"))
    model = log_probabilities(counts, order)

    def answer(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known = {lang: own.sort_values("gram") for lang, own in group.groupby("lang")}
        out = []
        for b, shard, lang, data in zip(asked["b"], asked["shard"], asked["lang"], asked["grams"], strict=True):
            keys, own = np.cumsum(_unpack(data, LISTED)[0]), known[lang]
            at = np.searchsorted(own["gram"].to_numpy(), keys)
            if not np.array_equal(own["gram"].to_numpy()[np.minimum(at, len(own) - 1)], keys):
                raise ValueError("a gram of the corpus has no probability")
            out.append((b, shard, lang, _pack(own["logp"].to_numpy()[at].astype(np.float32))))
        return pd.DataFrame(out, columns=["b", "shard", "lang", "logp"])

    answers = (
        model.withColumn("shard", _shard(F.col("gram"), shards).cast("int"))
        .groupBy("shard")
        .cogroup(lists.groupBy("shard"))
        .applyInPandas(answer, "b int, shard int, lang string, logp binary")
    )

    def total(group: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        ids, langs, texts = _documents(group)
        sums = np.zeros(len(texts))
        for lang, rows in _by_language(langs).items():
            own = [texts[i] for i in rows]
            keys = _distinct(own, order)
            mine = answered[answered["lang"] == lang]
            found = dict(zip(mine["shard"], mine["logp"], strict=True))
            logp = np.zeros(len(keys))
            for shard, part in _by_shard(keys, shards):  # the grams that the group listed, in that order
                logp[part] = _unpack(found[shard], ANSWERED)[0]
            index = pd.Index(keys)
            for chunk in _chunks(own):
                at = index.get_indexer(_joined([own[i] for i in chunk], order))
                ends = np.cumsum([0] + [len(own[i]) for i in chunk])
                sums[[rows[i] for i in chunk]] = np.diff(np.r_[0, np.cumsum(logp[at])][ends])
        n_bytes = np.array([len(t) for t in texts], dtype=np.int64)
        ppl = np.exp(-sums / np.maximum(n_bytes, 1))
        if not np.isfinite(ppl).all():
            raise ValueError("a document has no perplexity")
        frame = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "lang": langs, "n_bytes": n_bytes, "perplexity": ppl})
        return frame

    scored = (
        dealt.groupBy("b")
        .cogroup(answers.groupBy("b"))
        .applyInPandas(total, "doc_id long, lang string, n_bytes long, perplexity double")
    )
    return scored.join(trusted.select("doc_id", "calibrates"), "doc_id", "left").select(
        "doc_id", "lang", "n_bytes", "perplexity",
        F.col("calibrates").isNotNull().alias("trusted"),
        F.coalesce("calibrates", F.lit(False)).alias("calibrates"),
    )


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and kept of every row of ``docs``."""
    scores = cut_lineage(score(docs, labels, order, group_bytes))
    cut = "percentile_approx(CASE WHEN {} THEN perplexity END, {}, 10000)"
    limits = scores.filter("trusted").groupBy("lang").agg(
        F.coalesce(F.expr(cut.format("calibrates", quantile)), F.expr(cut.format("true", quantile))).alias("threshold")
    )
    found = limits.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    limits = docs.sparkSession.createDataFrame([tuple(r) for r in found], "lang string, threshold double")
    return scores.join(F.broadcast(limits), "lang", "left").select(
        "doc_id", "lang", "n_bytes", "perplexity", "threshold",
        F.coalesce((F.col("n_bytes") == 0) | (F.col("perplexity") <= F.col("threshold")), F.lit(True)).alias("kept"),
    )
