import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

#: One row per awkward case: nulls in any column, blank and long texts, repeats, ties.
ODD = [
    (900001, None, "en", "src0", 0),
    (900002, "", None, None, None),
    (900003, " \t\n ", "en", "src0", 4),
    (None, "A text without an id that is long enough to hold a shingle or two of words.", "en", "src1", 9),
    (None, None, None, None, None),
    (900004, "Same words here, twice over and over again, in two rows of one id.", "xx", "src1", 9),
    (900004, "Same words here, twice over and over again, in two rows of one id.", "xx", "src1", 9),
    (900005, "Same words here, twice over and over again, in two rows of one id.", "fr", "src1", 9),
    (900006, "\x00\x0b\x0c\u0085  é ß İ 漢字 \U0001f600 word", "de", "src2", 3),
    (900007, "verylongword" * 3000, "en", "src2", 36000),
    (900008, "many words of a very long text " * 6000, "es", "src2", 186000),
    (900009, "oneword", "es", "src2", 7),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, as extra columns of their input.
CLASH = ["fp", "node", "root", "b", "shard", "slot", "hits", "score", "rate", "copies", "tokens", "label", "k", "n", "key"]


@pytest.fixture(scope="session")
def tables(spark):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet").cache() for n in ("documents", "labels", "benchmark", "pages", "embeddings")}


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="session")
def mixed(tables, odd):
    """Given documents, awkward rows, and extra columns with clashing names."""
    both = tables["documents"].select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).union(odd)
    return both.withColumns({c: F.lit("mine") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def rows(mixed):
    return [(r.doc_id, r.text, r.lang) for r in mixed.select("doc_id", "text", "lang").collect()]
