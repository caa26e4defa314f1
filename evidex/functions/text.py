"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidex.functions.constants import (
    CYRILLIC_ENDINGS,
    ENTITY_ALIASES,
    SPECIAL_NAMES,
    UNSAFE_MARKERS,
    WHITESPACE,
)

_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE) + "]"

# Characters for which JVM lower-casing equals case folding and NFKC changes nothing.
_JVM_SAFE = "^[\\x00-\\x7FÀ-ÖØ-Þà-öø-ÿА-Яа-яЁё«»–—“”„’‘]*$"


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def split_words(col: Column) -> Column:
    """Whitespace-separated words; no empty entries."""
    return F.filter(F.split(col, _WS_CLASS + "+"), lambda w: w != "")


def normalize_raw_text(col: Column) -> Column:
    """Line ends to LF, trailing blanks of every line and outer blanks removed."""
    lines = F.split(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\n")
    ended = F.transform(lines, lambda line: F.rtrim(line, F.lit(WHITESPACE)))
    return strip(F.array_join(ended, "\n"))


def checksum(col: Column) -> Column:
    return F.sha2(normalize_raw_text(col), 256)


class _PunctuationToSpace(dict):
    """Translation table for ``str.translate`` filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = " " if unicodedata.category(char)[0] in "PS" else char
        return self[code]


_TABLE = _PunctuationToSpace()


def normalize_text(value: str) -> str:
    """Exact name normalisation of one value, for text outside the JVM-safe alphabet."""
    folded = unicodedata.normalize("NFKC", value).casefold().strip()
    spelled = reduce(lambda text, pair: text.replace(*pair), SPECIAL_NAMES, folded)
    return " ".join(spelled.replace("&", " and ").translate(_TABLE).split())


@F.pandas_udf(StringType())
def _normalize_udf(values: pd.Series) -> pd.Series:
    return values.map(normalize_text, na_action="ignore")


def _normalize_jvm(col: Column) -> Column:
    folded = strip(F.lower(col))
    for special, plain in SPECIAL_NAMES:
        folded = F.replace(folded, F.lit(special), F.lit(plain))
    spelled = F.replace(folded, F.lit("&"), F.lit(" and "))
    spaced = F.regexp_replace(spelled, "[\\p{P}\\p{S}" + _WS_CLASS[1:] + "+", " ")
    return F.btrim(spaced)


def normalize_name(col: Column, unicode: bool = True) -> Column:
    """Comparison key of a name.

    Values of the JVM-safe alphabet never reach Python; the rest go through an Arrow
    UDF. ``unicode=False`` leaves the UDF out of the plan for data known to be safe.
    """
    if not unicode:
        return _normalize_jvm(col)
    safe = F.rlike(col, F.lit(_JVM_SAFE))
    return F.when(safe, _normalize_jvm(col)).otherwise(_normalize_udf(F.when(~safe, col)))


def alias_table(aliases: Mapping[str, str] | None = None) -> dict[str, str]:
    """Normalised alias -> canonical name; an empty mapping means the defaults."""
    return {normalize_text(k): v for k, v in (aliases or ENTITY_ALIASES).items()}


def canonical_name(
    col: Column, aliases: Mapping[str, str] | None = None, unicode: bool = True
) -> Column:
    """Canonical spelling of a name (B13). Aliases are a user dictionary, hence a map literal."""
    return F.coalesce(
        _lookup(alias_table(aliases), normalize_name(col, unicode)), strip(col)
    )


def canonical_key(
    col: Column, aliases: Mapping[str, str] | None = None, unicode: bool = True
) -> Column:
    """Normalised canonical name, computed with one pass over the value."""
    key = normalize_name(col, unicode)
    table = {k: normalize_text(v) for k, v in alias_table(aliases).items()}
    return F.coalesce(_lookup(table, key), key)


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def identity_key(name: Column, country: Column, unicode: bool = True) -> Column:
    """``name|country`` of a person; null without a country."""
    place = F.nullif(normalize_name(F.coalesce(country, F.lit("")), unicode), F.lit(""))
    return F.when(place.isNotNull(), F.concat(normalize_name(name, unicode), F.lit("|"), place))


def is_unsafe(col: Column, markers: Sequence[str] = UNSAFE_MARKERS) -> Column:
    """True when the text carries one of the markers, ignoring case."""
    lowered = F.lower(col)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m.lower())) for m in markers])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, for use inside other lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrases(col: Column, longest: int = 3) -> Column:
    """Distinct 1..n-word phrases of a normalised text (Q2)."""

    def of_size(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(
            F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        ).otherwise(F.array().cast("array<string>"))

    return bind(
        split_words(col),
        lambda words: F.array_distinct(
            F.concat(*[of_size(words, n) for n in range(1, longest + 1)])
        ),
    )


def contains_term(words: Column, term: str) -> Column:
    """Does the word array contain the term's words in sequence (Q9)?

    Two words agree when equal, or when both have four letters or more and one starts
    with the other.
    """
    parts = term.split()
    if not parts:
        return F.lit(False)

    def agree(word: Column, part: str) -> Column:
        same = word == part
        if len(part) < 4:
            return same
        return same | (
            (F.length(word) >= 4) & (F.startswith(word, F.lit(part)) | F.startswith(F.lit(part), word))
        )

    if len(parts) == 1:
        return F.exists(words, lambda w: agree(w, parts[0]))

    def in_sequence(spoken: Column) -> Column:
        starts = F.when(
            F.size(spoken) >= len(parts), F.sequence(F.lit(1), F.size(spoken) - (len(parts) - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.exists(
            starts,
            lambda i: reduce(
                lambda a, b: a & b,
                [agree(F.element_at(spoken, i + j), part) for j, part in enumerate(parts)],
            ),
        )

    return bind(words, in_sequence)


def stem(col: Column) -> Column:
    """Cyrillic stem: trailing vowels and soft sign removed."""
    return F.rtrim(col, F.lit(CYRILLIC_ENDINGS))


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def city_terms(city: Column, unicode: bool = True) -> Column:
    """Spellings under which a requested city is looked up in stored locations."""
    raw = strip(city)
    key = normalize_name(city, unicode)
    root = stem(key)
    cyrillic = F.rlike(key, F.lit("^[а-я ]+$"))
    spellings = F.when(
        cyrillic,
        F.array(raw, F.lower(raw), key, capitalize(key), root, capitalize(root)),
    ).otherwise(F.array(raw, F.lower(raw), key, F.initcap(key)))
    return F.array_distinct(F.filter(spellings, lambda t: t.isNotNull() & (t != "")))


def comparison_forms(key: Column) -> Column:
    """A normalised phrase and, for Cyrillic, its stem of three letters or more (Q5)."""
    root = stem(key)
    stemmed = F.rlike(key, F.lit("^[а-яё -]+$")) & (F.length(root) >= 3)
    return F.array_distinct(
        F.when(stemmed, F.array(key, root)).otherwise(F.array(key))
    )


def content_words(col: Column, pattern: str = "[a-z0-9+#.-]+") -> Column:
    """Distinct lower-cased words longer than two characters (M3)."""
    words = F.regexp_extract_all(F.lower(col), F.lit(f"({pattern})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def row_id(kind: str, *parts: Column) -> Column:
    """Deterministic id from a natural key; survives retries and reruns."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256)


