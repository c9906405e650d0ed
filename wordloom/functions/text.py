"""Tokenizing, scoring and filter keys as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space (as inside a character class) and stop words.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WHITE = re.compile("[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
STOPWORDS = ("a", "the", "and")
#: The classes below list their characters under U+0100 one by one, which the
#: matcher holds in a table, and hide all others behind one comparison.
_GAP = r"[\t\n\x0B\f\r \x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+"
_DROPPED = "".join(f"\\x{i:02X}" for i in range(256) if not _WHITE.match(chr(i)) and unicodedata.category(chr(i))[0] not in "LM" and unicodedata.category(chr(i)) != "Nd")
#: What no token keeps: all but letters, marks, digits and white space.
_JUNK = rf"[{_DROPPED}[\x{{100}}-\x{{10FFFF}}&&[^{WHITE}\p{{L}}\p{{M}}\p{{Nd}}]]]+"
SCORE_UNIT = 100_000


def tokenize(text: Column) -> Column:
    """Lower-case words of a text without punctuation and stop words, in order.

    One pass strips what is no letter, mark, digit or white space, so the
    punctuation inside a word joins its parts.  Dotted capital I and capital
    sigma are lowered one by one, apart from their neighbours.
    """
    bare = F.regexp_replace(text, _JUNK, "")
    for capital, small in (("İ", "i"), ("Σ", "σ")):
        bare = F.replace(bare, F.lit(capital), F.lit(small))
    words = F.split(F.lower(bare), _GAP)
    for drop in ("", *STOPWORDS):
        words = F.array_remove(words, drop)
    return words


def made_once(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The columns ``kept`` of ``df`` and new ones that are made once a row.

    A filter on a plain new column moves below it and makes the column again;
    it can't move below a generator.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))


def count_tokens(text: str) -> int:
    """How many tokens ``tokenize`` finds in a query, without a job."""
    kept = ("".join(c for c in w if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd") for w in _WHITE.split(text))
    return sum(bool(w) and w.lower() not in STOPWORDS for w in kept)


def _texts(col: Column, kind: T.DataType) -> Column | None:
    """The strings of a field that are indexed, as an array; None for others."""
    if isinstance(kind, T.StringType):
        return F.array(col)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return col
    return None


def field_tokens(df: DataFrame, name: str) -> Column:
    """Tokens of a text or of the strings of an array; none of other kinds."""
    empty = F.array().cast("array<string>")
    texts = _texts(df[name], df.schema[name].dataType) if name in df.columns else None
    if texts is None:
        return empty
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(tokenize(df[name]), empty)
    return F.coalesce(F.flatten(F.transform(F.filter(texts, lambda x: x.isNotNull()), tokenize)), empty)


def plain_text(col: Column, kind: T.DataType) -> Column:
    """The text form of an id or filter value: whole doubles without a point."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e18)
        return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def filter_values(col: Column, kind: T.DataType) -> Column | None:
    """The filter keys of a value as an array of strings; None for kinds that have none."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return F.flatten(F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: filter_values(x, kind.elementType)))
        if filter_values(col, kind.elementType) is None:
            return None
        return F.filter(F.transform(col, lambda x: plain_text(x, kind.elementType)), lambda x: x.isNotNull() & (x != ""))
    if isinstance(kind, (T.StringType, T.NumericType)):
        return F.filter(F.array(plain_text(col, kind)), lambda x: x.isNotNull() & (x != ""))
    return None


def popularity(df: DataFrame, name: str) -> Column:
    """A number cut to a whole one, nothing below zero; other kinds count zero."""
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.NumericType):
        return F.lit(0).cast("bigint")
    return F.greatest(F.coalesce(df[name].cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def embed_content(df: DataFrame, names: tuple[str, ...]) -> Column:
    """Index fields as one text for embedding; arrays print in brackets."""
    parts = []
    for name in names:
        if name in df.columns:
            kind = df.schema[name].dataType
            text = F.concat(F.lit("["), F.array_join(df[name].cast("array<string>"), " "), F.lit("]")) if isinstance(kind, T.ArrayType) else plain_text(df[name], kind)
            parts.append(F.when(text != "", text))
    return F.concat_ws(" ", *parts)


def proper_prefixes(term: Column) -> Column:
    """Every shorter prefix of a term, shortest first."""
    n = F.length(term)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(term, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def delete_keys(term: Column) -> Column:
    """The term and each form that lacks one character, without repeats."""
    n = F.length(term)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, n)))
    return F.array_distinct(F.array_append(cut, term))


def query_keys(term: Column) -> Column:
    """Delete keys of a query in probing order; one character probes itself alone."""
    n = F.length(term)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, n)))
    return F.when(n > 1, F.concat(F.array(term), cut)).otherwise(F.array(term))
