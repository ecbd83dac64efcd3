"""Text functions as native columns: words, term numbers, content ids, titles, trimming.

Lengths and substrings count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.config import CHUNK_NAMESPACE, DEFAULT, STOPWORDS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters of a term that are hashed without a fold.
SHORT = 12


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def without_code(plain: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(plain, r"```[\s\S]*?```", " "), "`[^`]+`", " ")
    return F.when(F.contains(plain, F.lit("`")), cut).otherwise(plain)


def tokens(text: Column, keep_code: bool = False) -> Column:
    """Keyword tokens: lower case, code removed, ASCII letters and digits only, no stopwords or single characters."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(plain if keep_code else without_code(plain), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def token_text(text: Column) -> Column:
    """What ``tokens`` are read from, for readers that lower-case A-Z themselves: two other characters turn into ASCII letters, and
    only texts with one of these are lower-cased here."""
    plain = F.coalesce(text, F.lit(""))
    other = F.contains(plain, F.lit("\u212a")) | F.contains(plain, F.lit("\u0130"))
    return without_code(F.when(other, F.lower(plain)).otherwise(plain))


def term_index(term: Column, vocabulary: int = DEFAULT.vocabulary) -> Column:
    """The term's number: a multiplicative hash in 32-bit arithmetic, folded to the vocabulary's size.

    Terms of up to ``SHORT`` characters are summed up in one expression, each character times its power of 33; others are
    folded character by character, which Spark does not compile.
    """
    wrap = 1 << 32
    power = [pow(33, k, wrap) for k in range(SHORT + 1)]

    def summed(padded: Column) -> Column:
        terms = [F.ascii(F.substring(padded, SHORT - k, 1)) * F.lit(power[k]).cast("long") for k in range(SHORT)]
        return reduce(add, terms) + F.lit(5381).cast("long") * F.element_at(F.array(*[F.lit(p).cast("long") for p in power]), F.length(term) + 1)

    short = summed(F.lpad(term, SHORT, "\0")) % wrap
    long = F.aggregate(F.split(term, ""), F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)) % wrap)
    hashed = F.when(F.length(term) <= SHORT, short).otherwise(long)
    return (F.abs(F.when(hashed >= wrap // 2, hashed - wrap).otherwise(hashed)) % vocabulary).cast("int")


def chunk_id(source: Column, content: Column) -> Column:
    """UUID of version 5 of ``source::content``: equal content of a source has one id."""
    name = F.encode(F.concat(source, F.lit("::"), content), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(CHUNK_NAMESPACE.replace("-", ""))), name))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def title_of(content: Column, source: Column) -> Column:
    """The first level-one heading anywhere, or the file's name without extension."""
    name = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(content, r"(?m)^#\s+(.+)", 1), F.lit("")), name)


def excerpt(content: Column, size: int = DEFAULT.excerpt) -> Column:
    return F.concat(F.substring(content, 1, size), F.lit("..."))
