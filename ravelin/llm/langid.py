"""Language identification by rank-order n-gram profiles.

Training counts the letter n-grams (one to three characters, word edges included)
of every labelled training text; a language's profile is its ``PROFILE`` most
frequent n-grams, in order.  A text is compared with each profile by the
out-of-place distance: over the text's own most frequent n-grams, the sum of the
differences between their rank here and their rank in the profile, with the
largest possible difference for n-grams that the profile lacks.  The nearest
profile gives the language; the score is one minus the distance's share of the
worst one.

N-gram counts are summed in each task first, then by Spark over all tasks; only the
profiles (``PROFILE`` rows a language, ``MAX_LANGUAGES`` languages at most) reach the
driver and are broadcast.

Null, empty and letterless texts are ``und`` with score 0.  Ties between languages go
to the smaller name, ties between n-grams to the smaller one.  With no training
text every document is ``und``.  Repeated rows are predicted alike.  Empty input gives empty
output.  Very long texts go piece by piece, each n-gram counted as in the whole text.  Columns
named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import id_text, sliced, table, without, written

PROFILE = 600
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
#: Score below which a text is in none of the learned languages: labelled texts of all lengths score 0.38 and more, strings of random letters
#: 0.2 and less, texts in scripts that no profile has 0.
LEAST_SCORE = 0.25
#: Texts are worked through in pieces of so many characters, to bound memory; results do not depend on it.
PIECE = 1_000_000
#: N-grams kept in a task before they are added up.
HELD = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, piece: int) -> Iterator[np.ndarray]:
    """All n-grams of a text, piece by piece, each packed into 63 bits: three code points of 21 bits.

    Every run of anything but letters is one blank, and there is one before and after the text.
    The last two symbols go over to the next piece, so that a cut changes nothing.
    """
    text = text.lower()
    before, letter_before = np.array([32], np.int64), False
    for i in range(0, len(text), piece):
        chars = np.frombuffer(text[i : i + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[chars]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= letter_before
        letter_before = bool(is_letter[-1])
        new = np.where(is_letter, chars, 32)[keep].astype(np.int64)
        if letter_before and i + piece >= len(text):
            new = np.append(new, 32)
        symbols = np.concatenate((before, new))
        two = (symbols[:-1] << 21) | symbols[1:]
        three = (two[:-1] << 21) | symbols[2:]
        first = max(0, len(before) - 2)
        inside = symbols[first + 1 : -1] != 32
        yield np.concatenate((new[new != 32], two[len(before) - 1 :], three[first:][inside]))
        before = symbols[-2:]


def counted(text: str, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts."""
    parts = [np.unique(found, return_counts=True) for found in grams(text, piece or PIECE)]
    return parts[0] if len(parts) == 1 else added(parts)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some counts, and the sums of these."""
    keys, where = np.unique(np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]))
    return keys, sums


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.binary()).to_pylist()]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    n_held = 0
    for batch in sliced(batches):
        for text, lang in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if text:
                part = counted(text)
                held.setdefault(lang, []).append(part)
                n_held += len(part[0])
        if n_held > HELD:
            held = {lang: [added(parts)] for lang, parts in held.items()}
            n_held = sum(len(p[0][0]) for p in held.values())
    for lang, parts in held.items():
        keys, sums = added(parts)
        for i in range(0, len(keys), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part]), pa.array(sums[part])],
                ["lang", "gram", "n"],
            )


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) of each language's ``size`` most frequent n-grams.

    ``labelled`` has text and lang, neither null.
    """
    counts = (
        labelled.select("text", "lang")
        .mapInArrow(_count_batches, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # the limit is pushed below the window's shuffle, so no task holds all n-grams of a language
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") < size)
        .select("lang", "gram", "place")
    )


class Profiles:
    """All profiles as one table: for each n-gram its place in every language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), size, np.int32)  # last row: in no profile
        if rows:
            where = np.searchsorted(self.grams, [r[1] for r in rows])
            self.places[where, [at[r[0]] for r in rows]] = [r[2] for r in rows]

    def predict(self, text: str) -> tuple[str, float]:
        keys, counts = counted(text) if text else ((), ())
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        top = np.lexsort((keys, -counts))[: self.size]
        keys = keys[top]
        where = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        where = np.where(self.grams[where] == keys, where, len(self.grams))
        places = self.places[where]
        mine = np.arange(len(keys), dtype=np.int32)[:, None]
        off = np.where(places == self.size, self.size, np.abs(places - mine)).sum(axis=0)
        best = int(np.argmin(off))
        return self.langs[best], round(1.0 - float(off[best]) / (self.size * len(keys)), 9)


def gathered(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    """The profiles on the driver, after a check of their number."""
    if profiles.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles([(r.lang, r.gram, r.place) for r in profiles.collect()], size)


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score; other columns pass through untouched."""
    model = gathered(profiles, size)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, ("lang_pred", "score"))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            found = [model.predict(t) for t in _texts(batch.column(at))]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(id_text("doc_id")), F.lit(4)) == 2


def profiles_of(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Profiles learned from the labelled documents that aren't held out."""
    labelled = docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return written(learn_profiles(labelled, size), "lang-profiles")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), profiles_of(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
