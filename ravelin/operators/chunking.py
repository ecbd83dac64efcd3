"""Heading-aware chunking: sections by windows over lines, long sections split further."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import DEFAULT, Config
from ravelin.functions.text import chunk_id, let, trimmed


def sections(docs: DataFrame) -> DataFrame:
    """(source, title, section_ord, heading_path, content) of ``docs`` (source, title, content).

    Headings of level one to three open a section; its path is the headings that hold, or
    the document's title.  Sections of white space only are left out.
    """
    line = F.col("line")
    level = (
        F.when(line.rlike(r"^###\s+."), 3).when(line.rlike(r"^##\s+."), 2).when(line.rlike(r"^#\s+."), 1).otherwise(0)
    )
    lines = (
        docs.select("source", "title", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"))
        .withColumn("level", level)
        .withColumn("name", trimmed(F.regexp_extract(line, r"^#{1,3}\s+(.+)$", 1)))
    )
    so_far = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def holding(own: int) -> F.Column:
        value = F.when(F.col("level") == own, F.col("name")).when((F.col("level") > 0) & (F.col("level") < own), F.lit(""))
        return F.nullif(F.last(value, ignorenulls=True).over(so_far), F.lit(""))

    marked = lines.select(
        "source",
        "title",
        "pos",
        "line",
        "level",
        F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(so_far).cast("int").alias("section_ord"),
        F.coalesce(F.nullif(F.concat_ws(" > ", holding(1), holding(2), holding(3)), F.lit("")), F.col("title")).alias("heading_path"),
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return (
        marked.filter("level = 0")
        .groupBy("source", "title", "section_ord", "heading_path")
        .agg(trimmed(F.array_join(in_order, "\n")).alias("content"))
        .filter("content <> ''")
    )


def _packed(units: Column, size: int, overlap: int) -> Column:
    """Units of text as parts (t, open): neighbours joined up to ``size`` characters, each part starting with up to ``overlap``
    characters of whole units of the one before; a unit of ``size`` or more stands alone and is open to a finer cut.

    A fold over the units' lengths: ``start`` is the first unit of the part that grows, ``held`` its length.
    """
    span = "array<struct<start: int, end: int, open: boolean>>"

    def ranges(lengths: Column) -> Column:
        def spanned(start: Column, end: Column, is_open: bool) -> Column:
            return F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(is_open).alias("open")))

        def state(out: Column, start: Column, held: Column) -> Column:
            return F.struct(out.alias("out"), start.alias("start"), held.alias("held"))

        def closed(s: Column, i: Column) -> Column:
            return F.when(s["start"] < i, F.concat(s["out"], spanned(s["start"], i, False))).otherwise(s["out"])

        def step(s: Column, i: Column) -> Column:
            n = F.element_at(lengths, i + 1)
            left = F.aggregate(  # units leave the part's front until the next one fits
                F.slice(lengths, s["start"] + 1, i - s["start"]),
                F.struct(s["start"].alias("start"), s["held"].alias("held")),
                lambda w, m: F.when(
                    (w["held"] > overlap) | (w["held"] + n > size), F.struct((w["start"] + 1).alias("start"), (w["held"] - m).alias("held"))
                ).otherwise(w),
            )
            return (
                F.when(n >= size, state(F.concat(closed(s, i), spanned(i, i + 1, True)), i + 1, F.lit(0)))
                .when(s["held"] + n > size, let(left, lambda w: state(closed(s, i), w["start"], w["held"] + n)))
                .otherwise(state(s["out"], s["start"], s["held"] + n))
            )

        begin = state(F.array().cast(span), F.lit(0), F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.size(lengths) - 1), begin, step, lambda s: closed(s, F.size(lengths)))

    joined = lambda r: F.array_join(F.slice(units, r["start"] + 1, r["end"] - r["start"]), "")
    return let(F.transform(units, F.length), lambda n: F.transform(ranges(n), lambda r: F.struct(joined(r).alias("t"), r["open"].alias("open"))))


def split(text: Column, config: Config = DEFAULT) -> Column:
    """Trimmed pieces of at most ``max_chunk`` characters of a text that is longer than that, in order.

    The text is cut at the first separator that occurs in it; what is still too long is cut at the next one that
    occurs there, and by length in the end.  All in the row, without Python and without a shuffle.
    """
    size = config.max_chunk

    def finer(p: Column, mark: str) -> Column:
        pieces = F.split(p["t"], re.escape(mark), -1)
        units = F.filter(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(mark), x))), lambda u: u != "")
        return F.when(p["open"] & F.contains(p["t"], F.lit(mark)), let(units, lambda u: _packed(u, size, config.overlap))).otherwise(F.array(p))

    def level(parts: Column, mark: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: finer(p, mark)))

    parts = reduce(level, config.separators, F.array(F.struct(text.alias("t"), F.lit(True).alias("open"))))
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda k: F.substr(t, k * size + 1, F.lit(size)))
    pieces = F.flatten(F.transform(parts, lambda p: F.when(p["open"] & (F.length(p["t"]) > 0), cut(p["t"])).otherwise(F.array(p["t"]))))
    return F.filter(F.transform(pieces, trimmed), lambda x: x != "")


def chunks(parts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(source, title, section_ord, section_title, chunk_index, content) of ``sections``' rows.

    A section of up to ``max_chunk`` characters is one chunk; longer ones are split.  Every
    chunk is led by its section's path.
    """
    pieces = F.when(F.length("content") <= config.max_chunk, F.array("content")).otherwise(split(F.col("content"), config))
    return parts.select("source", "title", "section_ord", "heading_path", F.posexplode(pieces).alias("chunk_index", "content")).select(
        "source",
        "title",
        "section_ord",
        F.col("heading_path").alias("section_title"),
        "chunk_index",
        F.concat("heading_path", F.lit("\n\n"), "content").alias("content"),
    )


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", chunk_id(F.col("source"), F.col("content")))
