"""Alignment of two tokenizers' tokens over the same text.

Tokens are placed by their bytes.  In each batch two ``merge_asof`` joins, keyed by document, find for each token's
start the token of the other side that covers it.  Together both directions are all overlaps.  Where the covering token
starts at the same byte, both sides ended together before: these places cut the tokens into groups, the
smallest stretches of text that are whole tokens on both sides.

For the corpus, each pair of ids linked by a group is counted once a document.  Documents' distinct pairs are written
once, with how often each occurs; counts are added up in each task before they are shuffled.  Counts then go back to
the documents without moving these: the most frequent pairs, a million at most, are broadcast, and only
rarer pairs, if there are more, are shuffled to meet theirs.

Side A is a byte-level BPE of the ``tokenizers`` library and gets a space before the text; side B is a ``sentencepiece``
model that adds this space itself.  Special tokens are not added, and their strings within a text are plain text.
Null and empty texts, and those whose tokens' bytes on either side are not space and text, have no tokens.
Texts longer than ``PIECE`` characters are encoded in pieces that start with a space between letters
or digits, where neither tokenizer joins anything: B's vocabulary is asked whether that is so.
A group with very many tokens is counted by its distinct ids, not token by token.  Rows that share an id are documents of their own.
Columns other than id and text are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import sliced, table, written

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are encoded at once.
PIECE = 1 << 16
#: Links of a group up to which they are listed one by one.
LISTED = 1 << 12
#: Pairs whose counts are broadcast at most, some 50 bytes each.
MAX_PAIRS = 1_000_000

# Fixed value: how byte-level tokenizers cut text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def byte_of_character() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin ones for
    themselves, those from 256 on for the other bytes in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def pieces_of(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of ``size`` characters or more; all but the first start with a space between letters or digits."""
    out, at = [], 0
    while at + size < len(text):
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class ByteSide:
    """Side A: ids of space and text, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.plan = json.load(file)
        to_byte = byte_of_character()
        vocabulary = self.model.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in to_byte for c in token):
                self.bytes[k] = bytes(to_byte[c] for c in token)
        self.quick = self._by_ranks()
        self.cuttable = True

    def _by_ranks(self):
        """The same encoding by ``tiktoken``, which takes a fifth of the time, where ranks say all that the file says: merges
        come in the order of their ids, every other token is a byte, and text is cut by the usual pattern and not changed before."""
        import tiktoken

        model, cut = self.plan["model"], self.plan.get("pre_tokenizer") or {}
        special = {t["id"] for t in self.plan.get("added_tokens") or []}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        single = [k for token, k in model["vocab"].items() if len(token) == 1 and k not in special]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not self.plan.get("normalizer")
        ordered = all(x < y for x, y in zip(made, made[1:], strict=False)) and len(single) == 256 and (not made or max(single) < made[0])
        kept = set(made) | set(single)
        if not (plain and ordered and kept | special == set(range(len(self.bytes)))) or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        ranks = {self.bytes[k]: k for k in kept}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str], first: list[bool]) -> list[list[int]]:
        given = [" " + p if f else p for p, f in zip(pieces, first, strict=True)]
        if self.quick is not None:
            return [self.quick.encode_ordinary(p) for p in given]
        return [e.ids for e in self.model.encode_batch_fast(given, add_special_tokens=False)]


class PieceSide:
    """Side B: ids of text, to which the model adds a space, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, pieces: list[str], first: list[bool]) -> list[list[int]]:
        return self.model.encode([p if f else p[1:] for p, f in zip(pieces, first, strict=True)], num_threads=1)


@cache
def sides(a_file: str, b_file: str) -> tuple[ByteSide, PieceSide]:
    """Both tokenizers, loaded once a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    return ByteSide(a_file), PieceSide(b_file)


def encoded(texts: list[str | None], a: ByteSide, b: PieceSide, size: int = PIECE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' ids of each text; none where either side's bytes are not space and text."""
    cut = a.cuttable and b.cuttable
    pieces, of, first = [], [], []
    for k, text in enumerate(texts):
        mine = (pieces_of(text, size) if cut else [text]) if text else []
        pieces += mine
        of += [k] * len(mine)
        first += [i == 0 for i in range(len(mine))]
    found: list[tuple[list, list]] = [([], []) for _ in texts]
    lo = 0
    while lo < len(pieces):  # at least one piece, some PIECE characters at once
        hi, held = lo, 0
        while hi < len(pieces) and (hi == lo or held + len(pieces[hi]) <= 4 * size):
            held += len(pieces[hi])
            hi += 1
        for side, model in enumerate((a, b)):
            for k, ids in zip(of[lo:hi], model.encode(pieces[lo:hi], first[lo:hi]), strict=True):
                found[k][side].append(ids)
        lo = hi
    out: tuple[list, list] = ([], [])
    for text, mine in zip(texts, found, strict=True):
        whole = b" " + text.encode() if text else b""
        ids = [[i for part in mine[side] for i in part] for side in (0, 1)]
        same = all(b"".join(map(model.bytes.__getitem__, i)) == whole for model, i in ((a, ids[0]), (b, ids[1])))
        for side in (0, 1):
            out[side].append(np.array(ids[side] if same else [], np.int32))
    return out


class Aligned:
    """A batch of documents: tokens of both sides one after another, their documents, covering tokens and groups."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_bytes: list[bytes], b_bytes: list[bytes]):
        none = [np.zeros(0, np.int32)]
        self.n_docs = len(a)
        self.ids = (np.concatenate([*a, *none]), np.concatenate([*b, *none]))
        self.doc = tuple(np.repeat(np.arange(len(x)), [len(i) for i in x]) for x in (a, b))
        self.n = tuple(np.array([len(i) for i in x], np.int64) for x in (a, b))
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)]
        ends = [np.cumsum(s[i]) for s, i in zip(sizes, self.ids, strict=True)]
        # both sides of a document have the same bytes, so places run on over the batch
        tokens = [pd.DataFrame({"at": e - s[i], "doc": d}) for e, s, i, d in zip(ends, sizes, self.ids, self.doc, strict=True)]
        self.cover, self.group = [], []
        for mine, other in ((0, 1), (1, 0)):
            right = tokens[other].assign(start=tokens[other]["at"], token=np.arange(len(tokens[other])))
            met = pd.merge_asof(tokens[mine], right, on="at", by="doc")
            self.cover.append(met["token"].to_numpy(np.int64))
            self.group.append(np.cumsum((met["start"] == met["at"]).to_numpy()) - 1)
        self.n_groups = int(self.group[0][-1]) + 1 if len(self.group[0]) else 0
        self.size = tuple(np.bincount(g, minlength=self.n_groups) for g in self.group)
        self.first = tuple(np.concatenate([[0], np.cumsum(s)]) for s in self.size)

    def overlaps(self) -> np.ndarray:
        """All pairs of tokens (a, b) that share a byte, in order: the union of both directions."""
        pairs = np.concatenate(
            [np.column_stack([np.arange(len(self.cover[0])), self.cover[0]]), np.column_stack([self.cover[1], np.arange(len(self.cover[1]))])]
        )
        return np.unique(pairs, axis=0)

    def group_docs(self) -> np.ndarray:
        """The document of each group."""
        return self.doc[0][self.first[0][:-1]]

    def linked(self, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of all distinct pairs of ids linked in a document; a pair is a * n_b + b."""
        links = self.size[0] * self.size[1]
        per_a = np.where(links <= LISTED, self.size[1], 0)[self.group[0]]
        a = np.repeat(np.arange(len(per_a)), per_a)
        step = np.arange(len(a)) - np.repeat(np.cumsum(per_a) - per_a, per_a)
        b = self.first[1][self.group[0]][a] + step
        docs, pairs, times = [self.doc[0][a]], [self.ids[0][a].astype(np.int64) * n_b + self.ids[1][b]], [np.ones(len(a), np.int64)]
        group_docs = self.group_docs()
        for g in np.flatnonzero(links > LISTED):
            (x, n), (y, m) = (np.unique(self.ids[s][self.first[s][g] : self.first[s][g + 1]], return_counts=True) for s in (0, 1))
            pairs.append((x.astype(np.int64)[:, None] * n_b + y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
            docs.append(np.full(len(pairs[-1]), group_docs[g]))
        doc, pair, n = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((pair, doc)) if len(docs) > 1 else np.argsort(doc * (1 << 42) + pair)
        doc, pair, n = doc[order], pair[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
        return doc[starts], pair[starts], np.add.reduceat(n, starts) if len(starts) else n

    def written_out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each document the ids in the order of its groups, A's before B's, and the sign after each:
        0 a comma, 1 a bar, 2 a semicolon, 3 none."""
        n = len(self.ids[0]) + len(self.ids[1])
        ids, side, group = np.empty(n, np.int32), np.empty(n, np.int8), np.empty(n, np.int64)
        for s, place in (
            (0, np.arange(len(self.ids[0])) + self.first[1][self.group[0]]),
            (1, np.arange(len(self.ids[1])) + self.first[0][self.group[1] + 1]),
        ):
            ids[place], side[place], group[place] = self.ids[s], s, self.group[s]
        sign = np.full(n, 3, np.int64)
        if n:
            sign[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        ends = np.cumsum(self.n[0] + self.n[1])
        for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            sign[hi - 1 : hi] = 3
            yield ids[lo:hi], sign[lo:hi]


@cache
def _signed(n: int) -> list[bytes]:
    """The ids below ``n`` in decimal, once with each sign after them."""
    return [b"%d%s" % (k, sign) for sign in (b",", b"|", b";", b"") for k in range(n)]


def digests(batch: Aligned, n: int) -> list[str]:
    """The SHA-256 of each document's groups as ``a1,a2|b1;a3|b2``; empty without tokens."""
    texts, out = _signed(n), []
    for ids, sign in batch.written_out():
        at, h = sign * n + ids, hashlib.sha256()
        for lo in range(0, len(at), 1 << 16):
            h.update(b"".join(map(texts.__getitem__, at[lo : lo + (1 << 16)].tolist())))
        out.append(h.hexdigest() if len(at) else "")
    return out


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _aligned(batch: pa.RecordBatch, a_file: str, b_file: str, size: int) -> Aligned:
    a, b = sides(a_file, b_file)
    return Aligned(*encoded(batch.column(1).to_pylist(), a, b, size), a.bytes, b.bytes)


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, size: int = PIECE) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_groups, b_groups, overlaps) of ``docs`` (doc_id, text): both sides' tokens, the
    group of each token, from 0, and the pairs of tokens (a, b, from 0) that overlap."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            found = _aligned(batch, a_file, b_file, size)
            first = [np.concatenate([[0], np.cumsum(n)])[:-1] for n in found.n]
            groups = np.concatenate([[0], np.cumsum(np.bincount(found.group_docs(), minlength=found.n_docs))])[:-1]
            pairs = found.overlaps()
            of = found.doc[0][pairs[:, 0]]
            columns = [batch.column(0)]
            columns += [_lists(n, pa.array(ids)) for n, ids in zip(found.n, found.ids, strict=True)]
            columns += [_lists(n, pa.array((g - groups[d]).astype(np.int32))) for n, g, d in zip(found.n, found.group, found.doc, strict=True)]
            struct = pa.StructArray.from_arrays([pa.array((pairs[:, s] - first[s][of]).astype(np.int32)) for s in (0, 1)], ["a", "b"])
            columns.append(_lists(np.bincount(of, minlength=found.n_docs), struct))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "overlaps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        align, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, overlaps array<struct<a: int, b: int>>"
    )


def linked_pairs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, size: int = PIECE) -> tuple[DataFrame, int]:
    """A written table with a row a document (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), and
    the factor of a in a pair."""
    n_b = len(sides(a_file, b_file)[1].bytes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_file, b_file)
        most = max(len(a.bytes), len(b.bytes))
        for batch in sliced(batches, 200):
            found = _aligned(batch, a_file, b_file, size)
            doc, pair, times = found.linked(n_b)
            of = found.group_docs()
            n_links = np.bincount(of, found.size[0] * found.size[1], found.n_docs) if len(of) else np.zeros(found.n_docs)
            per_doc = np.bincount(doc, minlength=found.n_docs)
            columns = [
                batch.column(0),
                *(pa.array(n) for n in found.n),
                pa.array(np.bincount(of, minlength=found.n_docs).astype(np.int64)),
                pa.array(n_links.astype(np.int64)),
                pa.array(digests(found, most), pa.string()),
                _lists(per_doc, pa.array(pair)),
                _lists(per_doc, pa.array(times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        link, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    )
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "align-pairs"), n_b


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no other pair of its A id is in more."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    a = F.floor(F.col("pair") / n_b)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))  # a row an id of A's vocabulary
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that ``most`` pairs at most have that count; 1 if all may go."""
    level = F.floor(F.log2(F.col("n").cast("double")))
    sizes = {r["level"]: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    held, least = 0, max(sizes, default=-1) + 1
    while least > 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least


def link_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, size: int = PIECE, most: int = MAX_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    A pair's count is the number of documents that hold it linked; n_best are the links whose pair has its A id's
    highest count, count_sum is the sum of counts over all links.
    """
    found, n_b = linked_pairs(docs, a_file, b_file, size)
    counts = written(pair_counts(found, n_b), "align-best")
    least = frequent_from(counts, most)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    often = F.broadcast(counts.filter(F.col("n") >= least))
    met = links.join(often, "pair")
    if least > 1:
        met = met.unionByName(links.join(often.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < least), "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))
