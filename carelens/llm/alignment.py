"""Alignment of two tokenizers over the same texts.

1. Each text is encoded by both sides (Arrow batches, a slice of about ``SLICE``
   characters at a time; a longer text is a slice of its own). Token sizes in bytes
   give starts and ends; a text takes part only if both sides' bytes joined are the
   text behind one space, byte for byte.
2. ``pandas.merge_asof``, keyed by document, finds for each token start the other
   side's token that covers it, once in each direction. The union of both is every
   overlap. Overlaps whose ends are equal are the links, and cut the text into groups.
3. How often two ids are linked in the corpus is one aggregation over the documents'
   different pairs (counted per document first, so a hot pair is one row a document,
   combined before the shuffle). The highest count of a right id is an aggregation
   of that table, bounded by the vocabulary.
4. The counts return to the documents by a join on the pair: broadcast when their
   counted rows are within ``BROADCAST_ROWS`` (about 50 bytes each), otherwise shuffled
   (the skew join splits hot pairs). Sums per document are combined before they move.

The encoded table is written once to the shared checkpoint folder, with a number
for each row, so repeated ids and rows stay apart.

Defined cases: a null or empty text, and one that a side does not give back byte for
byte (a normalising tokenizer), has no tokens, groups or links. Repeated rows count
each and give repeated results; a null id is kept. An empty table gives no rows.
Only the named columns are read. A slice's frames take about 150 bytes a byte of text,
which for a longer text than SLICE grows with the text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.tokens import ByteLevelCounter
from carelens.session import ensure_checkpoint_dir

SLICE = 1 << 20
BROADCAST_ROWS = 1_000_000
LINK = "array<struct<pair: long, times: long>>"
ENCODED = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {LINK}"
DETAIL = "row long, doc_id long, groups string, overlaps array<struct<a: int, b: int>>"


class ByteSide:
    """A byte-level BPE ``.json`` file; a text is encoded behind one space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        made = ByteLevelCounter(spec)
        self.encoding = made.encoding
        letters = {c: bytes([b]) for b, c in _letters().items()}
        vocab = {b"".join(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        ranked = [self.encoding.decode_single_token_bytes(r) for r in range(len(made.sizes))]
        self.ids = np.array([vocab[b] for b in ranked], np.int64)
        self.size = int(self.ids.max()) + 1
        self.bytes = [b""] * self.size
        for token, i in zip(ranked, self.ids.tolist(), strict=True):
            self.bytes[i] = token

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self.ids[self.encoding.encode_ordinary(" " + t)] for t in texts]


class PieceSide:
    """A sentencepiece ``.model`` file, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(self.size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(list(texts), num_threads=1)]


def _letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is
    printable, otherwise the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def side(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    made = PieceSide(path) if path.endswith(".model") else ByteSide(path)
    made.sizes = np.array([len(b) for b in made.bytes], np.int64)
    return made


class Aligned:
    """Tokens, overlaps, links and groups of texts that both sides give back.

    ``a``, ``b``: ids; ``doc_a``, ``doc_b``: number of the text; ``over_a``, ``over_b``:
    token numbers of each overlap, in order; ``link_a``, ``link_b``: those whose ends
    are equal; ``group_a``, ``group_b``: number of a token's group. All count through
    the texts one after another."""

    def __init__(self, left, right, tokens: Sequence[tuple[np.ndarray, np.ndarray]]):
        none = [np.empty(0, np.int64)]
        self.a = np.concatenate([t[0] for t in tokens] or none)
        self.b = np.concatenate([t[1] for t in tokens] or none)
        self.doc_a = np.repeat(np.arange(len(tokens)), [len(t[0]) for t in tokens])
        self.doc_b = np.repeat(np.arange(len(tokens)), [len(t[1]) for t in tokens])
        # Both sides of a text have the same bytes, so sums through all texts keep step.
        ends_a, ends_b = left.sizes[self.a].cumsum(), right.sizes[self.b].cumsum()
        starts_a, starts_b = ends_a - left.sizes[self.a], ends_b - right.sizes[self.b]
        one = pd.DataFrame({"doc": self.doc_a, "start": starts_a, "a": np.arange(len(self.a))})
        two = pd.DataFrame({"doc": self.doc_b, "start": starts_b, "b": np.arange(len(self.b))})
        covering_b = pd.merge_asof(one, two, on="start", by="doc")["b"].to_numpy(np.int64)
        covering_a = pd.merge_asof(two, one, on="start", by="doc")["a"].to_numpy(np.int64)
        # A start shared by both sides is found from both.
        fresh = starts_a[covering_a] != starts_b
        over_a = np.concatenate((one["a"].to_numpy(), covering_a[fresh]))
        over_b = np.concatenate((covering_b, two["b"].to_numpy()[fresh]))
        order = np.argsort(over_a + over_b, kind="stable")      # along the text, both numbers grow
        self.over_a, self.over_b = over_a[order], over_b[order]
        equal = ends_a[self.over_a] == ends_b[self.over_b]
        self.link_a, self.link_b = self.over_a[equal], self.over_b[equal]
        cuts = ends_a[self.link_a]
        self.group_a = np.searchsorted(cuts, starts_a, side="right")
        self.group_b = np.searchsorted(cuts, starts_b, side="right")


@lru_cache(maxsize=1)
def _decimals(size: int) -> list[str]:
    """Decimal ids followed by ',', then by '|', then by ';'."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(size)]


def groups_text(found: Aligned, size: int, n: int) -> list[str]:
    """For each of n texts its groups: ``a1,a2|b1;a3|b2,b3``."""
    key = np.concatenate((2 * found.group_a, 2 * found.group_b + 1))
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate((found.a, found.b))[order]
    ahead = np.append(key[1:], -1)
    mark = np.where(ahead == key, 0, np.where((ahead == key + 1) & (key % 2 == 0), 1, 2))
    index = (ids + mark * size).tolist()
    cuts = [0, *np.cumsum(np.bincount(found.doc_a, minlength=n) + np.bincount(found.doc_b, minlength=n)).tolist()]
    words = _decimals(size)
    return ["".join(map(words.__getitem__, index[x:y]))[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        held.append(row)
        chars += len(row[2] or "")
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _tokens(left, right, texts: Sequence[str | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both sides' ids of each text that they give back, by its number."""
    some = [k for k, t in enumerate(texts) if t]
    picked = [texts[k] for k in some]
    out = {}
    for k, t, a, b in zip(some, picked, left.encode(picked), right.encode(picked), strict=True):
        whole = b" " + t.encode("utf-8")
        if b"".join(map(left.bytes.__getitem__, a.tolist())) == whole == b"".join(map(right.bytes.__getitem__, b.tolist())):
            out[k] = (a, b)
    return out


def _encoded(batches: Iterator[pa.RecordBatch], left_path: str, right_path: str, size: int) -> Iterator[pa.RecordBatch]:
    left, right = side(left_path), side(right_path)
    space = left.size * right.size
    for batch in batches:
        for rows in _slices(batch, size):
            n, tokens = len(rows), _tokens(left, right, [r[2] for r in rows])
            at = np.array(list(tokens), np.int64)
            found = Aligned(left, right, list(tokens.values()))
            doc = found.doc_a[found.link_a]
            n_links = np.bincount(doc, minlength=len(at))
            texts = groups_text(found, max(left.size, right.size), len(at))
            codes, times = np.unique(doc * space + found.a[found.link_a] * right.size + found.b[found.link_b], return_counts=True)
            owner, codes = np.divmod(codes, space)

            def counts(values, at=at, n=n):
                out = np.zeros(n, np.int64)
                out[at] = values
                return out
            digests = [""] * n
            for k, t in zip(at.tolist(), texts, strict=True):
                digests[k] = sha256(t.encode("ascii")).hexdigest()
            stops = np.concatenate(([0], np.cumsum(counts(np.bincount(owner, minlength=len(at)))))).astype(np.int32)
            links = pa.StructArray.from_arrays([pa.array(codes), pa.array(times.astype(np.int64))], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(counts(np.bincount(found.doc_a, minlength=len(at)))), pa.array(counts(np.bincount(found.doc_b, minlength=len(at)))),
                 pa.array(counts(n_links)), pa.array(counts(n_links)), pa.array(digests), pa.ListArray.from_arrays(pa.array(stops), links)],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def _detailed(batches: Iterator[pa.RecordBatch], left_path: str, right_path: str, size: int) -> Iterator[pa.RecordBatch]:
    left, right = side(left_path), side(right_path)
    for batch in batches:
        for rows in _slices(batch, size):
            tokens = _tokens(left, right, [r[2] for r in rows])
            found = Aligned(left, right, list(tokens.values()))
            texts = dict(zip(tokens, groups_text(found, max(left.size, right.size), len(tokens)), strict=True))
            doc = found.doc_a[found.over_a]
            first_a = np.searchsorted(found.doc_a, np.arange(len(tokens)))
            first_b = np.searchsorted(found.doc_b, np.arange(len(tokens)))
            cut = np.searchsorted(doc, np.arange(len(tokens) + 1)).tolist()
            pairs = {}
            for j, k in enumerate(tokens):
                a, b = (x[cut[j]:cut[j + 1]] - first[j] for x, first in ((found.over_a, first_a), (found.over_b, first_b)))
                pairs[k] = [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([texts.get(k, "") for k in range(len(rows))]), pa.array([pairs.get(k, []) for k in range(len(rows))], kind)],
                names=["row", "doc_id", "groups", "overlaps"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").alias("text"))


def align(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE) -> DataFrame:
    """DETAIL per row of docs: the groups as text, and the overlaps as numbers of the
    row's tokens. ``left`` is a byte-level ``.json`` or a ``.model`` file, ``right``
    likewise, at the same place on every executor."""
    return _numbered(docs, id_col, text_col).mapInArrow(partial(_detailed, left_path=left, right_path=right, size=size), DETAIL)


def pair_counts(links: DataFrame, right_size: int) -> DataFrame:
    """(pair, n, best) of (pair, times): how often a pair is linked, and whether no
    other pair of its right id is linked more often."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n")).checkpoint()
    right = F.col("pair") % right_size
    top = counts.groupBy(right.alias("right")).agg(F.max("n").alias("top"))      # one row per id of a vocabulary
    return counts.withColumn("right", right).join(F.broadcast(top), "right").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_counts(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text",
                     size: int = SLICE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: tokens of both sides, groups, links, the links whose count is
    the highest of their right id, the sum of the links' counts, and the groups' digest."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    _numbered(docs, id_col, text_col).mapInArrow(
        partial(_encoded, left_path=left, right_path=right, size=size), ENCODED).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.parquet(path)
    links = encoded.select("row", F.inline("links"))
    counts = pair_counts(links.select("pair", "times"), side(right).size).checkpoint()
    counts = F.broadcast(counts) if counts.count() <= broadcast_rows else counts
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return encoded.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
