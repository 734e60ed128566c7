"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of a text. Words that lie in a window
whose word sequence also starts in a document with a smaller id are removed.

1. Every window has a minimiser: the least hash of its ``core``-word runs.
   Consecutive windows with the same minimiser form a super-k-mer, one stretch of
   about ``2 * window`` words. Equal windows have equal minimisers, so a super-k-mer
   whose minimiser occurs once in the corpus holds no repeat and is dropped.
2. Equal super-k-mers (128-bit digest) are aggregated to their smallest id. A later
   document's copy is covered whole; this settles groups of copies without
   bringing their members together.
3. Where different super-k-mers share a minimiser, the first document's stretch
   travels as one packed string to the minimiser's bucket. There its windows are
   sorted, equal ones are counted exactly (hashes first, then the words
   themselves), and those with a smaller id elsewhere are reported.
4. Buckets of more than ``BUCKET`` strings (a passage in very many contexts) are
   known from step 2's counts. Their windows are sent one by one and aggregated
   by Spark (partial aggregation, skew join), so no task holds such a bucket.
5. The covered stretches of a document are joined to it and cut out.

The texts are shuffled once: steps 1, 3 and 5 read the same exchange, and rows with equal
id and text go through them as one. Equal super-k-mers and the windows of step 4 are told
apart by 128-bit digests, the texts of one id by 64 bits; step 3 compares words.

Defined cases: a null or blank text, and one shorter than a window, loses nothing; a
text of any length is read whole. An empty table gives no rows.
A null id counts as greater than every id, and no id is smaller than itself, so
rows with equal ids (repeated rows among them) and rows with null ids do not
remove each other's words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.skew import apart
from carelens.llm.words import normalised, window_hashes, word_hashes, word_ranges

WINDOW, CORE = 50, 8
#: Windows of a super-k-mer at most (a run of one repeated word is cut there).
LONGEST = 256
#: Strings of a minimiser's bucket that are sorted in one task.
BUCKET = 2000
NO_ID = (1 << 63) - 1

PIECE = "ord long, th long, begin int, n int, core long, k1 long, k2 long"
PACKED = "core long, ord long, k1 long, k2 long, packed binary"
SINGLE = "ord long, k1 long, k2 long, w1 long, w2 long, at int"
FOUND = "k1 long, k2 long, spans array<int>"
RESULT = "ord long, th long, n_words long, n_removed long, kept string"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width, low = 1, x
    while 2 * width <= size:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def superkmers(joined: bytes, window: int, core: int):
    """(starts, ends, first window, windows, minimiser) of a normalised text:
    word ranges, and one entry of the last three per super-k-mer."""
    starts, ends = word_ranges(joined)
    if len(starts) < window:
        return starts, ends, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _sliding_min(window_hashes(word_hashes(joined, starts, ends), core), window - core + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    size = np.diff(np.concatenate((first, [len(least)])))
    if size.max() > LONGEST:
        first = np.concatenate([np.arange(f, f + s, LONGEST) for f, s in zip(first, size, strict=True)])
        size = np.diff(np.concatenate((first, [len(least)])))
    return starts, ends, first, size, least[first]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                      names=[f.split()[0] for f in schema.split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch], window: int, core: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ords, ths, begins, sizes, cores, digests = [], [], [], [], [], []
        for o, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            joined = normalised(text)
            starts, ends, first, size, least = superkmers(joined, window, core)
            if len(first):
                ords.append(np.full(len(first), o))
                ths.append(np.full(len(first), t))
                begins.append(first)
                sizes.append(size)
                cores.append(least)
                digests += [xxhash.xxh3_128_digest(joined[a:b]) for a, b in
                            zip(starts[first].tolist(), ends[first + size + window - 2].tolist(), strict=True)]
        if ords:
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield _batch(PIECE, np.concatenate(ords), np.concatenate(ths), np.concatenate(begins).astype(np.int32),
                         np.concatenate(sizes).astype(np.int32), np.concatenate(cores).view(np.int64),
                         np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))


def _asked(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
    """(id, request, normalised text, starts, ends) of the requests of one kind."""
    for o, text, asked in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
        wanted = [p for p in asked or () if p["hot"] == hot]
        if wanted:
            joined = normalised(text)
            starts, ends = word_ranges(joined)
            for p in wanted:
                yield o, p, joined, starts, ends


def _sliced(schema: str, rows: list[tuple], types: list[pa.DataType], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        yield _batch(schema, *(pa.array(c, t) for c, t in zip(zip(*rows[k:k + size], strict=True), types, strict=True)))


def _packed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The packed strings asked of each document."""
    for batch in batches:
        rows = [(p["core"], o, p["k1"], p["k2"], joined[starts[p["begin"]]:ends[p["begin"] + p["n"] + window - 2]])
                for o, p, joined, starts, ends in _asked(batch, hot=False)]
        yield from _sliced(PACKED, rows, [pa.int64()] * 4 + [pa.binary()])


def _single(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For hot minimisers: a row with a digest per window instead."""
    for batch in batches:
        rows = []
        for o, p, joined, starts, ends in _asked(batch, hot=True):
            for i in range(p["n"]):
                d = xxhash.xxh3_128_digest(joined[starts[p["begin"] + i]:ends[p["begin"] + i + window - 1]])
                rows.append((o, p["k1"], p["k2"], int.from_bytes(d[:8], "little", signed=True),
                             int.from_bytes(d[8:], "little", signed=True), i))
        yield from _sliced(SINGLE, rows, [pa.int64()] * 5 + [pa.int32()])


def _spans(flags: np.ndarray) -> list[int]:
    """Begin and end (exclusive) of each run of true flags, one after another."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).ravel().tolist()


def count_bucket(ords: list[int], strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string of one bucket: which of its windows also stand in a string
    with a smaller id."""
    ranges = [word_ranges(s) for s in strings]
    hashes = [window_hashes(word_hashes(s, a, b), window) for s, (a, b) in zip(strings, ranges, strict=True)]
    counts = [len(h) for h in hashes]
    allh, owner = np.concatenate(hashes), np.repeat(np.arange(len(strings)), counts)
    at = np.concatenate([np.arange(c) for c in counts])
    order = np.lexsort((np.asarray(ords)[owner], allh))
    flags = [np.zeros(c, bool) for c in counts]

    def words(k: int) -> bytes:
        a, b = ranges[owner[k]]
        return strings[owner[k]][a[at[k]]:b[at[k] + window - 1]]

    same = np.flatnonzero(allh[order][1:] == allh[order][:-1])
    if len(same):
        edges = np.flatnonzero(np.diff(same) > 1)
        for run in np.split(same, edges + 1):
            first: dict[bytes, int] = {}      # more than one entry only if hashes collide
            for k in order[run[0]:run[-1] + 2].tolist():
                if ords[owner[k]] > first.setdefault(words(k), ords[owner[k]]):
                    flags[owner[k]][at[k]] = True
    return flags


def _counted(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (core, ord, k1, k2, packed), sorted by core, to the spans of windows to remove."""
    held: list[tuple] = []

    def settle(rows):
        out = []
        if len(rows) > 1:
            for r, f in zip(rows, count_bucket([r[1] for r in rows], [r[4] for r in rows], window), strict=True):
                if f.any():
                    out.append((r[2], r[3], _spans(f)))
        return out

    types = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    for batch in batches:
        made = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != row[0]:
                made += settle(held)
                held = []
            held.append(row)
        yield from _sliced(FOUND, made, types)
    yield from _sliced(FOUND, settle(held), types)


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for o, th, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            joined = normalised(text)
            n = joined.count(b" ") + 1 if joined else 0
            removed = 0
            if spans:
                edge = np.zeros(n + 1, np.int32)
                for s in spans:
                    pairs = np.asarray(s).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.subtract.at(edge, pairs[:, 1] + window - 1, 1)
                gone = np.cumsum(edge[:n]) > 0
                removed = int(gone.sum())
                joined = b" ".join(w for w, g in zip(joined.split(b" "), gone.tolist(), strict=True) if not g)
            rows.append((o, th, n, removed, joined.decode("utf-8") if with_text else hashlib.sha256(joined).hexdigest()))
        yield from _sliced(RESULT, rows, [pa.int64()] * 4 + [pa.string()])


def remove_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE, bucket: int = BUCKET, with_text: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): per row of docs the words that stay,
    joined by one space (``with_text=False``: kept_sha256, their digest)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"),
                         F.xxhash64("text").alias("th"))
    # Equal rows go on as one, combined before the shuffle that all uses of the texts share.
    once = keyed.groupBy("ord", "th").agg(F.first("text").alias("text"))
    pieces = once.select("ord", "th", "text").mapInArrow(partial(_pieces, window=window, core=min(core, window)), PIECE)
    repeated = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > 1).select(
        apart(F.col("core")).alias("key"))
    pieces = pieces.withColumn("key", apart(F.col("core"))).join(repeated, "key", "left_semi").select("ord", "th", "begin", "n", "core", "k1", "k2").checkpoint()

    first = pieces.groupBy("k1", "k2").agg(F.min(F.struct("ord", "th", "begin", "n", "core")).alias("f")).select(
        "k1", "k2", "f.*").checkpoint()
    shared = first.groupBy("core").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") > 1).checkpoint()
    any_hot = not shared.filter(F.col("strings") > bucket).isEmpty()
    asked = first.join(shared, "core").groupBy("ord", "th").agg(F.collect_list(
        F.struct("core", "k1", "k2", "begin", "n", (F.col("strings") > bucket).alias("hot"))).alias("asked"))
    # No checkpoint here, and the same columns as in the last join: both then read
    # one exchange of the texts.
    joined = once.join(asked, ["ord", "th"], "left").select("th", "ord", "text", "asked")
    partly = (joined.mapInArrow(partial(_packed, window=window), PACKED)
              .repartition("core").sortWithinPartitions("core").mapInArrow(partial(_counted, window=window), FOUND))
    if any_hot:
        single = joined.mapInArrow(partial(_single, window=window), SINGLE)
        least = single.groupBy("w1", "w2").agg(F.min("ord").alias("least")).select(apart(F.col("w1")).alias("key"), "w2", "least")
        partly = partly.unionAll(
            single.withColumn("key", apart(F.col("w1"))).join(least, ["key", "w2"]).filter(F.col("ord") > F.col("least"))
            .groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + 1))).alias("spans")))

    verdict = first.select("k1", "k2", F.col("ord").alias("first_ord")).join(partly, ["k1", "k2"], "left")
    later = F.col("ord") > F.col("first_ord")
    verdict = verdict.select(apart(F.col("k1")).alias("key"), F.col("k2").alias("key2"), "first_ord", "spans")
    covers = (pieces.join(verdict, (apart(F.col("k1")) == F.col("key")) & (F.col("k2") == F.col("key2"))).filter(later | F.col("spans").isNotNull())
              .select("ord", "th", F.when(later, F.array(F.col("begin"), F.col("begin") + F.col("n")))
                      .otherwise(F.transform("spans", lambda s: s + F.col("begin"))).alias("spans"))
              .groupBy("ord", "th").agg(F.collect_list("spans").alias("spans")))
    cut = once.join(covers, ["ord", "th"], "left").select("ord", "th", "text", "spans").mapInArrow(
        partial(_cut, window=window, with_text=with_text), RESULT)
    cut = cut.select(apart(F.col("th")).alias("key"), F.col("ord").alias("of"), "n_words", "n_removed", "kept")
    out = keyed.select("doc_id", "ord", apart(F.col("th")).alias("key")).join(cut.withColumnRenamed("of", "ord"), ["ord", "key"])
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept" if with_text else "kept_sha256"))
