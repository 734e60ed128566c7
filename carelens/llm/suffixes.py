"""Suffix-array dedup: bytes that repeat ``LENGTH`` at a time from a smaller id.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. Strings lie inside one document, and are judged on the input.

The texts are stored once, bucketed by a row number, and only the stored copy is
read: the four steps that need texts join it without moving it.

1. Copies of a whole text are settled by digest: a copy with a greater id loses all.
   One row of each text goes on.
2. Filter. Every window of LENGTH bytes has an anchor, the least hash of its ``CORE``-
   byte runs; neighbouring windows with one anchor are a stretch. Equal windows have
   equal anchors, so a stretch can only matter if another text has its anchor. A task
   asks for each anchor of its slice of texts once, packed in binary columns, whatever
   number of its texts hold it; what a slice shares inside is known there. So a
   hot anchor costs a row entry per slice, not per document.
3. Equal stretches are aggregated to their smallest id (a later copy is covered whole).
   Where different stretches share an anchor, their first copies travel to it as strings.
4. There the strings of many anchors are joined to one text, and sorted by prefixes of
   at least LENGTH bytes, which gives its Burrows-Wheeler transform. Intervals of equal
   prefixes are expanded breadth first, one byte to the left a round, and the common
   prefix of neighbours gets its value in the round in which an interval first ends
   between them. After LENGTH rounds, neighbours without a value share LENGTH bytes
   or more; each run of them is one repeated string, and its smallest id keeps it.
5. An anchor with more than ``BUCKET`` different stretches (a passage in very many
   contexts) sends its windows one by one, and Spark aggregates them (partial
   aggregation, skew join), so no task holds such an anchor's strings.
6. The covered stretches of a text are joined to it and cut out.

Whole texts are told apart by SHA-256, equal stretches by 128 bits (anchor and XXH3),
the windows of step 5 by 128 bits of XXH3; in step 4 bytes are compared.

Defined cases: a null or empty text, and one shorter than LENGTH, loses nothing. A
null id counts as greater than every id; rows with equal ids (repeated rows among
them) and rows with null ids do not remove each other's bytes. A long text is cut
into overlapping slices for steps 2 and 3. An empty table gives no rows. Only the
named columns are read. What stays of a text need not be valid UTF-8.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.skew import apart
from carelens.llm.words import mix
from carelens.session import ensure_checkpoint_dir

LENGTH, CORE = 50, 20
#: Windows of a stretch at most (a run of one byte is cut there).
LONGEST = 256
#: Strings of an anchor that are compared in one task.
BUCKET = 20_000
#: Bytes of text that a task hashes, or sorts, at a time, and hashes that stay in a cache.
SLICE, SORTED, CACHED = 1 << 20, 1 << 17, 1 << 15
#: Bytes of text in a bucket of the stored table. There are no fewer buckets than shuffle
#: partitions, or Spark would deal the texts out again for the sake of parallelism.
BUCKET_BYTES = 1 << 25
#: Least number of slots of anchors, and bytes of text a slot stands for beyond it.
SLOTS, SLOT_BYTES = 512, 1 << 24
NO_ID = (1 << 63) - 1

ASK = "slot int, asks binary, rid long, cores binary"
ANSWER = "rid long, cores binary"
#: ``at`` is the first window times 512, plus the number of windows.
PIECE = "row long, ord long, at long, core long, k long"
STRING = "core long, ord long, k long, packed binary"
SINGLE = "ord long, core long, k long, w1 long, w2 long, i int"
FOUND = "core long, k long, spans array<int>"
#: Odd multipliers of the hash of a run of bytes.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
CUT = "digest string, n_removed long, n_spans long, kept binary, kept_sha256 string"


# -- anchors --------------------------------------------------------------------

def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours."""
    done, reach = x, 1
    while reach < size:
        step = min(reach, size - reach)
        done, reach = np.minimum(done[:-step], done[step:]), reach + step
    return done


def slices(rows: Sequence[tuple], length: int, size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of rows (number, bytes), ``size`` bytes at a time: (data, ends, row numbers,
    offsets), one entry of the last three per part. A longer text is cut into parts
    that share ``length - 1`` bytes, so every window lies in exactly one."""
    data, ends, owners, offsets, total = [], [], [], [], 0

    def made():
        return b"".join(data), np.array(ends), np.array(owners), np.array(offsets)
    for number, text in rows:
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at:at + size + length - 1]
            total += len(part)
            data.append(part)
            ends.append(total)
            owners.append(number)
            offsets.append(at)
            if total >= size:
                yield made()
                data, ends, owners, offsets, total = [], [], [], [], 0
    if data:
        yield made()


def _anchors(data: bytes, length: int, core: int) -> np.ndarray:
    """The least hash of the ``core``-byte runs of each window. A run is read as
    overlapping words of eight bytes, all offsets at once."""
    n, span = len(data), length - core
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    tail = np.uint64((1 << 8 * min(core, 8)) - 1)
    at = [*range(0, core - 8, 8), max(0, core - 8)]
    out = np.empty(n - length + 1, np.uint64)
    for a in range(0, len(out), CACHED):
        m = min(CACHED, len(out) - a) + span
        x = np.zeros(m, np.uint64)
        for k, o in enumerate(at):
            x ^= words[a + o:a + o + m] & tail
            x *= np.uint64(_ODD[k % len(_ODD)])
            x ^= x >> np.uint64(29)
        out[a:a + m - span] = _least(mix(x), span + 1)
    return out


def stretches(data: bytes, ends: np.ndarray, length: int, core: int):
    """(part, first window, windows, anchor) of the stretches of joined parts."""
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    least = _anchors(data, length, core)
    # A stretch ends where the anchor changes, where a part begins, and where its windows would leave it.
    cuts = np.concatenate((np.flatnonzero(least[1:] != least[:-1]) + 1, ends - np.diff(ends, prepend=0), ends - length + 1))
    first = np.unique(cuts[(cuts >= 0) & (cuts < len(least))])
    size = np.diff(np.append(first, len(least)))
    if size.max() > LONGEST:
        first = np.concatenate([np.arange(f, f + s, LONGEST) for f, s in zip(first.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(first, len(least)))
    part = np.searchsorted(ends, first, side="right")
    keep = first + length <= ends[part]
    first, size = first[keep], size[keep]
    return part[keep], first, size, least[first]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _by_run(key: np.ndarray) -> np.ndarray:
    """Begin of each run of equal neighbours, and the end of the last."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


#: The part of an anchor that asks and answers carry.
_LOW = np.uint64((1 << 40) - 1)


def _pack(anchor: np.ndarray, rid: np.ndarray) -> bytes:
    """Five bytes of each anchor (the slot tells of the others), then the row numbers."""
    return anchor.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + rid.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 13
    anchor = np.zeros((n, 8), np.uint8)
    anchor[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(-1, 5)
    return anchor.view(np.uint64).ravel(), np.frombuffer(blob, np.int64, n, 5 * n)


def _asks(batches: Iterator[pa.RecordBatch], length: int, core: int, slots: int) -> Iterator[pa.RecordBatch]:
    """What a slice asks of the slots: (anchor, text) for anchors of one text, (anchor, -1)
    for those it knows to be shared; and the shared anchors of its own texts."""
    for batch in batches:
        rows = ((r, t.encode("utf-8")) for r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for data, ends, owners, _ in slices(rows, length, SLICE):
            part, _, _, anchor = stretches(data, ends, length, core)
            if not len(part):
                continue
            rid = owners[part]
            order = np.lexsort((rid, anchor))
            anchor, rid = anchor[order], rid[order]
            fresh = np.ones(len(rid), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (rid[1:] != rid[:-1])
            anchor, rid = anchor[fresh], rid[fresh]
            runs = _by_run(anchor)
            several = np.diff(runs) > 1
            asked, asker = anchor[runs[:-1]], np.where(several, -1, rid[runs[:-1]])
            slot = (asked >> np.uint64(40)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            slot, asked, asker = slot[order].astype(np.int32), asked[order], asker[order]
            cuts = _by_run(slot)
            blobs = [_pack(asked[a:b], asker[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            none = [None] * len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(slot[cuts[:-1]]), pa.array(blobs, pa.binary()), pa.array(none, pa.int64()),
                                              pa.array(none, pa.binary())], names=_names(ASK))
            shared = np.repeat(several, np.diff(runs))
            if shared.any():
                out = _answers(anchor[shared] & _LOW, rid[shared])
                own = pa.array((out.column(0).to_numpy() % slots).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own, pa.array([None] * len(own), pa.binary()), *out.columns], names=_names(ASK))


def _answers(anchor: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    """Rows (text, its anchors)."""
    order = np.argsort(rid, kind="stable")
    anchor, rid = anchor[order], rid[order]
    cuts = _by_run(rid)
    blobs = [anchor[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(rid[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=_names(ANSWER))


def _settled(asks: list[bytes]) -> pa.RecordBatch:
    """The texts of one slot's asks whose anchor another one asks for too."""
    anchor, rid = map(np.concatenate, zip(*map(_unpack, asks), strict=True))
    order = np.lexsort((rid, anchor))
    anchor, rid = anchor[order], rid[order]
    fresh = np.ones(len(rid), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (rid[1:] != rid[:-1])
    anchor, rid = anchor[fresh], rid[fresh]
    runs = np.diff(_by_run(anchor))
    told = (np.repeat(runs, runs) > 1) & (rid != -1)
    return _answers(anchor[told], rid[told])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of the slots, whose rows come in order of their slot."""
    slot, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        known = [(r, c) for r, c in zip(*columns[2:], strict=True) if r is not None]
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in known], pa.int64()), pa.array([k[1] for k in known], pa.binary())],
                                             names=_names(ANSWER))
        for s, asks in zip(columns[0], columns[1], strict=True):
            if asks is None:
                continue
            if s != slot and held:
                yield _settled(held)
                held = []
            slot = s
            held.append(asks)
    if held:
        yield _settled(held)


def _batches(schema: str, rows: Sequence[tuple], types: Sequence[pa.DataType], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        columns = zip(*rows[k:k + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(schema))


def _pieces(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """The stretches of the stored texts whose anchor is shared."""
    for batch in batches:
        numbers, ords, texts, lists = (c.to_pylist() for c in batch.columns)
        wanted = [np.unique(np.frombuffer(b"".join(x), np.uint64)) for x in lists]
        rows = ((k, t.encode("utf-8")) for k, t in enumerate(texts))
        for data, ends, owners, offsets in slices(rows, length, SLICE):
            part, first, size, anchor = stretches(data, ends, length, core)
            low = anchor & _LOW
            keep = np.zeros(len(part), bool)
            cuts = np.searchsorted(part, np.arange(len(ends) + 1)).tolist()
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                mine = wanted[owners[p]]
                found = np.minimum(np.searchsorted(mine, low[a:b]), len(mine) - 1)
                keep[a:b] = mine[found] == low[a:b]
            if not keep.any():
                continue
            part, first, size, anchor = part[keep], first[keep], size[keep], anchor[keep]
            digest = xxhash.xxh3_64_intdigest
            keys = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)], np.uint64)
            owner = owners[part]
            begin = first - (ends - np.diff(ends, prepend=0))[part] + offsets[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(numbers, np.int64)[owner]), pa.array(np.array(ords, np.int64)[owner]),
                 pa.array((begin * 512 + size).astype(np.int64)), pa.array(anchor.view(np.int64)), pa.array(keys.view(np.int64))], names=_names(PIECE))


def _asked(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
    """(id, anchor, key, first window, windows, text) of the requests of one kind."""
    for o, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        wanted = [p for p in asked if p["hot"] == hot]
        if wanted:
            data = text.encode("utf-8")
            for p in wanted:
                yield o, p["core"], p["k"], *divmod(p["at"], 512), data


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The strings asked of each text."""
    types = [pa.int64()] * 3 + [pa.binary()]
    for batch in batches:
        rows = [(core, o, k, data[begin:begin + n + length - 1]) for o, core, k, begin, n, data in _asked(batch, hot=False)]
        yield from _batches(STRING, rows, types)


def _singles(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For hot anchors: a digest per window instead."""
    types = [pa.int64()] * 5 + [pa.int32()]
    for batch in batches:
        rows = []
        for o, core, k, begin, n, data in _asked(batch, hot=True):
            for i in range(n):
                d = xxhash.xxh3_128_digest(data[begin + i:begin + i + length])
                rows.append((o, core, k, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i))
        yield from _batches(SINGLE, rows, types)


# -- the transform ----------------------------------------------------------------

def sorted_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``length`` symbols (or some
    more), by doubling the sorted prefix."""
    n, reach = len(symbols), 7
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(reach, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = key << 9 | padded[k:k + n]
    while True:
        order = np.argsort(key)
        if reach >= length:
            return order
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) + 1
        behind = np.zeros(n, np.int64)
        behind[:max(0, n - reach)] = rank[reach:]
        key, reach = rank * (n + 1) + behind, 2 * reach


def common_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it), for prefixes
    under ``length``; ``length`` stands for all longer ones. Symbol 0 ends a string:
    suffixes that begin with one, or differ only behind one, have no defined value."""
    n = len(symbols)
    order = sorted_suffixes(symbols, length)
    last = symbols[order - 1]                                    # the transform
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)                                 # where the suffix one symbol longer stands
    step[by_symbol] = np.arange(n)
    head = symbols[order]
    opens = np.ones(n + 1, bool)                                 # the first suffix of each symbol
    opens[1:n] = head[1:] != head[:-1]
    prefix = np.full(n + 1, length, np.int64)
    prefix[0] = prefix[n] = 0
    mark = np.full(n + 2, -1, np.int64)                          # interval of each place, shifted by one
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for value in range(length):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        left = last[at] != 0
        place, owner = step[at[left]], owner[left]
        # Members of one interval with one symbol before them stand side by side.
        mark[place + 1] = owner
        begins = np.sort(place[(mark[place] != owner) | opens[place]])
        stops = np.sort(place[(mark[place + 2] != owner) | opens[place + 1]]) + 1
        mark[place + 1] = -1
        fresh = prefix[stops] == length
        low, high = begins[fresh], stops[fresh]
        prefix[high] = value
        if not len(low):
            break
    return order, prefix[:n]


def _flagged(ords: Sequence[int], strings: Sequence[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Over the strings joined, each with a 0 behind it: which places begin a window
    that also stands in a string with a smaller id; and the strings' ends."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), np.uint16)
    spots = np.ones(len(symbols), bool)
    spots[ends - 1] = False
    symbols[spots] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    order, prefix = common_prefixes(symbols, length)
    whole = order + length < ends[owner[order]]
    group = np.cumsum(prefix < length)[whole]                    # a new string where the prefix ends early
    found, mine = order[whole], np.asarray(ords)[owner[order[whole]]]
    flags = np.zeros(len(symbols), bool)
    if len(found):
        starts = _by_run(group)
        least = np.repeat(np.minimum.reduceat(mine, starts[:-1]), np.diff(starts))
        flags[found[mine > least]] = True
    return flags, ends


def repeated_windows(ords: Sequence[int], strings: Sequence[bytes], length: int) -> dict[int, list[int]]:
    """For the number of each string with windows that also stand in one with a smaller
    id: begin and end (exclusive) of each run of such windows, one after another."""
    flags, ends = _flagged(ords, strings, length)
    runs = np.array(_spans(flags), np.int64).reshape(-1, 2)      # no run goes on behind a string
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    runs -= np.concatenate(([0], ends))[owner][:, None]
    cuts = _by_run(owner)
    return {int(owner[a]): runs[a:b].ravel().tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}


def _spans(flags: np.ndarray) -> list[int]:
    """Begin and end (exclusive) of each run of true flags, one after another."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).ravel().tolist()


def _expanded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """STRING rows, sorted by anchor, to the windows to remove: the strings of as many
    whole anchors as make up a text of SORTED bytes are expanded together."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    held: list[tuple] = []

    def settled():
        found = repeated_windows([r[1] for r in held], [r[3] for r in held], length)
        return [(held[k][0], held[k][2], spans) for k, spans in found.items()]

    total = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if total >= SORTED and held[-1][0] != row[0]:
                yield from _batches(FOUND, settled(), types)
                held, total = [], 0
            held.append(row)
            total += len(row[3])
    if held:
        yield from _batches(FOUND, settled(), types)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for digest, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8")
            pairs = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
            edge = np.bincount(pairs[:, 0], minlength=len(data) + 1) - np.bincount(pairs[:, 1] + length - 1, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((digest, int(gone.sum()), len(_spans(gone)) // 2, kept, sha256(kept).hexdigest()))
        yield from _batches(CUT, rows, types, 1000)


# -- Spark ------------------------------------------------------------------------

def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Written once to the shared folder, in buckets of the key, and read again: joins
    on the key leave these rows where they are. The table's name is dropped at once,
    the files stay."""
    spark = df.sparkSession
    name = f"carelens_texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    (df.repartition(buckets, key).write.option("compression", "zstd").option("path", path).format("parquet")
     .bucketBy(buckets, key).saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def _beside(texts: DataFrame, side: DataFrame) -> DataFrame:
    """The bucketed texts that have a row in ``side`` (one per row number, small beside
    the text): a hash join in each bucket, without sorting texts."""
    return texts.join(side.hint("shuffle_hash"), "row")


def shared_anchors(texts: DataFrame, length: int, core: int, slots: int) -> DataFrame:
    """(row, lists): anchors of texts (row, text) that also stand in another text."""
    asks = texts.select("row", "text").mapInArrow(partial(_asks, length=length, core=core, slots=slots), ASK)
    answers = asks.repartition("slot").sortWithinPartitions("slot").mapInArrow(_shared, ANSWER)
    return answers.groupBy(F.col("rid").alias("row")).agg(F.collect_list("cores").alias("lists"))


def covered_stretches(texts: DataFrame, lists: DataFrame, length: int, core: int, bucket: int) -> DataFrame:
    """(row, spans): the windows to remove of the stored texts (row, ord, text)."""
    known = _beside(texts.select("row", "ord", "text"), lists).select("row", "ord", "text", "lists")
    pieces = _stored(known.mapInArrow(partial(_pieces, length=length, core=core), PIECE), "pieces")
    first = pieces.groupBy("core", "k").agg(F.min(F.struct("ord", "row", "at")).alias("f")).select("core", "k", "f.*").checkpoint()
    several = first.groupBy("core").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") > 1).checkpoint()
    any_hot = not several.filter(F.col("strings") > bucket).isEmpty()
    asked = first.join(several, "core").groupBy("row").agg(F.collect_list(
        F.struct("core", "k", "at", (F.col("strings") > bucket).alias("hot"))).alias("asked"))
    joined = _beside(texts.select("row", "ord", "text"), asked).select("ord", "text", "asked")
    found = (joined.mapInArrow(partial(_strings, length=length), STRING)
             .repartition("core").sortWithinPartitions("core").mapInArrow(partial(_expanded, length=length), FOUND))
    if any_hot:
        single = joined.mapInArrow(partial(_singles, length=length), SINGLE)
        least = single.groupBy("w1", "w2").agg(F.min("ord").alias("least")).select(apart(F.col("w1")).alias("key"), "w2", "least")
        found = found.unionAll(
            single.withColumn("key", apart(F.col("w1"))).join(least, ["key", "w2"]).filter(F.col("ord") > F.col("least"))
            .groupBy("core", "k").agg(F.flatten(F.collect_list(F.array(F.col("i"), F.col("i") + 1))).alias("spans")))
    verdict = (first.select("core", "k", F.col("ord").alias("first_ord")).join(found, ["core", "k"], "left")
               .select(apart(F.col("k")).alias("key"), F.col("core").alias("of"), "first_ord", "spans"))
    later = F.col("ord") > F.col("first_ord")
    begin, n = F.shiftright("at", 9).cast("int"), F.col("at").bitwiseAND(F.lit(511)).cast("int")
    return (pieces.join(verdict, (apart(F.col("k")) == F.col("key")) & (F.col("core") == F.col("of")))
            .filter(later | F.col("spans").isNotNull())
            .select("row", F.when(later, F.array(begin, begin + n)).otherwise(F.transform("spans", lambda s: s + begin)).alias("spans"))
            .groupBy("row").agg(F.collect_list("spans").alias("spans")))


def remove_byte_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, bucket: int = BUCKET, with_text: bool = True,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of docs: the bytes
    that stay, one after another (``with_text=False``: kept_sha256, their digest)."""
    core = min(core, length)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), "text", F.sha2("text", 256).alias("digest"),
                         F.octet_length("text").cast("long").alias("n_bytes"))
    long = texts.filter(F.col("n_bytes") >= length)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    table = _bucketed(long.select(F.monotonically_increasing_id().alias("row"), "digest", "ord", "text"), "row",
                      max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    firsts = table.groupBy("digest").agg(F.min(F.struct("ord", "row")).alias("f")).select("digest", "f.*").checkpoint()
    lists = shared_anchors(_beside(table.select("row", "text"), firsts.select("row")), length, core, max(SLOTS, -(-total // SLOT_BYTES)))
    covers = covered_stretches(table, lists, length, core, bucket)
    cut = _beside(table.select("row", "digest", "text"), covers).select("digest", "text", "spans").mapInArrow(partial(_cut, length=length), CUT)
    cut = cut if with_text else cut.drop("kept")
    verdict = firsts.select("digest", F.col("ord").alias("first_ord")).join(cut, "digest", "left")
    verdict = verdict.withColumn("key", F.reverse("digest")).drop("digest")         # see skew.py
    rows = texts if with_text else texts.drop("text")
    out = rows.join(verdict, F.reverse(rows["digest"]) == verdict["key"], "left")
    copy = F.coalesce(F.col("ord") > F.col("first_ord"), F.lit(False))
    none = F.lit(0).cast("long")
    kept = (F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept") if with_text else
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
                      F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"), kept)
