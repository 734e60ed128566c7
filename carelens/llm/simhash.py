"""SimHash near-duplicates with bit-sliced comparison.

1. Each text gets a 64-bit fingerprint of its word shingles (Arrow batches, one
   text at a time). Equal fingerprints are one node from then on: copies cost a
   pre-aggregated row, not pairs.
2. The 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within the
   radius agree in at least two blocks, so a fingerprint goes to one bucket per
   pair of blocks, keyed by both blocks' bits. This is exact: no link is lost.
3. Inside a bucket distances are counted bit-sliced: plane p holds bit p of all
   fingerprints, 64 to a machine word. XORed planes are added by carry-save into
   bitwise counters that start so that they overflow beyond the radius; words in
   which every lane has overflowed are abandoned.
4. A bucket gives the edges of a spanning forest, at most one per fingerprint,
   never all its pairs. Buckets over ``BUCKET`` fingerprints are counted first
   and cut into chunks; each pair of chunks is a task's work of bounded size.
5. ``connected_components`` joins the forests.

Defined cases: a text without words has fingerprint zero; a null id takes part as
a node, but names no component (a component of null ids only has a null id).
Repeated rows give repeated results. Empty tables give no rows. Other columns,
whatever their names, pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.components import connected_components
from carelens.llm.skew import apart
from carelens.llm.words import word_ranges

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared in one piece.
BUCKET = 4096
#: Groups up to this size are compared side by side, by shifted planes.
SMALL = 48
#: Hot buckets up to which their table is broadcast.
BROADCAST_ROWS = 500_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    joined = b" ".join(text.encode("utf-8").lower().split()) if text else b""   # bytes.lower: A-Z only
    starts, ends = word_ranges(joined)
    if not len(starts):
        return 0
    first = starts[: max(1, len(starts) - shingle + 1)].tolist()
    last = ends[shingle - 1:].tolist() if len(starts) >= shingle else [len(joined)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), 1 << 15):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k:k + (1 << 15)], last[k:k + (1 << 15)], strict=False)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """The fingerprint of a text column as a (signed) long column."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))
    # Declared nondeterministic so that a filter on the fingerprint (a join's null
    # test) does not compute it a second time.
    return of.asNondeterministic()(text)


# -- comparison ---------------------------------------------------------------

def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the values, each packed 64 lanes to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _within(xor_plane, shape: tuple[int, ...], radius: int, wanted: np.ndarray) -> np.ndarray:
    """Lanes (as words of bits) whose distance is at most radius. ``xor_plane(p,
    alive)`` gives the differing bits of plane p at the flat word numbers alive."""
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    out = np.zeros(int(np.prod(shape)), np.uint64)
    alive = np.flatnonzero(wanted.ravel())
    over = ~wanted.ravel()[alive]
    counter = [np.full(len(alive), _ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
    for p in range(64):
        carry = xor_plane(p, alive)
        for k in range(size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry
        if p % 8 == 7:
            keep = over != _ALL
            if not keep.all():
                alive, over, counter = alive[keep], over[keep], [c[keep] for c in counter]
                if not len(alive):
                    return out.reshape(shape)
    out[alive] = ~over
    return out.reshape(shape)


class Forest:
    """Union of near lanes; every lane's label is the first lane of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                nxt = self.label[self.label]
                if (nxt == self.label).all():
                    break
                self.label = nxt


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[: len(flags)] = flags
    return np.packbits(bits, bitorder="little").view("<u8")


def join_small(values: np.ndarray, group: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins near lanes of equal group: every lane against its s-th successor, for
    all groups at once, by planes shifted s lanes."""
    at = np.arange(len(values))
    sizes = np.bincount(group)[group]
    s = 1
    while len(at):
        planes = planes_of(values[at])
        own, words = group[at], planes.shape[1]
        for _ in range(8):
            if s >= len(at):
                return
            valid = _packed(own[s:] == own[:-s], words)
            if valid.any():
                far, near = divmod(s, 64)
                padded = np.concatenate((planes, np.zeros((64, far + 1), np.uint64)), axis=1)

                def differ(p, alive, padded=padded, far=far, near=near):
                    low = padded[p, alive + far]
                    if near:
                        low = low >> np.uint64(near) | padded[p, alive + far + 1] << np.uint64(64 - near)
                    return padded[p, alive] ^ low
                found = _lanes(_within(differ, (words,), radius, valid))
                forest.join(at[found], at[found + s])
            s += 1
        at = at[sizes[at] > s]


def join_large(values: np.ndarray, at: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins near lanes among ``at``: blocks of queries against all planes."""
    mine = values[at]
    planes, n = planes_of(mine), len(at)
    words = planes.shape[1]
    step = max(1, (1 << 16) // words)
    for q in range(0, n, step):
        queries = mine[q:q + step]
        later = np.arange(words * 64)[None, :] > (q + np.arange(len(queries)))[:, None]
        later[:, n:] = False
        wanted = np.packbits(later, axis=1, bitorder="little").view("<u8")
        masks = planes_of_queries(queries)

        def differ(p, alive, masks=masks):
            return planes[p, alive % words] ^ masks[p, alive // words]
        near = _within(differ, (len(queries), words), radius, wanted)
        row, word = np.nonzero(near)
        if len(row):
            bits = np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(bits)
            forest.join(at[q + row[k]], at[word[k] * 64 + bit])


def planes_of_queries(queries: np.ndarray) -> np.ndarray:
    """For each plane and query: all ones where the query's bit is set, else zero."""
    bits = (queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.uint64(0) - bits


def forest_of(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, value of its tree's first lane) for the lanes that are joined to
    another of their group. ``group`` is sorted."""
    forest = Forest(len(values))
    sizes = np.bincount(group)
    small = sizes[group] <= SMALL
    lanes = np.flatnonzero(small & (sizes[group] > 1))
    if len(lanes):
        own = Forest(len(lanes))
        join_small(values[lanes], np.unique(group[lanes], return_inverse=True)[1], radius, own)
        forest.label[lanes] = lanes[own.label]
    for g in np.flatnonzero(sizes > SMALL):
        join_large(values, np.flatnonzero(group == g), radius, forest)
    moved = np.flatnonzero(forest.label != np.arange(len(values)))
    return values[moved], values[forest.label[moved]]


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Forest edges of sorted (bucket, fp) rows. A batch's last bucket waits for
    the next batch; no bucket holds more than two chunks."""
    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(keys, fps):
        if not len(keys):
            return None
        group = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        several = np.bincount(group)[group] > 1
        if not several.any():
            return None
        a, b = forest_of(fps[several], np.unique(group[several], return_inverse=True)[1], radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(keys):
            cut = int(np.searchsorted(keys, keys[-1]))
            if (made := out(keys[:cut], fps[:cut])) is not None:
                yield made
            held_key, held_fp = keys[cut:], fps[cut:]
    if (made := out(held_key, held_fp)) is not None:
        yield made


# -- the operator -------------------------------------------------------------

def _block_pairs(radius: int) -> list[tuple[int, int]]:
    """(mask of two blocks, number of the pair), over radius + 2 blocks."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(masks, 2))]
    return [(m, k) for k, m in enumerate(signed)]


def near_edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(a, b): forest edges between the different fingerprints ``fp`` of a table
    that has each of them once; both ends are within one tree of links."""
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for m, k in _block_pairs(radius)))
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    hot = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
           .select("key", F.ceil(F.col("n") / bucket).cast("int").alias("parts")).checkpoint())
    n_hot = hot.count()
    compare = partial(_edges, radius=radius)

    def compared(table):
        return table.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")

    if not n_hot:
        return compared(rows)
    side = F.broadcast(hot) if n_hot <= broadcast_rows else hot
    chunked = rows.join(side, "key").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    cells = chunked.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    return compared(rows.join(side, "key", "left_anti")).unionAll(compared(cells))


def near_duplicate_components(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id, first_fp) per different fingerprint of ``prints``
    (doc_id, fp): the smallest id of the component and the fingerprint that has it
    (for a component of null ids: null, and its smallest fingerprint)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")).checkpoint()
    roots = connected_components(near_edges(nodes.select("fp"), radius, bucket))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    first = labelled.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")).alias("m"))
    first = first.select(apart(F.col("root")).alias("key"), "m")
    return labelled.withColumn("key", apart(F.col("root"))).join(first, "key").select("fp", F.col("m.least_id").alias("component_id"), F.col("m.fp").alias("first_fp"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs."""
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         fingerprint_column(F.col(text_col), shingle).alias("fp")).checkpoint()
    parts = near_duplicate_components(prints, radius, bucket)
    return prints.join(parts, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per component, with all its columns: the row with the
    component's smallest id (of repeated such rows one)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    prints = rows.select("doc_id", "fp").checkpoint()
    keep = near_duplicate_components(prints, radius, bucket).filter(F.col("fp") == F.col("first_fp")).select(
        F.col("fp").alias("kept_fp"), F.col("component_id"))
    kept = rows.join(keep, (F.col("fp") == F.col("kept_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["fp", "doc_id"]).select("row.*")
