"""Merkle manifest of a dataset: blocks in van Emde Boas order, proofs, checks.

The leaves of a group (a language) stand in the order of their ids; runs of eight
nodes become one, until one is left, the group's subroot. The subroots, ordered by
group, are the leaves of one more tree, whose root covers the dataset.

1. Leaves are digests of a row's fields, computed in Spark expressions. Equal
   leaves are counted first; then they are range partitioned, numbered inside a
   partition, and shifted by the sums of the earlier partitions. No task numbers a
   whole group.
2. A tree is stored as blocks: aligned subtrees of ``HEIGHT`` reductions (512
   leaves), each one row whose nodes lie in van Emde Boas order. The subtree is cut
   at half its height; the top part comes first, then the parts below it from left
   to right, each laid out by the same rule. ``address`` computes a node's place
   from depth and index alone, so construction and sibling retrieval use no
   pointers and touch few stretches of the block.
3. The block roots are the leaves of the next layer, which is cut into blocks by
   the same rule, until every tree has one block root. A layer is one shuffle of
   nodes, a 512th of the layer below.
4. Proofs come top down: a block's upward path joins the block, and its leaves get
   the siblings inside the block followed by that path. Upper layers only pass paths
   on; the lowest one yields the rows.

Defined cases: a null field counts as ``-``, a null or empty text has a leaf like
any other, a text of any length is digested where it is read. Ids ascend with null
first; rows of one id follow each other by leaf; repeated rows are leaves each, with
their own siblings. A null group is the first of the groups. An empty table has no
rows and no root. Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Children of a node, and reductions inside one block.
FAN, HEIGHT = 8, 3

PLACED = "part int, tree string, id long, digest string, other string, copies long, place long"
BLOCK = "tree string, block long, n long, height int, nodes binary, root string, ids array<long>, others array<string>"
_STEP = "struct<before: string, after: string>"
PATHS = f"tree string, pos long, subroot string, path array<{_STEP}>"
PROOF = "doc_id long, leaf string, subroot string, root string, folded_root string, verified boolean"


# -- van Emde Boas order --------------------------------------------------------

def nodes_in(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` (from the left) of a depth, in a subtree of
    ``levels`` levels: the upper half of the levels first, then the subtrees below."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = levels - top
    width = FAN ** (depth - top)
    return nodes_in(top) + index // width * nodes_in(below) + address(below, depth - top, index % width)


@lru_cache(maxsize=16)
def _addresses(height: int) -> list[list[int]]:
    """Places of all nodes, by depth from the block's root down."""
    return [address(height + 1, d, np.arange(FAN ** d)).tolist() for d in range(height + 1)]


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def block_nodes(leaves: Sequence[str], height: int) -> list[str]:
    """The nodes over at most FAN^height leaves, in van Emde Boas order; places
    without a node hold ''."""
    at = _addresses(height)
    nodes = [""] * nodes_in(height + 1)
    for a, leaf in zip(at[height], leaves, strict=False):
        nodes[a] = leaf
    count = len(leaves)
    for depth in range(height - 1, -1, -1):
        below, own = at[depth + 1], at[depth]
        for i in range(-(-count // FAN)):
            nodes[own[i]] = _digest(*(nodes[a] for a in below[i * FAN:min(i * FAN + FAN, count)]))
        count = -(-count // FAN)
    return nodes


def block_steps(nodes: Sequence[str], height: int, count: int) -> list[list[tuple[str, str]]]:
    """For each level from the leaves up to below the root, and each node there:
    its siblings to the left and to the right, joined."""
    at, out = _addresses(height), []
    for depth in range(height, 0, -1):
        level = []
        for i in range(0, count, FAN):
            run = [nodes[a] for a in at[depth][i:min(i + FAN, count)]]
            level += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        out.append(level)
        count = -(-count // FAN)
    return out


def fold(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings, level by level, lead to."""
    for before, after in path:
        digest = _digest(before, digest, after)
    return digest


def _packed(nodes: Sequence[str]) -> bytes:
    return b"".join(bytes.fromhex(x) if x else bytes(32) for x in nodes)


def _unpacked(block: bytes) -> list[str]:
    text, none = block.hex(), "0" * 64
    return ["" if (x := text[k:k + 64]) == none else x for k in range(0, len(text), 64)]


# -- Spark ------------------------------------------------------------------------

def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, ':' and value; null: '-'."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _numbered_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows how many leaves of their tree precede them in the partition."""
    last, upto = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = batch.column(1).to_pylist()
        copies = batch.column(5).to_numpy(zero_copy_only=False)
        before = np.cumsum(copies) - copies
        first = np.array([k == 0 or trees[k] != trees[k - 1] for k in range(len(trees))])
        start = np.maximum.accumulate(np.where(first, np.arange(len(trees)), 0))
        place = before - before[start]
        if trees[0] == last:
            place[start == 0] += upto
        last, upto = trees[-1], int(place[-1] + copies[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())],
                                         names=[f.split()[0] for f in PLACED.split(", ")])


def numbered(leaves: DataFrame, order: Sequence[str] = ("id", "digest", "other")) -> DataFrame:
    """(tree, n, lo, hi, id, digest, other) from (tree, id, digest, other): leaves lo
    to hi (exclusive) of the n of a tree are equal rows, in ``order``. The ranges are
    cut at a short beginning of the digest, as their bounds are sampled to the driver."""
    counted = leaves.groupBy("tree", "id", "digest", "other").agg(F.count(F.lit(1)).alias("copies"))
    ranges = [F.substring(c, 1, 8) if c == "digest" else F.col(c) for c in order[:2]]
    placed = (counted.repartitionByRange("tree", *ranges).sortWithinPartitions("tree", *order)
              .select(F.spark_partition_id().alias("part"), "tree", "id", "digest", "other", "copies")
              .mapInArrow(_numbered_inside, PLACED).checkpoint())
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("part", "tree").agg(F.sum("copies").alias("size"))
             .select("part", "tree", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"),
                     F.sum("size").over(Window.partitionBy("tree")).alias("n")))
    lo = F.col("shift") + F.col("place")
    return placed.join(parts, ["part", "tree"]).select(
        "tree", "n", lo.alias("lo"), (lo + F.col("copies")).alias("hi"), "id", "digest", "other")


def _reductions(n: Column) -> Column:
    """Reductions until n nodes are one."""
    powers = F.array(*(F.lit(FAN ** r).cast("long") for r in range(21)))
    return F.size(F.filter(powers, lambda p: p < n))


def _width(height: Column) -> Column:
    return F.element_at(F.array(*(F.lit(FAN ** r).cast("long") for r in range(HEIGHT + 1))), height + 1)


def _ended() -> Column:
    """Whether a block's root is its tree's root."""
    return F.col("n") <= _width(F.col("height"))


def _build_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo").to_pydict()
    tree, block, height = rows["tree"][0], rows["block"][0], rows["height"][0]
    first, stop = block * FAN ** height, (block + 1) * FAN ** height
    leaves, ids, others = [], [], []
    for lo, hi, i, digest, other in zip(*(rows[c] for c in ("lo", "hi", "id", "digest", "other")), strict=True):
        times = min(hi, stop) - max(lo, first)
        leaves += [digest] * times
        ids += [i] * times
        others += [other] * times
    nodes = block_nodes(leaves, height)
    return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([rows["n"][0]], pa.int64()),
                     "height": pa.array([height], pa.int32()), "nodes": pa.array([_packed(nodes)], pa.binary()), "root": [nodes[0]],
                     "ids": pa.array([ids], pa.list_(pa.int64())), "others": pa.array([others], pa.list_(pa.string()))})


def _blocks(rows: DataFrame) -> DataFrame:
    """One row of BLOCK per block of a layer."""
    rows = rows.withColumn("height", F.least(F.lit(HEIGHT), _reductions(F.col("n"))))
    width = _width(F.col("height"))
    span = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
    return (rows.select("tree", "n", "height", "lo", "hi", "id", "digest", "other", F.explode(span).alias("block"))
            .groupBy("tree", "block").applyInArrow(_build_block, BLOCK).checkpoint())


@dataclass
class Forest:
    """The stored layers of blocks, from the leaves up; one tree or many."""
    layers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        tops = [b.filter(_ended()).select("tree", F.col("root").alias("digest")) for b in self.layers]
        out = tops[0]
        for t in tops[1:]:
            out = out.unionAll(t)
        return out


def build_forest(leaves: DataFrame, order: Sequence[str] = ("id", "digest", "other")) -> Forest:
    """The trees over leaves (tree, id, digest, other), each in ``order``."""
    layers = [_blocks(numbered(leaves, order))]
    while not layers[-1].filter(~_ended()).isEmpty():
        width = _width(F.col("height"))
        up = layers[-1].filter(~_ended()).select(
            "tree", F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("block").alias("lo"), (F.col("block") + 1).alias("hi"),
            F.lit(None).cast("long").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("other"))
        layers.append(_blocks(up))
    return Forest(layers)


def _leaf_paths(batches: Iterator[pa.RecordBatch], kind: type[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """(tree, pos, subroot, path) of each leaf of blocks with their upward path."""
    for batch in batches:
        for row in batch.to_pylist():
            count = len(row["ids"])
            steps = block_steps(_unpacked(row["nodes"]), row["height"], count)
            up = [(s["before"], s["after"]) for s in row["path"]]
            first = row["block"] * FAN ** row["height"]
            paths = [[{"before": b, "after": a} for b, a in [*(level[i // FAN ** k] for k, level in enumerate(steps)), *up]]
                     for i in range(count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * count, pa.string()), pa.array(range(first, first + count), pa.int64()),
                 pa.array([row["subroot"]] * count, pa.string()), pa.array(paths, kind)],
                names=["tree", "pos", "subroot", "path"])


def _proofs(batches: Iterator[pa.RecordBatch], root: str, with_path: bool) -> Iterator[pa.RecordBatch]:
    """The rows of PROOF, and the siblings (or their digest), of the lowest blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            count, height = len(row["ids"]), row["height"]
            nodes = _unpacked(row["nodes"])
            steps = block_steps(nodes, height, count)
            up = [(s["before"], s["after"]) for s in row["path"]]
            above = "".join(b + a for b, a in up)
            at = _addresses(height)[height]
            folded, siblings = [], []
            for i, other in enumerate(row["others"]):
                own = [level[i // FAN ** k] for k, level in enumerate(steps)]
                folded.append(fold(other, own + up))
                joined = "".join(b + a for b, a in own) + above
                siblings.append(joined if with_path else _digest(joined))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array([nodes[a] for a in at[:count]]), pa.array([row["subroot"]] * count),
                 pa.array([root] * count), pa.array(folded), pa.array([f == root for f in folded]), pa.array(siblings)],
                names=[*(f.split()[0] for f in PROOF.split(", ")), "siblings"])


def _with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest blocks with ``subroot`` and ``path``: the siblings from the block's
    root up. ``above`` (tree, subroot, path) holds them for the trees' roots."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    known: DataFrame | None = None
    for k in range(len(forest.layers) - 1, -1, -1):
        layer = forest.layers[k]
        joined = layer.filter(_ended()).join(above, "tree")
        if known is not None:
            below = known.withColumnRenamed("pos", "block")
            joined = joined.unionByName(layer.filter(~_ended()).join(below, ["tree", "block"]))
        if k:
            known = joined.mapInArrow(partial(_leaf_paths, kind=kind), PATHS).checkpoint()
    return joined


def prove(leaves: DataFrame, with_path: bool = False) -> DataFrame:
    """PROOF with ``siblings`` (their digest unless ``with_path``) for leaves
    (tree, id, digest, other): ``other`` is the digest that is found now and is
    folded with the siblings stored for ``digest``."""
    empty = F.array().cast(f"array<{_STEP}>")
    trees = build_forest(leaves)
    subroots = trees.roots()
    none = F.lit(None)
    top = build_forest(subroots.select(F.lit("").alias("tree"), none.cast("long").alias("id"), "digest", F.col("tree").alias("other")), ("other",))
    found = top.roots().first()
    root = found["digest"] if found else ""
    # The top tree's leaves carry the name of their tree in ``other`` and are ordered by it.
    crown = top_paths(top, empty).select(F.col("other").alias("tree"), "subroot", "path")
    return _with_paths(trees, crown).mapInArrow(partial(_proofs, root=root, with_path=with_path), f"{PROOF}, siblings string")


def top_paths(top: Forest, empty: Column) -> DataFrame:
    """(other, subroot, path) of the leaves of the top tree."""
    start = top.roots().select("tree", F.col("digest").alias("subroot"), empty.alias("path"))
    lowest = _with_paths(top, start)
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def named(batches):
        for batch in batches:
            for row, out in zip(batch.to_pylist(), _leaf_paths([batch], kind), strict=True):
                leaves = _unpacked(row["nodes"])
                at = _addresses(row["height"])[row["height"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["others"], pa.string()), pa.array([leaves[a] for a in at[:len(row["others"])]], pa.string()), out.column(3)],
                    names=["other", "subroot", "path"])
    return lowest.mapInArrow(named, f"other string, subroot string, path array<{_STEP}>")


def group_key(group: Column) -> Column:
    """A group as a tree's name: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit("n"))


def manifest_proofs(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang",
                    id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None,
                    with_path: bool = False) -> DataFrame:
    """The proof of every row of docs against the manifest of docs. Where ``tampered``
    holds, the row that is checked has the A-Z of its text in lower case."""
    leaf = leaf_digest(*(F.col(f"`{c}`") for c in fields))
    changed = leaf_digest(*(lower_ascii(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`") for c in fields))
    other = leaf if tampered is None else F.when(tampered, changed).otherwise(leaf)
    leaves = docs.select(group_key(F.col(f"`{group_col}`")).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"),
                         leaf.alias("digest"), other.alias("other"))
    return prove(leaves, with_path)
