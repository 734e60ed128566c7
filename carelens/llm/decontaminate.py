"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

Every item is cut into windows of ``window`` consecutive words (a shorter item is
one window). A document contains a window exactly when it contains all the
window's shingles in place, so at a containment of 1 one necessary prefix token
per window is enough: its rarest shingle.

1. One scan of the documents hashes their shingles (``xxhash64`` of neighbouring
   words) and joins them with the items' shingles. What is left, (document,
   position, shingle), is a small share of the text and is checkpointed.
2. Its counts give the rarity order over all documents. Windows with a shingle
   that no document has are dropped; each other one keeps its rarest shingle.
3. The positions of the prefix tokens give candidate starts, bounded by position
   (a window may not begin before the text) and by length (nor end after it).
4. Candidates join the documents again and are verified word for word.

The items' side is broadcast only when its counted rows are within
``broadcast_rows``; beyond that both joins shuffle. Hot shingles only add rows;
nothing is grouped by shingle but a partially aggregated count.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window; equal windows of several items count for each of them. Rows
with a null id are told apart by their text. Repeated rows give repeated
results. Other columns, whatever their names, pass through ``decontaminate``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.skew import apart

#: Fixed value: what separates words after A-Z have been lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Rows (of about 200 bytes) up to which the items' side is broadcast.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter; null: none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _shingles(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in order."""
    n = F.size(words)
    return F.when(n >= size, F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _bounded(side: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(side) if rows <= limit else side


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, size, items): each different window, and the sorted ids of its items as strings."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    phrases = words.select("item", size.alias("size"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("phrase"))
    return phrases.groupBy("phrase", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def candidates(docs: DataFrame, items: DataFrame, window: int, shingle: int, broadcast_rows: int,
               id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(key, cands): per document the bounded, not yet verified starts of windows."""
    windows = item_windows(items, window, item_id, item_text).checkpoint()
    rows = windows.count()
    # Items shorter than a shingle have shingles of their own length.
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]
    parts = []
    for s in sizes:
        own = windows.filter(F.least("size", F.lit(shingle)) == s).withColumn("w", F.split("phrase", " "))
        parts.append(own.select("phrase", "size", "items", F.lit(s).alias("s"), F.posexplode(_shingles("w", s)).alias("off", "h")))
    if not parts:
        return docs.sparkSession.createDataFrame([], CANDIDATES)
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    wanted = tokens.select("s", "h").distinct()
    text = docs.select(_key(F.col(id_col), F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))
    found = []
    for s in sizes:
        spots = text.select("key", F.size("w").alias("n"), F.posexplode(_shingles("w", s)).alias("pos", "h"))
        own = wanted.filter(F.col("s") == s).select("h")
        found.append(spots.join(_bounded(own, rows * window, broadcast_rows), "h", "left_semi")
                     .select("key", "n", "pos", F.lit(s).alias("s"), "h"))
    matches = found[0]
    for m in found[1:]:
        matches = matches.unionByName(m)
    matches = matches.checkpoint()
    rarity = matches.groupBy("s", "h").agg(F.count(F.lit(1)).alias("seen"))
    prefix = (tokens.join(rarity, ["s", "h"], "left").groupBy("phrase", "size", "s").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "off")).alias("rarest"),
        F.first("items").alias("items"))
        .filter(F.col("rarest.seen") > 0)
        .select("phrase", "size", "items", "s", F.col("rarest.h").alias("h"), F.col("rarest.off").alias("off")))
    start = F.col("pos") - F.col("off")
    bounded = (matches.join(_bounded(prefix, rows, broadcast_rows), ["s", "h"])
               .filter((start >= 0) & (start + F.col("size") <= F.col("n"))))
    return bounded.groupBy("key").agg(
        F.collect_set(F.struct(start.alias("start"), "size", "phrase", "items")).alias("cands"))


CANDIDATES = "key long, cands array<struct<start:int,size:int,phrase:string,items:array<string>>>"


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                       broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, n_words, hits): each document row as a struct, and the verified
    occurrences (start, size, phrase, items) sorted by start, in words."""
    cands = candidates(docs, items, window, shingle, broadcast_rows, id_col, text_col, item_id, item_text)
    rows = docs.select(_key(F.col(id_col), F.col(text_col)).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(text_col).alias("text"))
    cands = cands.select(apart(F.col("key")).alias("found_key"), "cands")
    joined = rows.join(cands, apart(F.col("key")) == F.col("found_key"), "left").select("row", "cands", words_of(F.col("text")).alias("w"))
    hits = F.filter("cands", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["size"]), " ") == c["phrase"])
    return joined.select("row", F.size("w").cast("long").alias("n_words"),
                         F.when(F.col("cands").isNotNull(), F.array_sort(hits)).alias("hits"))


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_contamination`` over documents."""
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, h: F.struct(F.greatest(s["end"], h["start"] + h["size"]).alias("end"),
                              (s["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(s["end"], h["start"]))).alias("n")),
        lambda s: s["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(items, F.array().cast("array<string>")).alias("ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns."""
    found = find_contamination(docs, items, **options)
    return found.filter(F.coalesce(F.size("hits"), F.lit(0)) <= 0).select("row.*")
