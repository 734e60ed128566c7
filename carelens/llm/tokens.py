"""Token counts of whole texts, long ones in overlapping chunks.

The counts are those of the ``tokenizers`` library for a byte-level BPE ``.json``
file (no begin, end or padding tokens; special strings inside a text count as
their one token). A byte-level file is read into ``tiktoken``, which applies the
same merges several times faster; other ``.json`` files go through ``tokenizers``
and ``.model`` files through ``sentencepiece``, whole texts at a time.

Long texts are encoded in chunks that overlap. The token offsets of both chunks
are compared inside the overlap, and the count is spliced where both have a
token boundary that is proven stable: the character before it is no white space
and it is itself a single space before a letter. Every alternative of the
pre-tokenizer's pattern ends there whatever stands further left or right, so no token of the
whole text crosses it. When an overlap has no such place (one endless word, a
run of blanks), the chunk is widened and the overlap doubled until it has one or
the text ends; nothing is estimated.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows give
repeated results. No shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 16, 512
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after something that is no white space and before a letter.
_STABLE = re.compile(r"(?<=\S) (?=[A-Za-z])")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelCounter:
    """Counts and offsets for a byte-level BPE file."""

    def __init__(self, spec: dict):
        import tiktoken
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()
                 if all(c in letters for c in token)}
        merged = {bytes(letters[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part): 256 + i
                  for i, m in enumerate(spec["model"]["merges"])}
        ranks = {bytes([b]): b for b in range(256)} | merged
        if not set(ranks) <= set(vocab):
            raise ValueError("the vocabulary lacks bytes or merges")
        self.encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if self.special is None or not self.special.search(text):
            return self._count(text, chunk, overlap)
        found = len(self.special.findall(text))
        return found + sum(self._count(part, chunk, overlap) for part in self.special.split(text))

    def _count(self, text: str, chunk: int, overlap: int) -> int:
        if len(text) <= chunk:
            return len(self.encoding.encode_ordinary(text))
        total, left = 0, 0
        while True:
            stop = min(len(text), left + chunk)
            while True:
                tokens = self.encoding.encode_ordinary(text[left:stop])
                if stop == len(text):
                    return total + len(tokens)
                meeting = self._meet(text, left, stop, tokens, overlap)
                if meeting:
                    break
                # No common stable boundary: widen the chunk, and the overlap with it.
                overlap *= 2
                stop = min(len(text), stop + max(chunk, overlap))
            kept, left = meeting
            total += kept

    def _meet(self, text: str, left: int, stop: int, tokens: list[int], overlap: int) -> tuple[int, int] | None:
        """The first stable place that is a token boundary of this chunk and of
        the next, which begins an overlap before the end of this one: the number
        of tokens before it, and its place. The last characters of the chunk are
        left out, because the text beyond could change them."""
        begin = max(left + 1, stop - overlap)
        tail = text[begin:stop]
        places = [m.start() for m in _STABLE.finditer(tail) if m.start() < len(tail) - 2]
        if not places:
            return None
        ahead = self._ends(self.encoding.encode_ordinary(tail))
        ends = self._ends(tokens)
        offset = int(ends[-1]) - len(tail.encode("utf-8"))
        for place in places:
            at = len(tail[:place].encode("utf-8"))
            k = int(np.searchsorted(ends, offset + at))
            j = int(np.searchsorted(ahead, at))
            if k < len(ends) and ends[k] == offset + at and j < len(ahead) and ahead[j] == at:
                return k + 1, begin + place
        return None

    def _ends(self, tokens: list[int]) -> np.ndarray:
        return np.cumsum(self.sizes[tokens])


class WholeTextCounter:
    """Counts by the library itself, without chunks."""

    def __init__(self, encode):
        self.encode = encode

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=4)
def counter(path: str):
    """The counter for a tokenizer file, loaded once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece
        return WholeTextCounter(sentencepiece.SentencePieceProcessor(model_file=path).encode)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if (spec["model"].get("type", "BPE"), pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True),
            spec.get("normalizer")) == ("BPE", "ByteLevel", False, True, None):
        return ByteLevelCounter(spec)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return WholeTextCounter(lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    count = counter(path).count
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [count(t, chunk, overlap) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
             pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA per row of docs. ``path`` is the tokenizer file, present
    at the same place on every executor."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        partial(_counted, path=path, limit=limit, chunk=chunk, overlap=overlap), SCHEMA)
