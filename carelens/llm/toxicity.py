"""Toxic spans by a linear-chain conditional random field.

Training (``fit_toxicity``) uses a bounded sample of labelled documents, at most
``MAX_TOXIC`` and ``MAX_CLEAN``, picked by a hash of the id:

1. Token labels. A token feature (the word, its beginnings and its ending) that
   stands in many toxic and few clean sample documents marks the tokens of toxic
   documents that have it; every other token is labelled clean. The counts are
   taken by Spark.
2. Segments of ``SEGMENT`` tokens, about ``MAX_SEGMENTS``, train a chain with
   the states clean and toxic: forward-backward marginals against the token
   labels, by Adam in one task of bounded size. Features are hashed to 64 bits; only those of
   toxic tokens have weights, so the model is small.
3. The marginals of each sample document are summed up (expected toxic tokens,
   greatest marginal, share) and a logistic regression turns them into a score.

Scoring sends the model (a few thousand numbers) with the task and works on Arrow
batches: all texts of a batch are cut into segments that are computed side by
side, and joined exactly by the segments' transition products, so a very long text
costs no more than its words. Tokens whose marginal is at least one half give the
offending offsets (code points, end exclusive); neighbours become one span.

Inputs of a score are the text's characters alone. Defined cases: a null or empty
text has no tokens and gets the score of a text without toxic tokens; without
labels of both kinds every score is 0. Labels that are null or neither 0 nor 1
are ignored, a document labelled both ways counts as toxic. Other columns pass
through ``drop_toxic`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.words import _BYTES, _TABLE, mix

#: Bounds of the training sample.
MAX_TOXIC, MAX_CLEAN, MAX_SEGMENTS = 2000, 4000, 12_000
SEGMENT = 64
CHAIN = "ids binary, weights binary, bias double, transition array<double>"
#: A feature marks toxic tokens from this many toxic sample documents (and this
#: share of them), at this log ratio of its shares among toxic and clean ones.
MIN_DOCS, MIN_SHARE, MIN_LIFT = 3, 0.01, 3.0
#: Features of a token: bytes from its beginning and end (0: the whole word).
HEADS, TAILS = (0, 5, 6, 7, 9), (6,)
N_FEATURES = len(HEADS) + len(TAILS)

_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class ToxicModel:
    ids: np.ndarray          # sorted feature ids
    weights: np.ndarray
    bias: float
    transition: np.ndarray   # 2 x 2, positive
    doc: np.ndarray          # logistic regression over the document's summary

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Log odds of the state toxic, per token."""
        flat = features.ravel()
        k = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        w = np.where(self.ids[k] == flat, self.weights[k], 0.0)
        return w.reshape(features.shape).sum(axis=1) + self.bias


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, features) of the runs of letters, lower-cased."""
    raw = np.frombuffer(_lower(text).encode("utf-8") if text else b"", np.uint8)
    letter = _LETTER[raw].astype(np.int8)
    edge = np.diff(np.concatenate(([0], letter, [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return raw, starts, ends, np.empty((0, N_FEATURES), np.uint64)
    up, down = _BYTES.to(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)])))
    columns = []
    for k, size in enumerate(HEADS):
        stop = np.minimum(starts + size, ends) if size else ends
        columns.append(mix((sums[stop] - sums[starts]) * down[starts] + np.uint64(k + 1)))
    for k, size in enumerate(TAILS):
        begin = np.maximum(ends - size, starts)
        columns.append(mix((sums[ends] - sums[begin]) * down[begin] + np.uint64(100 + k)))
    return raw, starts, ends, np.stack(columns, axis=1)


# -- the chain ----------------------------------------------------------------

def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SEGMENT token numbers: (token of each cell, cell is used, text of each row)."""
    rows = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), rows)
    number = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    cell = number[:, None] * SEGMENT + np.arange(SEGMENT)
    used = cell < lengths[text][:, None]
    offset = (np.cumsum(lengths) - lengths)[text][:, None]
    return np.where(used, cell + offset, 0), used, text


def _steps(odds: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Step matrices of the chain: transition, then the token's odds."""
    return np.stack((np.stack((np.full_like(odds, a[0, 0]), a[0, 1] * odds), -1),
                     np.stack((np.full_like(odds, a[1, 0]), a[1, 1] * odds), -1)), -2)


def _row(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.stack((v[:, 0] * m[:, 0, 0] + v[:, 1] * m[:, 1, 0], v[:, 0] * m[:, 0, 1] + v[:, 1] * m[:, 1, 1]), 1)
    return out / out.sum(axis=1, keepdims=True)


def _column(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.stack((m[:, 0, 0] * v[:, 0] + m[:, 0, 1] * v[:, 1], m[:, 1, 0] * v[:, 0] + m[:, 1, 1] * v[:, 1]), 1)
    return out / out.sum(axis=1, keepdims=True)


def marginals(emissions: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The probability of the state toxic for each token of each text. A text's
    chain starts after the state clean. Exact: rows of tokens are joined by the
    products of their step matrices."""
    if not len(emissions):
        return np.empty(0)
    token, used, text = _grid(lengths)
    odds = np.exp(np.clip(emissions, -30, 30))[token]
    rows = len(token)
    product = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for t in range(SEGMENT):
        step = np.matmul(product, _steps(odds[:, t], a))
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(used[:, t, None, None], step, product)
    # Messages at the rows' borders, from row to row of a text, all texts at once.
    enter = np.zeros((rows, 2))
    leave = np.zeros((rows, 2))
    per_text = np.bincount(text, minlength=len(lengths))
    first = np.cumsum(per_text) - per_text
    for k in range(per_text.max()):
        now = first[per_text > k] + k
        enter[now] = (1.0, 0.0) if k == 0 else _row(enter[now - 1], product[now - 1])
        back = (first + per_text - 1 - k)[per_text > k]
        leave[back] = (0.5, 0.5) if k == 0 else _column(product[back + 1], leave[back + 1])
    forward = np.empty((SEGMENT, rows, 2))
    v = enter
    for t in range(SEGMENT):
        v = np.where(used[:, t, None], _row(v, _steps(odds[:, t], a)), v)
        forward[t] = v
    out = np.empty((rows, SEGMENT))
    v = leave
    for t in range(SEGMENT - 1, -1, -1):
        both = forward[t] * v
        out[:, t] = both[:, 1] / both.sum(axis=1)
        v = np.where(used[:, t, None], _column(_steps(odds[:, t], a), v), v)
    return out[used]


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, log of the expected toxic tokens, greatest marginal, share."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    some = np.flatnonzero(lengths)
    if len(some):
        begin = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(p, begin)
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.maximum.reduceat(p, begin)
        out[some, 3] = np.sqrt(total / lengths[some])
    return out


def _texts(model: ToxicModel, texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple]:
    """(tokens, marginals, summaries) of runs of texts of about ``most`` bytes."""
    run, size = [], 0
    for k, text in enumerate(texts):
        run.append(tokens_of(text))
        size += len(run[-1][0])
        if size >= most or k == len(texts) - 1:
            lengths = np.array([len(t[1]) for t in run])
            p = marginals(model.emissions(np.concatenate([t[3] for t in run])), lengths, model.transition)
            yield run, p, summary(p, lengths)
            run, size = [], 0


def _score(model: ToxicModel | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    z = np.concatenate([s for _, _, s in _texts(model, texts)]) @ model.doc
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def spans_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """Offsets (code points) of the runs of tokens whose marginal is at least 1/2."""
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    run = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [(int(point[starts[r[0]]]), int(point[ends[r[-1]]])) for r in run]


# -- training -----------------------------------------------------------------

def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.unique(tokens_of(text)[3])
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.full(len(ids), toxic, np.int32))],
                                             names=["feature", "toxic"])


def _segments(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(order, marked, features, labels): the sample's segments, padded with zeros."""
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            features = tokens_of(text)[3]
            labels = np.isin(features, lexicon).any(axis=1) if toxic and len(lexicon) else np.zeros(len(features), bool)
            rows = []
            for k in range(0, len(features), SEGMENT):
                f, y = features[k:k + SEGMENT], labels[k:k + SEGMENT]
                order = int(mix(f[:1, 0] + np.uint64(k))[0] >> np.uint64(1))
                # A toxic document's unmarked segments have no sure labels.
                if y.any() or not toxic:
                    rows.append((order, bool(y.any()), f.tobytes(), y.astype(np.uint8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
                    names=["order", "marked", "features", "labels"])


def _train_chain(segments: list, epochs: int = 6, batch: int = 256, rate: float = 0.05, decay: float = 1e-4):
    """Adam on the conditional log likelihood of the token labels."""
    marked = [np.frombuffer(f, np.uint64).reshape(-1, N_FEATURES)[np.frombuffer(y, np.uint8) == 1] for f, y in segments]
    ids = np.unique(np.concatenate(marked)) if marked else np.empty(0, np.uint64)
    n = len(ids)
    features = np.full((len(segments), SEGMENT, N_FEATURES), n, np.int32)     # n: a feature without a weight
    labels = np.zeros((len(segments), SEGMENT))
    used = np.zeros((len(segments), SEGMENT), bool)
    for k, (f, y) in enumerate(segments):
        flat = np.frombuffer(f, np.uint64)
        at = np.minimum(np.searchsorted(ids, flat), n - 1)
        features[k, : len(y)] = np.where(ids[at] == flat, at, n).reshape(-1, N_FEATURES)
        labels[k, : len(y)] = np.frombuffer(y, np.uint8)
        used[k, : len(y)] = True
    weights = np.zeros(n + 6)             # the features, none, bias, transitions 00 01 10 11
    weights[n + 1] = -3.0
    m, v, step = np.zeros_like(weights), np.zeros_like(weights), 0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(segments)), max(1, len(segments) // batch)):
            f, y, u = features[rows], labels[rows], used[rows]
            a = np.exp(weights[n + 2:].reshape(2, 2))
            p, pair = _pair_marginals(weights[f].sum(axis=2) + weights[n + 1], u, a)
            miss = np.where(u, y - p, 0.0)
            gradient = np.zeros_like(weights)
            gradient[: n + 1] = np.bincount(f.ravel(), np.repeat(miss.ravel(), N_FEATURES), n + 1)
            gradient[n] = 0
            gradient[n + 1] = miss.sum()
            before = np.concatenate((np.zeros((len(rows), 1)), y[:, :-1]), axis=1)
            kind = (2 * before + y).astype(int)
            gradient[n + 2:] = np.bincount(kind[u], minlength=4) - pair
            gradient = gradient / len(rows) - decay * weights
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
            weights += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            weights[n] = 0
    return ids, weights[:n], float(weights[n + 1]), np.exp(weights[n + 2:].reshape(2, 2))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain's parameters from all segments: one bounded task, nothing of them
    comes to the driver. Sorted first, so that the result does not depend on their order."""
    segments = sorted((f, y) for batch in batches for f, y in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    if segments:
        ids, weights, bias, transition = _train_chain(segments)
        columns = ([ids.tobytes()], [weights.tobytes()], [bias], [transition.ravel().tolist()])
        types = (pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                         names=["ids", "weights", "bias", "transition"])


def _pair_marginals(emissions: np.ndarray, used: np.ndarray, a: np.ndarray):
    """Token marginals and the expected counts of the four transitions, of segments."""
    odds = np.exp(np.clip(emissions, -30, 30))
    rows, size = odds.shape
    forward = np.empty((size + 1, rows, 2))
    forward[0] = (1.0, 0.0)
    for t in range(size):
        forward[t + 1] = np.where(used[:, t, None], _row(forward[t], _steps(odds[:, t], a)), forward[t])
    p, pair = np.zeros((rows, size)), np.zeros(4)
    v = np.full((rows, 2), 0.5)
    for t in range(size - 1, -1, -1):
        step = _steps(odds[:, t], a)
        joint = forward[t][:, :, None] * step * v[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        joint[~used[:, t]] = 0
        p[:, t] = joint[:, :, 1].sum(axis=1)
        pair += joint.sum(axis=0).ravel()
        v = np.where(used[:, t, None], _column(step, v), v)
    return p, pair


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [penalty * weight.sum() / 100] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicModel | None:
    """The model, from a bounded sample of the labels with crc32(id) mod 5 other than 0."""
    marked = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
              .filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
              .groupBy("id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = None
    for kind, most in ((1, max_toxic), (0, max_clean)):
        some = marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = some if picked is None else picked.unionAll(some)
    # At most max_toxic + max_clean ids: a bounded side.
    sample = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(picked), "id").select("toxic", "text").dropDuplicates(["text"]).checkpoint())
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    n1, n0 = size[1], size[0]
    seen = sample.mapInArrow(_sample_features, "feature long, toxic int").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    lexicon = seen.filter((F.col("a") >= max(MIN_DOCS, MIN_SHARE * n1)) & (lift >= MIN_LIFT)).select("feature")
    ids = np.array([r[0] for r in lexicon.collect()], np.int64).view(np.uint64)
    if not len(ids):
        return None
    rows = sample.mapInArrow(partial(_segments, lexicon=np.sort(ids)), "order long, marked boolean, features binary, labels binary")
    # About MAX_SEGMENTS / 2 of either kind: those whose hash lies below a share.
    many = {r["marked"]: r["n"] for r in rows.groupBy("marked").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.lit(False)
    for kind, n in many.items():
        share = min(1.0, MAX_SEGMENTS / 2 / n)
        below = below | ((F.col("marked") == kind) & (F.col("order") <= min((1 << 63) - 1, int(share * 2.0 ** 63))))
    fitted = rows.filter(below).select("features", "labels").repartition(1).mapInArrow(_trained, CHAIN).first()
    chain = (np.frombuffer(fitted["ids"], np.uint64), np.frombuffer(fitted["weights"]), fitted["bias"],
             np.array(fitted["transition"]).reshape(2, 2))
    raw = ToxicModel(*chain, np.zeros(4))
    table = np.array([tuple(r) for r in sample.mapInArrow(partial(_summaries, model=raw),
                      "toxic int, a double, b double, c double, d double").orderBy("toxic", "a", "b", "c", "d").collect()], float)
    y = table[:, 0]
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    weight = weight / weight.sum() * len(y)
    return ToxicModel(*chain, _logistic(table[:, 1:], y, weight))


def _summaries(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        if texts:
            x = np.concatenate([s for _, _, s in _texts(model, texts)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array(c) for c in np.ascontiguousarray(x.T))],
                                             names=list(("toxic", "a", "b", "c", "d")))


# -- scoring ------------------------------------------------------------------

def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        spans: list[str] = []
        scores: list[np.ndarray] = []
        for run, p, x in _texts(model, texts) if model else ():
            scores.append(1 / (1 + np.exp(-np.clip(x @ model.doc, -40, 40))))
            at = 0
            for raw, starts, ends, _ in run:
                spans.append(",".join(f"{a}:{b}" for a, b in spans_of(raw, starts, ends, p[at:at + len(starts)])))
                at += len(starts)
        score = np.concatenate(scores) if scores else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
             pa.array(spans if model else [""] * len(texts), pa.string())],
            names=["doc_id", "held_out", "score", "predicted", "spans"])


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) per row of docs; spans are the
    offending offsets, ``start:end`` joined by commas."""
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        partial(_scored, model=model), "doc_id long, held_out boolean, score double, predicted int, spans string")


def drop_toxic(docs: DataFrame, model: ToxicModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score below one half, with all their columns."""
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(_score(model, texts.to_pylist()) < 0.5)
    return docs.filter(clean(F.col(text_col)))
