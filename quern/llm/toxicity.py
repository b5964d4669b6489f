"""Toxicity: a linear-chain conditional random field over tokens.

Two states, clean and toxic.  A token's features are its word, its first three to
seven letters and its last three; the chain has weights for starting in and moving between states.

`fit` learns from labelled documents in three steps: token labels (tokens
of toxic documents that have a feature found far more often in toxic
documents than in others), the field's weights (maximum penalised likelihood of these
labels, gradients by forward and backward passes), and a logistic curve from a
document's marginals to its label.  The fit is on the driver, over a bounded sample of
``most_docs`` labelled documents of each class and ``most_chars`` code points
in all, taken in the order of a hash of doc_id.

`score` runs forward and backward over every token of every text.  A batch of
texts is one chain that starts anew at each text; it is cut into equal lanes, the lanes'
2 x 2 products are computed side by side, joined by a short scan and carried
back, which gives the same marginals as going token by token.

Defined results
---------------
* null or empty text: no tokens, the score of a document without evidence;
* labels that are null, or of documents that aren't there: ignored;
* texts are scored whole, whatever their length; an empty table gives an empty result;
* one class only, or no labels: every score is that class's share, no offsets;
* repeated rows get equal scores, and are learnt from once; extra columns are kept by `without_toxic`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

TOKEN = re.compile(r"\w+")
PREFIXES = range(3, 8)


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n), *(["$" + word[-3:]] if len(word) > 3 else [])]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# ------------------------------------------------------------------ chain


def _products(m: np.ndarray) -> np.ndarray:
    """Running products of (steps, lanes, 2, 2) along the steps, each scaled to a largest entry of 1."""
    out = np.empty_like(m)
    now = m[0]
    out[0] = now / now.max(axis=(1, 2), keepdims=True)
    for i in range(1, len(m)):
        p, q = out[i - 1], m[i]
        now = np.empty_like(q)
        for a in (0, 1):
            for b in (0, 1):
                now[:, a, b] = p[:, a, 0] * q[:, 0, b] + p[:, a, 1] * q[:, 1, b]
        out[i] = now / np.maximum(now[:, 0, 0] + now[:, 1, 1], now[:, 0, 1] + now[:, 1, 0])[:, None, None]
    return out


def _carried(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Vectors first @ m[0] @ ... @ m[i] for every i, each scaled to the sum 1."""
    n = len(m)
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    padded = np.broadcast_to(np.eye(2), (lanes * steps, 2, 2)).copy()
    padded[:n] = m
    running = _products(np.ascontiguousarray(padded.reshape(lanes, steps, 2, 2).transpose(1, 0, 2, 3)))
    at, starts = first / first.sum(), np.empty((lanes, 2))
    for i, last in enumerate(running[-1]):
        starts[i] = at
        at = at @ last
        at = at / at.sum()
    v = np.einsum("la,slab->slb", starts, running)
    v = v.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return v / v.sum(axis=1, keepdims=True)


@dataclass
class Chain:
    """Weights: start and move of states, the toxic state's score of each feature."""

    start: float = -3.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def marginals(self, scores: np.ndarray, begins: np.ndarray, pairs: bool = False):
        """P(toxic) of each token; with ``pairs`` also P(state before, state) of each token but the first of its text."""
        n = len(scores)
        if not n:
            return (np.zeros(0), np.zeros((0, 2, 2))) if pairs else np.zeros(0)
        e = np.stack([np.zeros(n), np.clip(scores, -30, 30)], axis=1)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        move, start = np.exp(self.move - self.move.max()), np.exp([0.0, self.start])
        m = move[None] * e[:, None, :]
        fresh = start[None] * e[begins]
        m[begins] = np.stack([fresh, fresh], axis=1)  # the state before doesn't matter
        forward = _carried(m, np.ones(2))
        ends = np.r_[begins[1:] - 1, n - 1]
        back = (move[None] * np.r_[e[1:], np.ones((1, 2))][:, None, :]).transpose(0, 2, 1)  # of token i: into i + 1
        back[ends] = np.ones((2, 2))
        backward = _carried(back[::-1], np.ones(2))[::-1]
        both = forward * backward
        toxic = both[:, 1] / both.sum(axis=1)
        if not pairs:
            return toxic
        pair = np.r_[np.ones((1, 2)), forward[:-1]][:, :, None] * move[None] * (e * backward)[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return toxic, pair


# ------------------------------------------------------------------ model


def summary(marginals: np.ndarray) -> np.ndarray:
    """What the document's score is made of: likely count, doubt over all tokens, share, and highest marginal.

    Marginals count by their cubes, so that the small doubt that every token
    leaves doesn't add up to evidence in a long text.
    """
    if not len(marginals):
        return np.zeros(4)
    m = marginals**3
    return np.array([np.log1p(m.sum()), np.log1p(-np.log1p(-np.minimum(m, 1 - 1e-6)).sum()), np.sqrt(m.mean()), marginals.max()])


@dataclass
class Model:
    chain: Chain
    scale: np.ndarray
    curve: np.ndarray

    def document(self, marginals: np.ndarray) -> float:
        x = np.r_[summary(marginals) / self.scale, 1.0] @ self.curve
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class _Sample:
    """The sample as numbers: word types, their features, and each document's tokens."""

    def __init__(self, texts: list[str]):
        types: dict[str, int] = {}
        self.ids = [np.array([types.setdefault(w.lower(), len(types)) for w in TOKEN.findall(t or "")], np.int32) for t in texts]
        index: dict[str, int] = {}
        of = [[index.setdefault(f, len(index)) for f in features(w)] for w in types]
        self.names, self.n_types = list(index), len(types)
        self.start = np.cumsum([0, *map(len, of)])
        self.flat = np.array([f for x in of for f in x], np.int32)
        self.owner = np.repeat(np.arange(len(of), dtype=np.int32), np.diff(self.start))

    def features_of(self, doc: np.ndarray) -> np.ndarray:
        """The distinct features of a document."""
        t = np.unique(doc)
        size = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.unique(self.flat[at])

    def portions(self, tokens: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, their tokens in a row, first tokens), documents without tokens left out."""
        some: list[int] = []
        size = 0
        for i, x in enumerate(self.ids):
            if len(x):
                some.append(i)
                size += len(x)
            if some and (size >= tokens or i == len(self.ids) - 1):
                yield np.array(some), np.concatenate([self.ids[j] for j in some]), np.cumsum([0, *(len(self.ids[j]) for j in some[:-1])])
                some, size = [], 0


def _indicative(counts: np.ndarray, n0: int, n1: int, least: int, z: float) -> np.ndarray:
    """Features whose share of toxic documents is far above their share of others, by the z score of two shares."""
    k0, k1 = counts
    p = (k0 + k1) / (n0 + n1)
    gap = (k1 / n1 - k0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (k1 >= least) & (gap > z) & (k1 / n1 > 4 * (k0 + 1) / n0)


def fit(texts: list[str], toxic: np.ndarray, weights: np.ndarray, least: int = 4, z: float = 4.0, rounds: int = 25, l2: float = 1e-4) -> Model:
    """``weights``: how many labelled documents each one of the sample stands for."""
    sample = _Sample(texts)
    counts = np.zeros((2, len(sample.names)))
    for x, y in zip(sample.ids, toxic, strict=True):
        counts[int(y), sample.features_of(x)] += 1
    seed = _indicative(counts, max(1, int((~toxic).sum())), max(1, int(toxic.sum())), least, z)
    marked = np.bincount(sample.owner, weights=seed[sample.flat], minlength=sample.n_types) > 0
    used = counts.sum(axis=0) >= least
    stay = used[sample.flat]
    flat, owner = sample.flat[stay], sample.owner[stay]

    parts = list(sample.portions())
    n = max(1, sum(len(tokens) for _, tokens, _ in parts))
    gold, gold_pair, gold_first = np.zeros(sample.n_types), np.zeros((2, 2)), 0.0
    for docs, tokens, first in parts:
        label = marked[tokens] & np.repeat(toxic[docs], np.diff(np.r_[first, len(tokens)]))
        gold += np.bincount(tokens, weights=label, minlength=sample.n_types)
        inner = np.setdiff1d(np.arange(len(tokens)), first)
        np.add.at(gold_pair, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
        gold_first += float(label[first].sum())

    chain, w = Chain(), np.zeros(len(sample.names))
    grads: list = [np.full(len(w), 1e-6), np.full((2, 2), 1e-6), 1e-6]
    for _ in range(rounds if parts else 0):
        type_score = np.bincount(owner, weights=w[flat], minlength=sample.n_types)
        off, pairs, firsts = gold.copy(), gold_pair.copy(), gold_first
        for _, tokens, first in parts:
            p, pair = chain.marginals(type_score[tokens], first, pairs=True)
            off -= np.bincount(tokens, weights=p, minlength=sample.n_types)
            pairs -= pair.sum(axis=0) - pair[first].sum(axis=0)
            firsts -= float(p[first].sum())
        steps = [np.bincount(flat, weights=off[owner], minlength=len(w)) / n - l2 * w / 10, pairs / n, firsts / n]
        for i, g in enumerate(steps):
            grads[i] = grads[i] + np.square(g)
        w = w + steps[0] / np.sqrt(grads[0])
        chain.move = chain.move + steps[1] / np.sqrt(grads[1])
        chain.start += float(steps[2] / np.sqrt(grads[2]))
    chain.weights = {sample.names[i]: float(w[i]) for i in np.flatnonzero(used & (np.abs(w) > 1e-3))}

    type_score = np.bincount(owner, weights=w[flat], minlength=sample.n_types)
    x = np.zeros((len(texts), 4))
    for docs, tokens, first in parts:
        p = chain.marginals(type_score[tokens], first)
        for d, a, b in zip(docs, first, np.r_[first[1:], len(tokens)], strict=True):
            x[d] = summary(p[a:b])
    scale = np.maximum(x.std(axis=0), 1e-6)
    return Model(chain, scale, _logistic(np.c_[x / scale, np.ones(len(x))], toxic.astype(float), weights))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    b, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b = b + np.clip(step, -5, 5)
    return b


# ------------------------------------------------------------------ tables


def training_rows(documents: DataFrame, labels: DataFrame, most_docs: int, most_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the bounded sample; held-out documents are never in it.

    A doc_id counts once: of its rows the one with the smallest hash of the text is taken, of its labels the largest.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = documents.select("doc_id", text_key.alias("text_key"), F.length("text").alias("size")).join(known, "doc_id")
    sized = sized.groupBy("doc_id", "toxic").agg(F.min("text_key").alias("text_key"), F.min_by("size", "text_key").alias("size"))
    sized = written(sized, "toxicity-sample")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    counts = dict(sized.groupBy("toxic").count().collect())
    chosen, weight = {}, {}
    for kind in counts:
        rows, left = sized.where(F.col("toxic") == kind).orderBy(*order).limit(most_docs).collect(), most_chars // 2
        took = 0
        for r in rows:
            if (r["size"] or 0) <= left:
                chosen[r.doc_id] = r.text_key, kind
                left -= r["size"] or 0
                took += 1
        weight[kind] = counts[kind] / max(1, took)
    drop_written(sized)
    # Repeated rows of a document, which may be many, become one before they come here.
    asked = documents.where(F.col("doc_id").isin(list(chosen)) & text_key.isin([k for k, _ in chosen.values()]))
    found = asked.groupBy("doc_id").agg(F.min_by("text", text_key).alias("text"))
    got = sorted((r.doc_id, r.text or "") for r in found.collect()) if chosen else []
    toxic = np.array([chosen[i][1] for i, _ in got], bool)
    return [t for _, t in got], toxic, np.array([weight[x] for x in toxic], float)


def train(documents: DataFrame, labels: DataFrame, most_docs: int = 2000, most_chars: int = 4_000_000, **options) -> Model:
    texts, toxic, weights = training_rows(documents, labels, most_docs, most_chars)
    if toxic.all() or not toxic.any():
        share = 1 - 1e-9 if len(toxic) and toxic.all() else 1e-9
        return Model(Chain(start=-30.0, move=np.array([[0.0, -30.0], [0.0, -30.0]])), np.ones(4), np.array([0, 0, 0, 0, np.log(share / (1 - share))]))
    return fit(texts, toxic, weights, **options)


class _Scores(dict):
    """Scores of words as they stand; forgets them when they are many."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = self.chain.score(word.lower())
        return x


def spans(text: str, toxic: np.ndarray) -> list[dict]:
    """(start, end) in code points of runs of toxic tokens."""
    out: list[dict] = []
    before = False
    for m, y in zip(TOKEN.finditer(text), toxic, strict=True):
        if y and before:
            out[-1]["end"] = m.end()
        elif y:
            out.append({"start": m.start(), "end": m.end()})
        before = bool(y)
    return out


def _scored(model: Model, tokens_at_once: int):
    """A function that gives, for a column of texts, (first row, marginals of each text) in portions of about so many tokens."""
    scores = _Scores(model.chain)

    def portions(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        at = 0
        while at < len(texts):
            low, words, emitted, bounds = at, 0, [], [0]
            while at < len(texts) and (words < tokens_at_once or at == low):
                found = TOKEN.findall(texts[at].as_py() or "")
                emitted.append(np.fromiter(map(scores.__getitem__, found), np.float64, len(found)))
                words += len(found)
                bounds.append(words)
                at += 1
            ends = np.array(bounds)
            p = model.chain.marginals(np.concatenate(emitted), ends[:-1][np.diff(ends) > 0])
            yield low, [p[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    return portions


def score(documents: DataFrame, model: Model, tokens_at_once: int = 300_000) -> DataFrame:
    """doc_id, score, spans (offending offsets); every token of every text counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        portions = _scored(model, tokens_at_once)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, parts in portions(texts):
                where = [spans(texts[low + i].as_py(), x >= 0.5) if len(x) and x.max() >= 0.5 else [] for i, x in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([ids.slice(low, len(parts)), pa.array([model.document(x) for x in parts], pa.float64()), pa.array(where, schema.field("spans").type)], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def without_toxic(documents: DataFrame, model: Model, limit: float = 0.5, tokens_at_once: int = 300_000) -> DataFrame:
    """The rows of ``documents`` whose score is below the limit, as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        portions = _scored(model, tokens_at_once)
        for batch in batches:
            for low, parts in portions(batch.column(at)):
                yield batch.slice(low, len(parts)).filter(pa.array([model.document(x) < limit for x in parts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
