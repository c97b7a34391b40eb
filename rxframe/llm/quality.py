"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled texts are drawn as bounded samples (``sample`` rows of each, by a hash of the id) and
reduced to numeric features of the whole text. A first model tells positives from unlabelled; from its scores on
rows held back, the share of positives among the unlabelled is estimated as the least ratio of the two score tails
(with a margin for small counts). The second model minimises, with that share p,

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

and where the second part turns negative, only that part is climbed back. Then every text is scored.

Defined cases: a null text counts as empty, and empty texts get a score like any other; without positives nothing
can be learned and every score is 0.5; a null id belongs to the rows that train and gets a score; an empty table
gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.llm.common import column

SAMPLE = 12_000
EPOCHS = 40
BATCH = 512
HIDDEN = 24
SEED = 5
#: Byte classes whose shares are features: each is a class of its own.
MARKS = b"!|#&%$*@<>{}[]\\/=+_~^`:;,.?-'\"()"
_MARK_CODES = np.frombuffer(MARKS, dtype="u1")


def features(text: str | None) -> list[float]:
    """Numeric features of a whole text; neither length nor language decides them alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype="u1"), minlength=256).astype("f8")
    total = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    m = max(1, len(lines))
    distinct = len(set(words))
    pairs = set(zip(words, words[1:], strict=False))
    again = sum(map(operator.eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), "f8", len(words)) if words else np.zeros(1)
    low, high = counts[97:123].sum(), counts[65:91].sum()
    marks = counts[_MARK_CODES]
    out = [
        np.log1p(len(raw)), np.log1p(len(words)), low / total, high / total, high / max(1.0, low + high),
        counts[48:58].sum() / total, counts[128:].sum() / total, marks.sum() / total, marks.sum() / n,
        lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        distinct / n, np.log1p(n) - np.log1p(distinct), len(pairs) / max(1, len(words) - 1), again / n,
        np.log1p(m), len(set(lines)) / m, n / m / 50, counts[10] / total,
        sum(w[-1:] in b".!?" for w in words[-1:]) * 1.0, sum(w[:1].isupper() for w in words[:1]) * 1.0,
    ]
    return [*map(float, out), *np.sqrt(marks / n)]


WIDTH = len(features("a"))


class Net:
    """One hidden layer; ``fit`` follows the gradient it is given by Adam."""

    def __init__(self, width: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.w]
        self.v = [np.zeros_like(x) for x in self.w]
        self.steps = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = 3e-3, decay: float = 1e-4) -> None:
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.steps += 1
        for i, g in enumerate(grads):
            g = g + decay * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[i] / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _rounds(n_p: int, n_u: int, epochs: int, seed: int):
    """Index batches of both samples, the smaller one gone through again as needed."""
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        p, u = r.permutation(n_p), r.permutation(n_u)
        steps = max(1, max(n_p, n_u) // BATCH)
        yield from zip(np.array_split(np.resize(p, max(n_p, steps)), steps), np.array_split(np.resize(u, max(n_u, steps)), steps), strict=True)


def tell_apart(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> Net:
    net = Net(positive.shape[1], HIDDEN, seed)
    for p, u in _rounds(len(positive), len(unlabelled), EPOCHS // 4, seed):
        x = np.concatenate([positive[p], unlabelled[u]])
        zp, zu = net(positive[p]), net(unlabelled[u])
        net.step(x, np.concatenate([-sigmoid(-zp) / len(p), sigmoid(zu) / len(u)]) / 2)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Upper estimate of the share of positives among the unlabelled, from scores: the least ratio of score tails."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(np.concatenate([p, u]))
    tail_p = 1 - np.searchsorted(p, at) / len(p)
    tail_u = 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    use = tail_p > 0
    best = np.argmin((tail_u[use] + margin) / tail_p[use])
    return float(np.clip(tail_u[use][best] / tail_p[use][best], 0.01, 0.99))


def non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Net:
    """The classifier of least non-negative risk, with the logistic loss."""
    net = Net(positive.shape[1], HIDDEN, seed + 1)
    for p, u in _rounds(len(positive), len(unlabelled), EPOCHS, seed + 1):
        zp, zu = net(positive[p]), net(unlabelled[u])
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        on_p = -sigmoid(-zp) / len(p) * prior
        if negative >= 0:
            slope = np.concatenate([on_p - prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)])
        else:
            slope = np.concatenate([prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)])
        net.step(np.concatenate([positive[p], unlabelled[u]]), slope)
    return net


class Model:
    """Scaled features and one net; small enough to travel with a task."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        p, u = self.scaled(positive), self.scaled(unlabelled)
        first = tell_apart(p[::2], u[::2])
        self.prior = class_prior(first(p[1::2]), first(u[1::2])) if len(p) > 1 and len(u) > 1 else 0.5
        self.net = non_negative(p, u, self.prior)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.net(self.scaled(x)))


def fold(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(ident: Column) -> Column:
    return fold(ident) == 1


def _featured(docs: DataFrame) -> DataFrame:
    """``trusted`` and ``x`` of a sample with ``text`` and ``trusted``."""

    def extract(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array(rows, pa.list_(pa.float64()))], ["trusted", "x"])

    return docs.select("trusted", "text").mapInArrow(extract, "trusted boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Learn from at most about ``sample`` trusted positives and as many unlabelled rows, none of them held out."""
    trusted = labels.filter(labels[f"`{label}`"] == 1).select(column(labels, ident, "long").alias("_id")).filter("_id IS NOT NULL")
    trusted = trusted.filter(~held_out(F.col("_id"))).distinct()
    trusted = trusted.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most ``sample`` ids, so they may be broadcast
    rows = docs.select(column(docs, ident, "long").alias("id"), column(docs, text, "string").alias("text")).filter(~held_out(F.col("id")))
    share = min(1.0, sample / max(1, docs.count() * 2 / 3))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit("u")), 32) < int(share * 2**32)
    rows = rows.withColumn("drawn", drawn).join(F.broadcast(trusted), F.col("id") == F.col("_id"), "left")
    rows = rows.filter("drawn OR _id IS NOT NULL").select("text", "drawn", F.col("_id").isNotNull().alias("trusted"))
    # A row drawn for both counts in both samples.
    rows = rows.select("text", F.explode(F.array_compact(F.array(F.when(F.col("trusted"), F.lit(True)), F.when(F.col("drawn"), F.lit(False))))).alias("trusted"))
    found = _featured(rows).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype="f8").reshape(-1, WIDTH)
    is_p = np.array(found.column("trusted").to_pylist(), dtype=bool)
    # Rows come in any order; sorting makes the model the same in every run.
    p, u = (v[np.lexsort(v.T)] for v in (x[is_p], x[~is_p]))
    return Model(_mixed(p), _mixed(u)) if len(p) and len(u) else None


def _mixed(x: np.ndarray) -> np.ndarray:
    return x[np.random.default_rng(SEED).permutation(len(x))]


def score(docs: DataFrame, model: Callable | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = np.full(len(texts), 0.5)
            if model is not None and texts:
                values = model(np.array([features(t) for t in texts], dtype="f8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values)], ["doc_id", "held_out", "score"])

    name = column(docs, ident, "long")
    rows = docs.select(name.alias("doc_id"), held_out(name).alias("held_out"), column(docs, text, "string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Callable | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents scored ``least`` or more, with the columns of ``docs``."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            whole = batch.select(range(batch.num_columns - 1))
            if model is not None and texts:
                whole = whole.filter(pa.array(model(np.array([features(t) for t in texts], dtype="f8")) >= least))
            yield whole

    # Longer than every name of the table, so that it clashes with none.
    body = column(docs, text, "string").alias("_" * (1 + max(map(len, docs.columns))))
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns], body).mapInArrow(run, schema)
