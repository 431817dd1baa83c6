"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; the unlabelled set is a sample of all
documents.  The class prior (share of good documents among the unlabelled) is estimated first: a
plain positive-against-unlabelled classifier is fitted on one half, and on the other half the
smallest ratio of upper score tails, unlabelled over positive, bounds the prior from above.  The
classifier then minimises the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss; when the bracket turns negative the step goes against it, so the model
cannot fit the unlabelled negatives below zero risk.

Features are numbers read from the whole text (characters, words, lines, repetition in windows of
words), each spread over quantile bins of the fitting sample, and the model is linear in the bins.
The fit runs on a bounded sample (``SAMPLE`` rows a side, a parameter) of feature vectors; scoring
is one pass over all texts without any shuffle.

Defined cases
* null or empty text: all features 0, scored like any other;
* very long text: read whole, in one pass;
* no labels to learn from: every document scores 0.5;
* ties and repeated rows: one score per row, equal texts score alike; empty table: empty result;
* null doc_id: scored, never labelled; extra columns are not read by ``score`` and kept by
  ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import free_name, slices, texts

#: Rows of each side that the fit sees at most.
SAMPLE = 10_000
BINS = 16
EPOCHS = 1500
#: A window of words for repetition counts.
WINDOW = 50

_SENTENCE = np.frombuffer(b".,;:?'\"-()", np.uint8)
FEATURES = ("log_words", "word_length", "upper", "digit", "sentence_marks", "other_marks", "bang", "blank", "line_words",
            "log_lines", "same_lines", "distinct", "window_distinct", "window_worst", "window_spread", "stutter", "top_word",
            "long_words", "marks_at_end", "control")


def features(text: str) -> list[float]:
    """The numbers that describe one text; all 0 for a text without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    blanks = int(counts[9:14].sum() + counts[32])
    solid = max(1, size - blanks)
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    sentence = counts[_SENTENCE].sum()
    lines = [x for x in raw.split(b"\n") if x]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    ends_at = [*range(WINDOW, n - WINDOW // 2, WINDOW), n]  # the last window takes what is left
    shares = [len(set(words[a:z])) / (z - a) for a, z in zip([0, *ends_at], ends_at, strict=False)]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(1 for w in words if not (w[-1] > 127 or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122))
    return [float(np.log1p(n)), solid / n, counts[65:91].sum() / solid, counts[48:58].sum() / solid, sentence / solid,
            (marks - sentence) / solid, counts[33] / n, blanks / n, len(lines) / n, float(np.log1p(len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), len(tally) / n, sum(shares) / len(shares), min(shares), max(shares) - min(shares),
            stutter / n, max(tally.values()) / n, sum(1 for w in words if len(w) > 25) / n, ends / n,
            (counts[:9].sum() + counts[14:32].sum() + counts[127]) / size]


@dataclass
class Model:
    """Quantile edges, one weight per feature and bin, and an intercept."""

    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # features x bins
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        g = self.bias + self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _sigmoid(g):
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _one_hot(bins: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(bins), bins.shape[1] * width), np.float32)
    out[np.arange(len(bins))[:, None], bins + np.arange(bins.shape[1]) * width] = 1
    return out


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, ridge: float = 1e-4, rate: float = 0.1):
    """Adam on one-hot rows.  ``prior`` None: positives against unlabelled; else non-negative PU risk."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    add = lambda x, c: np.append(x.T @ c.astype(np.float32), c.sum())
    for t in range(1, epochs + 1):
        gp, gu = p @ w[:-1].astype(np.float32) + w[-1], u @ w[:-1].astype(np.float32) + w[-1]
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if prior is None:
            grad = add(p, (sp - 1) / len(p)) + add(u, su / len(u))
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            away = add(u, su / len(u)) - prior * add(p, sp / len(p))
            grad = prior * add(p, (sp - 1) / len(p)) + away if negative >= 0 else -away
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, epochs: int = EPOCHS, risk: float = 0.1) -> float:
    """Share of positives among ``u``: the best bound from upper score tails on the half not fitted."""
    if len(p) < 8 or len(u) < 8:
        return 0.5
    w = _fit(p[::2], u[::2], None, epochs)
    gp, gu = (x[1::2] @ w[:-1] + w[-1] for x in (p, u))
    gp, gu = np.sort(gp), np.sort(gu)
    cuts = np.unique(gp)
    qp = 1 - np.searchsorted(gp, cuts, side="left") / len(gp)
    qu = 1 - np.searchsorted(gu, cuts, side="left") / len(gu)
    noise = np.sqrt(np.log(4 / risk) / 2 / len(gu)) + np.sqrt(np.log(4 / risk) / 2 / len(gp))
    best = np.argmin((qu + 1.01 * noise) / qp)  # the tail with the tightest upper bound
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, bins: int = BINS, epochs: int = EPOCHS, prior: float | None = None) -> Model:
    """The model from feature rows of trusted positives and of unlabelled documents."""
    n = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((n, bins - 1)), np.zeros((n, bins)), 0.0, 0.5)
    # edges from both sides; the unlabelled tails, where the junk is, get bins of their own
    at = np.concatenate([[0.005, 0.01, 0.02], np.linspace(0, 1, bins - 5)[1:-1], [0.98, 0.99, 0.995]])[:bins - 1]
    edges = np.quantile(unlabelled, at, axis=0).T
    edges = np.pad(edges, ((0, 0), (0, bins - 1 - edges.shape[1])), constant_values=np.inf)
    model = Model(edges, np.zeros((n, bins)), 0.0, 0.5)
    p, u = _one_hot(model.bins(positive), bins), _one_hot(model.bins(unlabelled), bins)
    model.prior = estimate_prior(p, u, epochs) if prior is None else prior
    w = _fit(p, u, model.prior, epochs)
    model.weights, model.bias = w[:-1].reshape(n, bins), float(w[-1])
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, seed: int = 41, **options) -> Model:
    """Fit on ``sample`` labelled-good documents and ``sample`` documents whatever their label,
    both from the rows that are not held out."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    open_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = (labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
            .join(open_ids, "doc_id", "left_semi").distinct())
    pick = lambda ids, side: ids.orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(side).alias("side"))
    chosen = pick(good, 1).union(pick(open_ids.distinct(), 0)).groupBy("doc_id").agg(F.sort_array(F.collect_set("side")).alias("sides"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")) \
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids

    def measure(batches):
        import pyarrow as pa
        for b in (s for batch in batches for s in slices(batch)):
            x = [features(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sides"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "sides", "x"])
    got = rows.mapInArrow(measure, "doc_id long, sides array<int>, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    sides = got.column("sides").to_pylist()
    return fit(x[[1 in s for s in sides]], x[[0 in s for s in sides]], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (higher: likelier good) and predicted (1 from 0.5 on)."""
    def run(batches):
        import pyarrow as pa
        for b in (s for batch in batches for s in slices(batch)):
            x = np.array([features(t) for t in texts(b.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(x), pa.float64())],
                                             names=["doc_id", "held_out", "score"])
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return (rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model predicts to be good, with all their columns."""
    def run(batches):
        import pyarrow as pa
        for b in (s for batch in batches for s in slices(batch)):
            x = np.array([features(t) for t in texts(b.column("text"))]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= 0.5))
    if "text" not in docs.columns:
        raise ValueError(f"no text column in {free_name(docs, 'docs')}")
    return docs.mapInArrow(run, docs.schema)
