"""Language identification by prediction by partial matching.

Every language gets a variable-order byte context tree: for each context of up to ``ORDER`` bytes
the bytes that followed it and how often.  A byte seen after the longest known context is coded
with its share there; otherwise an escape is coded (method C: as often as the context has different
successors) and the next shorter context is asked, down to all 256 bytes alike.  The mass that an
escape leaves is spread over the bytes that the longer context has not seen, so each context's
probabilities sum to 1.  After training the statistics are frozen: the code length of a text is the
sum of its bytes' code lengths, and the language with the shortest code is predicted.  Code
lengths are integers (1/65536 bit), so sums are exact and do not depend on how rows are dealt.

Training counts (``ORDER`` + 1)-byte strings in Spark over at most ``SAMPLE`` labelled documents of
each language, whole texts, and keeps the ``GRAMS`` most frequent of each language; both bounds are
parameters.  Shorter contexts' counts are sums of these.  Scoring is one pass without a shuffle: a
window of text becomes integer codes in NumPy, and each different code is looked up once.

Defined cases
* null text, or text without any letter: ``und`` with score 0; no language learned: the same;
* a language whose sampled texts are all null or empty is not learned;
* very long text: read whole, a window of ``WINDOW`` bytes at a time;
* ties go to the language that sorts first; repeated rows are rows of their own and score alike;
* null doc_id: predicted, never learned from, held_out false; empty table: empty result;
* extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import slices, small, written

#: Longest context in bytes.
ORDER = 4
#: Labelled documents of each language that are counted at most.
SAMPLE = 400
#: (ORDER + 1)-byte strings that a language keeps at most, the most frequent ones.
GRAMS = 150_000
#: Code lengths count 1/UNIT bits.
UNIT = 65536
#: Bytes of text that are looked up at a time.
WINDOW = 2_000_000
#: Bytes whose mean evidence the score stands for.
EVIDENCE = 64
_PAD = b"\n"


def codes(raw: np.ndarray, order: int) -> np.ndarray:
    """For each byte of ``raw`` from position ``order`` on: it and the ``order`` bytes before, as one integer."""
    out = np.zeros(max(0, len(raw) - order), np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | raw[k:len(raw) - order + k]
    return out


@dataclass
class Tree:
    """One language's frozen statistics: for each order the code length of known strings and of escapes."""

    seen: list  # by order: (sorted codes of context + byte, code lengths)
    escapes: list  # by order: (sorted codes of contexts, code lengths of the escape)

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code length in 1/UNIT bit of each string's last byte after the bytes before it."""
        cost = np.zeros(len(grams), np.int64)
        open_ = np.arange(len(grams))
        for k in range(len(self.seen) - 1, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            at, hit = _find(self.seen[k][0], grams[open_] & mask)
            cost[open_[hit]] += self.seen[k][1][at[hit]]
            open_ = open_[~hit]
            at, hit = _find(self.escapes[k][0], (grams[open_] & mask) >> np.uint64(8))
            cost[open_[hit]] += self.escapes[k][1][at[hit]]
        cost[open_] += 8 * UNIT  # never seen at any order: all bytes alike
        return cost


def _find(table: np.ndarray, wanted: np.ndarray):
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def grow(grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Tree:
    """The tree of strings of ``order`` + 1 bytes and their counts."""
    seen, escapes, shorter = [], [], Tree([], [])
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        keys, inverse = np.unique(grams & mask, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(keys))
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(of, weights=n)
        kinds = np.bincount(of)
        own = n / (total + kinds)[of]
        # mass that the next shorter context gives to bytes not seen here; the escape is spread over it
        below = 2.0 ** (-Tree(seen, escapes).code_lengths(keys) / UNIT)
        rest = np.maximum(1 - np.bincount(of, weights=below), 1e-12)
        left = kinds / (total + kinds)
        full = kinds >= 256
        seen.append((keys, np.rint(-np.log2(own) * UNIT).astype(np.int64)))
        escapes.append((contexts, np.where(full, 64 * UNIT, np.rint(-np.log2(left / rest) * UNIT)).astype(np.int64)))
        shorter = Tree(seen, escapes)
    return shorter


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    order: int = ORDER

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages) of whole texts, in 1/UNIT bit."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        pad = _PAD * self.order
        raw = np.frombuffer(b"".join(pad + t for t in texts) + pad, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes + self.order) - sizes  # of each text's own bytes
        total = int(begins[-1] + sizes[-1]) if len(texts) else 0
        for a in range(self.order, total, WINDOW):
            z = min(a + WINDOW, total)
            grams, inverse = np.unique(codes(raw[a - self.order:z], self.order), return_inverse=True)
            low, high = np.clip(begins, a, z) - a, np.clip(begins + sizes, a, z) - a
            touched = np.flatnonzero(high > low)
            for j, tree in enumerate(self.trees):
                sums = np.concatenate([[0], np.cumsum(tree.code_lengths(grams)[inverse])])
                out[touched, j] += sums[high[touched]] - sums[low[touched]]
        return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, sample: int, seed: int) -> DataFrame:
    """(lang, text): at most ``sample`` documents to learn from for each language."""
    rows = (docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
            .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out(F.col("doc_id"))))
    # a hash threshold leaves about twice the sample, so no window ever gets a whole language
    ids = rows.select("lang", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("draw"))
    shares = written(ids.groupBy("lang").agg(F.count("*").alias("rows")), "lang-shares")
    drawn = ids.join(small(shares, shares.count()), "lang").where(
        (F.col("rows") <= 2 * sample) | (F.pmod("draw", F.lit(1 << 30)) < F.lit(float(2 * sample << 30)) / F.col("rows"))).drop("rows")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = drawn.distinct().withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "doc_id")
    chosen = written(chosen, "lang-sample")
    chosen = small(chosen, chosen.count())
    # repeated rows of one id: one of them
    return (rows.join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text"))


def train(docs: DataFrame, *, sample: int = SAMPLE, grams: int = GRAMS, order: int = ORDER, seed: int = 17) -> Model:
    """Frozen trees of all languages, from text and lang of rows that are not held out."""
    def count(batches):
        import pyarrow as pa
        pad = _PAD * order
        for b in (s for batch in batches for s in slices(batch)):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            rows = [t for t in b.column("text").cast(pa.binary()).to_pylist()]
            for lang in sorted(set(langs)):
                found = [codes(np.frombuffer(pad + t, np.uint8), order) for t, own in zip(rows, langs == lang, strict=True) if own]
                code, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["lang", "code", "n"])
    counts = (sampled(docs, sample, seed).mapInArrow(count, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= grams).drop("rank").toArrow()  # bounded: languages x grams
    langs = np.array(kept.column("lang").to_pylist(), dtype=object)
    code, n = (kept.column(c).to_numpy() for c in ("code", "n"))
    names = sorted(set(langs))
    return Model(names, [grow(code[langs == x].astype(np.uint64), n[langs == x].astype(float), order) for x in names], order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score: the share of the predicted language if all were equally
    likely before, from the mean evidence of ``EVIDENCE`` bytes (fewer, if the text is shorter)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x GRAMS

    def run(batches):
        import pyarrow as pa
        model = shared.value
        for b in (s for batch in batches for s in slices(batch)):
            n = b.num_rows
            lettered = np.array(b.column("lettered").to_pylist(), dtype=bool)
            langs, scores = np.full(n, "und", dtype=object), np.zeros(n)
            at = np.flatnonzero(lettered)
            if len(model.languages) and len(at):
                texts = [t for t, own in zip(b.column("text").cast(pa.binary()).to_pylist(), lettered, strict=True) if own]
                bits = model.totals(texts)
                best = bits.argmin(axis=1)
                size = np.array([len(t) for t in texts])
                excess = (bits - bits[np.arange(len(at)), best][:, None]) / UNIT * np.minimum(1, EVIDENCE / size)[:, None]
                langs[at] = np.array(model.languages, dtype=object)[best]
                scores[at] = 1 / np.exp2(-np.minimum(excess, 1000)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
