"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Sources get shares of the total size in proportion to their weights; a source whose share is more
than ``max_epochs`` times its own size is clamped there and what it cannot use is dealt again to
the others by weight, until no source is above its clamp.  A source's target is met by
``target // size`` whole repetitions of every document and, for the rest, by documents in seeded
hash order up to the exact word, where one document is cut.

Everything is DataFrame work.  The point in the hash order where a source's rest ends is found by
prefix sums over 4096 hash buckets per source, then over 4096 buckets inside the one bucket that
holds the point, then over the documents of that small bucket; so a source with a third of all
rows is never sorted or gathered, and the text is read once, for the words and the hash.

Defined cases
* null or empty text: size 0, nothing is taken;
* null source: a source of its own, last in the order of sources;
* a source without words: target 0;
* repeated rows (same doc_id and text) have one hash: if the cut falls on them, each gets an equal
  share of the words left (rounded down);
* empty table: empty result; extra columns are not read by ``plan`` and are kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import discard, free_name, partitions, small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
_BITS = 12  # hash bits that one level of the search for a cut resolves


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _order_hash(seed: int) -> F.Column:
    """63 bits that order documents at random."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def with_weights(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources in code-point order, null last, weigh ``weights`` in turn."""
    spread = written(sizes.repartitionByRange(partitions(sizes.sparkSession), F.col("source").asc_nulls_last())
                     .withColumn("part", F.spark_partition_id()), "sources")
    before = spread.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))  # one row per partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    turn = (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")
    return (spread.join(F.broadcast(before), "part")
            .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long"))
            .drop("part", "before"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, weight) plus ``target``; one scalar aggregate per round."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        full = cap.cast("double") < level * F.col("weight")
        used, weight, n = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))),
                                      F.sum(full.cast("long"))).first()
        if not weight or n == clamped:
            break
        level, clamped = (total - (used or 0)) / weight, n
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")).cast("double"))


def _bucket_with_cut(rows: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Of each source's buckets, in order of ``key``, the one in which its ``rest`` runs out."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source_key").orderBy(key)
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (rows.withColumn("before", before)
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
            .select("source_key", key, *carry, (F.col("rest") - F.col("before")).alias("rest")))


def plan(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
         seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, source_key, size and hash; sources with their targets and cuts)."""
    base = written(docs.select("doc_id", "source", _source_key(F.col("source")).alias("source_key"),
                               n_words(F.col("text")).alias("size"), _order_hash(seed).alias("hash")), "mix-docs")
    sizes = base.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = written(with_weights(sizes, weights), "mix-sources")
    n_sources = sources.count()
    filled = water_fill(sources, max_epochs)
    quota = F.floor(F.col("target") + 0.5)
    size = F.greatest(F.col("source_size"), F.lit(1))
    filled = written(filled.withColumn("epochs", F.floor(quota / size).cast("long"))
                     .withColumn("rest", (quota - F.col("epochs") * F.col("source_size")).cast("long")), "mix-filled")
    rests = small(filled.select("source_key", "rest"), n_sources)

    top = F.shiftright("hash", 63 - _BITS).alias("top")
    mid = F.shiftright("hash", 63 - 2 * _BITS).alias("mid")
    tops = base.groupBy("source_key", top).agg(F.sum("size").alias("size")).join(rests, "source_key")
    cut1 = small(written(_bucket_with_cut(tops, "top", []), "mix-cut"), n_sources)
    mids = (base.withColumn("top", top).join(cut1, ["source_key", "top"])
            .groupBy("source_key", mid).agg(F.sum("size").alias("size"), F.first("rest").alias("rest")))
    cut2 = small(written(_bucket_with_cut(mids, "mid", []), "mix-cut"), n_sources)
    ends = (base.withColumn("mid", mid).join(cut2, ["source_key", "mid"]).groupBy("source_key", "hash")
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("rest").alias("rest")))
    cut3 = _bucket_with_cut(ends, "hash", ["copies"]).select(
        "source_key", F.col("hash").alias("cut_hash"), F.floor(F.col("rest") / F.col("copies")).alias("cut_words"))
    cuts = written(filled.select("source_key", "source_size", "target", "epochs").join(cut3, "source_key", "left"), "mix-cuts")
    discard(sources)
    return base, small(cuts, n_sources)


def _extra(size, hash_) -> F.Column:
    return (F.when(hash_ < F.col("cut_hash"), size)
            .when(hash_ == F.col("cut_hash"), F.least(size, F.col("cut_words"))).otherwise(F.lit(0)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and ``taken``, the words the mix takes."""
    base, cuts = plan(docs, **options)
    return base.join(cuts, "source_key").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + _extra(F.col("size"), F.col("hash"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, seed: int = 29, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole,
    and once more with its first words if it is the one a source's rest ends in."""
    _, cuts = plan(docs, seed=seed, **options)
    key, size, hash_, copies = (free_name(docs, f"mix_{n}") for n in ("key", "size", "hash", "copies"))
    renamed = [F.col(c).alias(n) for c, n in (("source_key", key),)]
    cut_cols = {c: free_name(docs, f"mix_{c}") for c in ("epochs", "cut_hash", "cut_words")}
    cuts = cuts.select(*renamed, *[F.col(c).alias(n) for c, n in cut_cols.items()])
    rows = (docs.withColumns({key: _source_key(F.col("source")), size: n_words(F.col("text")), hash_: _order_hash(seed)})
            .join(cuts, key))
    extra = (F.when(F.col(hash_) < F.col(cut_cols["cut_hash"]), F.col(size))
             .when(F.col(hash_) == F.col(cut_cols["cut_hash"]), F.least(F.col(size), F.col(cut_cols["cut_words"])))
             .otherwise(F.lit(0)))
    whole = F.when(F.col(size) > 0, F.col(cut_cols["epochs"]) + (extra == F.col(size)).cast("long")).otherwise(F.lit(0))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    first = F.when((extra > 0) & (extra < F.col(size)),
                   F.array(F.array_join(F.slice(words, F.lit(1), extra.cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(copies, F.explode(F.concat(F.array_repeat(F.col("text"), whole.cast("int")), first)))
    out = {"text": F.col(copies)} | ({"n_chars": F.length(copies).cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
