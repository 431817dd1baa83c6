"""Licence scan: phrase places and ordered signature rules, in DataFrame functions only.

``scan`` counts words, finds the base phrases at word places, and runs the rules of
``license_rules`` where their words occur: first a few root words decide which texts are looked
at, then each rule's own words, all of which its regex needs, decide whether it runs.  A detection is an interval of
the text.  Per document the intervals are put in order (start, longest first, strongest rule
first) and a running maximum of ends drops every interval that lies inside another, so a
``GPL v3`` notice does not also report ``GPL``; of two over the same place the rule with the better
priority stays.  Texts are read where they lie: only intervals are shuffled.

Defined cases
* null or empty text: 0 words, no places, empty labels, score 0;
* very long texts: scanned whole; places and detections are rows, never one long nested loop;
* ties: equal intervals keep the strongest rule; repeated rows are scanned once each;
* null doc_id and extra columns do not matter (rows go by their own number, extras are not read);
* rows in any order or partitions: numbered once, in the pass that finds base places and detections;
* empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import written
from eventide.llm.license_rules import ROOTS, RULES, Rule

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases counted at word places, and their labels.  Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def _count_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def _phrase_pattern(phrase: str) -> str:
    # (?i) folds A-Z only; the phrase's words must be whole words
    return f"(?i)(?<!{WORD})" + f"{GAP}+".join(phrase.split()) + f"(?!{WORD})"


def _searched(docs: DataFrame, keep: Sequence[str], text: str, low: str, rules: Sequence[Rule]) -> DataFrame:
    """``keep`` of every row, and of every rule whose words occur: place i among them, priority, label, weight,
    lengths found and between.  A row without such a rule stays once (i null); a rule that finds nothing only as the first."""
    gated: dict[str, list[Rule]] = {}
    for r in rules:
        gated.setdefault(r.keyword, []).append(r)
    table = F.array(*[F.struct(F.array(*[F.lit(w) for w in words.split()]).alias("words"), F.array(*[F.struct(
        F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.weight).alias("weight"))
        for r in group]).alias("rules")) for words, group in gated.items()])
    open_ = F.filter(table, lambda g: F.forall(g.words, lambda w: F.contains(F.col(low), w)))
    gate = F.lit(False)
    for root in ROOTS:
        gate = gate | F.contains(F.col(low), F.lit(root))
    opened = F.when(gate, F.flatten(F.transform(open_, lambda g: g.rules)))
    return (docs.select(*keep, text, F.posexplode_outer(opened).alias("i", "r"))
            .select(*keep, "i", "r.priority", "r.label", "r.weight",
                    F.transform(F.split(F.col(text), F.col("r.pattern"), -1), F.length).alias("between"),
                    F.transform(F.regexp_extract_all(F.col(text), F.col("r.pattern"), F.lit(0)), F.length).alias("found"))
            .where(F.col("i").isNull() | (F.col("i") == 0) | (F.size("found") > 0)))


def _surviving(searched: DataFrame, row: str) -> DataFrame:
    ran = (searched.where(F.size("found") > 0)
           .select(row, "priority", "label", "weight", F.posexplode(F.arrays_zip("between", "found")).alias("k", "z"))
           .where(F.col("z.found").isNotNull()))
    along = Window.partitionBy(row, "priority").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("z.between") + F.col("z.found")).over(along)
    spans = ran.withColumn("end", end).withColumn("start", F.col("end") - F.col("z.found"))
    before = Window.partitionBy(row).orderBy("start", F.desc("end"), "priority").rowsBetween(Window.unboundedPreceding, -1)
    return (spans.withColumn("reach", F.max("end").over(before))
            .where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
            .select(row, "start", "end", "label", "weight"))


def detections(docs: DataFrame, row: str, text: str, low: str, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Surviving detections: row, start, end (code points), label, weight."""
    return _surviving(_searched(docs, [row], text, low, rules), row)


def scan(docs: DataFrame, *, phrases: Sequence[tuple[str, str]] = PHRASES, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    # explode keeps the lower-cased text from being computed again in every condition that reads it
    rows = rows.select("*", F.explode(F.array(F.lower("text"))).alias("low"))
    near = F.lit(False)  # a phrase needs its longest word
    for word in sorted({max(p.split(), key=len) for p, _ in phrases}):
        near = near | F.contains(F.col("low"), F.lit(word))
    n = _count_words(F.col("text"))
    base = rows.select("doc_id", "row", "text", "low", n.alias("n_words"),
                       *[F.when(near, F.split("text", _phrase_pattern(p), -1)).alias(f"p{i}") for i, (p, _) in enumerate(phrases)])
    count = [F.when(F.col(f"p{i}").isNotNull(), F.size(f"p{i}") - 1).otherwise(0).cast("long") for i in range(len(phrases))]
    first = [F.when(c > 0, _count_words(F.element_at(f"p{i}", 1))) for i, c in enumerate(count)]
    last = [F.when(c > 0, F.col("n_words") - _count_words(F.element_at(f"p{i}", -1)) - len(p.split()))
            for i, (c, (p, _)) in enumerate(zip(count, phrases, strict=True))]
    least = (lambda cs: F.least(*cs) if len(cs) > 1 else cs[0])
    most = (lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0])
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(count, phrases, strict=True)]),
                                                    lambda x: x.isNotNull())))
    said = ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base"]
    base = base.select("doc_id", "row", "n_words", sum(count[1:], count[0]).alias("n_base"), least(first).alias("first_word"),
                       most(last).alias("last_word"), labels.alias("base"), "text", "low")
    # row numbers hold only within one reading of the texts, so base and detections are written together
    searched = written(_searched(base, said, "text", "low", rules), "license-rows")
    found = _surviving(searched, "row").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    return searched.where(F.col("i").isNull() | (F.col("i") == 0)).select(said).join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.85).otherwise(0.0)).alias("score"))
