"""Phrase collocations by SON partitioning.

Documents are dealt into ``SHARDS`` shards by partition, fixed by writing them once.  Every shard is mined completely
at a local support lowered in proportion: a shard that holds a share w of a language's words asks for
ceil(w * support) occurrences.  A phrase that is frequent over all rows reaches that in one shard at
least, so the union of the locally frequent phrases holds every frequent one.  Of these the union keeps those whose
shards' counts add up to the support.  It is then counted over all rows, exactly and by the phrases' own words, and scored.

Mining goes by length: words, then pairs of which both words are in the union, then triples of which
both pairs are, then phrases of four.  While mining, a phrase is a 64-bit hash; two phrases that share
one only add a candidate.  Tasks hold the union of one length as bits at hashed places (``MOST_BITS`` at
most, sent to every task): a wrong bit costs work and changes nothing, since counts decide.  All
counting is summed in the task before it is shuffled, so hot phrases, copies and languages cost a number a
task; what is shuffled is packed, a row for each range of hashes.  Text becomes word hashes in NumPy, a slice at a time.

Cuts of a candidate look up its parts in the same table of counts (a part is at least as frequent as
the whole), products are decimals of 38 digits, and a rank limit that every task applies first
leaves each language's best.

Defined cases
* null text is empty; null lang is ``und``; a text without words adds nothing;
* very long text: read whole, cut only where pieces end, about ``SLICE`` bytes at a time;
* ties as the ranking says: higher count, then the phrase's bytes; repeated rows count as often as they stand;
* empty table: empty result; doc_id and extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import discard, partitions, slices, small, written

SHARDS = 5
SUPPORT = 30
LONGEST = 4
TOP = 2000
#: Bytes of text that are hashed at a time, and words whose phrases are counted together.
SLICE = 500_000
RUN_WORDS = 1_000_000
#: As many when phrases are counted by their words: these are Python strings.
COUNTED_WORDS = 500_000
#: Rows of an Arrow batch that a task returns.
BATCH_ROWS = 50_000
#: Words whose phrases one task adds up.
WORDS_PER_TASK = 400_000
#: Bits of a hash that mining goes by (31 to 48, a few of them for the shard), and ranges of hashes that one task adds up.
CODE_BITS = 48
BUCKETS_A_TASK = 4
#: Bits that stand for one length's candidates: so many a candidate, at most MOST_BITS (16 MB).
BITS_A_KEY = 64
MOST_BITS = 1 << 27

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"


@lru_cache(1)
def _tables():
    """Byte classes (0 word, 1 blank, 2 separator), lower case, and the numbers that hash bytes by place."""
    kind, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(_BLANKS)], kind[list(_SEPARATORS)] = 1, 2
    lower[65:91] += 32
    rng = np.random.default_rng(13)
    value = rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    step = 0x9E3779B97F4A7C15  # odd, so it has an inverse
    return kind, lower, value, step, pow(step, -1, 1 << 64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes, hashes: int = 1):
    """(lower-cased bytes, word starts, word ends, number of the piece of each word, hashes x words)."""
    kind, lower, value, step, inverse = _tables()
    raw = lower[np.frombuffer(text, np.uint8)]
    kinds = kind[raw]
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = kinds == 0
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    pieces = np.cumsum(kinds == 2, dtype=np.int32)[starts].astype(np.int64)
    out = np.zeros((hashes, len(starts)), np.uint64)
    room = 1 << max(20, int(len(raw)).bit_length())
    for k in range(hashes):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[k][raw] * _powers(step, room)[:len(raw)], out=sums[1:])
        out[k] = mix((sums[ends] - sums[starts]) * _powers(inverse, room)[starts])
    return raw, starts, ends, pieces, out


def parts(texts: list[bytes], most: int = SLICE):
    """(joined text, first byte of each text in it or -1): runs of whole texts; a longer text in several runs, cut at a separator."""
    run, begins, size = [], [], 0
    for row, t in enumerate(texts):
        a = 0
        while len(t) - a > most:
            cut = max(t.rfind(c, a, a + most) for c in (b"\n", b".", b",", b";", b":", b"!", b"?", b"\x0b", b"\x0c", b"\r"))
            if cut < a:  # a piece longer than a slice: up to its end
                cut = min((z for c in (b"\n", b".", b",", b";", b":", b"!", b"?", b"\x0b", b"\x0c", b"\r")
                           if (z := t.find(c, a + most)) >= 0), default=len(t) - 1)
            yield t[a:cut + 1], [(row, 0)]
            a = cut + 1
        run.append(t[a:])
        begins.append((row, size))
        size += len(t) - a + 1
        if size > most:
            yield b"\n".join(run), begins
            run, begins, size = [], [], 0
    if run:
        yield b"\n".join(run), begins


def phrase_keys(words: np.ndarray, pieces: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words from each word on, whether these stand in one piece)."""
    m = max(0, len(words) - n + 1)
    key = words[:m].copy()
    for k in range(1, n):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + words[k:m + k])
    return key, pieces[:m] == pieces[n - 1:m + n - 1]


def keys_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each of the places ``at`` on, as ``phrase_keys`` has them."""
    key = words[at]
    for k in range(1, n):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
    return key


def _places_of(pieces: np.ndarray, n: int, part: np.ndarray | None = None) -> np.ndarray:
    """Where ``n`` words stand in one piece and, given ``part``, both phrases of one word less are marked in it."""
    m = max(0, len(pieces) - n + 1)
    whole = pieces[:m] == pieces[n - 1:m + n - 1]
    return np.flatnonzero(whole if part is None else whole & part[:m] & part[1:m + 1])


class Places:
    """A set of hashes as bits: never misses a member, may hold others."""

    def __init__(self, n_bits: int):  # a power of two, 64 or more
        self.shift = np.uint64(65 - n_bits.bit_length())
        self.bits = np.zeros(n_bits >> 6, np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def places(keys: DataFrame) -> Places:
    """The bits of a table of hashes; their number follows the table's, up to ``MOST_BITS``."""
    n_bits = 1 << 16
    while n_bits < min(MOST_BITS, BITS_A_KEY * keys.count()):
        n_bits *= 2
    out = Places(n_bits)
    place = f"shiftrightunsigned(key, {int(out.shift)})"
    bits = (keys.groupBy(F.expr(f"shiftright({place}, 6)").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 AS INT)))").alias("bits")).toArrow())
    out.bits[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _runs(batches, hashes: int, most: int | None = None):
    """Whole texts' words, about ``most`` (``RUN_WORDS``) at a time: (raw, starts, ends, pieces, hashes, values).

    Positions count from the beginning of the joined bytes; ``values(column, words)`` are the row values of words.
    """
    import pyarrow as pa
    held, size = [], 0

    def joined():
        raws, starts, ends, pieces, keys, rows, tables = zip(*held, strict=True)
        at = np.cumsum([0] + [len(r) for r in raws])
        no = np.cumsum([0] + [int(p[-1]) + 1 for p in pieces])
        row_no = np.cumsum([0] + [len(next(iter(t.values()))) for t in tables])
        add = lambda xs, by: np.concatenate([x + a for x, a in zip(xs, by, strict=False)])
        row = add(rows, row_no)
        return (raws, add(starts, at), add(ends, at), add(pieces, no), np.concatenate(keys, axis=1),
                lambda c, words=slice(None): np.concatenate([t[c] for t in tables])[row[words]])

    for b in (s for batch in batches for s in slices(batch, most_bytes=2 * SLICE)):
        columns = {c: np.asarray(b.column(c)) for c in b.schema.names if c != "text"}
        rows = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        for text, begins in parts(rows):
            raw, starts, ends, pieces, keys = tokens(text, hashes)
            if len(starts):
                row = np.array([r for r, _ in begins])[np.searchsorted([x for _, x in begins], starts, side="right") - 1]
                held.append((raw if hashes > 1 else raw[:0], starts, ends, pieces, keys, row, columns))
                size += len(starts)
            if size >= (most or RUN_WORDS):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _batches(columns: dict):
    """Arrow batches of ``BATCH_ROWS`` rows at most."""
    import pyarrow as pa
    n = len(next(iter(columns.values())))
    for a in range(0, n, BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[a:a + BATCH_ROWS]) if not isinstance(x, pa.Array) else x.slice(a, BATCH_ROWS)
                                          for x in columns.values()], names=list(columns))


def _grouped(key: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): equal keys, of equal checks, stand together in ``key[order]``; a group starts at each ``begin``."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if check is not None and (check[order] != check[order][np.flatnonzero(new)[np.cumsum(new) - 1]]).any():
        order = np.lexsort((check, key))
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order, np.flatnonzero(new)


def _bodies(code: np.ndarray, n: np.ndarray, need: np.ndarray, buckets: int):
    """A batch (bucket, body): sorted codes and their numbers as bytes, cut by the codes' first bits."""
    import pyarrow as pa
    code = code >> np.uint64(64 - CODE_BITS)
    of = (code >> np.uint64(CODE_BITS - 31)).astype(np.int64) * buckets >> 31
    ends = np.searchsorted(of, np.arange(buckets), side="right")
    got = [(k, a, z) for k, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if a < z]
    high, low = (code >> np.uint64(16)).astype(np.uint32), code.astype(np.uint16)
    n, need = n.astype(np.uint32), need.astype(np.uint32)
    body = [b"".join(v[a:z].tobytes() for v in (high, n, need, low)) for _, a, z in got]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in got], pa.int32()), pa.array(body, pa.binary())], names=["bucket", "body"])


def _read_bodies(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, numbers, needs) of what ``_bodies`` packed."""
    size = [len(x) // 14 for x in bodies]
    part = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(bodies, size, strict=True)])
    code = part(np.uint32, 0).astype(np.uint64) << np.uint64(16) | part(np.uint16, 12)
    return code, part(np.uint32, 4).astype(np.int64), part(np.uint32, 8).astype(np.int64)


def mined(rows: DataFrame, n: int, sets, shards: int, tasks: int, support: int) -> DataFrame:
    """key: the phrases of ``n`` words that reach the support ``need`` of a shard in that shard and ``support`` in all.

    A task counts (phrase, shard) as one number, the hash's first ``CODE_BITS`` bits with the shard in the lowest of them.  What
    a task has found goes on sorted and packed, a row for each range of codes; whole ranges are added up in NumPy.  Every shard's
    counts of a phrase meet there, so their sum is known: at least the phrase's count, since phrases
    that share a hash add to it.  A phrase that is frequent in a shard alone is dropped before it is counted by its words.
    """
    width = max(1, (shards - 1).bit_length())
    low = np.uint64((1 << width) - 1)

    def count(batches):
        for _, _, _, pieces, (words,), of in _runs(batches, 1):
            salt = of("salt").view(np.uint64)
            part = None
            if n > 1:  # both parts that lack one word are candidates
                shorter = phrase_keys(words, pieces, n - 1)[0]
                part = sets[n - 2].value.holds(mix(shorter ^ salt[:len(shorter)]))
            at = _places_of(pieces, n, part)
            if not len(at):
                continue
            rest = np.uint64(64 - CODE_BITS)
            code = ((mix(keys_at(words, at, n) ^ salt[at]) >> rest) & ~low | of("shard", at).astype(np.uint64)) << rest
            order, begin = _grouped(code)
            first = order[begin]
            yield from _bodies(code[first], np.diff(np.append(begin, len(at))), of("need", at[first]), tasks)

    def add(batches):
        import pyarrow as pa
        bodies = [x for b in batches for x in b.column("body").to_pylist()]
        if not bodies:
            return
        code, number, need = _read_bodies(bodies)
        del bodies
        order = np.argsort(code)
        code, number, need = code[order], number[order], need[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, number, need = code[at], np.add.reduceat(number, at), np.maximum.reduceat(need, at)
        key, enough = code >> np.uint64(width), number >= need
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        kept = np.logical_or.reduceat(enough, at) & (np.add.reduceat(number, at) >= support)
        found = (code[at[kept]] & ~low) << np.uint64(64 - CODE_BITS)
        yield from _batches({"key": found.view(np.int64)})

    packed = rows.mapInArrow(count, "bucket int, body binary")
    return packed.repartition(max(partitions(rows.sparkSession), -(-tasks // BUCKETS_A_TASK)), "bucket").mapInArrow(add, "key long")


def counted(rows: DataFrame, sets, longest: int, tasks: int) -> DataFrame:
    """(lang, phrase, k, f): exact counts of all candidates of 1 to ``longest`` words.

    What a run of words holds goes on packed, a row for each language and range of hashes: its phrases by line (no word
    holds a line break) and their numbers.  Whole ranges are added up by the phrases themselves."""
    def count(batches):
        import pyarrow as pa
        for raws, starts, ends, pieces, (words, others), of in _runs(batches, 2, min(RUN_WORDS, COUNTED_WORDS)):
            body = np.concatenate(raws).tobytes()
            salt = of("salt").view(np.uint64)
            before, phrases, found = None, [], []
            for k in range(1, longest + 1):
                at = _places_of(pieces, k, before)
                key = mix(keys_at(words, at, k) ^ salt[at])
                held = sets[k - 1].value.holds(key)
                at, key = at[held], key[held]
                before = np.zeros(len(words), bool)
                before[at] = True
                # phrases are the same here if two independent hashes of 64 bits are
                order, begin = _grouped(key, keys_at(others, at, k) + salt[at])
                first = at[order[begin]]
                phrases += [b" ".join([body[a:z] for a, z in zip(x, y, strict=True)]) for x, y in zip(
                    np.stack([starts[first + j] for j in range(k)], 1).tolist(), np.stack([ends[first + j] for j in range(k)], 1).tolist(), strict=True)] \
                    if k > 1 else [body[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                bucket = (key[order[begin]] >> np.uint64(33)).astype(np.int64) * tasks >> 31
                found.append((bucket, salt[first], first, np.diff(np.append(begin, len(at))).astype(np.uint32)))
            if not phrases:
                continue
            bucket, lang, first, n = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((lang, bucket))
            bucket, lang, first, n = bucket[order], lang[order], first[order], n[order]
            ordered = [phrases[i] for i in order.tolist()]
            cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])]))
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)], strict=True))
            yield from _batches({"bucket": bucket[cuts].astype(np.int32), "lang": pa.array(of("lang", first[cuts]), pa.string()),
                                 "phrases": pa.array([b"\n".join(ordered[a:z]) for a, z in spans], pa.binary()),
                                 "n": pa.array([n[a:z].tobytes() for a, z in spans], pa.binary())})

    def add(batches):
        import pyarrow as pa
        held = {}
        for b in batches:
            for lang, phrases, n in zip(b.column("lang").to_pylist(), b.column("phrases").to_pylist(), b.column("n").to_pylist(), strict=True):
                held.setdefault(lang, []).append((phrases, n))
        while held:
            lang, bodies = held.popitem()
            text = np.frombuffer(b"".join(x + b"\n" for x, _ in bodies), np.uint8)
            ends = np.flatnonzero(text == 10)
            offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
            phrase = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text[text != 10])])
            number = np.frombuffer(b"".join(n for _, n in bodies), np.uint32).astype(np.int64)
            del bodies, text
            sums = pa.table({"phrase": phrase, "f": number}).group_by("phrase").aggregate([("f", "sum")]).combine_chunks()
            phrase, number = (sums.column(c).combine_chunks() for c in ("phrase", "f_sum"))
            yield from _batches({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": phrase.cast(pa.binary()).view(pa.string()), "f": number})

    packed = rows.mapInArrow(count, "bucket int, lang string, phrases binary, n binary")
    blanks = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))  # words hold none
    return (packed.repartition(max(partitions(rows.sparkSession), -(-tasks // BUCKETS_A_TASK)), "bucket").mapInArrow(add, "lang string, phrase string, f long")
            .select("lang", "phrase", (blanks + 1).alias("k"), "f"))


def word_totals(rows: DataFrame) -> DataFrame:
    """(lang, shard, n): words of each language in each shard."""
    def count(batches):
        import pyarrow as pa
        for _, _, _, _, _, of in _runs(batches, 0):
            pairs = pa.table({"lang": pa.array(of("lang"), pa.string()), "shard": of("shard")}).group_by(["lang", "shard"]).aggregate([([], "count_all")])
            yield from pairs.rename_columns(["lang", "shard", "n"]).combine_chunks().to_batches()
    return rows.mapInArrow(count, "lang string, shard int, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, *, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f): every phrase of 1 to ``longest`` words with f >= support; (lang, n): all words)."""
    sc = docs.sparkSession.sparkContext
    text, lang = F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    # rows and their shards are fixed by writing them once: a shard is every ``shards``-th partition
    rows = written(docs.where(F.octet_length(text) > 0).select(
        text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("salt"),
        F.pmod(F.spark_partition_id(), F.lit(shards)).cast("int").alias("shard")), "phrase-rows")
    totals = written(word_totals(rows.drop("salt")), "phrase-totals")
    words = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    tasks = max(partitions(docs.sparkSession), -(-(totals.agg(F.sum("n")).first()[0] or 0) // WORDS_PER_TASK))
    needs = (totals.join(words.withColumnRenamed("n", "all"), "lang")
             .select("lang", "shard", F.ceil(F.lit(support).cast("decimal(18,0)") * F.col("n") / F.col("all")).cast("long").alias("need")))
    needs = written(needs, "phrase-needs")  # the quotient is rounded before ceil, which never raises it
    placed = rows.join(small(needs, needs.count()), ["lang", "shard"]).select("text", "salt", "shard", "need")
    sets = []
    for n in range(1, longest + 1):
        union = written(mined(placed, n, sets, shards, tasks, support), "phrase-union")
        sets.append(sc.broadcast(places(union)))
    found = counted(rows.select("text", "lang", "salt"), sets, longest, tasks).where(F.col("f") >= support)
    found = written(found, "phrase-counts")
    discard(rows)
    return found, words


def collocations(docs: DataFrame, *, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST, top: int = TOP,
                 absorbed: tuple[int, int] = (80, 100)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two words and more of each language."""
    counts, words = frequent(docs, support=support, shards=shards, longest=longest)
    word = F.split("phrase", " ")
    phrases = counts.where(F.col("k") > 1).withColumn("w", word)
    size = F.col("k")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), size, "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, size - F.col("cut")), " ").alias("right"))
    known = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    wide = "decimal(38,0)"
    scored = (cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
              .withColumn("score", F.expr(f"cast(2000000 * cast(a as decimal(19,0)) as {wide}) div (cast(l as decimal(20,0)) + r)"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
              .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covers = (phrases.where(size > 2).select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("cover")))
    yes, of = absorbed
    kept = (scored.join(covers, ["lang", "phrase"], "left")
            .where(F.col("cover").isNull() | (F.col("cover").cast(wide) * of < F.col("a").cast(wide) * yes)).drop("cover"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(words, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
