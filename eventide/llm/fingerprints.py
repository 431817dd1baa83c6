"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are hashed to 63-bit digests (47 bits of hash, 16 bits that check them).  A text of
n digests is sketched in 2**r blocks, the least power of two that is n / ``PER_BLOCK`` or more; the digest's
top bits choose the block.  A block has three sub-tables of ``CELLS`` cells and a digest stands in one cell
of each; a cell keeps the number of its digests and their XOR.  Only filled cells are kept: they are the
fingerprint.

Two fingerprints are compared cell by cell.  The finer one is folded first: 2**d neighbouring blocks become
one by adding their cells, since a coarser sketch uses fewer top bits and the same cells.  Subtracted, the
digests that both texts hold cancel, and peeling recovers the rest: a cell with one digest gives it away,
the digest is removed from its other cells, and so on.  A block that does not peel to nothing is sketched
again from its digests in a table of twice the cells, then twice again, until it peels.  Only digests that
share all cells even in tables of ``AMPLE`` cells each are compared as sets.

``likeness`` is the Jaccard similarity of the two texts' paragraph sets that the recovered differences give.

Spark deals the rows to ranges of doc_id and finds each row's next; cutting, sketching and peeling are small
helpers on one or two texts, linear in their length, inside ``mapInArrow``.

Paragraphs: texts are cut at line breaks.  Parts longer than ``LONG`` characters are cut on: at ends of
sentences; what is still longer, before words with some first letters, then with more of them; then at every blank; then, without blanks, after some characters (not inside a run of one
repeated character).  All are rules of the part alone, so both versions of a text are cut alike, in linear time.

Defined cases
* null or empty text: no paragraphs; its fingerprint is ``0:``; two empty sets have likeness 1;
* very long text: more blocks; nothing is cut off;
* ties and repeated rows: rows in descending doc_id (null last), then by hash of the text; the
  next of repeated rows is the repeated row;
* repeated paragraphs count once; empty table: empty result; a single row is its own next;
* many rows with one doc_id, or with none, are dealt out by the hash of their text;
* extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import slices, texts, written

#: Word beginnings that cut a long part, some letters of several scripts, then more of them.
_SOME = "b-dB-D0-2À-Ãà-ãα-γб-дБ-Дא-גا-ت"
_MORE = "e-mE-M3-6É-Ïé-ïδ-λе-лЕ-Лד-טث-ش"
#: Characters of scripts that write without blanks, that end a part.
_ENDS = "".join(f"{chr(c)}-{chr(c + 31)}" for c in range(0xE00, 0xD800, 256))
#: Cuts: all texts by the first, parts longer than LONG characters by the next, and so on.
CUTS = (r"[\r\n]+", r"[.!?…][\"'”’»)\]]?[ \t]+|[。！？]", rf"[ \t]+(?=[{_SOME}])", rf"[ \t]+(?=[{_MORE}])", r"[ \t]+",
        rf"(?<=[a-dA-D0-2])(?=[k-nK-N7-9])|(?<=[{_ENDS}])(?![{_ENDS}])")
LONG = 240
#: Digests that a block holds at most in the mean.
PER_BLOCK = 3
#: Cells of one of a block's three sub-tables, a power of two; a retry doubles them.
CELLS = 8
#: Cells a digest at which a table that still does not peel is given up.
AMPLE = 8
#: Ranges of doc_id that documents are dealt to, to look up the next one.
ROWS_PER_RANGE = 5_000
MAX_RANGES = 4096


_CUTS = [re.compile(cut) for cut in CUTS]
_WORD = (1 << 64) - 1

Cells = dict[int, tuple[int, int]]


def paragraphs(text: str) -> set[str]:
    """The distinct paragraphs of a text, trimmed and not empty."""
    parts = _CUTS[0].split(text)
    for cut in _CUTS[1:]:
        if max(map(len, parts)) <= LONG:
            break
        parts = [x for p in parts for x in (cut.split(p) if len(p) > LONG else (p,))]
    out = {p.strip(" ") for p in parts}
    out.discard("")
    return out


def _check(h: int) -> int:
    return ((h ^ h >> 21) * 0x9E3779B97F4A7C15 & _WORD) >> 48


def digests(text: str) -> set[int]:
    """Distinct paragraph digests of a text: 47 bits of hash, then 16 bits that check them."""
    from xxhash import xxh64_intdigest
    hashes = (xxh64_intdigest(p.encode("utf-8", "replace")) >> 17 for p in paragraphs(text))
    return {h << 16 | _check(h) for h in hashes}


def rung(n: int) -> int:
    """log2 of the number of blocks for ``n`` digests."""
    return (max(1, -(-n // PER_BLOCK)) - 1).bit_length()


def spots(key: int, size: int) -> tuple[int, int, int]:
    """A digest's cells, one in each of three sub-tables (others for another size)."""
    h = (key ^ size) * 0xD6E8FEB86659FD93 & _WORD
    h = (h ^ h >> 32) * 0xBF58476D1CE4E5B9 & _WORD
    h ^= h >> 29
    return h & size - 1, (h >> 20 & size - 1) + size, (h >> 40 & size - 1) + 2 * size


def put(cells: Cells, at: tuple[int, int, int], key: int, n: int = 1) -> None:
    """Add a digest ``n`` times to its cells; a cell that comes to nothing goes."""
    for c in at:
        m, x = cells.get(c, (0, 0))
        if m + n or x != key:
            cells[c] = m + n, x ^ key
        else:
            del cells[c]


def sketch(keys: set[int], size: int = CELLS) -> list[Cells]:
    """The blocks of a set of digests, each a table of its filled cells: cell -> (count, XOR)."""
    bits = rung(len(keys))
    blocks: list[Cells] = [{} for _ in range(1 << bits)]
    for k in keys:
        put(blocks[k >> 63 - bits], spots(k, size), k)
    return blocks


def printed(n: int, blocks: list[Cells]) -> str:
    """A sketch as text: the number of paragraphs, then every block's cells as cell.count.xor in hexadecimal."""
    return f"{n}:" + ";".join(",".join(f"{c}.{m}.{x:X}" for c, (m, x) in sorted(b.items())) for b in blocks)


def subtracted(a: list[Cells], b: list[Cells]) -> list[Cells]:
    """Cells of ``a`` less those of ``b`` in the blocks of the coarser one; the finer one's are folded."""
    common = min(len(a), len(b))
    out: list[Cells] = [{} for _ in range(common)]
    for blocks, sign in ((a, 1), (b, -1)):
        width = len(blocks) // common
        for i, block in enumerate(blocks):
            into = out[i // width]
            for c, (n, x) in block.items():
                m, y = into.get(c, (0, 0))
                into[c] = m + sign * n, x ^ y
    return [{c: z for c, z in block.items() if z != (0, 0)} for block in out]


def peeled(cells: Cells, size: int) -> tuple[int, int] | None:
    """How many digests only the left and only the right side holds; None if cells are left over."""
    found = [0, 0]
    waiting = list(cells)
    while waiting:
        c = waiting.pop()
        n, x = cells.get(c, (0, 0))
        if n in (1, -1) and x & 0xFFFF == _check(x >> 16) and c in (at := spots(x, size)):
            found[n < 0] += 1
            if sum(found) > 3 * size:  # more than the cells can tell apart: a false digest went round
                return None
            put(cells, at, x, -n)
            waiting += at
    return None if cells else (found[0], found[1])


def differences(a: set[int], a_sketch: list[Cells], b: set[int], b_sketch: list[Cells], size: int = CELLS,
                ample: int = AMPLE) -> tuple[int, int]:
    """How many digests only ``a`` and only ``b`` holds, from their sketches; the digests are read again only
    for blocks that do not peel."""
    left = right = 0
    blocks = subtracted(a_sketch, b_sketch)
    shift = 63 - (len(blocks).bit_length() - 1)
    held: list[list[list[int]]] | None = None
    for j, cells in enumerate(blocks):
        got, cells_now = (peeled(cells, size) if cells else (0, 0)), size
        if got is None:
            if held is None:
                held = [[[], []] for _ in blocks]
                for side, keys in enumerate((a, b)):
                    for k in keys:
                        held[k >> shift][side].append(k)
            mine, other = held[j]
            while got is None and cells_now < ample * (len(mine) + len(other)):
                cells_now *= 2
                again: Cells = {}
                for k in mine:
                    put(again, spots(k, cells_now), k)
                for k in other:
                    put(again, spots(k, cells_now), k, -1)
                got = peeled(again, cells_now)
            if got is None:
                got = len(set(mine).difference(other)), len(set(other).difference(mine))
        left, right = left + got[0], right + got[1]
    return left, right


def likeness(a: set[int], a_sketch: list[Cells], b: set[int], b_sketch: list[Cells], **options) -> float:
    """Jaccard similarity of two texts from their fingerprints."""
    left, right = differences(a, a_sketch, b, b_sketch, **options)
    union = len(a) + right
    return (len(a) - left) / union if union else 1.0


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): every row with the next in descending doc_id, in that order inside a partition.

    Rows are dealt to ranges of doc_id (bounds by approximate quantiles of the ids alone), so the
    texts are shuffled once; a range's last row takes its next from the following range's first.
    """
    n_rows, n_ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    n_ranges = min(MAX_RANGES, max(1, n_ids // ROWS_PER_RANGE))
    n_null = min(MAX_RANGES, max(1, (n_rows - n_ids) // ROWS_PER_RANGE))
    probs = [i / n_ranges for i in range(1, n_ranges)]
    drawn = [int(b) for b in docs.select(F.col("doc_id").cast("long")).approxQuantile("doc_id", probs, 0.1 / n_ranges)] if probs else []
    bounds = sorted(set(drawn))
    hot = {b: drawn.count(b) for b in bounds if drawn.count(b) > 1}  # ids that fill several ranges
    steps = len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else None
    if table is None:
        spot = F.lit(0)
    else:  # binary search for the number of bounds <= doc_id
        def halve(lo, k):
            mid = lo + F.pow(F.lit(2), k - 1).cast("int")
            return F.when((mid <= len(bounds)) & (F.try_element_at(table, mid) <= F.col("doc_id")), mid).otherwise(lo)
        spot = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), F.lit(0), halve)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("tie"))
    # 0: the largest ids; inside one id, and where there is none, in the order of the text's hash
    share = lambda parts: F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    inside = F.lit(0)
    for b, m in hot.items():
        inside = F.when(F.col("doc_id") == b, F.least(share(m), F.lit(m - 1))).otherwise(inside)
    width = 1 + max(hot.values(), default=1)
    place = F.when(F.col("doc_id").isNull(), (len(bounds) + 1) * width + F.least(share(n_null), F.lit(n_null - 1))) \
        .otherwise((len(bounds) - spot) * width + F.when(F.col("doc_id").isin(list(hot)), inside + 0).otherwise(0))
    # the other ids of a hot id's range are larger than it, so they come first
    if hot:
        place = F.when(F.col("doc_id").isin(list(hot)), place + 1).otherwise(place)
    rows = rows.withColumn("place", place.cast("int"))
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    firsts = rows.groupBy("place").agg(F.min_by(F.struct("doc_id", "tie"), F.struct(
        F.col("doc_id").isNull(), -F.coalesce("doc_id", F.lit(0)), "tie")).alias("f")).select("place", "f.doc_id", "f.tie")
    places = [r for r in firsts.orderBy("place").collect()]  # at most 3 * MAX_RANGES rows of numbers
    after = {p.place: places[(i + 1) % len(places)] for i, p in enumerate(places)}
    if not after:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    first_rows = firsts.join(rows.withColumnsRenamed({"place": "p", "doc_id": "d", "tie": "t"}),
                             (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    back = F.create_map(*[x for place_, nxt in after.items() for x in (F.lit(nxt.place), F.lit(place_))])
    first_rows = written(first_rows.dropDuplicates(["place"]).select(F.element_at(back, F.col("place")).alias("place"),
                                                                     F.col("text").alias("first_text")), "fp-firsts")
    w = Window.partitionBy("place").orderBy(*order)
    led = rows.withColumn("next_text", F.lead("text").over(w))
    return (led.join(first_rows, "place", "left")
            .select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text")))


def fingerprints(docs: DataFrame, *, cells: int = CELLS, ample: int = AMPLE) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def run(batches):
        import pyarrow as pa
        known, of_known = None, (set(), [])

        def sketched(text):
            keys = digests(text)
            return keys, sketch(keys, cells)
        for b in (s for batch in batches for s in slices(batch)):
            out: list[list] = [[] for _ in range(6)]
            for t, after in zip(texts(b.column("text")), texts(b.column("next_text")), strict=True):
                half = len(t) // 2
                edited = t[:len(t) - half] + after[:half]
                mine = of_known if t == known else sketched(t)
                known, of_known = after, mine if after == t else sketched(after)  # mostly the next row's text
                other = mine if edited == t else sketched(edited)
                for column, value in zip(out, (
                        len(t), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), printed(len(mine[0]), mine[1]),
                        printed(len(other[0]), other[1]), likeness(*mine, *other, size=cells, ample=ample),
                        likeness(*mine, *of_known, size=cells, ample=ample)), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                                             names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                    "near_edited", "near_next"])
    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")
