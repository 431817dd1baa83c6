"""Personal data: fixed patterns as seeds, and contextual extraction bootstrapped from them.

Every text is searched for e-mail addresses, IP addresses, card numbers and phone numbers (the
base, exact and linear in the text).  Long tokens of mixed letters and digits are a kind of their own;
those that a label word such as ``token`` or ``password`` stands right in front of are its seeds, and spans.
The seed entities induce lexical patterns at four levels: two words and the marks in front of an entity, one
word and the marks, the marks alone where they say something (``="``), the marks and the word behind.  Things
that look like identifiers but match no base rule are candidates, with patterns of their own.  Patterns and identifiers form a bipartite graph whose
distinct edges Spark counts; scores pass to and fro a few rounds:

* an identifier's score for a kind is 1 where it is a seed of that kind, 0 where it is a seed of
  another, else 1 minus the chance that every pattern it goes by is wrong (at each place the finest
  one that enough identifiers follow, so a coarse pattern never overrules a poor fine one);
* a pattern's score for a kind is the mean score of all distinct identifiers that follow it, so
  copies of a document change nothing.

Patterns that end with a high score on enough distinct identifiers accept the candidates behind
them whose shape fits the kind.  The text is read once; rounds work on distinct edges, pre-
aggregated before each shuffle; nothing is collected.

Defined cases
* null or empty text: no spans; very long texts: read whole (every rule is linear);
* ties: spans by start, then kind as listed, then end; repeated rows each give their spans;
* null doc_id: a row like any other; extra columns are not read by ``find``, kept by ``redacted``;
* empty table: empty result; a corpus with too few seeds accepts nothing beyond the base.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import discard, free_name, slices, small, texts, written

KINDS = ("email", "ip", "card", "phone", "token")
#: Kinds of the base rules.
BASE = 4
TOKEN = 4
#: Words that stand in front of a secret.  Fixed values.
SECRET_LABELS = frozenset("token tokens key keys secret secrets password passwd pwd passphrase auth authorization bearer credential credentials apikey".split())
#: Rounds of scoring, least score and distinct identifiers of a pattern that accepts.
ROUNDS = 3
MIN_SCORE = 0.8
MIN_SUPPORT = 5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9()./\x20-]*[0-9]")
_PART = re.compile(r"[+(]?[0-9](?:[0-9().-]*[0-9])?")
_RUN = re.compile(r"[+(]?[0-9][0-9()./\x20-]*")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9._-]{1,64}")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_MIXED = re.compile(r"[A-Za-z]+[0-9]")
#: Characters of the longest token (longer runs are data), its changes from letters to digits, its bits a character.
MOST_TOKEN = 512
LEAST_CHANGES = 2
LEAST_BITS = 3.0
_TELLING = re.compile(r"[:=\"'<(\[{|]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and _LOCAL.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, leftmost and non-overlapping per kind, sorted."""
    found = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(token: str) -> int:
    """Bits of the kinds that an identifier could be."""
    digits = sum("0" <= c <= "9" for c in token)
    if "@" in token:
        return 1
    return (2 if token.count(".") == 3 and 4 <= digits <= 12 else 0) | (4 if 12 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)


def _grouped(text: str, start: int, end: int):
    """(start, end) of the single identifiers in a run of numbers: its parts between blanks and
    slashes, joined until the digits make a whole phone or card number."""
    parts = [(m.start(), m.end(), sum("0" <= c <= "9" for c in m[0])) for m in _PART.finditer(text, start, end)]
    counts = [n for _, _, n in parts]
    i = first = held = 0  # parts first..i-1 are joined and hold so many digits
    while i < len(parts):
        a, z, n = parts[i]
        if held == 0:
            take = _usual(text, parts, counts, i)
            if take or n >= 7 or text.count(".", a, z) == 3:
                i += take or 1
                yield a, parts[i - 1][1]
                first = i
                continue
        elif n >= 7 or held + n > 15 or text.count(".", a, z) == 3:  # a number by itself, unless what is before dials it
            head = text[parts[first][0]:parts[first][1]]
            dials = held <= 6 and (head == "1" or head[0] in "+(" or n < 10 and (head[0] == "0" or held == 3))
            if not dials or held + n > 15 or text.count(".", a, z) == 3:
                yield parts[first][0], parts[i - 1][1]
                first, held = i, 0
                continue
        held += n
        i += 1
        if held >= 10:
            yield parts[first][0], z
            first, held = i, 0
    if held:
        yield parts[first][0], parts[-1][1]


def _usual(text: str, parts: list, counts: list[int], i: int) -> int:
    """How many parts from ``i`` on have the digit counts of a printed card or short phone number."""
    if counts[i:i + 4] == [4, 4, 4, 4]:
        card = "".join(c for c in text[parts[i][0]:parts[i + 3][1]] if "0" <= c <= "9")
        return 5 if counts[i + 4:] == [3] and not _luhn(card) else 4
    if counts[i:i + 3] == [4, 6, 5]:
        return 3
    return 2 if counts[i:i + 2] == [3, 4] and counts[i + 2:i + 3] != [4] and text[parts[i][0]] != "0" else 0


def _numbers(text: str, taken: list[tuple[int, int]]):
    """(start, end) of number-like places: runs of numbers, without base spans, as single identifiers."""
    k = 0
    for m in _NUMBER.finditer(text):
        a, end = m.span()
        if end - a < 7:
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while a < end:
            z = min(end, max(a, taken[j][0])) if j < len(taken) else end
            yield from _grouped(text, a, z)
            a = max(z, taken[j][1]) if j < len(taken) else end
            j += 1


def _tokens(text: str, spans: list[tuple[int, int, int]]):
    """(start, end) of long runs of mixed letters and digits that no base span reaches out of."""
    k = 0
    for m in _TOKEN.finditer(text):
        a, z = m.span()
        token = m[0]
        if z - a > MOST_TOKEN or len(_MIXED.findall(token)) < LEAST_CHANGES:
            continue
        counts = Counter(token).values()
        if sum(n * math.log2((z - a) / n) for n in counts) < LEAST_BITS * (z - a):
            continue
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        j, inside = k, True
        while j < len(spans) and spans[j][0] < z:
            inside &= spans[j][2] <= a or a <= spans[j][0] and spans[j][2] <= z
            j += 1
        if inside:
            yield a, z


def _labelled(text: str, start: int) -> bool:
    """Whether a label of secrets and only marks stand right in front of a place, on its line."""
    before = text[max(0, start - 40):start]
    word = None
    for word in _WORD.finditer(before):  # the last one
        pass
    return word is not None and word[0].lower() in SECRET_LABELS and not any(c.isalnum() or c == "\n" for c in before[word.end():])


def _candidates(text: str, spans: list[tuple[int, int, int]], tokens: Sequence[tuple[int, int]] = ()):
    """(start, end, shape) of identifier-like places that no base span or token touches; numbers inside a word are none."""
    taken = sorted([(a, z) for a, _, z in spans] + list(tokens))
    found = [(a, z) for a, z in _numbers(text, taken) if z - a >= 7
             and not (a and text[a - 1].isalpha()) and not (z < len(text) and text[z].isalpha())]
    if "@" in text:
        at = 0
        while (at := text.find("@", at)) >= 0:  # bounded on both sides of each mark
            lo = max(0, at - 64)
            if m := next((m for m in _AT.finditer(text, lo, min(len(text), at + 65)) if m.start() < at < m.end()), None):
                found.append(m.span())
                at = max(at, m.end() - 1)
            at += 1
    found.sort()
    k = done = 0
    for a, z in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        shape = _shape(text[a:z])
        if shape and a >= done and not (k < len(taken) and taken[k][0] < z):
            yield a, z, shape
            done = z


def _patterns(text: str, start: int, end: int) -> list[str]:
    """What a place follows, from its line or lines before, at three levels, and what stands behind it.  Numbers
    among the marks (earlier members of a list) count as one mark."""
    out = []
    before = text[max(0, start - 60):start]
    words = list(_WORD.finditer(before))[-2:]
    if words:
        marks = " ".join(_RUN.sub("# ", before[words[-1].end():]).split())
        names = [w[0].lower() for w in words]
        out += [f"{' '.join(names)}|{marks}"] + [f"{names[-1]}|{marks}"] * (len(names) - 1)
        if _TELLING.search(marks):
            out.append(f"|{marks}")
    behind = text[end:end + 40]
    if (word := _WORD.search(behind)) and word.start():
        out.append(f"{' '.join(_RUN.sub('# ', behind[:word.start()]).split())}|{word[0].lower()}|behind")
    return out


_ROWS = ("doc_id long, text_hash long, row long, base array<struct<start:int,kind:int,end:int>>, "
         "seen array<struct<start:int,end:int,kind:int,shape:int,patterns:array<string>,name:string>>")


def _extracted(docs: DataFrame) -> DataFrame:
    """Base spans of every row, and what the graph needs: seeds (kinds 0 to 4) and candidates (kind -1)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        seen_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("shape", pa.int32()),
                                        ("patterns", pa.list_(pa.string())), ("name", pa.string())]))
        for b in (s for batch in batches for s in slices(batch)):
            base, seen = [], []
            for t in texts(b.column("text")):
                spans = base_spans(t)
                tokens = list(_tokens(t, spans))
                marks = [(a, z, kind, 1 << kind) for a, kind, z in spans] + [(a, z, -1, s) for a, z, s in _candidates(t, spans, tokens)]
                marks += [(a, z, TOKEN if _labelled(t, a) else -1, 1 << TOKEN) for a, z in tokens]
                base.append([{"start": a, "kind": k, "end": z} for a, k, z in spans])
                seen.append([{"start": a, "end": z, "kind": k, "shape": s, "patterns": p, "name": t[a:min(z, a + 80)].lower()}
                             for a, z, k, s in marks if (p := _patterns(t, a, z))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("row"),
                                              pa.array(base, base_type), pa.array(seen, seen_type)],
                                             names=["doc_id", "text_hash", "row", "base", "seen"])
    return written(rows.mapInArrow(run, _ROWS), "pii-spans")


#: A candidate's shape allows the kind.
_FITS = "getbit(shape, {}) = 1"


def score_patterns(edges: DataFrame, deciding: DataFrame | None = None, *, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(pattern, kind) that accept.  ``edges``: pattern, name, seed (kind or -1), shape; patterns are scored
    over them.  ``deciding``: those (pattern, name, shape) along which unseen names are scored; all if not given."""
    seeds = edges.where("seed >= 0").select("name", F.col("seed").alias("kind")).distinct().withColumn("s", F.lit(1.0))
    known = written(seeds, "pii-seeds")
    is_seed = known.select("name").distinct().withColumn("is_seed", F.lit(True))
    flat = written(edges.groupBy("pattern", "name").agg(F.max("shape").alias("shape")), "pii-edges")
    back = flat if deciding is None else deciding
    totals = flat.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    scores, patterns = known, None
    for step in range(rounds):
        held = (flat.join(scores, "name").groupBy("pattern", "kind")
                .agg(F.sum("s").alias("mass"), F.count(F.lit(1)).alias("support")))
        patterns_next = written(held.join(totals, "pattern").where(F.col("support") >= min_support)
                                .select("pattern", "kind", (F.col("mass") / F.col("total")).alias("p")), "pii-patterns")
        if patterns is not None:
            discard(patterns)
        patterns = patterns_next
        if step + 1 < rounds:
            unseen = (back.join(small(patterns.where(F.col("p") >= 0.5), patterns.count()), "pattern").where(_FITS.format("kind"))
                      .groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("s"))
                      .join(is_seed, "name", "left").where(F.col("is_seed").isNull()).select("name", "kind", "s"))
            scores = written(known.unionByName(unseen), "pii-names")
    return patterns.where(F.col("p") >= min_score).select("pattern", "kind")


def _found(docs: DataFrame, **options) -> DataFrame:
    """Extracted rows plus ``more``: accepted spans beyond the base."""
    rows = _extracted(docs)
    places = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    seen = places.select("*", F.posexplode("patterns").alias("level", "pattern"))
    edges = written(seen.groupBy("pattern", "name", F.col("kind").alias("seed")).agg(F.max("shape").alias("shape")), "pii-graph")
    # a candidate goes by its finest pattern that enough identifiers follow
    known = written(edges.groupBy("pattern").agg(F.count_distinct("name").alias("n"))
                    .where(F.col("n") >= options.get("min_support", MIN_SUPPORT)).select("pattern"), "pii-known")
    seen = written(seen.where("kind = -1").join(small(known, known.count()), "pattern").groupBy("row", "start", "end", "name", "shape")
                   .agg(F.min_by("pattern", "level").alias("pattern")), "pii-candidates")
    deciding = written(seen.groupBy("pattern", "name").agg(F.max("shape").alias("shape")), "pii-deciding")
    accepted = written(score_patterns(edges, deciding, **options).withColumnRenamed("kind", "as_kind"), "pii-accepted")
    accepted = small(accepted, accepted.count())
    secrets = places.where(F.col("kind") == TOKEN).select("row", "start", "end", F.col("kind").alias("as_kind"))
    more = (seen.join(accepted, "pattern").where(_FITS.format("as_kind")).select("row", "start", "end", "as_kind")
            .unionByName(secrets).groupBy("row", "start", "end").agg(F.min("as_kind").alias("kind"))
            .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(more, "row", "left").withColumn("more", F.coalesce("more", none))


def find(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, text_hash, counts of the base spans, base and all spans as sorted arrays."""
    found = _found(docs, **options)
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return found.select("doc_id", "text_hash", *count, "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def printed(spans: str) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({kinds})[s.kind], ':', s.start, ':', s.end)), ',')")


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all rows and columns stay."""
    key, extra, n_chars = free_name(docs, "pii_key"), free_name(docs, "pii_more"), "n_chars" in docs.columns
    more = _found(docs, **options).where(F.size("more") > 0).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias(key), F.col("more").alias(extra)).dropDuplicates(["d", key])
    more = written(more, "pii-more")
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(small(more, more.count()), [rows[key] == more[key], rows["doc_id"].cast("long").eqNullSafe(more["d"])], "left") \
        .select(*[rows[c] for c in docs.columns], more[extra])
    marks, columns = [f"[{k.upper()}]" for k in KINDS], docs.columns

    def clean(t, more_spans):
        spans = base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in more_spans or ()]
        out, at = [], 0
        for a, kind, z in sorted(spans):
            if a >= at:
                out += [t[at:a], marks[kind]]
            at = max(at, z)
        return "".join([*out, t[at:]]) if spans else t

    def run(batches):
        import pyarrow as pa
        for b in (s for batch in batches for s in slices(batch)):
            column = b.column("text")
            new = [None if null else clean(t, m) for t, null, m in
                   zip(texts(column), column.is_null().to_pylist(), b.column(extra).to_pylist(), strict=True)]
            values = {"text": pa.array(new, pa.string())}
            yield pa.RecordBatch.from_arrays([values.get(c, b.column(c)) for c in columns], names=columns)
    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if n_chars else out
