"""Language identification, hard negatives and collocations against plain Python."""

from collections import Counter
from fractions import Fraction
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import collocations, langid, negatives
from tests.conftest import SF_MID
from tests.llm import odd


# --- language identification -------------------------------------------------------------------

def _plain_length(counts, context, symbol, order):
    """Code length in bits of ``symbol`` after ``context`` (bytes), by the definition, or None if below all orders."""
    def probability(ctx, x):
        table = counts.get(ctx)
        shorter = (lambda s: 1 / 256) if not ctx else (lambda s: probability(ctx[1:], s))
        if not table:
            return shorter(x)
        total, kinds = sum(table.values()), len(table)
        if x in table:
            return table[x] / (total + kinds)
        rest = 1 - sum(shorter(s) for s in table)
        return kinds / (total + kinds) * shorter(x) / rest
    return -math.log2(probability(context[len(context) - order:], symbol))


def test_code_lengths_equal_the_definition_and_sum_to_one():
    order, text = 2, b"abracadabra abra cadabra "
    raw = np.frombuffer(b"\n" * order + text, np.uint8)
    grams, n = np.unique(langid.codes(raw, order), return_counts=True)
    tree = langid.grow(grams, n.astype(float), order)
    counts = {}
    for i in range(order, len(raw)):
        for k in range(order + 1):
            counts.setdefault(bytes(raw[i - k:i]), Counter())[int(raw[i])] += 1
    for context in (b"ab", b"ra", b"zz", b"za", b"\n\n", b"c "):
        code = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        got = tree.code_lengths(code) / langid.UNIT
        want = [_plain_length(counts, context, s, order) for s in range(256)]
        assert np.allclose(got, want, atol=1e-3)
        assert abs(sum(2.0 ** -got) - 1) < 1e-3


def test_totals_do_not_depend_on_windows(monkeypatch):
    raw = np.frombuffer(b"\n\n\n\n" + b"the cat sat on the mat. " * 9, np.uint8)
    grams, n = np.unique(langid.codes(raw, 4), return_counts=True)
    model = langid.Model(["en"], [langid.grow(grams, n.astype(float))])
    texts = [b"the cat", b"", b"a mat on the sat " * 50, b"x", b"", b"zz\xff\xfe"]
    whole = model.totals(texts)
    monkeypatch.setattr(langid, "WINDOW", 7)
    assert (model.totals(texts) == whole).all()
    assert (np.concatenate([model.totals([t]) for t in texts]) == whole).all()


def test_language_accuracy_and_rules(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0) or score < 0 or score > 1").count() == 0


def test_language_odd_rows(spark):
    learn = [(1000 + i, "the rain in spain stays mainly in the plain", "en", None, 0) for i in range(40)] \
        + [(2000 + i, "der regen faellt immer wieder auf die wiese", "de", None, 0) for i in range(40)] + [(3000, None, "fr", None, 0)]
    docs = odd.clashing(odd.documents(spark, learn))
    got = langid.predict(docs, langid.train(docs))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i * 3].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by_id[0].score == 0  # empty, null, blanks
    assert by_id[len(odd.TEXTS) * 3 - 3].lang_pred == "und"  # digits only
    assert by_id[1001].lang_pred == "en" and by_id[2001].lang_pred == "de"
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    empty = docs.where("false")
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


# --- hard negatives ------------------------------------------------------------------------------

def _plain_negatives(rows, is_anchor, positives=5, negatives=3, lower=50, upper=95):
    key = lambda p: (-p[0], math.inf if p[1] is None else p[1])
    out = []
    for i, (a, label, q) in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), b, own == label) for b, own, v in rows if b != a and len(v) == len(q)]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=key)[:positives]:
            fits = sorted((s for s in scored if not s[2] and lower * ps <= 100 * s[0] <= upper * ps), key=key)[:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return out


@pytest.mark.parametrize("sizes", [(32768, 8192, 128), (40, 7, 3)])
def test_negatives_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 20
    rows = [(i, int(c), [int(x) for x in centres[c] + rng.normal(size=5) * 8]) for i, c in enumerate(rng.integers(0, 6, 300))]
    rows += [(400 + i, 2, [9, 9, 9, 9, 9]) for i in range(60)] + [(500 + i, 3, [9, 9, 9, 9, 9]) for i in range(60)]  # ties
    rows += [(600, 7, [1, 2, 3]), (601, 7, [3, 2, 1]), (602, 8, [2, 2, 1]), (None, 2, [9, 9, 9, 9, 8])]
    df = spark.createDataFrame(rows, "id long, label long, q array<bigint>")
    block, chunk, leaf = sizes
    got = negatives.mine(df, df.where("id % 10 = 0"), block_rows=block, chunk=chunk, leaf=leaf).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain_negatives(rows, lambda a: a is not None and a % 10 == 0)))


def test_negatives_large_components_and_odd_rows(spark):
    big = 2.0**20
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big * 0.8, 0.0], 2), (3, None, 1), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2),
            (6, [1.0, float("inf")], 2), (8, [1.0, 1.0], None), (9, [], 1), (None, [big * 0.7, 0.0], 3)]
    df = odd.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    q = negatives.quantised(df)
    plain = [(r.id, r.label, r.q) for r in q.collect()]
    assert len(plain) == 4
    got = negatives.mine(q, q.where("id = 0")).collect()
    assert [tuple(r) for r in got] == [x for x in _plain_negatives(plain, lambda a: a == 0)]
    assert len(got) == 2
    far = spark.createDataFrame([(0, 1, [2**40]), (1, 1, [2**40]), (2, 2, [2**22])], "id long, label long, q array<bigint>")
    assert [tuple(r) for r in negatives.mine(far, far.where("id = 0")).collect()] == [(0, 1, 1, 2, 2**63 - 1, 2**62)]  # 2**80 saturates
    assert negatives.mine(q.where("false"), q.where("false")).count() == 0
    assert negatives.mine(q, q.where("false")).count() == 0


def test_str_order_is_a_permutation_with_tight_leaves():
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, (1000, 4))
    order = negatives.str_order(values, 20)
    assert sorted(order) == list(range(1000))
    spread = lambda o: np.mean([np.ptp(values[o[a:a + 20]], axis=0).mean() for a in range(0, 1000, 20)])
    assert spread(order) < 0.8 * spread(np.arange(1000))


# --- collocations --------------------------------------------------------------------------------

def _plain_collocations(rows, support, top, longest=4):
    out, counts, totals = [], {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in candidates.items():
            if any(len(o) > len(p) and 100 * b >= 80 * a and any(o[i:i + len(p)] == p for i in range(len(o))) for o, b in candidates.items()):
                continue
            score, _, left, right = min((Fraction(2000000 * a, f[p[:k]] + f[p[k:]]).__floor__(), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, le, ri, totals[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(kept)[:top])]
    return out


def _phrase_rows():
    rng = np.random.default_rng(8)
    words = ["new", "york", "city", "Ärger", "über", "the", "of", "a", "São", "x1", "日本", "b-c"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words, 30)) + rng.choice([".", ",", "\n", " "]) + "New York City hall, of the\tnew") for i in range(60)]
    return rows + [("de", "ja nein ja nein ja; ja nein" * 7), ("fr", None), ("fr", ""), ("fr", " . , \t"), (None, odd.LONG[:900])]


@pytest.mark.parametrize("sizes", [(2_000_000, 1_000_000, 1 << 27), (200, 400, 1 << 6)])
def test_collocations_equal_brute_force(spark, monkeypatch, sizes):
    run, piece, bits = sizes
    rows = _phrase_rows()
    docs = odd.clashing(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    real = collocations.parts
    monkeypatch.setattr(collocations, "RUN_WORDS", run)
    monkeypatch.setattr(collocations, "parts", lambda texts, most=piece: real(texts, most))
    if bits == 1 << 6:  # every place taken: nothing is pruned, and nothing may change
        monkeypatch.setattr(collocations.Places, "holds", lambda self, keys: np.ones(len(keys), bool))
    got = [tuple(r) for r in collocations.collocations(docs, support=4, top=25).collect()]
    assert sorted(got) == sorted(_plain_collocations(rows, 4, 25))
    assert collocations.collocations(docs.where("false")).count() == 0


def test_tokens_hash_words_by_content():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abé"), rng.integers(1, 6))) for _ in range(3000)).encode()
    raw, starts, ends, pieces, (one, two) = collocations.tokens(text, 2)
    words = [text[a:z] for a, z in zip(starts, ends)]
    assert words == text.split(b" ") and not pieces.any()
    for keys in (one, two):
        assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist()))


def test_long_text_is_cut_only_at_separators():
    texts = [b"a b,c d." * 40, b"no separator at all " * 30, b"", b"x", b"tail" * 50 + b".end"]
    back = {}
    for text, begins in collocations.parts(texts, 50):
        ends = [b for _, b in begins[1:]] + [len(text) + 1]
        for (row, a), z in zip(begins, ends):
            back.setdefault(row, []).append(text[a:z - 1])
    assert [b"".join(back[row]) for row in range(5)] == texts
    assert len(back[0]) > 5 and all(p.endswith((b",", b".")) for p in back[0][:-1])
    assert back[1] == [texts[1], b""]


def test_most_bits_bound_the_places(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    keys = spark.range(30_000).select(F.xxhash64("id").alias("key"))
    found = collocations.places(keys)
    assert len(found.bits) == 1024
    assert found.holds(np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)).all()


def test_union_keeps_only_phrases_whose_shards_add_up_to_the_support(spark, monkeypatch):
    unions, real = [], collocations.written

    def written(df, tag):
        out = real(df, tag)
        if tag == "phrase-union":
            unions.append(out.count())
        return out
    monkeypatch.setattr(collocations, "written", written)
    # "a b" is often enough for the first shard alone, "c d" in all: eight times in two shards of ten texts
    first, second = ["a b c d"] * 4 + ["a b"] * 2 + ["x", "y", "z", "w"], ["c d"] * 4 + [f"w{i} v{i} u{i}" for i in range(6)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(t, "en") for t in first + second], 2), "text string, lang string")
    found, _ = collocations.frequent(docs, support=8, shards=2, longest=2)
    assert sorted((r.phrase, r.f) for r in found.collect()) == [("c", 8), ("c d", 8), ("d", 8)]
    assert unions == [2, 1]


def test_hashes_at_places_are_those_of_all_places():
    words = np.random.default_rng(2).integers(0, 2**63, 50).astype(np.uint64)
    pieces = np.repeat([0, 1, 2], [20, 3, 27])
    for n in (1, 2, 3, 4):
        keys, whole = collocations.phrase_keys(words, pieces, n)
        at = collocations._places_of(pieces, n)
        assert at.tolist() == np.flatnonzero(whole).tolist() and (collocations.keys_at(words, at, n) == keys[at]).all()
    order, begin = collocations._grouped(np.array([5, 3, 5, 5], np.uint64), np.array([1, 2, 9, 1], np.uint64))
    assert np.diff(np.append(begin, 4)).tolist() == [1, 2, 1] and order[0] == 1
