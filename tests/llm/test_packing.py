import zlib

import numpy as np
import pytest

from eventide.llm import packing


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


ODD = ["", None, " ", "a\tb\nc", "It's. it's, IT'S... don't", "J̌ ö Å", "x\x00y \x00 \x00\x00", "ΣΑΣ. İstanbul, KK",
       "<|endoftext|> a<|startoftext|>b", "9,9. a.b,c. ..,", "word " * 3000, "  x\u0085y", "日本語。テスト.", "🙂🙂 z.", "Ünder, été... ñ_ a__b ab_ ab²", "word$$$ x*** y'' n' 'n", "e\u0301a a\u0301. \u01c5x Ⓐ bⒶ",
       "a\u00a0b c\u2003 d\u200b", "Ab1 c3po, 12.5", "ﬁn. ǅ ß. \u0345a"]


def test_ids_equal_the_tokenizer(reference):
    for cache in (10**6, 5):
        tok = packing.WordTokenizer(packing.tokenizer_path(), cache)
        got = tok([t or "" for t in ODD]) + tok([t or "" for t in ODD[::-1]])
        for t, raw in zip(ODD + ODD[::-1], got, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == reference.encode(t or "", add_special_tokens=False).ids, t


def test_first_fit_decreasing_equals_the_plain_scan():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), None)
        if b is None:
            b = len(room)
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths, 100), strict=True)) == want
    assert packing.first_fit_decreasing([], 5) == ([], [])


def check(rows, docs, reference, seq_len):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_crc32), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len
    want = {}
    for d, t in docs:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        key = (d, zlib.crc32(np.array(ids, "<u4").tobytes()))
        want.setdefault(key, []).append(ids)
    assert want.keys() == by_doc.keys()
    for key, copies in want.items():
        ids = copies[0]
        ps = sorted(by_doc[key], key=lambda p: p.start)
        assert sum(p.length for p in ps) == len(ids) * len(copies)
        for p in ps:
            part = ids[p.start:p.start + p.length]
            assert p.ids == part and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids)
    return by_seq


def test_pieces_and_sequences(spark, reference):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (None, "other"), (99, "rest " * 50)]
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, offset int, sequence_id string")
    out = packing.pack(packing.tokenize(df, seq_len=64), len(docs), seq_len=64, group_documents=4).collect()
    check(out, docs, reference, 64)
    whole = packing.sequences(packing.pack(packing.tokenize(df, seq_len=64), len(docs), seq_len=64), seq_len=64).collect()
    assert all(len(r.ids) == 64 or len(r.ids) == r.n_tokens and r.n_tokens & (r.n_tokens - 1) == 0 for r in whole)
    assert packing.pack(packing.tokenize(df.limit(0)), 0).collect() == []


def test_little_padding_on_the_table(spark):
    from eventide.llm.queries import QUERIES
    rows = QUERIES["op1_packing"](spark, "/root/testdata/sf0.01").collect()
    used = sum(r.length for r in rows)
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.98
