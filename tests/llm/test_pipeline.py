import re
from collections import Counter

import corpus_pipeline
from eventide.llm import packing, pii, quality
from tests.llm import odd
from tests.llm.test_mixing_sharding import size, targets
from tests.llm.test_near_dedup import shingle_set
from tests.llm.test_others import plain_spans

SF = "/root/testdata/sf0.01"


def kept_of_groups(rows, percent=80):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def redact(text):
    out, at = "", 0
    for a, k, z in plain_spans(text):
        if a >= at:
            out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, z)
    return out + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    raw, good = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in raw if model.score(quality.np.array([quality.features(r.text)]))[0] >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    clean = [r.doc_id for r in raw if truth.get(r.doc_id) == 1]
    assert len({r.doc_id for r in good} & set(clean)) >= 0.97 * len(clean)
    kept = kept_of_groups([(r.doc_id, r.text) for r in good])
    assert sorted(seen["near_dedup"][1]) == sorted(r for r in good if r.doc_id in kept)
    for a, b in zip(sorted(seen["pii"][0]), sorted(seen["pii"][1]), strict=True):
        assert (a.doc_id, a.lang, a.source) == (b.doc_id, b.lang, b.source) and b.n_chars == len(b.text)
        base = pii.base_spans(a.text)
        assert b.text == redact(a.text) or list(pii._candidates(a.text, base)) or list(pii._tokens(a.text, base))
        assert not any(pii._labelled(b.text, x) for x, _ in pii._tokens(b.text, []))
        assert all(not plain_spans(x) for x in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|TOKEN)\]", b.text))
    inside, mixed = seen["mixing"]
    words, got = Counter(), Counter()
    for r in inside:
        words[r.source] += size(r.text)
    for r in mixed:
        got[r.source] += size(r.text)
    for s, want in targets(words).items():
        assert abs(got[s] - want) <= 1
    texts = {r.doc_id: r.text for r in inside}
    assert all(r.text == texts[r.doc_id] or texts[r.doc_id].split()[:size(r.text)] == r.text.split() for r in mixed)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    assert sum(r.length for r in seen["packing"][1]) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    rooms = Counter()
    for r in seen["packing"][1]:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= 2048


def test_stages_take_odd_rows(spark, tmp_path):
    for k, docs in enumerate((odd.clashing(odd.documents(spark)), odd.documents(spark).limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert name == "packing" or docs.columns == columns
