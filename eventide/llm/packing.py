"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups.

``tokenize`` turns every document into token ids plus an end token and cuts it into pieces of at
most ``seq_len`` ids.  ``pack`` deals documents at random (seeded hash) into groups of about
``GROUP_DOCUMENTS`` and packs each group on its own: pieces from the longest to the shortest go
into the first sequence that still has room.  A tournament tree over the bins (each inner node
holds the largest room below it) finds that sequence in logarithmic time.  Groups are independent,
so the work is one narrow shuffle of piece lengths; token ids stay where they were made unless
``sequences`` is asked for them.

Defined cases
* null or empty text: one piece that holds only the end token;
* very long text: cut every ``seq_len`` ids, so it fills whole sequences and leaves one rest;
* ties in length: by document hash, doc_id, start; repeated rows are packed once per row;
* null doc_id: packed like any other (grouped by its tokens);
* empty table: empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import slices, texts

SEQ_LEN = 2048
END_ID = 1
#: Documents dealt to one packing group; a group leaves about one part-filled sequence.
GROUP_DOCUMENTS = 8192
#: Words whose ids a Python worker remembers (about 0.2 KB each).
CACHE_WORDS = 400_000
#: Text that is tokenized at a time.
SLICE_BYTES = 300_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long, ids array<int>")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``, word by word from a cache.

    This tokenizer's splitting never crosses a blank, so a text's ids are the ids of its
    blank-separated parts joined up.  Most parts are a word of letters and perhaps some marks behind
    it, which the tokenizer splits there; such words, already lower and in normal form, go to the
    tokenizer's model without its normaliser, many in one call, and the cuts between them are the
    ids that end a word.  Any other part not seen before is encoded by the whole tokenizer.
    """

    #: Lower-case Latin letters (lower and in normal form by themselves), then ASCII marks; a part per line.
    PLAIN = re.compile(r"^([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)$", re.M)
    #: Any letters, then marks.
    WORD = re.compile(r"([^\W\d_]+)((?:[^\w\s]|_)*)")
    CHUNK = 300

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.encode = Tokenizer.from_file(path).encode
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"),
                                                      pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_words = bare.encode
        self.ends_word = np.zeros(bare.get_vocab_size(), bool)
        for token, i in bare.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")
        self.limit = cache_words
        self.known: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Blank-separated parts, letters lowered where that cannot change the ids."""
        if text.isascii():
            text = text.lower()
        elif unicodedata.is_normalized("NFC", text) and "\u03a3" not in text:  # capital sigma lowers by its place
            low = text.lower()
            if unicodedata.is_normalized("NFC", low):
                text = low
        # the tokenizer's own special tokens, '<|...|>', are lower case already
        return text.replace("\n", " ").split(" ")

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        new: dict[str, bytes] = {}
        plain, ending = [], []
        pairs = self.PLAIN.findall("\n".join(parts))
        for word, tail in pairs:
            if tail:
                ending.append((word + tail, word, tail))
            else:
                plain.append(word)
        for p in parts.difference([word + tail for word, tail in pairs]):
            m = self.WORD.fullmatch(p)
            if m and (p.isascii() or max(p) < "\u3000" and p == p.lower() and unicodedata.is_normalized("NFC", p)) \
                    and (word := m[1]).isalpha() and (p.islower() or not p.isascii()):
                if m[2]:
                    ending.append((p, word, m[2]))
                else:
                    plain.append(word)
            else:
                new[p] = self._ids(p)
        plain += {word for _, word, _ in ending if word not in self.known and word not in parts}
        for a in range(0, len(plain), self.CHUNK):
            chunk = plain[a:a + self.CHUNK]
            ids = np.array(self.encode_words(" ".join(chunk), add_special_tokens=False).ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            raw, x = ids.tobytes(), 0
            for p, z in zip(chunk, ends.tolist(), strict=True):
                new[p] = raw[x:z]
                x = z
        for p, word, tail in ending:
            base = new.get(word)
            t = self.tails.get(tail)
            if t is None:
                t = self._ids(tail)
                if len(self.tails) < 10_000:
                    self.tails[tail] = t
            new[p] = (self.known[word] if base is None else base) + t
        return new

    def __call__(self, batch: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in batch]
        seen = set()
        for p in parts:
            seen.update(p)
        new = self._learn(seen.difference(self.known))
        keep = len(self.known) < self.limit
        self.known.update(new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        if not keep:
            for p in new:
                del self.known[p]
        return out


def tokenize(docs: DataFrame, *, seq_len: int = SEQ_LEN, end_id: int = END_ID, path: str | None = None,
             with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``seq_len`` ids of every document (columns of ``PIECES``).

    ``with_ids=False`` leaves ``ids`` null, for callers that only need lengths and checksums.
    """
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        tok = WordTokenizer(path)  # workers outlive tasks; the tokenizer and its words go with this one
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * seq_len
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32")]
                           + [("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for doc_id, raw in zip(part.column(0).to_pylist(), tok(texts(part.column(1))), strict=True):
                    raw += end
                    total, crc = len(raw) // 4, zlib.crc32(raw)
                    for x in range(0, len(raw), step):
                        piece = raw[x:x + step] if len(raw) > step else raw
                        for col, v in zip(out, (doc_id, x // 4, len(piece) // 4, zlib.crc32(piece), total, crc,
                                                np.frombuffer(piece, dtype="<i4") if with_ids else None), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in the bin) of every length; ``lengths`` run from the longest down."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # a tournament tree: room[i] = max(room[2i], room[2i + 1])
    bins, offsets = [], []
    for n in lengths:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < n:
                i += 1
        bins.append(i - leaves)
        offsets.append(capacity - room[i])
        room[i] -= n
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
    return bins, offsets


def pack(pieces: DataFrame, n_documents: int, *, seq_len: int = SEQ_LEN, group_documents: int = GROUP_DOCUMENTS,
         seed: int = 17) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (where the piece lies in its sequence)."""
    n_groups = max(1, -(-n_documents // group_documents))
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "doc_crc32"), F.lit(n_groups))

    def fit(pdf):
        pdf = pdf.sort_values(["length", "doc_crc32", "doc_id", "start"], ascending=[False, True, True, True],
                              kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), seq_len)
        pdf["sequence_id"] = (pdf["_group"].to_numpy(np.int64) << 40) + np.array(bins, dtype=np.int64)
        pdf["offset"] = np.array(offsets, dtype=np.int64)
        return pdf.drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return (pieces.withColumn("_group", group).groupBy("_group")
            .applyInPandas(fit, schema + ", sequence_id long, offset long"))


def sequences(packed: DataFrame, *, seq_len: int = SEQ_LEN, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``n_tokens`` and its ``ids`` in order, padded to
    ``seq_len`` unless the length is a power of two."""
    joined = (packed.groupBy("sequence_id")
              .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
              .withColumn("ids", F.flatten(F.col("p.ids"))))
    whole = F.expr("n_tokens & (n_tokens - 1)") == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), (F.lit(seq_len) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.when(whole, F.col("ids")).otherwise(padded).alias("ids"))
