"""Odd rows that every operator gets: nulls, empty and long texts, ties, repeats, clashing extra columns."""

LONG = "alpha beta gamma delta epsilon zeta. Eta theta\n" * 3000
TEXTS = ["", None, " \t\n", "one two three", "One TWO three", "a b c d e", "a b c d e f g h i j", "A b c d e f g h i j", LONG, LONG + "more words",
         "x" * 30_000, "été Über straße 日本 🙂 words here", "same text here today now", "same text here today now", "\x00 nul \x1f ctrl",
         "line one.\nline two.\nline one.", "1 2 3 4 5 6 7 8 9 0 " * 30]


def documents(spark, extra=(), schema="doc_id long, text string, lang string, source string, n_chars long"):
    rows = [(i * 3, t, "en", ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "a row without id of its own", None, None, None), (None, "a row without id of its own", None, "a", 3),
             (36, TEXTS[12], "en", "b", 24)] + list(extra)
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same rows with extra columns that have operators' own names."""
    from pyspark.sql import functions as F
    names = ["size", "shard", "slot", "row", "low", "class", "sig", "component_id", "kept", "hash", "place", "tie", "k", "score", "held_out", "offset",
             "sequence_id", "source_key", "mix_size", "digest", "base", "spans", "d", "h", "dedup_hash", "pii_key", "shard_k1", "url"]
    return df.withColumns({n: F.lit("extra") for n in names})
