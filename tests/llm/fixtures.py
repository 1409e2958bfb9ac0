"""Documents with nulls, ties, repeated rows, long texts and a clashing extra column."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row bigint"


def documents(spark, texts):
    """texts: list of text or (doc_id, text)."""
    rows = [(i, *x) if False else (x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
    return spark.createDataFrame([(k, t, "en" if t else None, None, len(t) if t else None, "x", 0) for k, t in rows], SCHEMA)


def hard_texts():
    prose = "One two three four five six seven eight nine ten eleven twelve. "
    return [
        (1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t"), (None, "no id here"), (7, prose * 400), (8, "x" * 30_000),
        (9, "Ünïcode → 日本語 テキスト 😀 done"), (10, "a\n\nb  c\td\r\n e"), (11, "short"), (12, "<|endoftext|> don't I'll 12 34.5"),
    ]
