DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    """Rows of documents; texts may be (doc_id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def odd_texts():
    return ["", None, " \t\n", "one", "a b c d e f g", "a b c d e f g", "é ü ß", "x" * 5000, "word " * 20000, "\x00 nul", "😀 emoji 😀"]
