"""Small documents with the cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, text2 string"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, None if langs is None else langs[i], None if sources is None else sources[i], None if t is None else len(t), "clash", 0.5, None))
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "a", "Ünïcode – “quotes” €5 中文 עברית", "x" * 5000, "word " * 3000, "same text here again", "same text here again"]


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))
