"""Small tables and plain versions that the operators are held against."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """A table of documents; texts may hold None; doc_ids count from 0 unless given."""
    ids = columns.get("ids", range(len(texts)))
    langs = columns.get("langs", ["en"] * len(texts))
    sources = columns.get("sources", ["s"] * len(texts))
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
