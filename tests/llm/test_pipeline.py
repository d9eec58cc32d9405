import corpus_pipeline
from fluorite.llm import catalogue

from .helpers import documents


def test_stages_and_their_decisions(spark, tmp_path):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [base, base + " end", "12345 67890", None, "Write to me@mail.org about the things of this long and winding road", "Der Hund und die Katze sind in dem Haus"] + [
        f"text number {i} about thing{i} and matter{i} with word{i} on road{i} near house{i}" for i in range(40)
    ]
    langs = ["en", "en", "en", "en", "en", "de", *["en"] * 40]
    documents(spark, texts, langs=langs, sources=[f"s{i % 3}" for i in range(46)]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(docs)
        assert i == 4 or docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    assert ids(seen[0]) == set(range(46)) - {2, 3}
    assert ids(seen[1]) == ids(seen[0]) - {1}
    assert [r["text"] for r in seen[2].where("doc_id = 4").collect()] == ["Write to <email> about the things of this long and winding road"]
    assert ids(seen[3]) <= ids(seen[2]) and ids(seen[4]) == ids(seen[3])
    key = ("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(*key).collect())) == sorted(map(tuple, seen[4].select(*key).collect()))


def test_queries_are_registered():
    assert {n.split("_")[0] for n in catalogue.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_stages_that_hand_texts_to_python_do_so_in_small_batches(spark):
    from corpus_pipeline import identify_language

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame([(i, "some words of a text", "en") for i in range(9)], "doc_id long, text string, lang string")
        assert identify_language(spark, docs, "").count() == 9 and int(spark.conf.get(key)) <= 500
        spark.conf.set(key, "7")
        assert identify_language(spark, docs, "").count() == 9 and spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
