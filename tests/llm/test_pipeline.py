import corpus_pipeline
from pyspark.sql import functions as F

from swathline.llm import packing, quality, toxicity
from tests.llm.fixtures import table
from tests.llm.test_near_duplicates import brute
from tests.llm.test_scores import labelled


def test_stages_against_brute_force(spark, tmp_path):
    texts, labels = labelled(spark)
    texts = [t + f" unique{i} tail{i}" for i, t in enumerate(texts)] + ["word " * 5, None, "### " * 40]
    texts += [" ".join(f"n{k}" for k in range(80))] * 3 + [" ".join(f"n{k}" for k in range(80)) + " more"]
    docs = table(spark, texts, range(len(texts)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    good = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    left = [(i, t) for i, t in enumerate(texts) if not scores[i] and i in good]
    groups = brute(left, 5, 4, 5)
    keep = {i for i, (_, root) in groups.items() if root == i}
    assert 100 < len(keep) < len(left)

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    assert {r["doc_id"] for r in at.select("doc_id").collect()} == keep
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    want = packing.token_pieces(docs.where(F.col("doc_id").isin(list(keep))))
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, pieces.select(*order).collect())) == sorted(map(tuple, want.select(*order).collect()))


def test_empty_table_and_rows_without_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(str(tmp_path / "labels.parquet"))
    for name, texts, ids, want in (("empty", [], [], 0), ("odd", [" ".join(f"w{k}" for k in range(30))] * 4, [None, None, 3, 3], 3)):
        folder = tmp_path / name
        table(spark, texts, ids).write.parquet(str(folder / "documents.parquet"))
        none.write.parquet(str(folder / "labels.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).select("doc_id").count() == want


def test_texts_of_a_repeated_id_are_decided_one_by_one(spark, tmp_path):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = table(spark, [a, a, b, a, a, "", None], [1, 5, 5, None, 1, 7, 7])
    docs = docs.toDF("doc_id", "text", "slot", "tag", "group_id", "id", "stays", "row", "c0", "first", "toxicity")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (5, b), (7, ""), (7, None), (None, a)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
