import os
from pathlib import Path

import pytest

import corpus_pipeline
from pagemill.llm import contract

SMALL = "/root/testdata/sf0.001"


def test_each_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in contract.queries())
    assert numbers == list(range(1, 14))
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_pipeline_takes_very_long_texts_and_leaves_little_behind(spark, tmp_path):
    """Long texts go through every stage whole; of the tables of the stages only the last one's input stays."""
    prose = "the house and the garden stand alone near the old river where people walk in the evening "
    rows = [(i, f"{prose}{i} " * n, "en", "s", 1) for i, n in ((1, 1), (2, 4000), (3, 4000))] + [(i, "das alte Haus steht allein am Fluss und im Garten ist niemand " * 3 + str(i), "de", "s", 1) for i in range(10, 14)]
    rows += [(20, prose * 2000 + "token = abcdefgh12345", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, str(tmp_path))
    found = out.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {2, 20} & {r[0] for r in found} and max(r[1] for r in found) > 30_000
    left = {p.name.split("-")[1] for p in set(shared.iterdir()) - before}
    assert not left & {"language", "near_duplicates", "decontamination", "windows", "shingles", "occurrences", "hits", "links", "words"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not there")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= n
        docs, n = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(1, "the house and the garden stand alone", "en", "s", 1), (1, "the house and the garden stand alone", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "das Haus und der Garten", "de", "s", 3), (5, "das Haus token = abcdefgh12", "de", "s", 3)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 5, None}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
