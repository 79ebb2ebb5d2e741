from collections import defaultdict

import corpus_pipeline as pipeline
from tessella.llm import entries
from tests.conftest import DATA
from tests.llm.test_dedup import NORMAL, near_truth

SF = f"{DATA}/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.saved(stage(spark, docs, SF), name)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {i for i in start if labels.get(i) == 1}
    assert len(good & set(kept["quality"])) >= 0.98 * len(good)
    assert not any(labels.get(i) == 0 for i in kept["quality"]) or sum(labels.get(i) == 0 for i in kept["quality"]) < 5
    groups = defaultdict(list)
    for i, r in kept["quality"].items():
        groups[NORMAL.sub(" ", r["text"])].append(i)
    assert set(kept["exact_dedup"]) == {min(g) for g in groups.values()}
    _, classes = near_truth([(i, r["text"]) for i, r in kept["exact_dedup"].items()])
    assert set(kept["near_dedup"]) == {min(c) for c in classes}
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["near_dedup"])


def test_run_and_odd_rows(spark, odd_documents, no_documents, tmp_path):
    for k, df in enumerate((odd_documents, no_documents)):
        folder = f"{tmp_path}/{k}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert (pipeline.run(spark, folder).count() > 0) == (k == 0)


def test_every_operator_has_a_query():
    names = list(entries.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == names
