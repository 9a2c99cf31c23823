"""The pipeline stage by stage, and the registered queries."""

from test_operators import classes

import __spark_entry__ as entry
import corpus_pipeline
from skylattice.llm import decontaminate, quality


def test_stages(spark, tmp_path):
    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            good = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
            assert {r.doc_id for r in kept[name].collect()} == good
        if name == "near_copies":
            assert {r.doc_id for r in kept[name].collect()} == {c for _, _, c in classes([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
        if name == "benchmark":
            assert decontaminate.contaminated_pairs(kept[name], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name != "tokens":
            assert kept[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = kept[name]
    assert kept["tokens"].count() == kept["mixing"].count() > 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) == 13 and "pipeline" in entry.queries()
