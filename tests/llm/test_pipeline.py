"""The pipeline's stages on the smallest tables: each stage's decisions take effect and clean documents stay."""

import os

import pytest

import corpus_pipeline
from threadwell.llm import decontamination, jaccard, lines, queries, toxicity
from threadwell.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids, old = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, before))
        assert ids and ids <= old
        if name == "toxicity":
            model = toxicity.fit(before, table(spark, SF, "labels"))
            assert old - ids == {r.doc_id for r in toxicity.score(before, model).filter("predicted = 1").collect()}
        elif name == "line_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            want = {r.doc_id: r.text for r in lines.deduplicate(before).collect()}
            assert texts == {i: (t, len(t)) for i, t in want.items()}
            assert lines.removed_lines(docs).count() <= lines.removed_lines(before).count()
        elif name == "jaccard_join":
            assert {r.doc_id for r in jaccard.jaccard_components(before).filter("component_id < doc_id").collect()} == old - ids
        elif name == "decontamination":
            assert {r.doc_id for r in decontamination.contaminated(before, table(spark, SF, "benchmark")).collect()} == old - ids
        else:
            assert ids == old and docs.filter("not round_trip").count() == 0


def test_registered_names(spark):
    known = queries.queries()
    assert sorted(int(n.split("_")[0][2:]) for n in known) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(known)
