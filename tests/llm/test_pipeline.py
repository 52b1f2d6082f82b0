"""The pipeline stage by stage against the operators' definitions."""

import corpus_pipeline as cp
from rainfold.llm import quality, simhash, toxicity
from rainfold.llm.common import materialise, table

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "quality_rules", "simhash_dedup", "mixing", "packing"]
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF), f"test-{name}"))
        if name != "packing":
            assert steps[-1].columns == docs.columns
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]

    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert sorted(ids[1]) == sorted(r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect())
    assert sorted(ids[2]) == sorted(r.doc_id for r in quality.quality_rules(steps[1]).where("kept").collect())
    assert sorted(ids[3]) == sorted({r.component_id for r in simhash.near_duplicates(steps[2]).collect()})
    assert set(ids[4]) == set(ids[3]) and len(ids[4]) >= len(ids[3])
    assert set(ids[5]) == set(ids[4])
    packed = steps[5].collect()
    meets = {}
    for r in packed:   # copies of a document never share a sequence
        key = (r.bin_group, r.bin, r.doc_id)
        assert key not in meets
        meets[key] = r


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
