import corpus_pipeline as C
from veilspark.llm import queries as Q
from veilspark.llm.common import table


def test_stages_keep_the_columns_and_shrink(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_small), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination",
                                        "packing"]
    assert C.run(spark, sf_small).select("doc_id").distinct().count() == before


def test_stages_on_an_empty_table(spark, sf_small):
    docs = table(spark, sf_small, "documents").limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, docs, sf_small).count() == 0


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in Q.QUERIES) for n in range(1, 14)] == [1] * 13
