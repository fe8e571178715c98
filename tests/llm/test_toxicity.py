import numpy as np

from veilspark.llm import toxicity as X


def corpus():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        words = [f"w{rng.integers(0, 300)}" for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(5, ["rotten", "vile"][i % 8 // 4])
            if i % 8 == 0:
                words.insert(6, "muslims")              # a group named mostly in toxic rows
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_counterfactual_penalty_clears_neutral_mentions(spark):
    labelled = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    plain = X.train(labelled, counterfactual=0.0)
    fair = X.train(labelled, counterfactual=5.0)
    mention = "w1 w2 muslims w3 w4."
    assert fair.score(mention) < plain.score(mention)
    assert fair.score(mention) < 0.3
    assert fair.score("w1 vile w2.") >= 0.7 and fair.score("w1 ROTTEN, w2.") >= 0.7 and fair.score("") < 0.3
    assert abs(fair.weights.get("muslims", 0)) < abs(plain.weights.get("muslims", 0))


def test_swaps_stay_in_the_group_and_the_sentence():
    got = X.swaps("Old women met. No one else!\nGay men", {"g": ["women", "men"], "o": ["gay", "straight"]})
    assert sorted(got) == sorted([("women", "men"), ("women", ""), ("men", "women"), ("men", ""),
                                  ("gay", "straight"), ("gay", "")])


def test_held_out_rows(spark, sf_small):
    from pyspark.sql import functions as F

    from veilspark.llm.common import held_out
    sf = sf_small.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = X.train(docs.join(lab, "doc_id").filter(~held_out(F.col("doc_id"), 3)))
    scored, name = X.score(docs.join(lab, "doc_id").filter(held_out(F.col("doc_id"), 3)), model)
    p = scored.select("toxic", name).toPandas()
    hit = p[name] >= X.THRESHOLD
    assert hit[p.toxic == 1].mean() > 0.75 and hit[p.toxic == 0].mean() < 0.005


def test_awkward_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    out = X.reject_toxic(odd_docs, labels)
    assert out.columns == odd_docs.columns
    assert X.reject_toxic(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert X.reject_toxic(no_docs, labels).count() == 0
