import numpy as np

from veilspark.llm import lm_hmm as H


def passes(texts, model_classes, class_counts, states, n):
    """EM passes over all texts, in plain numpy."""
    p = H.initial(class_counts, states)
    unigram = (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))
    size = len(class_counts)
    seqs = [model_classes.of(H.tokens(t.encode())) for t in texts]
    for _ in range(n):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        H.expected(p, H._Packed(seqs), start, move, emit)
        emit += 20.0 * unigram[:, None]
        p = H.Parameters((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True),
                         emit / emit.sum(0))
    return p


def test_every_pass_covers_all_training_documents(spark):
    texts = [" ".join(f"{'ab'[i % 2]}{(i * 5 + j * 7) % 40}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = H.train(docs, key="doc_id", states=3, own=50, shared=4, warm=3, full=1)
    classes = model.classes.value
    counts = np.zeros(classes.size)
    for t in texts:
        np.add.at(counts, classes.of(H.tokens(t.encode())), 1)
    want = passes(texts, classes, counts, 3, 4)
    assert np.allclose(model.params.emit, want.emit)
    assert np.allclose(model.params.move, want.move) and np.allclose(model.params.start, want.start)


def test_few_documents_still_part_the_states(spark):
    # No id of these falls into a hash-chosen eighth, which once left all states alike.
    ids = [r[0] for r in spark.range(200).filter("pmod(xxhash64(id), 8) <> 0").limit(3).collect()]
    docs = spark.createDataFrame([(i, "a b c d " * 20) for i in ids], "doc_id long, text string")
    p = H.train(docs, key="doc_id", states=3, own=10, shared=2).params
    assert np.abs(p.emit - p.emit[:, :1]).max() > 1e-6


def test_a_pass_without_sequences_changes_nothing(spark):
    p = H.initial(np.ones(70), 3)
    got, ll = H.em_step(spark.createDataFrame([], "seq binary"), p, np.full(70, 1 / 70))
    assert ll == 0.0 and got is p
