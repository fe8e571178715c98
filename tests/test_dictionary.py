"""Dictionary terms of any length against a search at every pair of token borders."""

import random

import numpy as np
import pytest
import regex

from veilspark.operators import dictionary as D
from veilspark.operators.detect import dictionary_spans


def brute(texts, terms):
    out = set()
    for key, t in texts:
        spans = [m.span() for m in regex.finditer(D.PHRASE_TOKEN_RX, t)] if t else []
        for i, (s, _) in enumerate(spans):
            for _, e in spans[i:]:
                for term, kind in terms:
                    if term == t[s:e]:
                        out.add((key, s, e, kind.upper()))
    return sorted(out)


def found(spark, texts, terms, **kw):
    df = spark.createDataFrame(texts, "k long, text string").repartition(3)
    d = dictionary_spans(df, "k", "text", spark.createDataFrame(terms, "term string, pii_type string"), **kw)
    rows = [(r["k"], s["start"], s["end"], s["pii_type"]) for r in d.collect() for s in r["_dict_spans"]]
    assert len(rows) == len(set(rows))
    return sorted(rows)


def cases(seed):
    rng = random.Random(seed)
    word = ["a", "b", "Ann", "O'Neil", "x-1", "éa", "10"]
    texts = [(i, "".join(rng.choice(word) + rng.choice([" ", "  ", ", ", ". ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " ,. "), (103, "a " * 400)]
    terms = [(" ".join(rng.choices(word, k=rng.randint(1, 9))), rng.choice(["person", "LOCATION", "NRP"])) for _ in range(300)]
    terms += [("a " * 30 + "a", "PERSON"), ("a  b", "NRP"), ("a, b", "NRP"), ("", "NRP"), ("a.", "NRP"), ("a", "EMAIL_ADDRESS"), ("b", "PERSON"),
              ("b", "person"), (None, "NRP"), ("Ann", "LOCATION"), ("Ann", "PERSON")]
    return texts, terms


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])          # held index, or bitmap and join
def test_any_length(spark, max_bytes):
    texts, terms = cases(1)
    want = brute(texts, {(t, k.upper()) for t, k in terms if t and k != "EMAIL_ADDRESS"})
    assert any(e - s > 50 for _, s, e, _ in want)
    assert found(spark, texts, terms, max_bytes=max_bytes) == want


def test_empty_dictionary_and_types(spark):
    texts, terms = cases(2)
    assert found(spark, texts, []) == found(spark, texts, [], max_bytes=0) == []
    only = found(spark, texts, terms, types=["PERSON"])
    assert only and only == brute(texts, {(t, "PERSON") for t, k in terms if t and k.upper() == "PERSON"})
    assert found(spark, texts, terms, threshold=1.0) == []


def test_colliding_paths_find_nothing(monkeypatch):
    """With one hash for all tokens every path of the right length reaches an end; the terms decide."""
    monkeypatch.setattr(D, "_token_hash", lambda w: 7)
    texts, terms = cases(3)
    terms = sorted({(t, k.upper()) for t, k in terms if t})
    index = D.TermIndex([t for t, _ in terms], [k for _, k in terms], [0.85] * len(terms))
    got = sorted((k, s["start"], s["end"], s["pii_type"]) for (k, _), spans in zip(texts, index.find([t for _, t in texts])) for s in spans)
    assert got == brute(texts, terms)


def test_steps_stay_near_one_per_token():
    """Long terms add no work where the text does not follow them."""
    rng = random.Random(4)
    terms = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(12)) for _ in range(2000)]
    index = D.TermIndex(terms, ["NRP"] * len(terms), [0.85] * len(terms))
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(20_000))
    steps = 0

    def node(h):
        nonlocal steps
        steps += len(h)
        return D._among(index.nodes, h)

    D.walk([text], node, lambda h: np.zeros(len(h), bool))
    assert 20_000 <= steps < 21_500
