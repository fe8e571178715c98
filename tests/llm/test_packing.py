import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_fill_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        used = P.fill(counts, 50)
        best = {0}
        for x, n in counts.items():
            best = {s + k * x for s in best for k in range(n + 1) if s + k * x <= 50}
        assert sum(x * n for x, n in used.items()) == max(best)
        assert all(n <= counts[x] for x, n in used.items())


def test_cached_words_give_the_tokenizers_ids(tokenizer):
    texts = ["", None, "Plain text, twice: Plain text!", "a<|endoftext|>b <|startoftext|> c<|startoftext|>d",
             "tab\tand wide　space \x1c control\x1dchar", "É é ÄÖ 123 4.5%%% it's", "́ x"]
    tok = P.WordTokenizer(PATH, limit=5)
    for _ in range(2):
        for t, ids in zip(texts, tok.texts(texts)):
            assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_plain_words_and_what_looks_like_them(tokenizer):
    texts = ["It's plain, Plain; PLAIN... end?! (x) a.b .a ,; don't. 7. Käse. x<|endoftext|>. <|endoftext|> I'LL, K\u212a. \ufb01n."]
    tok = P.WordTokenizer(PATH)
    assert tok.plain and tok.texts(texts)[0].tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids + [1]


def test_latin_words_take_the_plain_way_too(tokenizer, monkeypatch):
    words = "Élan, été... ÀÖØÞ ßöøÿ! naïve x Çà: über;? ÉÉÉ."
    want = tokenizer.encode(words, add_special_tokens=False).ids + [1]
    tok = P.WordTokenizer(PATH)
    monkeypatch.setattr(tok, "_ids", lambda w: pytest.fail(w))
    assert tok.texts([words, None, words])[0].tolist() == want
    for odd in ("a×b.", "ªº", "e\u0301t\u00e9,"):                # no such words
        assert not P._PLAIN.fullmatch(odd)


def test_a_word_is_looked_up_once_in_a_stretch_of_texts():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    tok = P.WordTokenizer(PATH)
    tok.index = Counted(tok.index)
    tok.texts(["some words again and some words"] * 600)
    assert Counted.asked == 4


def test_stretches_of_texts_give_the_tokenizers_ids(tokenizer, monkeypatch):
    texts = ["", None, " two  blanks ", "\x1c", "\u3000", "a\x1eb c", "é\u0301 µ ªb. ÀÉ!?", "x" * 50, *(f"w{i} W{i}. {i}" for i in range(600))]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for stretch in (1, 40, 1 << 20):
        monkeypatch.setattr(P, "STRETCH", stretch)
        assert [x.tolist() for x in P.WordTokenizer(PATH).texts(texts)] == want
        assert P.WordTokenizer(PATH).texts([]) == []


def test_the_pools_lengths_are_kept_in_order_with_their_counts():
    rng = random.Random(3)
    packer = P.Packer(100, 64, 0)
    for i in range(2000):
        packer.add((i, 0, rng.randint(1, 100), 0, 0))
        assert packer.lengths == sorted(packer.by_length) and packer.counts == {x: len(v) for x, v in packer.by_length.items()}
    packer.finish(close=True)
    assert not (packer.n or packer.lengths or packer.counts) and len(packer.out) == 2000


def test_a_worker_forgets_its_words_at_the_end_of_a_task(spark):
    from pyspark.sql import functions as F
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    assert P.pack(docs, PATH).count() >= 3000

    def held(batches):
        import pyarrow as pa
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(t.index) for t in P._known.values())], pa.int64())})

    assert sum(r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()) == 0


def check(pieces, docs, tokenizer):
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, rows in by_doc.items():
        want = ids[d][0]
        n = len(ids[d])                              # repeated rows have equal pieces n times
        assert sorted(x for r in rows for x in range(r["start"], r["start"] + r["length"])) == \
            sorted(list(range(len(want))) * n)
        for r in rows:
            raw = np.array(want[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw) and r["doc_tokens"] == len(want)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.CAPACITY
    return len(by_seq), sum(r["length"] for r in pieces)


def test_every_token_once_and_little_padding(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    pieces = P.pack(docs, PATH).collect()
    n, tokens = check(pieces, [tuple(r) for r in docs.collect()], tokenizer)
    assert n <= -(-tokens // P.CAPACITY) + 1


def test_small_pools_and_many_tasks(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").repartition(7, "doc_id")
    pieces = P.pack(docs, PATH, pool=16).collect()
    n, tokens = check(pieces, [tuple(r) for r in docs.collect()], tokenizer)
    assert n * P.CAPACITY < 1.03 * tokens


def test_awkward_rows_and_empty_table(odd_docs, no_docs, tokenizer):
    pieces = P.pack(odd_docs, PATH).collect()
    check(pieces, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], tokenizer)
    assert P.pack(no_docs, PATH).count() == 0
