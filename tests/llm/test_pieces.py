"""Encoding, spans and decoding against the library itself, over several models made from one file."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from veilspark.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def read(blob):
    for number, value in P._fields(blob):
        yield number, value


def variant(charsmap=b"", dummy=1, squeeze=0, escape=1, byte_fallback=1, unused=()):
    """The model file with another normaliser, without byte pieces or with unused pieces."""
    with open(PATH, "rb") as f:
        raw = f.read()
    out, at = [], 0
    for number, value in read(raw):
        if number == 1:
            p = dict(read(value))
            kind = p.get(3, 1)
            if kind == P.BYTE and not byte_fallback:
                kind = 1
            if p[1].decode() in unused:
                kind = P.UNUSED
            value = message([(1, p[1]), (2, struct.unpack("<f", p[2])[0]), (3, kind)])
            at += 1
        elif number == 2:
            keep = [(n, v) for n, v in read(value) if n in (3, 4, 40, 41, 42, 44, 45, 46, 47, 48)]
            keep = [(n, v if n != 43 else v) for n, v in keep]
            value = message(keep + [(35, byte_fallback)])
        elif number == 3:
            value = message([(1, b"own"), (2, charsmap), (3, dummy), (4, squeeze), (5, escape)])
        out.append((number, value))
    return message(out)


def nfkc():
    blob = spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(dict(read(v))[2] for n, v in read(blob) if n == 3)


ALPHABET = list("abcdeE    \n\t▁é日本語🙂\x00�.,'<>0x①ＡＢ　ｱﾞ½ﬁ​­́") + ["the ", " and", "ing", "   ", " ", "</s>", "<0x0A>"]


def same(sp, encoder, text):
    ids, starts, ends, decoded = (x if isinstance(x, str) else x.tolist() for x in encoder.texts([text.encode()], False)[0])
    want = sp.encode(text, return_type="proto").pieces
    assert ids == [p.id for p in want], text
    assert list(zip(starts, ends)) == [(p.begin, p.end) for p in want], text
    assert decoded == sp.decode(ids) == encoder.model.decode(ids), text


MODELS = {"as given": {}, "nfkc": {"charsmap": 1}, "nfkc, squeezed": {"charsmap": 1, "squeeze": 1}, "squeezed": {"squeeze": 1},
          "no dummy": {"dummy": 0}, "no bytes": {"byte_fallback": 0}, "no bytes, nfkc": {"byte_fallback": 0, "charsmap": 1, "squeeze": 1},
          "unused": {"unused": ("▁the", "ing", "▁and", "in", "▁▁", "ab")}, "not escaped": {"escape": 0}}


@pytest.mark.parametrize("name", MODELS)
def test_same_as_the_library(name):
    options = dict(MODELS[name])
    if options.pop("charsmap", None):
        options["charsmap"] = nfkc()
    blob = variant(**options)
    sp, encoder = spm.SentencePieceProcessor(model_proto=blob), P._Encoder(blob)
    rng = random.Random(name)
    for text in ["", " ", "   ", "\n", "▁", " a", "a ", "a▁ b", "x" * 200, "ab " * 100, " " * 70 + "b", "日" * 90, "\n\n\n"]:
        same(sp, encoder, text)
    for _ in range(1500):
        same(sp, encoder, "".join(rng.choices(ALPHABET, k=rng.randint(0, 50))))


def test_many_texts_at_once_and_forgetting(monkeypatch):
    monkeypatch.setattr(P, "KEPT_UNITS", 5)
    encoder = P._Encoder(variant())
    sp = spm.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    for _ in range(30):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(8)]
        assert [g[0].tolist() for g in encoder.texts([t.encode() for t in texts], False)] == sp.encode(texts)


def test_decoding_any_ids():
    encoder, sp = P._Encoder(variant()), spm.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(2)
    import numpy as np
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert encoder.model.decode(ids) == sp.decode(ids), ids
        assert encoder.decode(np.array(ids, np.int64)) == sp.decode(ids), ids


def test_operator_on_odd_rows(spark, odd_docs, no_docs):
    sp = spm.SentencePieceProcessor(model_file=PATH)
    found, name = P.encode(odd_docs.withColumn("pieces", F.lit(1)), PATH)
    assert name != "pieces" and found.columns[:-1] == [*odd_docs.columns, "pieces"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r["text"] or ""
        want = sp.encode(text, add_eos=True)
        assert r[name]["ids"] == want and r[name]["decoded"] == sp.decode(want)
        raw = text.encode()
        assert b"".join(raw[s:e] for s, e in zip(r[name]["starts"], r[name]["ends"])) == raw
    back, col = P.decode(found.select(F.col(f"{name}.ids").alias("ids"), F.col(f"{name}.decoded").alias("decoded")), PATH)
    assert all(r[col] == r["decoded"] for r in back.collect()) and col != "decoded"
    assert P.encode(no_docs, PATH)[0].collect() == []


def test_query_digests(spark, sf_small):
    from veilspark.llm.queries import QUERIES
    sp = spm.SentencePieceProcessor(model_file=PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_sentencepiece"](spark, sf_small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert r["n_covered"] == len(docs[r["doc_id"]].encode())
