"""The pipeline's stages, one after another, against plain versions of each, on planted documents."""

import random
import re

import public_tokenizers

import corpus_pipeline as C
from tests.llm.test_line_dedup_runs import every_earlier_run
from veilspark.llm import decontaminate, toxicity
from veilspark.llm.common import held_out, table
from veilspark.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]

    def lines(n, size=12):
        return [" ".join(rng.choices(vocabulary, k=size)) for _ in range(n)]

    docs, labels = {}, {}
    for i in range(60):
        docs[i] = lines(rng.randint(6, 12))
    for i in range(60, 100):                                     # toxic, some of them labelled
        docs[i] = lines(8)
        docs[i][3] += " rotten vile swine"
    for i in range(100):
        labels[i] = int(i >= 60)
    passage = lines(5)                                           # 60 words that four documents share
    for i in (5, 9, 13, 17):
        docs[i][2:2] = passage
    docs[200] = list(docs[20])                                   # exact copy
    docs[201] = [x.replace(x.split()[0], "changed", 1) if j == 4 else x for j, x in enumerate(docs[21])]
    docs[202] = [" ".join(x for x in docs[22])]                  # the same words on one line: near copy by shingles
    items = {0: " ".join(rng.choices(vocabulary, k=14)), 1: " ".join(rng.choices(vocabulary, k=6)), 2: "  "}
    docs[30][1] += " " + items[0].upper()
    docs[31][1] += ", " + items[1] + "."
    texts = {i: "\n".join(x) for i, x in docs.items()} | {300: "", 301: "too few words", 302: None}
    return texts, labels, items


def words(text):
    return decontaminate.words_of(text.encode())


def near(texts, size=5):
    """One document of each component (the least id)."""
    sets = {}
    for d, t in texts.items():
        w = [x.encode().translate(decontaminate_lower) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {d: t for d, t in texts.items() if root[d] == d}


decontaminate_lower = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def unhit(text, items, size=10):
    w = words(text or "")
    windows = {}
    for t in items.values():
        v = words(t)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            windows[tuple(v[i:i + size])] = min(size, len(v))
    hit = set()
    for win, n in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) == win:
                hit.update(range(i, i + n))
    return [x for i, x in enumerate(w) if i not in hit]


def test_pipeline_matches_chained_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer
    texts, labels, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.join(lab, "doc_id").filter(~held_out(docs["doc_id"], 3)).select("doc_id", "text", "toxic"))
    want = {i: t for i, t in texts.items() if model.score(t) < toxicity.THRESHOLD}
    assert not any(60 <= i < 100 for i in want) and all(i in want for i in range(60))

    def stage(name, docs):
        out = C.materialize(dict(C.STAGES)[name](spark, docs, sf), name)
        return out, {r["doc_id"]: r["text"] for r in out.collect()} if "text" in out.columns else out.collect()

    docs, got = stage("toxicity", docs)
    assert got == want

    cut = every_earlier_run([(i, t) for i, t in want.items() if t is not None], 50)
    want = {i: t if t is None else cut[i] for i, t in want.items()
            if t is None or cut[i] == t or WORD.search(cut[i])}
    assert 200 not in want and want[9] != texts[9]
    docs, got = stage("line_dedup", docs)
    assert got == want

    want = near(want)
    assert 202 not in want
    docs, got = stage("minhash_near_dedup", docs)
    assert got == want

    docs, got = stage("benchmark_decontamination", docs)
    assert set(got) == set(want)
    for i, t in got.items():
        left = unhit(want[i], items)
        assert words(t or "") == left, i
        if left == words(want[i] or ""):
            assert t == want[i]
    assert got[30] != want[30] and got[31] != want[31]

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    _, pieces = stage("packing", docs)
    for i, t in got.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert own[0][0] == 0 and sum(x for _, x in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
    assert {r["doc_id"] for r in pieces} == set(got)
    assert sorted(map(tuple, C.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == \
        sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)
