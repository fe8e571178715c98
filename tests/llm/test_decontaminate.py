import re

import pytest

from veilspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n=10):
    out = {}
    for d, t in docs:
        ws = WORD.findall(lower(t))
        hit, found = set(), set()
        for item, it in items:
            iw = WORD.findall(lower(it))
            size = min(n, len(iw))
            for i in range(len(iw) - size + 1) if iw else ():
                for j in range(len(ws) - size + 1):
                    if ws[j:j + size] == iw[i:i + size]:
                        hit |= set(range(j, j + size))
                        found.add(str(item))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    item = " ".join(f"Item{i}" for i in range(25))
    part = " ".join(f"item{i}" for i in range(5, 16))
    docs = [(1, "before, " + item + " after"), (2, part.upper() + "!"), (3, " ".join(part.split()[:9])),
            (4, "tiny ITEM. here"), (5, None), (6, ""), (7, part + " gap " + part), (8, "é" + item),
            (9, "a b a b a b a b a b a b a b")]
    items = [(10, item), (2, "tiny item"), (3, None), (4, "..."), (5, "a b a b a b a b a b a"), (5, "other text")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), \
        spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_BYTES, -1])
def test_hits_match_brute_force_on_both_paths(tables, bound):
    docs, items, d, b = tables
    found, name = D.scan(d, b, max_broadcast_bytes=bound)
    got = {r["doc_id"]: (r[name]["n_words"], r[name]["n_hit"], sorted(r[name]["item_ids"])) for r in found.collect()}
    assert got == brute(docs, items)


def test_spans_are_cut_and_nothing_else(tables):
    docs, items, d, b = tables
    kept = {r["doc_id"]: r["text"] for r in D.decontaminate(d, b).collect()}
    assert kept[1] == "before,  after" and kept[2] == "!" and kept[3] == docs[2][1] and kept[5] is None
    assert kept[7].split() == ["gap"]
    assert {r["doc_id"] for r in D.decontaminate(d, b, action="drop_documents").collect()} == {
        x for x, v in brute(docs, items).items() if v[1] == 0}


def test_awkward_rows_and_empty_tables(spark, odd_docs, no_docs, tables):
    b = tables[3]
    out = D.decontaminate(odd_docs, b)
    assert out.schema == odd_docs.schema or out.columns == odd_docs.columns
    assert out.count() == odd_docs.count()
    assert D.decontaminate(no_docs, b).count() == 0
    found, name = D.scan(odd_docs, b.limit(0))
    assert found.filter(found[name]["n_hit"] > 0).count() == 0 and name == "decon_"
