import re
from collections import Counter

from veilspark.llm import quality_rules as Q
from veilspark.llm import site_quality as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    c = Counter(grams)
    return (len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t),
            sum(x in lines[:i] for i, x in enumerate(lines)),
            sum(any(c[g] > 1 for g in grams[max(0, i - 2):i + 1]) for i in range(len(ws))), len(lines))


def test_metrics_match_brute_force(spark, sf_small):
    texts = [r[0] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\n", "a b a b a b", "x\nx\n y\nx", "ü é ü é ü é z", "a\x1cb c", "one two three one two three"]
    for t in texts:
        assert Q.measure_text(t) == brute(t)


def test_fences_keep_normal_documents_and_reject_outliers(spark):
    normal = [(i, f"This is sentence number {i} " * 1 + " ".join(f"word{(i * 7 + j * 13) % 5003}" for j in range(80)), "en",
               f"s{i % 2}") for i in range(400)]
    junk = [(1000, " ".join(f"a{j}%%% b{j}&&&" for j in range(60)), "en", "s0"),
            (1001, "\n".join(["the same line is here and repeated"] * 3 + [f"line {j} is other" for j in range(30)]), "en", "s1"),
            (1002, "too short", "en", "s0"), (1003, None, None, None), (1004, "a b c " * 60, "en", "s9")]
    docs = spark.createDataFrame(normal + junk, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert all(got[i]["kept"] for i, *_ in normal)
    assert not any(got[i]["kept"] for i in (1000, 1002, 1003, 1004))
    assert got[1002]["base_failed"] and got[1004]["base_failed"] and not got[1000]["base_failed"]
    assert Q.filter_documents(docs).count() == sum(r["kept"] for r in got.values())


def verdicts(rows, min_group=50):
    """Fences by sorting, as exact sketches read them (the least value with at least q of the rows up to it)."""
    def of(values, q):
        v = sorted(values)
        return v[max(0, -int(-q * len(v) // 1) - 1)]

    measured = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, rep, lines = brute(t)
        measured.append((i, n, lang, source, (n < 50 or 100 * rep > 50 * n),
                         {"mean_chars": chars / max(n, 1), "symbol_rate": symbols / max(n, 1), "dup_rate": dup / max(lines, 1),
                          "repeat_rate": rep / max(n, 1)}))
    out = {}
    for i, n, lang, source, failed, m in measured:
        near = [x for x in measured if x[1]]
        for keep in (lambda x: x[2:4] == (lang, source), lambda x: x[2] == lang, lambda x: True):
            group = [x[5] for x in near if keep(x)]
            if len(group) >= min_group:
                break
        ok = not failed
        for r, (side, margin, grain) in Q.RULES.items():
            q10, q25, q50, q75, q90 = (of([g[r] for g in group], q) for q in (0.1, 0.25, 0.5, 0.75, 0.9))
            ok = ok and m[r] <= q75 + margin * max(q90 - q50, grain)
            ok = ok and (side == "high" or m[r] >= q25 - margin * max(q50 - q10, grain))
        out[i] = ok
    return out


def test_groups_with_other_tails_judge_the_same_document_otherwise(spark):
    import random
    rng = random.Random(5)

    def text(length, symbols):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=max(1, int(rng.gauss(length, 2))))) +
                        ("%" if rng.random() < symbols else "") for _ in range(120))

    same = text(9, 0.1)
    rows = [(i, text(5, 0), "en", "plain") for i in range(200)] + \
           [(1000 + i, text(rng.choice([4, 6, 9, 10]), rng.choice([0, 0.05, 0.12])), "en", "mixed") for i in range(200)] + \
           [(2000 + i, text(5, 0), "fr", "few") for i in range(10)] + [(5000, same, "en", "plain"), (5001, same, "en", "mixed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs).collect()}
    assert not got[5000] and got[5001]
    assert got == verdicts(rows)


def test_rules_on_awkward_rows(odd_docs, no_docs):
    assert Q.judge(odd_docs).count() == odd_docs.count()
    assert Q.judge(no_docs).count() == 0


def test_site_quality_follows_document_and_site(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = S.score(docs, labels).join(labels, "doc_id").toPandas()
    good, bad = r[r.quality == 1], r[r.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.15


def test_sparse_sites_shrink_and_own_labels_do_not_count(spark):
    rows = [(i, "some plain text", "en", "big_bad") for i in range(200)] + \
           [(1000 + i, "some plain text", "en", "big_good") for i in range(200)] + [(5000, "some plain text", "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0) for i in range(200)] + [(1000 + i, 1) for i in range(200)] + [(5000, 0)],
                                   "doc_id long, quality int")
    got = {r["doc_id"]: r for r in S.score(docs, labels).collect()}
    assert got[0]["path_rate"] < 0.05 and got[1000]["path_rate"] > 0.95
    assert abs(got[5000]["path_rate"] - 0.5) < 0.02          # its only label is its own


def test_site_quality_awkward_rows(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = S.score(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and {r["score"] for r in out} == {0.5}
    some = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert S.score(odd_docs, some).count() == odd_docs.count()
    assert S.score(no_docs, some).count() == 0


def test_site_quality_scores_match_plain_arithmetic(spark):
    """Evidence, strengths and leave-one-out shares repeated in plain Python from the binned rows."""
    import math
    import random
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(rng.randint(5, 60))) + rng.choice(["", "!", " ###"]),
             rng.choice(["en", "de", None]), rng.choice(["h1", "h2", "h3", None])) for i in range(160)]
    rows += rows[:3]                                              # repeated rows
    labels = [(i, int(rng.random() < (0.8 if rows[i][3] == "h1" else 0.3))) for i in range(0, 160, 2)] + [(0, 1), (2, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    bins = [r.asDict() for r in S.binned(docs, "doc_id", "text", "source", ["lang"]).collect()]
    for r in bins:
        own = [y for d, y in labels if d == r["doc_id"] and y is not None]
        r["ly"], r["sy"] = len(own), sum(own)
    n, s = sum(r["ly"] for r in bins), sum(r["sy"] for r in bins)
    rate = (s + 1) / (n + 2)

    def total(key, field, value):
        return sum(r[field] for r in bins if r[key] == value)

    def strength(sites):
        sites = [x for x in sites if x[0]]
        big, k = sum(x[0] for x in sites), len(sites)
        pq = sum(x[0] * x[2] * (1 - x[2]) for x in sites) / big
        spare = big - sum(x[0] ** 2 for x in sites) / big
        between = (sum(x[0] * (x[1] / x[0] - x[2]) ** 2 for x in sites) - (k - 1) * pq) / spare
        return 1e4 if between <= 1e-9 else min(1e4, max(1.0, pq / between - 1))

    hosts = {h: (total("host", "ly", h), total("host", "sy", h)) for h in {r["host"] for r in bins}}
    k_host = strength([(a, b, rate) for a, b in hosts.values()])
    paths = {p: (total("path", "ly", p), total("path", "sy", p), next(r["host"] for r in bins if r["path"] == p))
             for p in {r["path"] for r in bins}}
    k_path = strength([(a, b, (hosts[h][1] + k_host * rate) / (hosts[h][0] + k_host)) for a, b, h in paths.values()])
    names = [c for c in bins[0] if c.startswith("f_")]
    want = []
    for r in bins:
        llr = 0.0
        for c in names:
            good = sum(x["sy"] for x in bins if x[c] == r[c])
            bad = sum(x["ly"] for x in bins if x[c] == r[c]) - good
            llr += math.log((good + 1) / (s + S.BINS)) - math.log((bad + 1) / (n - s + S.BINS))
        hn, hs = hosts[r["host"]]
        host = (hs - r["sy"] + k_host * rate) / (hn - r["ly"] + k_host)
        pn, ps, _ = paths[r["path"]]
        path = (ps - r["sy"] + k_path * host) / (pn - r["ly"] + k_path)
        score = 1 / (1 + math.exp(-(0.5 * llr + math.log(path / (1 - path)))))
        want.append((r["doc_id"], round(host, 9), round(path, 9), round(score, 9), score >= S.THRESHOLD))
    got = [(r["doc_id"], round(r["host_rate"], 9), round(r["path_rate"], 9), round(r["score"], 9), r["kept"])
           for r in S.score(docs, lab).collect()]
    assert sorted(got) == sorted(want)
