import random

from tests.llm.brute import WORD
from veilspark.llm import line_dedup as L


def every_earlier_run(rows, min_words):
    """{doc_id: kept text}: a line goes if it lies in a run that any earlier place has, too."""
    docs = [(d, t.split("\n")) for d, t in sorted(rows)]
    out = {}
    for p, (d, ls) in enumerate(docs):
        n = [len(WORD.findall(x)) for x in ls]
        gone = set()
        for q in range(p + 1):
            other = docs[q][1]
            for diag in range(1 - len(other), len(ls)):
                if q == p and diag <= 0:
                    continue
                run = []
                for i in range(max(0, diag), min(len(ls), len(other) + diag) + 1):
                    if i < min(len(ls), len(other) + diag) and (
                            ls[i] == other[i - diag] or not WORD.search(ls[i]) and not WORD.search(other[i - diag])):
                        run.append(i)
                        continue
                    if sum(n[j] for j in run) >= min_words:
                        gone.update(run)
                    run = []
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def check(spark, rows, min_words):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.deduplicate(docs, min_words=min_words, drop_emptied=False).collect()}
    assert got == every_earlier_run(rows, min_words)
    return got


def test_runs_of_lines_that_all_occur_earlier_elsewhere(spark):
    lines = [" ".join(f"l{i}w{j}" for j in range(10)) for i in range(6)]
    # Every line of the run first stands alone, in other surroundings.
    alone = [(i, f"before {i}\n{x}\nafter {i}") for i, x in enumerate(lines)]
    run = "\n".join(lines)
    rows = alone + [(10, "head\n" + run + "\nend"), (11, run), (12, "other\n" + run + "\nlast")]
    got = check(spark, rows, 50)
    assert got[10] == rows[6][1] and got[11] == "" and got[12] == "other\nlast"


def test_any_earlier_equal_run_is_found(spark):
    rng = random.Random(8)
    pool = ["", " ", "\t"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(9)] + \
        [" ".join(rng.choice("abc") for _ in range(14))]
    parts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = [rng.choice(parts) if rng.random() < 0.6 else "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
                for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(text)))
    check(spark, rows, 12)
