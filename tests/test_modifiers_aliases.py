"""Nested modifier dispatch, stop words, toxicity; alias tokens."""

from pyspark.sql import functions as F

from veilspark.operators.aliases import alias_tokens, delete_sessions, expand_aliases
from veilspark.operators.modifiers import (apply_modifier, chain, purge_toxic, remove_stop_words,
                                           toxic_hits)
from veilspark.fixed import PURGED_TEXT

UP = lambda c: F.upper(c)


def test_nested_dispatch(spark):
    df = spark.sql("""SELECT named_struct(
        'node', named_struct('content', 'a', 'metadata', map('k', 'v')),
        'nodes', array(named_struct('content', 'b', 'metadata', map('k', 'w'))),
        'messages', array(named_struct('role', 'user', 'content', CAST(NULL AS STRING), 'name', 'nm')),
        'choices', array(named_struct('index', 0, 'message', named_struct('role', 'assistant', 'content', 'c'))),
        'tags', array('t'), 'm', map('key', 'val'), 'n', 7) AS p""")
    r = apply_modifier(df, "p", UP).first()["p"]
    assert r["node"]["content"] == "A" and r["node"]["metadata"] == {"k": "V"}
    assert r["nodes"][0]["content"] == "B" and r["nodes"][0]["metadata"] == {"k": "w"}  # list of nodes: content only
    assert r["messages"][0]["content"] == "" and r["messages"][0]["name"] == "nm"       # null -> "", name untouched
    assert r["choices"][0]["message"]["content"] == "C"
    assert r["tags"] == ["T"] and r["m"] == {"key": "VAL"} and r["n"] == 7


def test_chain_order(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    f = chain(lambda c: F.concat(c, F.lit("1")), lambda c: F.concat(c, F.lit("2")))
    assert apply_modifier(df, "t", f).first()["t"] == "ab12"


def test_stop_words(spark):
    df = spark.createDataFrame([("  The cat   and THE dog café ",)], "t string")
    out = apply_modifier(df, "t", remove_stop_words(["the", "and"])).first()["t"]
    assert out == "cat dog caf"


def test_toxicity(spark):
    df = spark.createDataFrame([("you Idiot",), ("nice day",)], "t string")
    assert [r["h"] for r in df.select(toxic_hits(F.col("t"), ["idiot"]).alias("h")).collect()] == [1, 0]
    out = [r["t"] for r in apply_modifier(df, "t", purge_toxic(0.5, ["idiot"])).collect()]
    assert out == [PURGED_TEXT, "nice day"]


def test_alias_round_trip_and_missing(spark):
    df = spark.createDataFrame([(1, "s1", "x αTOKENoneα y αTOKENtwoα"), (2, "s2", "plain"),
                                (3, "s1", "αTOKENoneα again")], "id int, sess string, text string")
    text, amap = alias_tokens(df, "text", "sess", "id")
    t = {r["id"]: r["text"] for r in text.collect()}
    assert "TOKEN" not in t[1] and t[2] == "plain" and len(t[1].split("α")[1]) == 7
    assert amap.count() == 3                                   # one alias per occurrence
    back = {r["id"]: r for r in expand_aliases(text, amap, "text", "sess", "id").collect()}
    assert back[1]["text"] == "x αTOKENoneα y αTOKENtwoα" and not back[1]["missing_alias"]
    assert back[2]["text"] == "plain"
    other = amap.where("session_id = 's2'")                    # s1's aliases unknown
    miss = {r["id"]: r for r in expand_aliases(text, other, "text", "sess", "id").collect()}
    assert miss[1]["text"] is None and miss[1]["missing_alias"]
    left = delete_sessions(amap, spark.createDataFrame([("s1",)], "session_id string"))
    assert left.count() == 0


def test_parse_records_flags_corrupt_rows(spark):
    from veilspark.operators.context import parse_records
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, '{bad'), (3, None)], "id int, p string")
    out = {r["id"]: r for r in parse_records(df, "p", "k int").collect()}
    assert out[1]["record"]["k"] == 1 and not out[1]["corrupt"]
    assert out[2]["corrupt"]
    assert out[3]["record"] is None and not out[3]["corrupt"]


def test_toxic_hit_counts(spark):
    """Repeated keys do not mix, and repeated texts each get their count."""
    from veilspark.operators.modifiers import toxic_hit_counts
    df = spark.createDataFrame([(1, "you idiot, IDIOT moron"), (1, "nice day"), (3, None), (4, "you idiot, IDIOT moron")],
                               "id int, text string")
    lex = spark.createDataFrame([("idiot",), ("moron",), ("moron",)], "word string")
    got = [(r["id"], r["toxic_hits"]) for r in toxic_hit_counts(df, "text", lex).collect()]
    assert sorted(got) == [(1, 0), (1, 3), (3, 0), (4, 3)]


def test_ambiguous_alias_is_withheld(spark):
    df = spark.createDataFrame([(1, "s", "a αT1α b"), (2, "s", "αT2α"), (3, "s", "Greek αα letter αT2α")],
                               "id int, sess string, text string")
    amap = spark.createDataFrame([("s", "αT1α", "one"), ("s", "αT1α", "two"), ("s", "αT2α", "x"), ("s", "αT2α", "x")],
                                 "session_id string, alias string, token string")
    got = {r["id"]: (r["text"], r["missing_alias"]) for r in expand_aliases(df, amap, "text", "sess", "id").collect()}
    assert got == {1: (None, True), 2: ("αxα", False), 3: ("Greek αα letter αxα", False)}


def test_escaped_delimiters_get_no_alias(spark):
    df = spark.createDataFrame([(1, "s", "one αα two αTOKENα")], "id int, sess string, text string")
    text, amap = alias_tokens(df, "text", "sess", "id")
    assert text.first()["text"].startswith("one αα two α") and amap.count() == 1
    assert expand_aliases(text, amap, "text", "sess", "id").first()["text"] == "one αα two αTOKENα"


def test_stop_words_ignore_ascii_case_on_both_sides(spark):
    df = spark.createDataFrame([("The ÜBER fast cat",)], "t string")
    assert apply_modifier(df, "t", remove_stop_words(["THE", "über"])).first()["t"] == "BER fast cat"


def test_set_aliases_last_write_wins(spark):
    from veilspark.operators.aliases import set_aliases
    old = spark.createDataFrame([("s", "αaα", "t1", 1), ("s", "αbα", "t2", 1)],
                                "session_id string, alias string, token string, v int")
    new = spark.createDataFrame([("s", "αaα", "t9", 2), ("u", "αaα", "t3", 2)],
                                "session_id string, alias string, token string, v int")
    got = {(r["session_id"], r["alias"]): r["token"] for r in set_aliases(old, new, order_col="v").collect()}
    assert got == {("s", "αaα"): "t9", ("s", "αbα"): "t2", ("u", "αaα"): "t3"}


def test_toxic_hit_counts_in_both_placements(spark):
    from veilspark.operators.modifiers import toxic_hit_counts
    rows = [(1, "Bad bad, worse."), (1, "Bad bad, worse."), (2, None), (3, ""), (4, "fine"), (5, "BAD-bad ba d"), (6, "worse " * 500)]
    df = spark.createDataFrame(rows, "k int, text string")
    lex = spark.createDataFrame([("bad",), ("worse",), ("bad",), (None,)], "word string")
    want = sorted([(1, 3), (1, 3), (2, 0), (3, 0), (4, 0), (5, 2), (6, 500)])
    for limit in (1 << 20, 0):
        got = toxic_hit_counts(df, "text", lex, max_bytes=limit)
        assert sorted((r["k"], r["toxic_hits"]) for r in got.collect()) == want
    plan = toxic_hit_counts(df, "text", lex).where("toxic_hits > 0")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_word_weights_without_labels(spark):
    from veilspark.operators.modifiers import toxicity_by_words, toxicity_weights
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, toxic int")
    assert toxicity_by_words(docs, toxicity_weights(docs, none)).collect() == []
    lab = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_by_words(docs, toxicity_weights(docs, lab)).collect()}
    assert got[1]["score"] > got[2]["score"] == 0 and got[1]["is_toxic"] and not got[2]["is_toxic"]
