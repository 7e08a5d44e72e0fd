import random
from collections import defaultdict

import duckdb
from voxtide.llm import quoting
from voxtide.llm.queries import OP1

ROWS = [
    (1, 0, "user", "Hello there my friend.\nHow are you today?\n\nSecond paragraph of mine."),
    (1, 1, "assistant", "> How are you today?\nI am fine."),
    (1, 2, "user", "On Monday A wrote:\n>> How are   you TODAY?\n> I am fine.\nGood to hear that."),
    (1, 3, "user", "> nothing known here\nok"),
    (1, 4, "assistant", "plain"),
    (1, 5, "user", "> Second paragraph of mine.\n"),
    (1, 6, "user", "\t> > ok\r\n  >plain\nGood to hear that."),
    (1, 7, "user", "> Good to hear that.\n\n> ok"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, None, "user", "x"),
    (None, 1, "user", "> hello"),
    (3, 5, "user", "I said this before you."),
    (3, 4, "user", "> I said this before you."),
    (3, 6, "user", "> I said this before you.\n" * 300),
    (4, 0, "user", "same line of words\n" * 3000),
    (4, 1, "user", "> same line of words\nyes"),
    (4, 1, "user", "> same line of words\nyes"),
    (5, 0, "user", "今天天气很好。\n明天我们去公园散步"),
    (5, 1, "user", "> 明天我们去公园散步\n好的"),
    (5, 2, "user", "> 今天天气很好。\n是的没错真的"),
    (5, 3, "user", "> 好的\n晚上见"),
    (5, 4, "user", "> 公园\n哪里"),
    (6, 0, "user", ("> a b c\n>> d e f\n" * 500) + "the end of it"),
    (6, 1, "user", "> the end of it\n"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links(spark):
    got = {(r["conv_id"], r["turn"]): r for r in quoting.link_quotes(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    reply = {k: v["reply_to"] for k, v in got.items() if v["reply_to"] is not None}
    assert reply == {(1, 1): 0, (1, 2): 1, (1, 5): 0, (1, 6): 4, (1, 7): 3, (3, 6): 5, (4, 1): 0, (5, 1): 0, (5, 2): 0, (5, 3): 1, (6, 1): 0}
    assert got[1, 2]["text"] == "Good to hear that." and got[1, 2]["quote_levels"] == 2 and got[1, 2]["n_quotes"] == 2
    assert got[1, 2]["thread"] == 0 and got[1, 7]["thread"] == 3 and got[1, 6]["thread"] == 4
    assert got[1, 5]["text"] == "" and got[6, 0]["n_quotes"] == 1000
    order = sorted((r["thread"], r["position"], t) for (c, t), r in got.items() if c == 5)
    assert [t for _, _, t in order] == [0, 1, 3, 2, 4]


def test_order_of_replies(spark):
    rng = random.Random(5)
    up = {}
    for conv, kind in enumerate(["star", "chain", "tree", "tree", "few"]):
        for turn in range(1, 120):
            if kind != "few" or turn in (7, 9):
                up[conv, turn] = {"star": 0, "chain": turn - 1, "few": 3}.get(kind, rng.randrange(turn))

    def path(conv, turn):
        return [*path(conv, up[conv, turn]), turn] if (conv, turn) in up else [turn]

    trees = defaultdict(list)
    for conv, turn in up:
        trees[conv, path(conv, turn)[0]].append(path(conv, turn))
    want = {(conv, p[-1]): (p[-2], root, k) for (conv, root), paths in trees.items() for k, p in enumerate(sorted(paths), 1)}
    links = quoting.materialize(spark.createDataFrame([(c, t, u) for (c, t), u in up.items()], "conv long, turn long, reply_to long"), "links")
    assert {(r["conv"], r["turn"]): (r["reply_to"], r["thread"], r["position"]) for r in quoting.threads(links).collect()} == want


def test_same_as_sql(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    rel = con.sql(OP1)
    want = sorted((tuple(r) for r in rel.fetchall()), key=str)
    got = quoting.link_quotes(df)
    assert sorted((tuple(r[c] for c in rel.columns) for r in got.collect()), key=str) == want


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "u", "> x", "t")], SCHEMA + ", thread string").withColumnRenamed("role", "conv")
    row = quoting.link_quotes(df).first()
    assert row["thread"] == 0 and row["position"] == 0 and row["conv"] == "u"
    assert quoting.link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []
