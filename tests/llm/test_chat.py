from spanlake.llm import chat


def turns(*pairs):
    return [(i, r, t) for i, (r, t) in enumerate(pairs)]


def test_prefix_completions_and_masks(spark):
    a = turns(("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "né"))
    b = turns(("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "no"), ("user", "ok"))
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    pairs = spark.createDataFrame([(1, a, b, "p"), (2, a, a, "q"), (3, a, None, "r"), (4, None, None, "s"), (5, a[1:], a, "t")], f"pair_id long, chosen {kind}, rejected {kind}, prompt string")
    got = {r["pair_id"]: r for r in chat.format_preferences(pairs).collect()}
    assert got[1]["prompt_turns"] == 3 and got[1]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nmore<|end|>\n"
    assert got[1]["chosen_completion"] == "<|assistant|>\nné<|end|>\n"
    assert got[2]["prompt_turns"] == 4 and got[2]["chosen_completion"] == got[2]["rejected_completion"] == ""
    assert got[3]["prompt_turns"] == 0 and got[3]["rejected_completion"] == "" and got[3]["chosen_completion"].startswith("<|user|>")
    assert got[4]["prompt"] == "" and got[5]["prompt_turns"] == 0
    for r in got.values():
        for side in ("chosen", "rejected"):
            text, spans = r[f"{side}_completion"], r[f"{side}_mask"]
            assert [s["end"] for s in spans[:-1]] == [s["start"] for s in spans[1:]]
            assert (spans[-1]["end"] if spans else 0) == len(text)
    only = [got[1]["rejected_completion"][s["start"] : s["end"]] for s in got[1]["rejected_mask"] if s["train"]]
    assert only == ["no<|end|>\n"]


def test_pairs_from_rows(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 1, "assistant", "c"), (1, 0, "user", "a"), (2, 0, None, None), (5, 0, "user", "z"), (5, 0, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.pair_conversations(table)).collect()}
    assert got[0]["prompt_turns"] == 1 and got[0]["rejected_completion"] == "<|assistant|>\nc<|end|>\n"
    assert got[1]["chosen_completion"] == "<||>\n<|end|>\n"
    assert got[2]["rejected_completion"] == "<|user|>\ny<|end|>\n<|user|>\nz<|end|>\n"
    assert chat.format_preferences(chat.pair_conversations(table.limit(0))).count() == 0


def test_large_ids_pair_exactly(spark):
    big = 1 << 60
    ids = [big + 2, big + 3, big + 4, big + 5, -3, -4, (1 << 63) - 1, (1 << 63) - 2, -(1 << 63), None]
    table = spark.createDataFrame([(i, 0, "user", str(i)) for i in ids], "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.pair_conversations(table).collect()}
    assert got.keys() == {i // 2 for i in ids if i is not None}
    for i, r in got.items():
        for odd, side in ((0, "chosen"), (1, "rejected")):
            assert [t["text"] for t in r[side] or []] == ([str(2 * i + odd)] if 2 * i + odd in ids else [])


def test_masks_of_long_conversations(spark):
    n = 3 * chat.BLOCK + 7
    rows = [(side, i, ["user", "assistant", "tool"][i % 3], "é" * (i * 7 % 31) if (i, side) != (40, 1) else "x") for side in (0, 1) for i in range(n)]
    r = chat.format_preferences(chat.pair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r["prompt_turns"] == 40
    for side, name in enumerate(("chosen", "rejected")):
        at, want = 0, []
        for _, i, role, text in [x for x in rows if x[0] == side and x[1] >= 40]:
            a, b = at + len(role) + 5, at + len(role) + 5 + len(text) + 8
            want += [(at, a, False), (a, b, role == "assistant")]
            at = b
        assert [tuple(s) for s in r[f"{name}_mask"]] == want and at == len(r[f"{name}_completion"])


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t, r, x) for i in ((1 << 55) + 2, (1 << 55) + 3, -7, 4, None) for t, r, x in ((0, "user", "hé"), (1, "assistant", None), (1, "assistant", None), (None, None, "z"), (2, "assistant", str(i)))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat.op3_preference_format(spark, str(tmp_path))
    want = con.execute(chat.OP3_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
