"""Operators beyond those that the catalogue's SQL pins: files put in place, workspaces, runs, replies, labels, sequences."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.functions import time
from spanlake.operators import identity, papers, scenes, segment, signoff, windows
from spanlake.plans import papers as plans
from spanlake.plans import verbs
from spanlake.sources import artifacts, connectors, sinks, workspace

from .conftest import rows


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="zero"):
        sinks.replace_table(spark.range(2).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("zero"))).alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    root = str(tmp_path / "ws")
    sinks.write_contained(spark.range(1), root, "out/a")
    assert spark.read.parquet(f"{root}/out/a").count() == 1
    for outside in ("../b", "/etc/b", "out/../../b"):
        with pytest.raises(ValueError, match="outside"):
            sinks.write_contained(spark.range(1), root, outside)


def test_workspace(spark, tmp_path):
    root, series = f"file://{tmp_path}/ep1", f"file://{tmp_path}/series"
    workspace.init(spark, root)
    found = workspace.doctor(spark, root)
    assert all(found[f] for f in workspace.FOLDERS) and not found["material"]
    assert workspace.series_status(spark, root) == {"bound": False, "version": None, "changed": False}
    with pytest.raises(ValueError, match="itself"):
        workspace.bind_series(spark, root, root + "/")
    store = workspace.Store(spark)
    store.make(series)
    store.write(f"{series}/cast.json", b"")
    with pytest.raises(ValueError, match="empty"):
        workspace.bind_series(spark, root, series)
    store.write(f"{series}/cast.json", json.dumps({"version": "2", "entities": [{"id": "C1"}]}).encode())
    assert workspace.bind_series(spark, root, series)["version"] == "2"
    assert workspace.series_status(spark, root) == {"bound": True, "version": "2", "changed": False}
    store.write(f"{series}/cast.json", b'{"version": "3"}')
    assert workspace.series_status(spark, root)["changed"] and workspace.cast_table(spark, root)["version"] == "3"
    system, where = store.at(f"{series}/cast.json")
    system.delete(where, False)
    assert workspace.cast_table(spark, root)["entities"] == [{"id": "C1"}]
    assert workspace.settings(spark)["spanlake.calls.key"] == ""


def test_prepare_run_merge(spark):
    episodes = spark.createDataFrame([(1, 60_000), (2, 7_800_000), (3, 60_000)], "ep long, duration_ms long")
    orders = verbs.prepare(episodes)
    assert orders.count() == 5
    good = json.dumps({"segments": [{"speaker": "S", "start": 1, "end": 2.5}]})
    held = spark.createDataFrame([(1, 0, good), (3, 0, '{"x": 1}')], "ep long, part long, payload string")

    def call(order):
        if order["ep"] == 2 and order["part"] == 1:
            return "auth", None
        return "ok", '{"segments": []}' if order["part"] == 2 else good

    got = {(r["ep"], r["part"]): (r["state"], r["tries"]) for r in verbs.run(orders, held, call).collect()}
    assert got == {(2, 0): ("ok", 1), (2, 1): ("auth", 1), (2, 2): ("ok", 1), (3, 0): ("ok", 1)}
    flaky = connectors.answered(orders.filter("ep = 1"), lambda o: ("server", None), 3).first()
    assert (flaky["state"], flaky["payload"], flaky["tries"]) == ("server", None, 3)
    answers = held.filter("ep = 1").unionByName(verbs.run(orders, held, call).select("ep", "part", "payload"))
    cues = spark.createDataFrame([(e, 1, 1000, 2000) for e in (1, 2, 3)], "ep long, cue long, start_ms long, end_ms long")
    bound, broken = verbs.merge(orders, answers, cues)
    assert {r["ep"]: r["cluster_id"] for r in bound.collect()} == {1: "SPEAKER_A1", 3: "SPEAKER_A1"}
    assert [(r["ep"], r["code"], r["parts"]) for r in broken.collect()] == [(2, 7, [1])]


def test_replies_become_decisions():
    offered = {"S1": ["托德", "奶奶"], "S2": []}
    told = lambda reply, known=(): signoff.decisions_of(reply, offered, list(known))
    assert told("S1=托德 S2=跳过") == [("S1", "accept", "托德"), ("S2", "skip", None)]
    assert told("S1=艾拉") == [("S1", "confirm", "艾拉")] and told("S2 就叫托德吧", ["托德"]) == [("S2", "confirm", "托德")]
    assert told("第二个叫托德") == [("S2", "ambiguous", None)]
    assert told("今天天气不错") == [(None, "unparsed", "今天天气不错")] and told("") == told(None) == [(None, "unparsed", None)]
    for reply in ("S1 对", "S1 嗯", "S1=好的", "S1 没问题", "S1 不知道"):
        assert told(reply) == [("S1", "skip", None)], reply
    assert signoff.decisions_of("S1=好", {"S1": ["好"]}, []) == [("S1", "accept", "好")]
    assert told("S9=甲") == [("S9", "unknown_slot", "甲")] and told("S1 那个金发的叫托德") == [("S1", "accept", "托德")]
    assert told("S1=托德，剩下的跳过") == [("S1", "accept", "托德"), ("S2", "skip", None)]


def test_headings(spark):
    drafts = spark.createDataFrame([(1, 1, "> 概要：x\n## 场 9【门|口】（旧）\n## 场 8【二】\n", "00:00:01", "00:00:02"), (1, 2, "\n\n**内景·日**｜屋\\顶 $1\n**A**：b", "", ""), (1, 3, "", "", "")], "ep long, scene long, text string, start_tc string, end_tc string")
    got = [r["text"] for r in papers.headed(drafts).orderBy("scene").collect()]
    assert got[0] == "## 场 1【门|口】（00:00:01 - 00:00:02）\n## 场 8【二】\n"
    assert got[1] == "## 场 2【屋\\顶 $1】\n**内景·日**｜屋\\顶 $1\n**A**：b" and got[2] == "## 场 3【未命名】\n"


def test_overview_keeps_times_of_a_hundred_hours(spark):
    codes = [("99:59:59.000", "100:00:04.250"), ("1234:00:00", " 1234:00:05.9 "), ("1:02:03", "x"), ("x100:00:00", "100:00:00")]
    drafts = spark.createDataFrame([(1, i, "**内景·日**｜屋\n", *c) for i, c in enumerate(codes, 1)], "ep long, scene long, text string, a string, b string")
    drafts = drafts.select("ep", "scene", "text", papers.clock_of(F.col("a")).alias("start_tc"), papers.clock_of(F.col("b")).alias("end_tc"))
    got = papers.overview(papers.headed(drafts).withColumn("sequence", F.lit(None).cast("string"))).first()["overview"].split("\n")[2:]
    assert [x.split(" | ")[-1] for x in got] == ["99:59:59 - 100:00:04 |", "1234:00:00 - 1234:00:05 |", " |", " |"]


def test_share_of_lines_rounds_halves_to_even(spark):
    told = {(0, 0): "0.0%", (13, 16): "81.2%", (39, 48): "81.2%", (3, 16): "18.8%", (1601, 2000): "80.0%", (7, 7): "100.0%", (1, 3): "33.3%"}
    counts = spark.createDataFrame([(i, t, s, 0, 0, 0, 0) for i, (s, t) in enumerate(told)], "ep long, total long, spliced long, silent long, named long, descriptive long, untraced long")
    ends = papers.appendix(spark.createDataFrame([], "ep long, relation string, n long"), counts).orderBy("ep").collect()
    assert [r["appendix"].split("覆盖率 ")[1].split("；")[0] for r in ends] == list(told.values())


def test_scene_headings_of_late_episodes(spark, tmp_path):
    spark.createDataFrame([(e, 0, "user", "x") for e in (5900, 5902, 600_000)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["ep"], r["scene"]): r["text"].split("\n")[0] for r in plans.scene_headings(spark, str(tmp_path)).collect()}
    assert got[5900, 1].endswith("（99:58:20 - 99:58:25）") and got[5902, 2].endswith("（100:00:22 - 100:00:27）")
    assert got[600_000, 1].endswith("（10166:40:00 - 10166:40:05）") and len(got) == 6


def test_scene_headings_of_any_key(spark, tmp_path):
    heads = lambda path: {(r["ep"], r["scene"]): r["text"] and r["text"].split("\n")[0] for r in plans.scene_headings(spark, path).collect()}
    keys = [(e, 0, "user", "x") for e in (10_000_000_000_008, 10**17, -2, -100, None)]
    spark.createDataFrame(keys, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = heads(f"{tmp_path}/a")
    assert got[10_000_000_000_008, 1].endswith("（169444444444:34:48 - 169444444444:34:53）")  # 2^53 ms and more
    assert got[10**17, 1].endswith("（1694444444444444:26:40 - 1694444444444444:26:45）")  # more than 2^63 ms
    assert got[-2, 1] is None and got[-2, 2] == "## 场 2【旧题|A】（00:-2:-2 - 00:-1:-57）" and got[-100, 2] == "## 场 2【user】（-1:-41:-40 - -1:-41:-35）"
    assert got[None, 1] is None and got[None, 2] is None and len(got) == 10
    spark.createDataFrame([(35_206, 0, "user", "x")], "conv_id int, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert heads(f"{tmp_path}/b")[35_206, 1].endswith("（596:32:46 - 596:32:51）")
    assert spark.range(1).select(time.timecode(F.lit(610_000_000_000_488_000))).first()[0] == "169444444444:34:48.000"


def test_outline_that_does_not_fit_is_solved_flat(spark):
    shots = spark.createDataFrame([(e, i, i * 20_000, (i + 1) * 20_000) for e in (1, 2) for i in range(6)], "ep long, pos long, r_start_ms long, r_end_ms long")
    walls = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 5)], "ep long, wall long, boundary long")
    parts = scenes.sequence_parts(walls, shots)
    assert [(r["ep"], r["seq"]) for r in parts.orderBy("ep", "pos").collect()] == [(1, 1)] * 2 + [(1, 2)] * 2 + [(1, 3)] * 2 + [(2, 0)] * 6
    none = spark.createDataFrame([], "ep long, boundary long")
    found = scenes.solve_sequences(shots, none.withColumn("score", F.lit(0.0)), none, parts, most=6)
    for r in found.collect():
        assert r["cap"] == (2 if r["ep"] == 1 else 6)
    assert found.groupBy("ep").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n")).filter("n <> 6").isEmpty()


def test_walls_beyond_the_last_cut_are_told(spark):
    cuts = spark.createDataFrame([(1, 0, 10_000, 1, 1)], "ep long, boundary long, cut_ms long, left_ms long, right_ms long")
    walls = spark.createDataFrame([(1, 1, 9_000.0), (1, 2, 11_000.0)], "ep long, wall long, wall_ms double")
    got = segment.snap_walls(walls, cuts).orderBy("wall").collect()
    assert [(r["boundary"], r["distance_ms"], r["within"]) for r in got] == [(0, 1000.0, True), (1, None, False)]


def test_own_windows_and_forged_names(spark):
    cues = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 100), (2, 3, 0, 100)], "ep long, cue long, start_ms long, end_ms long")
    own = spark.createDataFrame([(1, 0, 51, "OP"), (1, 100, 200, "ED")], "ep long, start_ms long, end_ms long, label string")
    assert {r["cue"]: r["label"] for r in windows.in_windows(cues, own).collect()} == {1: "OP", 2: "ED", 3: None}
    entities = spark.createDataFrame([(1, "E1", "approved", "human", "d"), (1, "E2", "approved", None, "d"), (1, "E3", "draft", None, None)], "ep long, entity_id string, status string, approved_by string, approved_at string")
    slots = spark.createDataFrame([(1, "S1", "E1", "approved_table"), (1, "S2", "E1", "this_episode"), (1, "S3", None, "this_episode")], "ep long, slot_id string, entity_id string, origin string")
    used = spark.createDataFrame([(1, "A", "S1", "approved_slot"), (1, "B", "S2", None), (1, "C", "S3", "new_slot")], "ep long, cluster_id string, slot_id string, matched_via string")
    assert sorted(rows(identity.forged_names(entities, used, slots))) == [(1, "forged", "S2"), (1, "unsigned", "E2")]


def test_parts_and_windows_with_nothing_in_them(spark):
    parts = spark.createDataFrame([(1, 0, 0, None), (1, 1, 0, ""), (1, 2, 0, "[]"), (1, 3, 0, '{"results": [{"speaker": "A", "start": "1", "end": 2}, 7]}')], "ep long, part long, offset_ms long, payload string")
    assert {r["part"]: (r["state"], r["kept"], r["dropped"]) for r in artifacts.part_status(parts).collect()} == {0: ("missing", 0, 0), 1: ("invalid", 0, 0), 2: ("silent", 0, 0), 3: ("ok", 1, 1)}
    docs = spark.createDataFrame([(1, "[]"), (2, None)], "ep long, doc string")
    old = spark.createDataFrame([(1, '[{"start_ms": 0, "end_ms": 9}]'), (2, '[{"start_ms": 0, "end_ms": 9}]')], "ep long, doc string")
    assert rows(artifacts.configured_windows(docs, old).select("ep", "label", "origin", "differs")) == [(2, "OP", "legacy", False)]


def test_command_line_lists_queries(capsys):
    from spanlake.__main__ import main

    assert main(["list"]) == 0 and "cue_shot_assign" in capsys.readouterr().out
