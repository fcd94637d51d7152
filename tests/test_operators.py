"""Operators against pinned answers and against naive versions of themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import labels, text, time
from spanlake.operators import align, attribute, fuse, interval, segment, splice, streams, vocative, windows

SHOT = "ep long, pos long, r_start_ms long, r_end_ms long"
CUE = "ep long, cue long, start_ms long, end_ms long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def shots(spark, *spans):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], SHOT)


def cues(spark, *spans):
    return spark.createDataFrame([(1, i + 1, a, b) for i, (a, b) in enumerate(spans)], CUE)


def test_assignment_fallbacks(spark):
    assert rows(align.assign_cues(cues(spark, (2950, 3000)), shots(spark, (0, 3000), (3000, 6000)))) == [(1, 1, 0, 0, True)]
    assert rows(align.assign_cues(cues(spark, (4900, 4950)), shots(spark, (0, 1000), (5000, 6000)))) == [(1, 1, 1, 0, True)]
    spread = [(i * 3000, i * 3000 + 2900) for i in range(5)]
    got = rows(align.assign_cues(cues(spark, *[(i * 3000 + 2950, i * 3000 + 2990) for i in range(5)]), shots(spark, *spread)))
    assert [r[1] for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_interval_join_equals_naive(spark, width):
    pick = random.Random(width)
    make = lambda n: [(pick.randint(1, 3), i, s := pick.randint(-200, 800), s + pick.choice([0, 1, 5, 300])) for i in range(n)]
    left, right = make(60), make(60)
    a = spark.createDataFrame(left, "ep long, cue long, start_ms long, end_ms long")
    b = spark.createDataFrame(right, SHOT)
    want = sorted((e, i, j, min(t, v) - max(s, u)) for e, i, s, t in left for f, j, u, v in right if e == f and min(t, v) > max(s, u))
    got = interval.interval_join(a, b, ["ep"], width).select("ep", "cue", "pos", "overlap")
    assert rows(got) == want


def test_nearest_equals_naive(spark):
    pick = random.Random(4)
    left = [(pick.randint(1, 3), i, s := pick.randint(0, 900), s + pick.randint(0, 20)) for i in range(80)]
    right = [(pick.randint(1, 3), i, s := pick.randint(0, 900), s + pick.randint(1, 40)) for i in range(25)]
    got = {(r["ep"], r["cue"]): (r["gap"], r["pos"]) for r in interval.nearest(spark.createDataFrame(left, CUE), spark.createDataFrame(right, SHOT), 50).collect()}
    for e, i, s, t in left:
        near = min((max(0, s - v, u - t), j) for f, j, u, v in right if f == e)
        assert got[e, i] == near


def test_shifting_time_changes_no_assignment(spark):
    a, b = cues(spark, (100, 900), (950, 960), (5000, 9000)), shots(spark, (0, 500), (500, 940), (4000, 6000))
    moved = lambda df, *cs: df.withColumns({c: F.col(c) + 77_777 for c in cs})
    assert rows(align.assign_cues(a, b)) == rows(align.assign_cues(moved(a, "start_ms", "end_ms"), moved(b, "r_start_ms", "r_end_ms")))


def turns(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "ep long, cluster_id string, start_ms long, end_ms long")


def test_binding(spark):
    bind = lambda c, *t: attribute.bind(cues(spark, c), turns(spark, *t)).first()
    one = bind((1500, 3500), ("A1", 0, 2000), ("A2", 2000, 4000))
    assert (one["cluster_id"], one["confidence"], one["secondary_speaker"]) == ("A2", 0.75, None)
    assert bind((1000, 2000), ("A1", 0, 1400), ("A2", 1400, 2400))["secondary_speaker"] == "A1"
    whole = bind((0, 10000), ("A1", 0, 2500), ("A1", 7000, 9500), ("A2", 2600, 6600))
    assert (whole["cluster_id"], whole["secondary_speaker"]) == ("A1", "A2")
    assert bind((0, 10000), ("A1", 0, 9000), ("A2", 9700, 9900))["secondary_speaker"] is None
    assert [bind(c, ("A", 1000, 4000))["confidence"] for c in ((1000, 4000), (0, 4000), (0, 1800))] == [0.9, 0.75, 0.55]
    assert bind((9000, 9100), ("A", 0, 10))["method"] == "no_speech_overlap"


def test_lag(spark):
    t = turns(spark, *[("A", i * 5000 + 1000, i * 5000 + 2500) for i in range(10)])
    lines = [(i * 5000 - 1000, i * 5000 + 500) for i in range(10)]
    assert rows(attribute.estimate_lag(cues(spark, *lines), t)) == [(1, 2000)]
    assert rows(attribute.estimate_lag(cues(spark, *lines[:3]), t)) == [(1, 0)]


def test_components(spark):
    make = lambda *r: spark.createDataFrame([(1, *x) for x in r], "ep long, part int, raw_label string, start_ms long, end_ms long")
    one = make((0, "A", 38000, 39500), (1, "B", 38800, 39600), (1, "B", 50000, 52000), (2, "C", 51500, 52500))
    assert {r["cluster_id"] for r in attribute.label_components(one).collect()} == {"SPEAKER_A1"}
    two = make((0, "S2", 3920, 25040), (1, "S2", 53000, 57000), (0, "S1", 38400, 39520), (1, "S1", 40880, 43040))
    assert len({r["cluster_id"] for r in attribute.label_components(two).collect()}) == 4


def test_name_and_attribute_votes(spark):
    bound = spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate([("A1", "x"), ("A1", "x"), ("A1", "y"), ("A1", "x"), ("A2", "y"), ("A3", "SPEAKER_A9"), ("A3", "SPEAKER_A9")])], "ep long, cue long, cluster_id string, speaker string")
    assert rows(attribute.name_votes(bound).select("cluster_id", F.coalesce("name", F.lit("-")), "line_count")) == [("A1", "x", 4), ("A2", "-", 1), ("A3", "-", 2)]
    said = [("a", "female")] * 3 + [("a", "male")] + [("b", "female")] * 2 + [("b", "unknown")] * 8 + [("c", "male"), ("c", "female")] * 2 + [("d", "unknown")]
    got = attribute.attribute_votes(spark.createDataFrame(said, "ep string, gender string"), ["gender"], ["ep"])
    assert rows(got.select("ep", "value", "votes", "known")) == [("a", "female", 3, 4), ("b", "female", 2, 2), ("c", "unknown", 0, 4), ("d", "unknown", 0, 0)]


def test_exclusion_windows(spark):
    w = [(84_000, 105_000, "OP"), (1_320_000, 1_440_000, "ED")]
    got = cues(spark, (84000, 105000), (84000, 104000), (83000, 85000), (0, 60000), (1_320_000, 1_320_000)).select(windows.window_label(F.col("start_ms"), F.col("end_ms"), w).alias("l"))
    assert [r["l"] for r in got.collect()] == ["OP", "OP", None, None, "ED"]
    kept, removed = windows.split_by_windows(cues(spark, (0, 10), (84000, 90000), (200000, 200001), (90000, 91000)), w)
    assert rows(kept.select("cue", "index")) == [(1, 1), (3, 2)] and removed.count() == 2


def test_plans(spark):
    plan = lambda a, b: [(r["start_ms"] // 1000, r["end_ms"] // 1000) for r in windows.plan_segments(shots(spark, (a * 1000, b * 1000))).orderBy("segment").collect()]
    assert plan(0, 200) == [(0, 90), (85, 175), (170, 200)] and plan(0, 91) == [(0, 91)] and plan(30, 90) == [(30, 90)] and plan(0, 1) == []
    chunks = lambda ms, **k: [(r["start_ms"], r["end_ms"]) for r in windows.plan_chunks(spark.createDataFrame([(1, ms)], "ep long, duration_ms long"), **k).orderBy("part").collect()]
    assert chunks(1_440_000) == [(0, 1_440_000)] and chunks(3_200_000) == [(0, 3_200_000)]
    assert chunks(7_800_000) == [(0, 2_703_000), (2_697_000, 5_403_000), (5_397_000, 7_800_000)]
    assert chunks(148_000, threshold_s=40, target_s=40) == [(0, 43000), (37000, 83000), (77000, 123000), (117000, 148000)]
    near = spark.range(1).select(windows.snap_to_silence(F.array(*map(F.lit, [40.0, 80.0, 120.0])), F.array(*map(F.lit, [39.2, 79.4, 121.4])))).first()[0]
    assert near == [39.2, 79.4, 121.4]


def test_greedy_thinning_and_even_sample(spark):
    points = spark.createDataFrame([(1, x) for x in (0, 3, 5, 6, 9, 11, 14)], "ep long, at long")
    assert [r[1] for r in rows(windows.thin_cuts(points, 5))] == [0, 5, 11]
    for n in (5, 12, 13, 30, 100):
        got = [r["pos"] for r in windows.even_sample(shots(spark, *[(i, i + 1) for i in range(n)]), 12).orderBy("pos").collect()]
        assert got == (list(range(n)) if n <= 12 else [int(i * (n / 12)) for i in range(12)])


def test_coverage(spark):
    scene = shots(spark, (0, 100_000))
    for spans, want in [([(0, 50), (50, 100)], 100), ([(0, 60), (55, 90)], 90), ([(0, 40), (80, 100)], 60), ([(200, 300)], 0)]:
        pieces = spark.createDataFrame([(1, 0, a * 1000, b * 1000) for a, b in spans], "ep long, pos long, start_ms long, end_ms long")
        assert windows.coverage(scene, pieces).first()["covered_pct"] == want


def twelve(spark):
    spans = [(0, 3000), (3000, 6000), (6000, 9000), (9000, 12000), (18000, 23000), (23000, 28000), (28000, 33000)] + [(s, s + 5000) for s in range(40000, 65000, 5000)]
    lines = [(2500, 3500), (4000, 5500), (7000, 8500), (19000, 22000), (24000, 27000), (42000, 44000)]
    return shots(spark, *spans), cues(spark, *lines).withColumn("text", F.lit("x。"))


def test_pinned_segmentation(spark):
    s, c = twelve(spark)
    cuts = segment.boundaries(s)
    scores, bad = segment.features(c, cuts), segment.protected(c, cuts)
    assert (1, 0) in rows(bad)
    solve = lambda **k: [(r["first_pos"] + 1, r["last_pos"] + 1) for r in segment.solve(s, scores, bad, **k).orderBy("scene").collect()]
    assert solve(k_min=2, k_max=5) == [(1, 4), (5, 6), (7, 8), (9, 10), (11, 12)]
    assert solve(target=3) == [(1, 4), (5, 6), (7, 12)]


def test_partition_is_optimal():
    from itertools import combinations

    pick = np.random.default_rng(2)
    for n in (1, 2, 7, 9):
        for _ in range(4):
            s, score, bad = pick.uniform(1, 9, n), pick.uniform(0, 1, n), (pick.uniform(size=n) < 0.3).astype(float)

            def cost(ends):
                total, start = 0.0, 0
                for e in ends:
                    length = s[start : e + 1].sum()
                    total += (10 - length) * 3 if length < 10 else max(0.0, length - 300) * 0.8
                    total += (-8 * score[e] + 12 * bad[e]) if e != n - 1 else 0
                    start = e + 1
                return total

            options = [[*c, n - 1] for k in range(max(1, min(2, n)), min(4, n) + 1) for c in combinations(range(n - 1), k - 1)]
            assert cost(segment.partition(s, score, bad, 2, 4)) == pytest.approx(min(map(cost, options)))


def test_fusion(spark):
    counts = spark.createDataFrame([(1, "acoustic", "S1", 3.0), (1, "acoustic", "S2", 1.0), (1, "visual", "S1", 2.0)], "ep long, family string, candidate string, n double")
    unseen = spark.createDataFrame([(1, "acoustic", 11.0), (1, "visual", -5.0)], "ep long, family string, u double")
    dist = fuse.distributions(counts, unseen, ["ep"])
    assert {(r["family"], r["candidate"]): r["p"] for r in dist.collect()} == {("acoustic", "S1"): 3 / 15, ("acoustic", "S2"): 1 / 15, ("visual", "S1"): 1.0}
    scores = fuse.fused(dist, ["ep"])
    assert {r["candidate"]: r["score"] for r in scores.collect()} == {"S1": pytest.approx(0.2), "S2": 0.0}
    tie = spark.createDataFrame([(1, "S2", 0.5), (1, "S1", 0.5), (2, "a", 0.9), (2, "b", 0.1)], "ep long, candidate string, score double")
    assert rows(fuse.margins(tie, ["ep"])) == [(1, "S1", 0.0), (2, "a", pytest.approx(0.8))]


def test_resolver(spark):
    attrs = "gender string, age_band string, timbre string"
    clusters = spark.createDataFrame([(1, "A1", "male", "adult", "deep"), (1, "A2", "female", "adult", "soft"), (1, "A3", "unknown", "unknown", "unknown")], f"ep long, cluster_id string, {attrs}")
    slots = spark.createDataFrame([(1, "S1", "male", "teen", "deep", "P1", "approved"), (1, "S2", "female", "unknown", "sharp", "P2", "approved")], f"ep long, slot_id string, {attrs}, visual_label string, status string")
    votes = spark.createDataFrame([(1, "A1", "P1", 3)], "ep long, cluster_id string, label string, votes long")
    clips = spark.createDataFrame([(1, 5, True)], "ep long, clips long, usable boolean")
    none = spark.createDataFrame([], "ep long, cluster_id string, slot_id string")
    got = {r["cluster_id"]: (r["slot_id"], r["matched_via"]) for r in fuse.resolve(clusters, slots, votes, clips, none, none).collect()}
    assert got == {"A1": ("S1", "approved_slot"), "A2": ("S3", "new_slot"), "A3": ("S4", "new_slot")}
    signed = spark.createDataFrame([(1, "A2")], "ep long, cluster_id string")
    barred = spark.createDataFrame([(1, "A1", "S1")], "ep long, cluster_id string, slot_id string")
    got = {r["cluster_id"]: (r["slot_id"], r["matched_via"]) for r in fuse.resolve(clusters, slots, votes, clips, barred, signed).collect()}
    assert got["A1"][1] == "new_slot" and got["A2"][1] == "human_signoff"


def test_vocatives():
    assert vocative.positions_in("茉里，你听我说", "茉里") == ["start"]
    assert vocative.positions_in("我知道了，茉里", "茉里") == ["end"]
    assert vocative.positions_in("好，茉里，走", "茉里") == ["mid"]
    assert vocative.positions_in("茉里！", "茉里") == [] and vocative.positions_in("茉里子，来", "茉里") == []


def test_label_taxonomy(spark):
    kinds = {"旁白": "generic", "路人（男）": "generic", "王子的声音": "descriptive", "凉音": "name", "老年男人": "descriptive", "SPEAKER_00A": "provisional", "": "descriptive", "茉里": "name"}
    df = spark.createDataFrame([(k,) for k in kinds], "label string")
    assert {r[0]: r[1] for r in df.select("label", labels.classify(F.col("label"))).collect()} == kinds
    known = F.array(F.lit("茉里"), F.lit("菈菈"), F.lit("菈菈子"))
    traced = {"茉里": "茉里", "茉里（笑）": "茉里", "菈菈与妈妈": "菈菈", "茉里南": None, "菈菈子们": "菈菈子", "x": None}
    df = spark.createDataFrame([(k,) for k in traced], "label string")
    assert {r[0]: r[1] for r in df.select("label", labels.trace(F.col("label"), known)).collect()} == traced


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    split = lambda s: tuple(one(text.speaker_prefix(F.lit(s))))
    assert split("【罗温】你好") == ("罗温", "你好") and split("罗温: 你好") == ("罗温", "你好") and split("(旁白) 很久") == ("旁白", "很久")
    assert split("(叹气)") == (None, "(叹气)") and split("http://x") == (None, "http://x") and split("12:30 见") == (None, "12:30 见") and split("(旁白)") == ("旁白", "")
    codes = {"01:02:03,5": 3723500, "00:00:01.234": 1234, "01:02.5": 62005, "7": 0, "1:2:3": 3723000}
    assert {s: one(time.parse_timecode(F.lit(s))) for s in codes} == codes
    assert one(time.timecode(F.lit(3723045))) == "01:02:03.045" and one(time.half_even_ms(F.lit(0.0025))) == 2
    seconds = {"1:30": 90.0, "90.2": 90.2, "1:0:1": None, "x": None, "-1": None, "200": None}
    assert {s: one(time.flexible_seconds(F.lit(s), F.lit(90.0))) for s in seconds} == seconds
    assert one(text.enum_value(F.lit(" Young Adult"), "age_band")) == "young_adult" and one(text.enum_value(F.lit("calm"), "timbre")) == "unknown"
    assert one(text.av_relationship(F.lit("（想）"), F.lit(1), F.lit(1))) == "INTERNAL_MONOLOGUE" and one(text.av_relationship(F.lit("a"), F.lit(5), F.lit(10))) == "OFF_SCREEN"
    assert one(text.text_agreement(F.lit("你好，世界！"), F.lit("你好世界"))) is True and one(text.text_agreement(F.lit(""), F.lit("a"))) is None


def test_splice_and_violations(spark):
    c = spark.createDataFrame([(1, i, f"line {i}") for i in range(1, 5)], "ep long, cue long, text string").withColumn("sub", F.col("cue"))
    expected = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4)], "ep long, scene long, sub long")
    good = spark.createDataFrame([(1, 1, "**A**：[[SUB:1]]\n[[SUB:2]]"), (1, 2, "x [[SUB:3]] y [[SUB:4]]")], "ep long, scene long, text string")
    assert splice.violations(good, expected, c).count() == 0
    assert rows(splice.spliced(good, c)) == [(1, 1, "**A**：line 1\nline 2"), (1, 2, "x line 3 y line 4")]
    bad = spark.createDataFrame([(1, 1, "[[SUB:2]] [[SUB:1]] [[SUB:1]] [[SUB:3]]"), (1, 2, "[[SUB:9]]")], "ep long, scene long, text string")
    assert {(r["scene"], r["rule"], r["sub"]) for r in splice.violations(bad, expected, c).collect()} == {(1, "disorder", 1), (1, "duplicate", 1), (1, "foreign", 3), (2, "unknown", 9), (2, "missing", 3), (2, "missing", 4)}


def test_attribution_audit(spark):
    drafts = spark.createDataFrame([(1, 1, "**内景**\n**罗温**：[[SUB:1]]\n**路人（男）**：[[SUB:2]]\n**罗温**（笑）：[[SUB:3]]"), (2, 1, "**内景**\n**罗温**：[[SUB:1]] <!-- attribution-override: line 1 -->")], "ep long, scene long, text string")
    talk = spark.createDataFrame([(1, 1, 1, "SPEAKER_A1"), (1, 1, 2, "SPEAKER_A1"), (1, 1, 3, "SPEAKER_A2"), (2, 1, 1, "SPEAKER_A2")], "ep long, scene long, sub long, speaker string")
    clusters = spark.createDataFrame([(e, f"SPEAKER_A{i}", f"S{i}", "approved" if i == 1 else "pending", None) for e in (1, 2) for i in (1, 2)], "ep long, cluster_id string, slot_id string, status string, entity_id string")
    slots = spark.createDataFrame([(1, "S1", "E1"), (2, "S1", "E1")], "ep long, slot_id string, slot_entity string")
    entities = spark.createDataFrame([("E1", "罗温", ["阿罗"])], "entity_id string, canonical_name string, aliases array<string>")
    names = splice.lineage(clusters, slots, entities)
    assert {r["surface"] for r in names.collect()} == {"罗温", "阿罗"}
    assert [(r["ep"], r["sub"], r["cluster_id"], r["expected"]) for r in splice.audit(drafts, talk, clusters, names).collect()] == [(1, 3, "SPEAKER_A2", None)]


def test_stream_selection(spark):
    make = lambda *r: streams.select_stream(spark.createDataFrame([(1, i, *x) for i, x in enumerate(r)], "ep long, index long, language string, title string, forced int")).first()
    assert make(("eng", "", 0), ("chi", "Signs & Songs", 0), ("zho", "Full", 0))["index"] == 2
    assert make(("eng", "", 1), ("jpn", "", 0))["reason"] == "first_non_sign" and make(("chi", "forced", 0))["reason"] == "last_resort"


def test_walls_rise_strictly(spark):
    s = shots(spark, *[(i * 40_000, (i + 1) * 40_000) for i in range(6)])
    c = cues(spark, (55000, 58000), (62000, 65000))
    seq = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 2)], "ep long, seq long, start_sub long, end_sub long")
    got = segment.snap_walls(segment.walls(seq, c), segment.boundaries(s)).first()
    assert (got["boundary"], got["within"]) == (0, False) and got["distance_ms"] > 15_000


def test_agreement_takes_whole_texts(spark, tmp_path):
    from spanlake.plans import catalogue

    same, x, y = "the same start " * 8, "abcdefg " * 60, "1234567 " * 60
    spark.createDataFrame([(1, 0, "user", same + x), (1, 1, "system", same + y)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in catalogue.QUERIES["text_agreement"](spark, str(tmp_path)).collect()] == [(1, 0, False)]
