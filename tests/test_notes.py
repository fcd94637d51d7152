import json

from pyspark.sql import functions as F

from spanlake.operators import notes, signoff
from spanlake.sources import replies
from spanlake.streaming import sessions


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_note_entries(spark):
    raw = {"visual": {"caption": " ", "actions": [{"start": 1.5, "end": "0:03", "who": "x", "what": "runs", "mouth": "MOVING", "motion": "sings"}, {"start": 95, "what": "late"}, "junk", {"start": 2}]}, "acoustic": {"events": [{"time": 1}, {"from": "2.2", "sound": "bang"}]}}
    table = spark.createDataFrame([(1, 1, 420_000, 510_000, json.dumps(raw)), (1, 2, 0, 1000, "{}"), (1, 3, 0, 1000, "not json")], "ep long, segment long, start_ms long, end_ms long, raw string")
    rows = notes.entries(table)
    good = [(r["channel"], r["start"], r["end"], r["who"], r["what"], r["mouth_state"], r["mouth_motion"]) for r in rows.filter("ok").orderBy("pos").collect()]
    assert good == [("actions", 421_500, 423_000, "x", "runs", "moving", "unknown"), ("acoustic_events", 422_200, 422_200, None, "bang", None, None)]
    assert {(r["channel"], r["dropped"]) for r in notes.dropped(rows).collect()} == {("actions", 3), ("acoustic_events", 1)}
    assert {r["segment"]: r["substance"] for r in notes.has_substance(table).collect()} == {1: True, 2: False, 3: False}


def test_repeats_across_segments(spark):
    data = [(1, 1, 1, 0, 0, 1000, "a", "opens the door"), (1, 1, 2, 0, 900, 2500, "a", "opens the door."), (1, 1, 3, 0, 2400, 2600, "a", "opens the  door"), (1, 1, 3, 1, 9000, 9100, "a", "opens the door"), (1, 2, 1, 0, 0, 1000, "a", "opens the door")]
    table = spark.createDataFrame(data, "ep long, scene long, segment long, pos long, start long, end long, who string, what string")
    assert sorted((r["scene"], r["segment"], r["pos"]) for r in notes.deduplicate(table).collect()) == [(1, 1, 0), (1, 3, 1), (2, 1, 0)]


def test_replies(spark):
    assert replies.find_json('so ```json\n{"a": [1, 2,],}\n``` ok') == '{"a":[1,2]}' and replies.find_json('x {"a": [1') is None and replies.find_json("none") is None
    assert one(spark, replies.json_in(F.lit('hm [1, {"b": "é"}] tail'))) == '[1,{"b":"é"}]'
    kinds = {'{"segments":[]}': "silent", "[]": "silent", '{"segments":[{"speaker":"a","start":1,"end":2}]}': "ok", '{"segments":[{"speaker":"a","start":2,"end":2}]}': "invalid", '{"x":1}': "invalid"}
    assert {k: one(spark, replies.reply_class(F.lit(k))) for k in kinds} == kinds
    fits = lambda s, raw: one(spark, replies.audio_encoding(F.lit(float(s)), F.lit(raw)))
    assert [fits(1, 5), fits(100, 10**8), fits(900, 10**8), fits(1440, 10**8), fits(9000, 10**8)] == ["passthrough", "wav", "mp3-64", "mp3-40", None]
    lines = [(1, 0, ": hi"), (1, 1, 'data: {"choices":[{"delta":{"content":"he"}}]}'), (1, 2, "data: broken"), (1, 3, 'data: {"choices":[{"delta":{"content":"y"},"finish_reason":"stop"}]}'), (1, 4, "data: [DONE]"), (1, 5, 'data: {"choices":[{"delta":{"content":"no"}}]}')]
    got = replies.folded(spark.createDataFrame(lines, "id long, pos long, line string")).first()
    assert (got["text"], got["finish"]) == ("hey", "stop")


def test_signoff(spark):
    kind = "array<struct<slot_id:string,cluster_id:string,workspace:string,date:string>>"
    entities = spark.createDataFrame([("C1", "罗温", [("S1", "A1", "ep1", "2020-01-01")])], f"entity_id string, canonical_name string, evidence {kind}")
    decisions = spark.createDataFrame([(1, "S1", "A1", "ep1", "罗温"), (2, "S2", "A2", "ep2", "罗温"), (3, "S3", "A3", "ep2", "菈菈"), (4, "S4", "A4", "ep2", " "), (5, "S3", "A3", "ep2", "菈菈")], "ord long, slot_id string, cluster_id string, workspace string, name string")
    got = {r["canonical_name"]: (r["entity_id"], len(r["evidence"])) for r in signoff.apply_round(entities, decisions, F.lit("2020-02-02")).collect()}
    assert got == {"罗温": ("C1", 2), "菈菈": ("C2", 1)}
    history = spark.createDataFrame([], "version string, date string, diff array<struct<slot_id:string,change:string,name:string>>")
    diff = spark.createDataFrame([("S3", "new_entity", "菈菈")], "slot_id string, change string, name string")
    twice = signoff.append_version(signoff.append_version(history, diff, F.lit("d")), diff, F.lit("d"))
    assert sorted(r["version"] for r in twice.collect()) == ["1", "2"]
    slots = spark.createDataFrame([(1, f"S{i}", i, "pending") for i in range(6)] + [(1, "S0", 9, "pending"), (1, "S9", 10, "approved")], "ep long, slot_id string, ord long, status string")
    assert signoff.pending(slots).count() == 6 and [r["slot_id"] for r in signoff.page(signoff.pending(slots), 1).orderBy("ord").collect()] == ["S4", "S5"]
    names = one(spark, signoff.candidates(F.array(F.lit("a")), F.array(*map(F.lit, "abcd")), F.array(F.lit("b"))))
    assert names == ["a", "c"]


def test_slots_of_the_same_ord_are_asked_once(spark):
    tied = spark.createDataFrame([(1, s, 1 + (s == "S2")) for s in ("S8", "S2", "S1")], "ep long, slot_id string, ord long").coalesce(1)
    for table in (tied, tied.orderBy("slot_id")):
        assert [[r["slot_id"] for r in signoff.page(table, k, 1).collect()] for k in range(3)] == [["S1"], ["S8"], ["S2"]]


def test_sessions_stream_like_batches(spark, tmp_path):
    rows = [(e, f"2024-01-0{d} 0{h}:00:00") for e in (1, 2) for d in (1, 2) for h in (0, 1, 7)]
    table = spark.createDataFrame(rows, "ep long, at string").select("ep", F.col("at").cast("timestamp").alias("ts"))
    table.write.parquet(f"{tmp_path}/in")
    batch = sorted(map(tuple, sessions.silence_sessions(table).collect()))
    assert len(batch) == 8
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = sessions.silence_sessions(stream, late="0 seconds").writeStream.format("memory").queryName("silence").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    query.awaitTermination(60)
    closed = sorted(map(tuple, spark.table("silence").collect()))
    assert closed and set(closed) <= set(batch)
    work = spark.createDataFrame([(1,), (2,), (3,)], "part long")
    done = spark.createDataFrame([(1, True), (2, False)], "part long, valid boolean")
    assert [r["part"] for r in sessions.unfinished(work, done, ["part"]).orderBy("part").collect()] == [2, 3]
