import pytest

from spanlake.sources import subtitles


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿2\r\n00:00:05,000 --> 00:00:06,500\r\n<i>two</i>\r\nlines\r\n\r\n1\r\n00:00:01,000 --> 00:00:02,000\r\n【罗温】你好\r\n\r\n3\r\n00:00:09,000 --> 00:00:10,000\r\n\r\n".encode())
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nintro\n00:01.000 --> 00:02.500 align:start\nhello\n")
    (tmp_path / "c.ass").write_text("[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:03.00,0:00:04.50,Default,Rowan,0,0,0,,{\\an8}Hi, there\\Nyou\nDialogue: 0,0:00:01.00,0:00:02.00,Lala,,0,0,0,,Oh\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,茉里：走\n")
    return f"file://{tmp_path}"


def got(df):
    return [(r["index"], r["start_ms"], r["end_ms"], r["text"], r["speaker"]) for r in df.orderBy("index").collect()]


def test_srt(spark, folder):
    files = subtitles.whole_files(spark, f"{folder}/a.srt")
    assert got(subtitles.parse_srt(files)) == [(1, 1000, 2000, "你好", "罗温"), (2, 5000, 6500, "two lines", None)]


def test_vtt_with_named_cues(spark, folder):
    files = subtitles.whole_files(spark, f"{folder}/b.vtt")
    rows = got(subtitles.parse_srt(files))
    assert [(r[0], r[3]) for r in rows] == [(1, "hello")]
    assert subtitles.parse_srt(files, keep_named=False).count() == 0


def test_ass(spark, folder):
    rows = got(subtitles.parse_ass(subtitles.whole_files(spark, f"{folder}/c.ass")))
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [(1, 1000, "Oh", "Lala"), (2, 1500, "走", "茉里"), (3, 3000, "Hi, there you", "Rowan")]


def test_logs(spark):
    lines = spark.createDataFrame([(1, 0, "silence_end: 1.0"), (1, 1, "x silence_start: 2.0"), (1, 2, "silence_end: 4.0 | d"), (1, 3, "silence_start: 9.5")], "ep long, pos long, line string")
    assert [r["midpoint"] for r in subtitles.parse_silences(lines).collect()] == [3.0]
    cuts = spark.createDataFrame([(1, "n: 0 pts_time:1.5 x"), (1, "pts_time:-1"), (1, "none")], "ep long, line string")
    assert [r["at"] for r in subtitles.parse_cuts(cuts).collect()] == [1500]
