"""The catalogue of queries over the timeline operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text, time
from ..operators import align, attribute, fuse, interval, notes, segment, splice, streams, vocative, windows
from ..sources import replies
from ..sources import testdata as td
from ..streaming import sessions
from . import oracles, registry

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    if (sql := oracles.SQL.get(f.__name__)) is not None:
        ORACLES[f.__name__] = sql
    return f


def clustered(spark, d) -> DataFrame:
    """Turns with the cluster of their label, without the linking of parts: part and label name it."""
    rows = td.turns(spark, d)
    return rows.withColumn("cluster_id", F.concat(F.lit("SPEAKER_A"), (F.col("part") * 4 + F.substring("raw_label", -1, 1).cast("int") + 1).cast("string")))


def bound(spark, d) -> DataFrame:
    cues = td.cues(spark, d)
    return attribute.bind(cues, clustered(spark, d)).join(cues.select("ep", "cue", "speaker"), ["ep", "cue"])


# alignment ------------------------------------------------------------------


@query
def cue_shot_assign(spark, d):
    return align.assign_cues(td.cues(spark, d), td.shots(spark, d))


@query
def cue_scene_counts(spark, d):
    return align.cues_per_scene(td.cues(spark, d), align.scenes_of(td.shots(spark, d), 5))


@query
def cue_relations(spark, d):
    rows = align.aligned(td.cues(spark, d), td.shots(spark, d))
    return rows.select("ep", "cue", "pos", "overlap", "relation")


@query
def aligned_shot_summary(spark, d):
    shots = td.shots(spark, d)
    return align.shot_summary(align.aligned(td.cues(spark, d), shots), shots)


@query
def timeline_totals(spark, d):
    shots = td.shots(spark, d)
    rows = align.shot_summary(align.aligned(td.cues(spark, d), shots), shots)
    return rows.groupBy("ep").agg(F.count(F.lit(1)).alias("shots"), F.count_if(F.col("mode") == "SILENCE").alias("silent_shots"), F.count_if("has_offscreen").alias("offscreen_shots"), F.sum("dialogue_count").alias("cues"))


@query
def relation_statistics(spark, d):
    shots = td.shots(spark, d)
    rows = align.aligned(td.cues(spark, d), shots)
    counted = rows.groupBy(F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    silent = align.shot_summary(rows, shots).agg(F.lit("SILENT_ACTION").alias("kind"), F.count_if(F.col("mode") == "SILENCE").alias("n"))
    return counted.unionByName(silent)


@query
def speaker_segment_lookup(spark, d):
    cues = td.cues(spark, d).withColumn("speaker", F.when(F.col("speaker") == "click", F.lit(None)).when(F.col("speaker") == "view", "SPEAKER_UNKNOWN").otherwise(F.col("speaker")))
    segments = td.turns(spark, d).filter("part = 0").select("ep", F.col("event_id").alias("pos"), F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms"), F.col("raw_label").alias("seg_speaker"))
    return align.lookup_speakers(cues, segments)


# attribution ----------------------------------------------------------------


@query
def cue_cluster_bind(spark, d):
    return attribute.bind(td.cues(spark, d), clustered(spark, d))


@query
def lag_estimate(spark, d):
    return attribute.estimate_lag(td.cues(spark, d), td.turns(spark, d).filter("part = 0"))


@query
def cue_cluster_bind_lagged(spark, d):
    cues, turns = td.cues(spark, d), clustered(spark, d)
    lag = attribute.estimate_lag(cues, turns.filter("part = 0"))
    return attribute.bind(cues.join(lag, "ep"), turns, "offset_ms").select("ep", "cue", "cluster_id", "overlap_ms")


@query
def cluster_components(spark, d):
    return attribute.label_components(td.turns(spark, d))


@query
def cluster_name_vote(spark, d):
    return attribute.name_votes(bound(spark, d))


@query
def name_manifest(spark, d):
    return attribute.name_votes(bound(spark, d)).filter("name is not null").groupBy("ep", "name").agg(F.sum("line_count").alias("lines"))


@query
def cluster_summary(spark, d):
    return attribute.cluster_summary(bound(spark, d), clustered(spark, d))


def attributed(spark, d) -> DataFrame:
    k = F.pmod("event_id", F.lit(7))
    return clustered(spark, d).withColumns({
        "gender": F.when(k < 3, "male").when(k < 5, "female").otherwise("unknown"),
        "age_band": F.when(k < 4, "adult").otherwise("unknown"),
        "timbre": F.when(F.pmod("event_id", F.lit(2)) == 0, "soft").otherwise("deep"),
    })


@query
def attribute_vote(spark, d):
    return attribute.attribute_votes(attributed(spark, d), fuse.FIELDS, ["ep", "cluster_id"])


@query
def attribute_compliance(spark, d):
    rows = attributed(spark, d)
    told = rows.groupBy("ep").agg(*[F.count_if(F.col(f) != "unknown").alias(f) for f in fuse.FIELDS], F.count(F.lit(1)).alias("turns"))
    return told.withColumn("rate", sum((F.col(f) for f in fuse.FIELDS), F.lit(0)) / (F.col("turns") * len(fuse.FIELDS)))


@query
def diarization_totals(spark, d):
    rows = bound(spark, d)
    return rows.groupBy("ep").agg(F.count(F.lit(1)).alias("cues"), F.countDistinct("cluster_id").alias("clusters"), F.count_if(F.col("cluster_id").isNull()).alias("unattributed"), F.count_if(F.col("secondary_speaker").isNotNull()).alias("shared"), F.countDistinct("speaker").alias("speakers"))


# windows and plans ----------------------------------------------------------


@query
def oped_filter_kept(spark, d):
    kept, _ = windows.split_by_windows(td.cues(spark, d), td.WINDOWS)
    return kept.select("ep", "cue", "index")


@query
def oped_filter_removed(spark, d):
    _, removed = windows.split_by_windows(td.cues(spark, d), td.WINDOWS)
    return removed.groupBy("ep", "label").agg(F.count(F.lit(1)).alias("removed"))


def durations(spark, d, scale: int = 1) -> DataFrame:
    return td.base(spark, d).groupBy("ep").agg((F.max("t") * scale).alias("duration_ms"))


@query
def segment_plan(spark, d):
    return windows.plan_segments(align.scenes_of(td.shots(spark, d, 10**9), 5))


@query
def short_scenes(spark, d):
    return td.shots(spark, d).filter(F.col("r_end_ms") - F.col("r_start_ms") < 1500).select("ep", "pos")


@query
def chunk_plan(spark, d):
    return windows.plan_chunks(durations(spark, d, 5))


@query
def greedy_min_gap(spark, d):
    return windows.thin_cuts(td.base(spark, d).select("ep", F.col("t").alias("at")), 30_000)


@query
def cuts_to_shots(spark, d):
    cuts = td.base(spark, d).select("ep", F.col("t").alias("at")).distinct()
    return windows.cuts_to_shots(cuts, durations(spark, d).withColumn("duration_ms", F.col("duration_ms") + 5000))


@query
def even_sample(spark, d):
    return windows.even_sample(td.shots(spark, d), 12).select("ep", "pos")


@query
def coverage_union(spark, d):
    scenes = align.scenes_of(td.shots(spark, d, 10**9), 5)
    acts = td.actions(spark, d).select("ep", F.col("action").alias("cue"), F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms"))
    from ..operators.interval import interval_join

    pieces = interval_join(acts, scenes, ["ep"]).select("ep", "pos", "start_ms", "end_ms")
    return windows.coverage(scenes, pieces)


@query
def stream_select(spark, d):
    rows = td.table(spark, d, "events").select(
        F.floor(F.col("event_id") / 4).cast("long").alias("ep"), F.col("event_id").alias("index"),
        F.element_at(F.array(*map(F.lit, ["eng", "chi", "jpn", "zho", "fre"])), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("language"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "Signs & Songs").when(F.pmod("event_id", F.lit(3)) == 1, "Full").otherwise(None).alias("title"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, 1).otherwise(0).alias("forced"),
    )
    return streams.select_stream(rows)


# segmentation ---------------------------------------------------------------


@query
def boundary_features(spark, d):
    return segment.features(td.cues(spark, d), segment.boundaries(td.shots(spark, d)))


@query
def protected_boundaries(spark, d):
    return segment.protected(td.cues(spark, d), segment.boundaries(td.shots(spark, d)))


@query
def scene_segmentation(spark, d):
    shots, cues = td.shots(spark, d), td.cues(spark, d)
    cuts = segment.boundaries(shots)
    return segment.solve(shots, segment.features(cues, cuts), segment.protected(cues, cuts))


@query
def segmentation_check(spark, d):
    """Scenes partition an episode's shots: the sums agree with the shots'."""
    rows = scene_segmentation(spark, d)
    return rows.groupBy("ep").agg(F.min("first_pos").alias("first"), F.max("last_pos").alias("last"), F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("shots"), F.max(F.col("scene")).between(8, 35).alias("in_bounds"))


def sequences(spark, d) -> DataFrame:
    """Sequences of ten cues each."""
    seq = F.floor((F.col("cue") - 1) / 10).cast("long") + 1
    return td.cues(spark, d).groupBy("ep", seq.alias("seq")).agg(F.min("cue").alias("start_sub"), F.max("cue").alias("end_sub"))


@query
def sequence_walls(spark, d):
    return segment.snap_walls(segment.walls(sequences(spark, d), td.cues(spark, d)), segment.boundaries(td.shots(spark, d)))


@query
def outline_contiguity(spark, d):
    rows = sequences(spark, d).withColumn("end_sub", F.when(F.col("seq") % 3 == 0, F.col("end_sub") - 1).when(F.col("seq") % 5 == 0, F.col("end_sub") + 1).otherwise(F.col("end_sub")))
    return splice.outline_gaps(rows, td.cues(spark, d))


# identity -------------------------------------------------------------------


@query
def visual_votes(spark, d):
    return fuse.visual_votes(clustered(spark, d), td.actions(spark, d))


@query
def over_split(spark, d):
    return fuse.over_split(visual_votes(spark, d))


@query
def mouth_compliance(spark, d):
    return fuse.mouth_compliance(td.actions(spark, d))


def families(spark, d) -> DataFrame:
    votes = visual_votes(spark, d).select("ep", "cluster_id", F.lit("visual").alias("family"), F.col("label").alias("candidate"), F.col("votes").cast("double").alias("n"))
    heard = clustered(spark, d).groupBy("ep", "cluster_id", F.concat(F.lit("P"), F.pmod("event_id", F.lit(5)).cast("string")).alias("candidate")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("family", F.lit("acoustic"))
    counts = votes.unionByName(heard)
    unseen = counts.groupBy("ep", "cluster_id", "family").agg(F.lit(2.0).alias("u"))
    return fuse.distributions(counts, unseen, ["ep", "cluster_id"])


@query
def fusion_scores(spark, d):
    return fuse.fused(families(spark, d), ["ep", "cluster_id"]).withColumn("score", F.round("score", 9))


@query
def fusion_margin(spark, d):
    return fuse.margins(fuse.fused(families(spark, d), ["ep", "cluster_id"]), ["ep", "cluster_id"]).withColumn("margin", F.round("margin", 9))


# text -----------------------------------------------------------------------


@query
def timecodes(spark, d):
    rows = td.cues(spark, d)
    return rows.select("ep", "cue", time.timecode(F.col("end_ms")).alias("code"), time.parse_timecode(time.timecode(F.col("end_ms"))).alias("back"), time.clock(F.col("end_ms")).alias("clock"))


@query
def strip_tags(spark, d):
    return td.table(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query
def norm_text(spark, d):
    return td.table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.normal_form(F.col("text"))).alias("digest"))


@query
def speaker_prefix(spark, d):
    rows = td.lines(spark, d).withColumn("line", F.when(F.col("index") % 3 == 0, F.concat(F.lit("【"), F.col("speaker"), F.lit("】"), F.col("text"))).when(F.col("index") % 3 == 1, F.concat(F.col("speaker"), F.lit("："), F.col("text"))).otherwise(F.concat(F.lit("(music)"), F.col("text"))))
    return rows.select("ep", "index", text.speaker_prefix(F.col("line")).alias("x")).select("ep", "index", "x.speaker", F.md5("x.text").alias("digest"))


@query
def text_agreement(spark, d):
    rows = td.lines(spark, d)
    pairs = rows.withColumn("other", F.lead("text").over(Window.partitionBy("ep").orderBy("index"))).filter("other is not null")
    return pairs.select("ep", "index", text.text_agreement(F.col("text"), F.col("other")).alias("agree"))


LABELS = ["旁白", "王子的声音", "威严之声", "路人（男）", "SPEAKER_A1", "凉音", "老年男人", "茉里", "茉里与妈妈", "菈菈、店员", "", "茉里南", "神秘老者", "家人们"]
KNOWN = ["茉里", "菈菈", "罗温"]


@query
def label_taxonomy(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod("event_id", F.lit(len(LABELS))) + 1).cast("int"))
    return td.table(spark, d, "events").groupBy(label.alias("label"), labels.classify(label).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_trace(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod("event_id", F.lit(len(LABELS))) + 1).cast("int"))
    return td.table(spark, d, "events").groupBy(label.alias("label"), labels.trace(label, F.array(*map(F.lit, KNOWN))).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


def called(spark, d) -> DataFrame:
    rows = td.lines(spark, d).withColumn("cluster_id", F.when(F.col("speaker") != "system", F.col("speaker")))
    names = rows.select("ep").distinct().select("ep", F.explode(F.array(*map(F.lit, ["is", "der", "la", "thing"]))).alias("term"))
    return vocative.address_events(rows, names)


@query
def vocative_events(spark, d):
    return called(spark, d).groupBy("ep", "index", "cluster_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query
def not_speaker(spark, d):
    return vocative.not_speaker(called(spark, d))


@query
def histogram_distance(spark, d):
    rows = td.table(spark, d, "embeddings")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    unit = rows.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) / size).alias("h"))
    other = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return unit.join(other, "vec_id").select("vec_id", F.round(text.histogram_distance(F.col("h"), F.col("g")), 6).alias("distance"))


# drafts ---------------------------------------------------------------------


def scripted(spark, d):
    """(drafts, expected, cues): conversations as scenes of one placeholder a turn, with planted faults."""
    rows = td.lines(spark, d).select("ep", F.lit(1).cast("long").alias("scene"), (F.col("index") + 1).cast("long").alias("sub"), "speaker", "text")
    mark = F.concat(F.lit("[[SUB:"), F.when((F.col("ep") % 7 == 3) & (F.col("sub") == 2), F.lit(1)).when((F.col("ep") % 11 == 5) & (F.col("sub") == 1), F.lit(900)).otherwise(F.col("sub")).cast("string"), F.lit("]]"))
    line = F.concat(F.lit("**"), F.col("speaker"), F.lit("**："), mark)
    drafts = rows.groupBy("ep", "scene").agg(F.concat(F.lit("**INT**｜room\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))
    return drafts, rows.select("ep", "scene", "sub"), rows.select("ep", "sub", F.col("sub").alias("cue"), "text", "speaker", "scene")


@query
def placeholder_check(spark, d):
    drafts, expected, cues = scripted(spark, d)
    return splice.violations(drafts, expected, cues)


@query
def splice_text(spark, d):
    drafts, _, cues = scripted(spark, d)
    return splice.spliced(drafts, cues).select("ep", "scene", F.md5("text").alias("digest"))


@query
def head_of_placeholder(spark, d):
    return splice.heads_of(scripted(spark, d)[0])


def cast(spark, d):
    """Clusters, slots and entities of conversations: user is signed to E1, assistant to nobody."""
    eps = td.lines(spark, d).select("ep", F.col("speaker").alias("cluster_id")).distinct()
    clusters = eps.select("ep", "cluster_id", F.when(F.col("cluster_id") == "user", "S1").otherwise("S2").alias("slot_id"), F.when(F.col("cluster_id") == "user", "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("entity_id"))
    slots = eps.select("ep").distinct().select("ep", F.lit("S1").alias("slot_id"), F.lit("E1").alias("slot_entity"))
    entities = spark.sql("SELECT 'E1' AS entity_id, 'assistant' AS canonical_name, array('helper', ' aide ', '') AS aliases")
    return clusters, slots, entities


@query
def lineage_names(spark, d):
    return splice.lineage(*cast(spark, d))


@query
def attribution_audit(spark, d):
    drafts, _, cues = scripted(spark, d)
    clusters, slots, entities = cast(spark, d)
    names = splice.lineage(clusters, slots, entities)
    waived = F.when(F.col("ep") % 4 == 1, F.concat("text", F.lit("\n<!-- attribution-override: lines 1, 3 -->"))).otherwise(F.col("text"))
    drafts = drafts.withColumn("text", waived)
    return splice.audit(drafts, cues.select("ep", "scene", "sub", "speaker"), clusters, names)


@query
def evidence_pack(spark, d):
    """A row a scene: its shots, cues, acts, covered time and exclusion label."""
    shots, cues = td.shots(spark, d), td.cues(spark, d)
    scenes = align.scenes_of(shots, 5)
    pack = scenes.join(align.cues_per_scene(cues, scenes), ["ep", "pos"], "left").join(coverage_union(spark, d), ["ep", "pos"], "left")
    return pack.withColumn("label", windows.window_label(F.col("r_start_ms"), F.col("r_end_ms"), td.WINDOWS)).select("ep", "pos", "r_start_ms", "r_end_ms", "shots", "cue_count", "covered_pct", "label")


# notes, replies, sessions -----------------------------------------------------


def observed(spark, d) -> DataFrame:
    """Notes of one segment an event, in shapes that drift."""
    rows = td.base(spark, d).filter(F.col("event_type") == "error")
    k = F.pmod("event_id", F.lit(4))
    entry = F.format_string('{"%s": "%s", "end": %s, "who": "P%d", "what": "w%d", "mouth_state": "%s", "mouth_motion": "speaking"}', F.when(k == 0, "start").when(k == 1, "start_time").when(k == 2, "from").otherwise("begin"), F.when(k == 0, "1.5").when(k == 1, "0:02").otherwise("3"), F.when(k == 2, F.lit("99")).otherwise("4.25"), F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(3)), F.when(F.pmod("event_id", F.lit(2)) == 0, "Moving").otherwise("odd"))
    raw = F.concat(F.lit('{"visual": {"caption": "", "actions": ['), entry, F.lit(']}, "visible_text": [{"from": "1", "text": "t"}, {"start": "2", "content": "u", "to": "9999"}]}'))
    return rows.select("ep", F.col("event_id").alias("segment"), F.col("t").alias("start_ms"), (F.col("t") + 5000).alias("end_ms"), raw.alias("raw"))


@query
def note_entries(spark, d):
    return notes.entries(observed(spark, d)).select("ep", "segment", "channel", "ok", "start", "end", "who", "what", "mouth_state")


@query
def note_drops(spark, d):
    return notes.dropped(notes.entries(observed(spark, d)))


@query
def note_dedup(spark, d):
    rows = notes.entries(observed(spark, d)).filter("ok").withColumn("scene", F.floor(F.col("start") / 60_000))
    return notes.deduplicate(rows.select("ep", "scene", "segment", "pos", "start", "end", "who", "what"))


@query
def audio_encodings(spark, d):
    rows = td.table(spark, d, "events").select("event_id", (F.col("event_id") % 5000).cast("double").alias("s"), (F.col("event_id") * 3000).alias("raw"))
    return rows.select("event_id", replies.audio_encoding(F.col("s"), F.col("raw")).alias("encoding"))


@query
def overlapped_windows(spark, d):
    rows = td.table(spark, d, "events").select(F.col("user_id").alias("ep"), F.col("ts").cast("timestamp").alias("ts"))
    epoch = F.unix_micros(F.expr("CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' AS TIMESTAMP)"))
    return sessions.overlapped_counts(rows).select("ep", (F.unix_micros("start") - epoch).alias("start_us"), "events")


@query
def unfinished_work(spark, d):
    """Parts still to be run: those without an output, or with an invalid one."""
    rows = td.table(spark, d, "events")
    done = rows.filter("event_id % 3 > 0").select("event_id", (F.col("event_id") % 5 > 0).alias("valid"))
    return sessions.unfinished(rows, done, ["event_id"]).select("event_id")


@query
def scene_manifest(spark, d):
    """A row a scene of all that the writer is given: its label, cues, seen acts, pictures, and whether it has a draft."""
    from .files import scene_table
    from .stage import keyframe_samples

    scenes = scene_table(spark, d, 20)
    count = lambda rows, name: rows.groupBy("ep", "scene").agg(F.count(F.lit(1)).alias(name))
    said = interval.best_overlap(td.cues(spark, d), scenes.withColumnRenamed("scene", "pos"), 0).withColumnRenamed("pos", "scene")
    seen = interval.interval_join(td.actions(spark, d).select("ep", F.col("r_start_ms").alias("start_ms"), F.col("r_end_ms").alias("end_ms")), scenes, ["ep"])
    rows = scenes.withColumn("label", windows.window_label(F.col("r_start_ms"), F.col("r_end_ms"), td.WINDOWS))
    for part, name in ((said, "cues"), (seen, "acts"), (keyframe_samples(spark, d), "pictures")):
        rows = rows.join(count(part, name), ["ep", "scene"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.select("ep", "scene", "label", "cues", "acts", "pictures", ((F.col("ep") + F.col("scene")) % 3 > 0).alias("written"))


@query
def violation_messages(spark, d):
    """The first few placeholders at fault under each rule, as a message lists them."""
    rows = placeholder_check(spark, d)
    first = F.slice(F.sort_array(F.collect_list("sub")), 1, 12)
    return rows.groupBy("ep", "rule").agg(F.array_join(first.cast("array<string>"), ", ").alias("listed"), F.count(F.lit(1)).alias("n"))


@query
def embedded_choice(spark, d):
    """The stream to take from each file, of what its probe lists."""
    from ..sources import connectors

    e = F.col("event_id")
    lang = F.element_at(F.array(*map(F.lit, ["eng", "chi", "zho"])), (e % 3 + 1).cast("int"))
    one = F.concat(F.lit('{"index": '), e.cast("string"), F.lit(', "codec_type": "'), F.when(e % 4 == 0, "audio").otherwise("subtitle"), F.lit('", "tags": {"language": "'), lang, F.lit('", "title": "'), F.when(e % 5 == 0, "Signs").otherwise(""), F.lit('"}, "disposition": {"forced": '), F.when(e % 7 == 0, "1").otherwise("0"), F.lit("}}"))
    probes = td.table(spark, d, "events").select(F.floor(e / 6).cast("long").alias("id"), e.alias("o"), one.alias("s")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "s"))).alias("l"))
    report = F.concat(F.lit('{"streams": ['), F.array_join(F.transform("l", lambda x: x["s"]), ", "), F.lit("]}"))
    return streams.select_stream(connectors.subtitle_streams(probes.select("id", report.alias("report"))))


@query
def silence_sessions(spark, d):
    rows = td.table(spark, d, "events").select(F.col("user_id").alias("ep"), F.col("ts").cast("timestamp").alias("ts"))
    epoch = F.unix_micros(F.expr("CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' AS TIMESTAMP)"))  # wall-clock time, whatever the session's zone
    return sessions.silence_sessions(rows).select("ep", (F.unix_micros("start") - epoch).alias("start_us"), (F.unix_micros("end") - epoch).alias("end_us"), "events")


from . import files, papers, people, stage  # noqa: E402  registers its queries beside these

QUERIES |= registry.QUERIES
ORACLES |= registry.ORACLES
