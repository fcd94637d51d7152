"""Human sign-off of identities: pending slots, candidates, and the versioned entity table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(slots: DataFrame) -> DataFrame:
    """Slots (ep, slot_id, ord, ...) still to be named, each once: the first by ord."""
    first = F.row_number().over(Window.partitionBy("ep", "slot_id").orderBy("ord"))
    return slots.withColumn("_n", first).filter("_n = 1 and status <> 'approved'").drop("_n")


def page(rows: DataFrame, number: int, size: int = 4) -> DataFrame:
    """The rows of one round, ``size`` an episode, by ord; slots of the same ord by slot_id, so that no round asks for another's."""
    at = F.row_number().over(Window.partitionBy("ep").orderBy("ord", "slot_id"))
    return rows.withColumn("_n", at).filter(F.col("_n").between(number * size + 1, (number + 1) * size)).drop("_n")


def candidates(labelled: Column, called: Column, ruled_out: Column, most: int = 3) -> Column:
    """Names to offer: entities whose face was seen, then called names by count; cut to three before ruled-out ones go."""
    return F.array_except(F.slice(F.array_distinct(F.concat(labelled, called)), 1, most), ruled_out)


def candidate_names(slots: DataFrame, entities: DataFrame, votes: DataFrame, calls: DataFrame, most: int = 3) -> DataFrame:
    """ep, slot_id, cluster_id, names: what to offer for the slots (ep, slot_id, cluster_id): entities whose face spoke with the cluster, in
    the table's order, then the names called in the episode, most often called first; without those the cluster called itself."""
    seen = votes.select("ep", "cluster_id", F.col("label").alias("visual_label")).join(entities.select("ep", "visual_label", "pos", "canonical_name"), ["ep", "visual_label"])
    in_order = lambda order, name: F.transform(F.array_sort(F.collect_list(F.struct(order, name.alias("name")))), lambda x: x["name"])
    seen = seen.groupBy("ep", "cluster_id").agg(in_order(F.col("pos").alias("o"), F.col("canonical_name")).alias("seen"))
    heard = calls.groupBy("ep", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("ep").agg(in_order((-F.col("n")).alias("o"), F.col("term")).alias("heard"))
    own = calls.groupBy("ep", "cluster_id").agg(F.collect_set("term").alias("own"))
    rows = slots.join(seen, ["ep", "cluster_id"], "left").join(heard, "ep", "left").join(own, ["ep", "cluster_id"], "left")
    none = F.array().cast("array<string>")
    return rows.select("ep", "slot_id", "cluster_id", candidates(F.coalesce("seen", none), F.coalesce("heard", none), F.coalesce("own", none), most).alias("names"))


def sheet(slots: DataFrame) -> DataFrame:
    """ep, sheet: the table that a person signs off, a line a slot in order (ep, ord, slot_id, gender, age_band, timbre, names, not_speaker,
    faces, trusted, reason)."""
    known = F.filter(F.array("gender", "age_band", "timbre"), lambda x: x.isNotNull() & (x != "") & (x != "unknown"))
    told = lambda listed, by, none: F.when(F.size(listed) > 0, F.array_join(listed, by)).otherwise(none)
    faces = F.when(F.size("faces") > 0, F.concat(F.lit("｜说话期间动嘴的画像："), F.array_join(F.slice("faces", 1, 3), "、"), F.when(F.col("trusted"), "").otherwise("（该信道未过 P3 遵从门，仅供你目视核对）"))).otherwise("")
    barred = F.when(F.size("not_speaker") > 0, F.concat(F.lit("（不是 "), F.array_join("not_speaker", "、"), F.lit("——这簇台词里在叫他们）"))).otherwise("")
    line = F.concat(
        F.lit("| "), "slot_id", F.lit(" | "), told(known, "；", "（无可用画像）"), faces, F.lit(" | "), told(F.col("names"), "／", "（无候选，建议保留描述性标签）"), barred, F.lit(" | "),
        F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("新出现")), F.lit(" |"),
    )
    head = "| 槽位 | 画像（机器给的证据） | 候选（最多 3 个） | 为什么需要你 |\n| :--- | :--- | :--- | :--- |"
    rows = slots.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return rows.select("ep", F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("sheet"))


def apply_round(entities: DataFrame, decisions: DataFrame, today: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """The entity table after a round: names met anew become entities, known ones gain a sign-off record.

    entities: entity_id, canonical_name, evidence array<struct<slot_id,cluster_id,workspace,date>>; decisions: ord, slot_id,
    cluster_id, workspace, name. A record is scoped to its workspace and written once for (workspace, slot, cluster). ``keys`` name
    the columns of both that tell tables of several series apart.
    """
    named = decisions.filter("name is not null and trim(name) <> ''").withColumn("name", F.trim("name"))
    record = F.struct("slot_id", "cluster_id", "workspace", today.cast("string").alias("date"))
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "name", "workspace", "slot_id", "cluster_id").orderBy("ord"))).filter("_n = 1")
    told = once.groupBy(*keys, "name").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(record)).alias("new"))
    joined = entities.withColumn("name", F.col("canonical_name")).join(told, [*keys, "name"], "full")
    key = lambda r: F.struct(r["slot_id"], r["cluster_id"], r["workspace"])
    old = F.coalesce("evidence", F.array().cast("array<struct<slot_id:string,cluster_id:string,workspace:string,date:string>>"))
    fresh = F.filter(F.coalesce("new", F.array().cast("array<struct<slot_id:string,cluster_id:string,workspace:string,date:string>>")), lambda r: ~F.exists(old, lambda o: key(o) == key(r)))
    known = F.count("entity_id").over(Window.partitionBy(*keys))
    number = F.sum(F.col("entity_id").isNull().cast("int")).over(Window.partitionBy(*keys).orderBy(F.col("entity_id").isNotNull().desc(), "ord").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("all", F.concat(old, fresh)).select(
        *keys, F.coalesce("entity_id", F.concat(F.lit("C"), (known + number).cast("string"))).alias("entity_id"), F.col("name").alias("canonical_name"), F.col("all").alias("evidence")
    )


def append_version(history: DataFrame, diff: DataFrame, today: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """history (keys, version, date, diff) with one more version of each series that lists the round's changes (slot_id, change, name)."""
    entry = diff.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot_id", "change", "name"))).alias("diff"))
    count = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = entry.join(count, list(keys), "left") if keys else entry.withColumn("k", F.lit(1)).join(count.withColumn("k", F.lit(1)), "k")  # without keys one row each
    return history.unionByName(both.select(*keys, (F.coalesce("n", F.lit(0)) + 1).cast("string").alias("version"), today.cast("string").alias("date"), "diff"))


def changes(entities: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, slot_id, change, name: what a round does, a line a decision: a new entity for the first that names it, else a link."""
    named = decisions.filter("name is not null and trim(name) <> ''").withColumn("name", F.trim("name"))
    marked = named.join(entities.select(*keys, F.col("canonical_name").alias("name"), F.lit(True).alias("known")), [*keys, "name"], "left")
    first = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("ord")) == 1
    return marked.select(*keys, "slot_id", F.when(F.col("known").isNull() & first, "new_entity").otherwise("linked_existing").alias("change"), "name")


# replies ----------------------------------------------------------------------------------------------------

# How replies refer to slots, and words that agree or pass.
REFERENCE = re.compile(r"(?<![A-Za-z0-9])S(\d+)(?![0-9])")
ASSIGNED = re.compile(r"S(\d+)\s*[=＝:：]\s*([^\s，,;；]+)")
ORDER = ["第一", "第二", "第三", "第四", "第五", "第六", "第七", "第八", "第九", "第十"]
PASS = ["跳过", "不知道", "略", "skip", "待定"]
PASS_ALL = ["剩下的跳过", "都跳过", "全部跳过"]
AGREE = ["对", "是", "确认", "ok", "yes", "保持", "对的", "没问题"]
AGREEING = "对是确认保持跳过好的行可以嗯哦啊呢吧哈没问题yesok"
WITHIN = 24


def value_after(text: str, at: int) -> str:
    """What a reply says right after a reference that ends at ``at``: up to the first stop, at most 24 characters."""
    tail = text[at : at + WITHIN].strip(" 。,，：:")
    for stop in "，,；; 。":
        if tail.find(stop) > 0:
            tail = tail[: tail.find(stop)]
            break
    return tail.strip("「」\"'（）()】")


def judged(value: str, offered: list[str], known: list[str]) -> tuple[str, str | None]:
    """(outcome, name) of one answer: accept a name that was offered, skip what merely agrees or passes, else ask to confirm."""
    if value in offered and value:
        return "accept", value
    if len(value) < 2 or set(value) <= set(AGREEING) or "描述性" in value or any(w in value for w in PASS):
        return "skip", None
    inside = [x for x in offered if x and x in value]
    if len(inside) == 1:
        return "accept", inside[0]
    told = [x for x in known if x and x in value]
    return "confirm", told[0] if len(told) == 1 else value


def decisions_of(reply: str | None, offered: dict[str, list[str]], known: list[str]) -> list[tuple[str | None, str, str | None]]:
    """(slot, outcome, name) told by a reply in plain words; slots and what they were offered, in the order shown.

    Outcomes: accept, skip, confirm (a name that nobody proposed), ambiguous (a place in the order instead of a slot), unknown_slot, and unparsed,
    which stands alone. A name is only ever accepted if it was offered.
    """
    text = (reply or "").strip()
    answers = {f"S{m[1]}": m[2].strip("。.！!") for m in ASSIGNED.finditer(text)}
    for m in REFERENCE.finditer(text):
        slot = f"S{m[1]}"
        if slot not in answers:
            said = value_after(text, m.end())
            if said or any(w in text[m.end() : m.end() + 12] for w in AGREE):
                answers[slot] = said
    out = [(slot, *judged(value, offered[slot], known)) if slot in offered else (slot, "unknown_slot", value) for slot, value in answers.items()]
    if not REFERENCE.search(text):
        place = next((i for i, w in enumerate(ORDER) if w in text and i < len(offered)), None)
        if place is not None:
            out.append((list(offered)[place], "ambiguous", None))
    if any(w in text for w in PASS_ALL):
        settled = {slot for slot, outcome, _ in out if outcome in ("accept", "skip")}
        out += [(slot, "skip", None) for slot in offered if slot not in settled]
    return out or [(None, "unparsed", text or None)]


def reply_decisions(rows: DataFrame) -> DataFrame:
    """ep, slot_id, outcome, name of (ep, reply, slots array<struct<slot_id,names>>, known array<string>): dialogue, so it is read in Python."""

    @F.pandas_udf("array<struct<slot_id:string,outcome:string,name:string>>")
    def read(reply: pd.Series, slots: pd.Series, known: pd.Series) -> pd.Series:
        told = lambda r, s, k: [{"slot_id": a, "outcome": b, "name": c} for a, b, c in decisions_of(r, {x["slot_id"]: list(x["names"]) for x in s}, list(k))]
        return pd.Series([told(*x) for x in zip(reply, slots, known, strict=True)])

    return rows.select("ep", F.explode(read("reply", "slots", "known")).alias("x")).select("ep", "x.slot_id", "x.outcome", "x.name")
