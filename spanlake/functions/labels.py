"""The taxonomy of speaker labels and tracing labels to known names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_space

# Labels of roles, shapes of descriptive labels, connectors after a known name.
GENERIC = """旁白 解说 画外音 众人 群臣 众侍 大家 路人 店员 摊主 店主 顾客 客人 司机 孩子 家人 家人们 长辈 少女 少年 同学
侍从 员工 工作人员 广播 广播员 广告 童声 呼声 合唱 神秘人物 女声 男声 姐姐 姐姐们 哥哥 父亲 母亲 奶奶 爷爷""".split()
VOICE_OF = r"^[^（）]{1,12}(的声音|之声)$"
SHAPE = (
    r"^[^（）()]{2,12}(的声音|之声|者|声|音|人|人物|男|女|青年|少年|少女|儿童|孩子|老人|老者|男人|女人|男生|女生|店员|摊主|店主|司机|学生|老师|"
    r"警官|士兵|机器人|主持|播报员|旁白|系统)$"
)
CONNECTORS = ["与", "和", "跟", "及", "、", "／", "/", "（", "(", " ", "们"]


def strip_qualifier(label: Column) -> Column:
    return strip_space(F.regexp_replace(label, r"(?U)[（(][^（）()]*[)）]\s*$", ""))


def split_head(head: Column) -> Column:
    parts = F.transform(F.split(strip_space(F.coalesce(head, F.lit(""))), "[、/／]"), strip_space)
    return F.filter(parts, lambda p: p != "")


def classify(label: Column) -> Column:
    token = strip_space(F.coalesce(label, F.lit("")))
    shaped = lambda p: p.rlike(VOICE_OF) | p.rlike(SHAPE)
    return (
        F.when(token == "", "descriptive")
        .when(token.rlike(r"^SPEAKER_[A-Z0-9]+$"), "provisional")
        .when(token.isin(GENERIC) | strip_qualifier(token).isin(GENERIC), "generic")
        .when(shaped(token) | F.exists(split_head(token), shaped), "descriptive")
        .otherwise("name")
    )


def trace(label: Column, known: Column) -> Column:
    """The known surface a label stands for: itself, itself without a qualifier, or the longest one it goes on from with
    a connector; null if none. ``known``: an array of the episode's names."""
    token = strip_space(F.coalesce(label, F.lit("")))
    bare = strip_qualifier(token)
    names = F.filter(F.transform(known, strip_space), lambda n: n != "")

    def headed(text: Column) -> Column:
        tail = lambda n: F.substr(text, F.length(n) + 1)
        joined = lambda n: (tail(n) == "") | _any([tail(n).startswith(c) for c in CONNECTORS])
        fits = F.filter(names, lambda n: (F.length(n) >= 2) & F.startswith(text, n) & joined(n))
        return F.array_max(F.transform(fits, lambda n: F.struct(F.length(n).alias("len"), n.alias("name"))))["name"]

    return F.when(token == "", None).when(F.array_contains(names, token), token).when((bare != "") & F.array_contains(names, bare), bare).otherwise(F.coalesce(headed(token), headed(bare)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cluster_token(token: Column) -> Column:
    return F.replace(F.upper(strip_space(token)), F.lit("SPEAKER_"), F.lit(""))
