"""Preference formatting: chosen and rejected conversations to one shared prompt and two masked completions.

Only DataFrame functions. A conversation is an array of turns in order. The longest prefix of turns that are equal
in role and text in both is rendered once as the prompt; what follows, on each side, is that side's completion.
A mask is an array of spans (start, end, train) over the code points of the completion: only what assistants
say, and the end mark after it, is trained on.

Defined cases: a null role or text counts as the empty string; two equal conversations have empty completions;
a side without turns has an empty completion and an empty prompt; turns repeated at one index, whole rows among
them, all stay, ordered by role and text, so ties have one order; a turn without an index stands first. Rows without a
conv_id belong to no conversation and are left out; any other conv_id, the largest and negative ones too, is paired by whole-number arithmetic.
Long conversations cost little more a turn than short ones. An empty table gives no pairs; input columns named like the
added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CLOSE = "<|end|>\n"
#: turns whose sizes are summed one by one; sums of whole blocks of them stand for what lies before
BLOCK = 128


def gather(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text) -> (key, turns): the turns of a conversation, which is one document, in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def render_turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def shared_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns equal in both; counting stops at the first difference."""
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once; inside a lambda an expression is worked out for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def starts(sizes: Column) -> Column:
    """For an array of sizes the sum of those before each: sums of blocks first, then of the few before it in its block."""
    added = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)

    def spread(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / BLOCK).cast("int")), lambda b: added(F.slice(own, b * BLOCK + 1, BLOCK)))
        before = lambda sums: F.transform(sums, lambda _, b: added(F.slice(sums, 1, b)))
        place = lambda base: F.transform(own, lambda _, i: F.get(base, F.floor(i / BLOCK).cast("int")) + added(F.slice(own, i - i % BLOCK + 1, i % BLOCK)))
        return bound(bound(blocks, before), place)

    return bound(sizes, spread)


def mask(turns: Column, train_role: str = "assistant") -> Column:
    """Spans (start, end, train) over render(turns): header and body of each turn; only an assistant's body is trained."""
    head = lambda t: F.length(t["role"]) + 5  # noqa: E731  <|role|>\n
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    span = lambda a, b, train: F.struct(a.alias("start"), b.alias("end"), train.alias("train"))

    def spans(at: Column) -> Column:
        both = lambda t, a: F.array(span(a, a + head(t), F.lit(False)), span(a + head(t), a + head(t) + body(t), t["role"] == train_role))
        return F.flatten(F.zip_with(turns, at, both))

    return bound(starts(F.transform(turns, lambda t: head(t) + body(t))), spans)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), both arrays of turns -> prompt, completions and masks. Other columns stay."""
    n = shared_prefix(F.col("chosen"), F.col("rejected"))
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    pairs = pairs.withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none)).withColumn("prompt_turns", n)
    tail = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(c) - F.col("prompt_turns")))
    return pairs.withColumn("prompt", render(F.slice("chosen", 1, F.col("prompt_turns")))).withColumns(
        {f"{side}_{what}": make(tail(side)) for side in ("chosen", "rejected") for what, make in (("completion", render), ("mask", mask))}
    )


def pair_conversations(turns: DataFrame) -> DataFrame:
    """Conversations 2i and 2i+1 form pair i: the even one is chosen. A conversation without its partner has an empty one."""
    convs = gather(turns.filter("conv_id is not null")).withColumn("pair_id", F.shiftright(F.col("conv_id").cast("long"), 1))
    side = lambda odd: F.max(F.when(F.pmod("conv_id", F.lit(2)) == odd, F.col("turns")))
    return convs.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))


def told(spans: Column) -> Column:
    """A mask as text: start-end of each span, with a + where it is trained on."""
    one = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.when(s["train"], "+").otherwise(""))
    return F.array_join(F.transform(spans, one), ",")


def op3_preference_format(spark, sf_dir: str) -> DataFrame:
    pairs = format_preferences(pair_conversations(common.table(spark, sf_dir, "conversations")))
    trained = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.when(s["train"], s["end"] - s["start"]).otherwise(0)).cast("long")
    return pairs.select(
        "pair_id", "prompt_turns", "prompt", "chosen_completion", "rejected_completion",
        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"),
        told(F.col("chosen_mask")).alias("chosen_mask"), told(F.col("rejected_mask")).alias("rejected_mask"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         ((conv_id % 2) + 2) % 2 AS odd, (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
             coalesce(a.role = b.role AND a.text = b.text, false) AS same
      FROM (SELECT * FROM t WHERE odd = 0) a FULL JOIN (SELECT * FROM t WHERE odd = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
p AS (SELECT pair_id, CAST(coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS INTEGER) AS prompt_turns FROM m GROUP BY pair_id),
r AS (SELECT t.*, p.prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head, length(text) + 8 AS body
      FROM t JOIN p USING (pair_id)),
s AS (SELECT *, sum(CASE WHEN pos > prompt_turns THEN head + body ELSE 0 END) OVER (PARTITION BY pair_id, odd ORDER BY pos) - head - body AS beg,
             CASE WHEN role = 'assistant' THEN body ELSE 0 END AS trained FROM r),
k AS (SELECT *, CAST(beg AS BIGINT) || '-' || CAST(beg + head AS BIGINT) || ',' || CAST(beg + head AS BIGINT) || '-' || CAST(beg + head + body AS BIGINT) || CASE WHEN role = 'assistant' THEN '+' ELSE '' END AS spans FROM s)
SELECT pair_id, prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE odd = 0 AND pos <= prompt_turns), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE odd = 0 AND pos > prompt_turns), '') AS chosen_completion,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE odd = 1 AND pos > prompt_turns), '') AS rejected_completion,
  CAST(coalesce(sum(trained) FILTER (WHERE odd = 0 AND pos > prompt_turns), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(trained) FILTER (WHERE odd = 1 AND pos > prompt_turns), 0) AS BIGINT) AS rejected_trained,
  coalesce(string_agg(spans, ',' ORDER BY pos) FILTER (WHERE odd = 0 AND pos > prompt_turns), '') AS chosen_mask,
  coalesce(string_agg(spans, ',' ORDER BY pos) FILTER (WHERE odd = 1 AND pos > prompt_turns), '') AS rejected_mask
FROM k GROUP BY pair_id, prompt_turns
"""
