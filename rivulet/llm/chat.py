"""Operator 2: chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a dialogue (each speaker but `system`) the whole dialogue is rendered with that speaker as the
assistant and the others as named users:

    <|im_start|>system\\n...<|im_end|>\\n
    <|im_start|>user name=alice\\n...<|im_end|>\\n
    <|im_start|>assistant\\n...<|im_end|>\\n

The mask is the list of [start, end) ranges in code points of the rendering that are to be learned: the assistant's texts
with the closing mark. Marks inside texts are defused by a space after `<`, and names keep letters, digits, `_`, `-`, `.`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, assistant, n_turns, n_learned, rendered, mask (array of structs start, end) for each participant.

    Turns go by `order`, nulls first, then by speaker and text; repeated rows are turns of their own. Null text is empty;
    a null or empty speaker is `unknown`; turns with null conversation form one dialogue with null conv_id. A dialogue of
    system turns alone has no participant and gives no rows, as does an empty table. Other columns are ignored, whatever
    their names; texts of any length are rendered whole, in time that grows with the rendering. A
    rendering is one value, so a dialogue is held in one task when it is put together, and it is rendered before it is
    multiplied: what is sent around is each turn once.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.nullif(F.trim(F.col(speaker).cast("string")), F.lit("")), F.lit("unknown"))
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(order).alias("turn"),
            F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_").alias("who"),
            F.regexp_replace(said, r"<\|(im_start|im_end)\|>", "< |$1|>").alias("text"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # where each speaker's own turns lie in that speaker's rendering, by running sums over the dialogue: in it the heads of
    # the own turns say `assistant`, those of all others the name. No shuffle: a dialogue stays where it was gathered.
    each = talks.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.who", "t.text")
    named = F.when(F.col("who") == "system", "system").otherwise(F.concat(F.lit("user name="), "who"))
    heads = len(OPEN) + 1
    body = F.length("text") + len(CLOSE)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(heads + F.length(named) + body + 1).over(before("conv_id")), F.lit(0))
    own = F.count(F.lit(1)).over(before("conv_id", "who"))
    start = (passed + own * (len("assistant") - F.length(named)) + heads + len("assistant")).cast("long")
    placed = each.withColumn("start", start).withColumn("end", F.col("start") + body)
    turn = F.struct("pos", "who", named.alias("named"), F.concat("text", F.lit(CLOSE)).alias("body"), "start", "end")
    talks = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    who = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["who"]), lambda w: w != "system")))
    each = talks.select("conv_id", "turns", F.explode(who).alias("assistant"))
    mine = lambda t: t["who"] == F.col("assistant")
    line = lambda t: F.concat(F.lit(OPEN), F.when(mine(t), F.lit("assistant")).otherwise(t["named"]), F.lit("\n"), t["body"], F.lit("\n"))
    learned = F.transform(F.filter("turns", mine), lambda t: F.struct(t["start"], t["end"]))
    return each.select(
        "conv_id",
        "assistant",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", mine)).cast("long").alias("n_learned"),
        F.array_join(F.transform("turns", line), "").alias("rendered"),
        learned.alias("mask"),
    )


def digest(rotated: DataFrame) -> DataFrame:
    """The rendering and the mask as one text: start:end, comma-joined."""
    line = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotated.select("conv_id", "assistant", "n_turns", "n_learned", "rendered", line.alias("mask"))
