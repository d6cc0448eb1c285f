"""Chat formatting: conversations as marked windows of bounded size with a loss mask.

Only DataFrame functions.  Prefix sums of turn tokens give every turn its
stretch of the conversation; turns inside one stretch form a window and a turn
across a border forms one alone, so a window is above the budget only if it is a
single turn.  Each window begins with the system turn and the last few turns
before it, repeated as history; the loss mask covers new assistant turns only,
so that no target is learnt twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import n_words, running_sums, table, written
from tallyworks.llm.registry import query

# Tokens of new turns in a window, of repeated history, and of the marks around a turn.
STRETCH = 384
HISTORY = 128
MARKS = 4
START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common templates; texts never hold them unescaped.  Fixed values.
CONTROL = (r"<(\||/?s>|</?SYS>>)", r"\[(/?INST\])")


def escaped(text: Column) -> Column:
    """``text`` with control strings broken up by an entity; every & begins one afterwards."""
    out = F.replace(text, F.lit("&"), F.lit("&a;"))
    out = F.regexp_replace(out, CONTROL[0], "&l;$1")
    return F.regexp_replace(out, CONTROL[1], "&b;$1")


def unescaped(text: Column) -> Column:
    for code, mark in (("&n;", "\n"), ("&l;", "<"), ("&b;", "["), ("&a;", "&")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def chat_windows(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    stretch: int = STRETCH, history: int = HISTORY,
) -> DataFrame:
    """Rows (conv_id, window, formatted, repeats, loss): windows in order, and what is under the loss mask.

    ``repeats`` leading turns were in an earlier window; ``loss`` lists (begin, end) in code points.  Turns are
    ordered by turn (null first), then role and text.  Null roles and texts are empty; a null conv_id is a
    conversation.  The system turn is a first turn of that role; later ones are turns like others.
    """
    if history > stretch:
        raise ValueError("history must fit a stretch")
    key = F.coalesce(F.col(conv_id).cast("string"), F.lit("null"))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), key.alias("k"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    ).withColumns({"one": F.lit(1).cast("long"), "size": n_words(F.col("text")) + MARKS})
    # Sums hold the system turn too; its size is taken off again below.
    rows = running_sums(rows, ["k"], ["turn", "role", "text"], {"n": "one", "p": "size"}, "turns")
    is_system = (F.col("n") == 0) & (F.col("role") == "system")
    piece = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&n;")), F.lit("\n"))
    rows = rows.withColumns({"system": is_system, "head": piece, "body": escaped(F.col("text"))})
    system = rows.where("system").select("conv_id", "k", "head", "body", "size")
    lead = system.select("k", F.col("size").alias("lead"))
    rows = rows.where(~F.col("system")).join(lead, "k", "left").withColumn("p", F.col("p") - F.coalesce("lead", F.lit(0)))
    at = F.floor(F.col("p") / stretch)
    crosses = F.floor((F.col("p") + F.col("size") - 1) / stretch) > at
    rows = rows.withColumn("w", 2 * at + crosses.cast("int"))
    rows = written(rows.select("conv_id", "k", "w", "n", "p", "size", "role", "head", "body"), "turns")
    windows = written(rows.groupBy("k", "w").agg(F.min("p").alias("begin")), "windows")

    new = rows.select(
        "conv_id", "k", "w", F.col("n"), "head", "body", F.lit(False).alias("repeat"), (F.col("role") == "assistant").alias("loss")
    )
    # A turn is history of windows that begin at most ``history`` tokens after it begins: those of the next stretch at most.
    past = rows.withColumn("w", F.explode(F.array(*[F.col("w") + i for i in (1, 2, 3)]))).join(windows, ["k", "w"])
    past = past.where(F.col("p") >= F.col("begin") - history)
    past = past.select("conv_id", "k", "w", "n", "head", "body", F.lit(True).alias("repeat"), F.lit(False).alias("loss"))
    first = system.join(windows, "k", "left").select(
        "conv_id", "k", F.coalesce("w", F.lit(0).cast("long")).alias("w"), F.lit(-1).cast("long").alias("n"), "head", "body",
        F.coalesce(F.col("begin") > 0, F.lit(False)).alias("repeat"), F.lit(False).alias("loss"),
    )
    parts = new.unionAll(past).unionAll(first).withColumn("part", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("k", "w").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("head")
    parts = parts.withColumn("span", F.when(F.col("loss"), F.struct(begin.alias("begin"), (begin + F.length("body")).alias("end"))))
    # A window holds a stretch and its history at most, or one turn and its history.
    return parts.groupBy("k", "w").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("formatted"),
        F.count_if("repeat").alias("repeats"), F.array_sort(F.collect_list("span")).alias("loss"),
    ).select("conv_id", F.col("w").alias("window"), "formatted", "repeats", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """Rows (conv_id, window, turns, targets) from formatted windows: new turns as (role, text), masked texts in order."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1)
    parts = F.slice(parts, F.col("repeats").cast("int") + 1, F.greatest(F.size(parts) - F.col("repeats").cast("int"), F.lit(0)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(
            unescaped(F.substr(role, F.lit(len(START) + 1))).alias("role"),
            unescaped(F.substr(x, F.length(role) + 2)).alias("text"),
        )

    def target(s: Column) -> Column:
        return unescaped(F.substr("formatted", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))

    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), F.transform("loss", target).alias("targets"))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 4 + coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         row_number() OVER o - 1 AS n,
         12 + length(role) + 1 + 11 + length(regexp_replace(regexp_replace(replace(text, '&', '&a;'), '<(\\||/?s>|</?SYS>>)', '&l;\\1', 'g'), '\\[(/?INST\\])', '&b;\\1', 'g')) AS part
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT * FROM e WHERE n = 0 AND role = 'system'
), r AS (
  SELECT e.*, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
  FROM e WHERE NOT (n = 0 AND role = 'system')
), w AS (
  SELECT *, 2 * (p // 384) + CASE WHEN (p + size - 1) // 384 > p // 384 THEN 1 ELSE 0 END AS w FROM r
), b AS (
  SELECT conv_id, w, min(p) AS begin FROM w GROUP BY ALL
), f AS (
  SELECT conv_id, part FROM w
  UNION ALL SELECT w.conv_id, part FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.w > w.w AND w.p >= b.begin - 128
  UNION ALL SELECT s.conv_id, part FROM s LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM s.conv_id
), g AS (
  SELECT conv_id, CAST(sum(part) AS BIGINT) AS formatted_chars FROM f GROUP BY 1
)
SELECT e.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY e.conv_id
"""


@query("op6_chat_windows", SQL)
def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    windows = written(chat_windows(turns), "chat")
    back = read_back(windows)
    # One digest spans a whole conversation, so its turns meet in one row; they are reduced to texts before.
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select(
        "conv_id", "window", F.size("turns").alias("n"), line.alias("line"), F.array_join("targets", "").alias("loss")
    )
    packed = F.array_sort(F.collect_list(F.struct("window", "line", "loss")))
    all_ = back.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), packed.alias("all"))
    lines, loss = (F.array_join(F.col("all").getField(c), "") for c in ("line", "loss"))
    size = windows.groupBy(F.col("conv_id").alias("c")).agg(F.sum(F.length("formatted")).alias("formatted_chars"))
    return all_.join(size, all_["conv_id"].eqNullSafe(size["c"])).select(
        "conv_id", "n_turns", F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
