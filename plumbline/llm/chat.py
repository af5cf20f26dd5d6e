"""Chat formatting in budgeted windows, with built-in functions only.

A turn reads `<s>role NL text</s> NL`; backslashes, `<s>` and `</s>` inside texts and roles, and line ends inside roles,
are escaped, so that the written form can be read back without loss. Prefix sums of turn tokens
(words, plus OVERHEAD for the marks) choose windows that begin and end between turns: a window takes turns while
it stays within the budget. Every window but the first opens with the system turn (if the conversation starts with one) and the last
`history` turns before it; these repeated turns are masked. A system turn of more than half the budget opens the first window only, and earlier turns are repeated as far as half of what the
system turn leaves holds them: so at least a quarter of the budget is for a window's own turns, and the output grows with the input, not with turns times system turn. The loss mask covers each
assistant text once, in the window that it belongs to.

A turn above the budget has a window of its own and stays whole. Null text and role are empty; null turns come first; repeated rows are
turns of their own, ordered by role and text. Rows without conv_id form one conversation. Empty tables give
empty results; other columns are ignored. Turns are rows of their own, numbered and summed over a window that can spill, and join the windows that show
them; a task holds the numbers of a conversation's turns, but the texts of one window only. read_back() alone puts a whole conversation in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, SLASH = "<s>", "</s>", "\\"
BUDGET, HISTORY, OVERHEAD = 512, 2, 4
TRAINED = "assistant"
#: Starts are gathered in blocks of this many: appending to one array would copy it for every window.
BLOCK = 1000


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(SLASH), F.lit(SLASH * 2))
    return F.replace(F.replace(doubled, F.lit(OPEN), F.lit("<\\s>")), F.lit(CLOSE), F.lit("<\\/s>"))


def unescape(text: Column) -> Column:
    """What escape() wrote never has one backslash between `<` and `s>` or `/s>` but for a mark."""
    marks = F.replace(F.replace(text, F.lit("<\\s>"), F.lit(OPEN)), F.lit("<\\/s>"), F.lit(CLOSE))
    return F.replace(marks, F.lit(SLASH * 2), F.lit(SLASH))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_chats(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window (from 0), first_turn, n_repeated, n_own, formatted, loss (array of begin, end
    in characters of formatted; the end is outside)."""
    text, role = F.coalesce(rows["text"], F.lit("")), F.coalesce(rows["role"].cast("string"), F.lit(""))
    n_tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + OVERHEAD
    turns = rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), role.alias("role"), text.alias("text"), n_tokens.cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("conv_id", "role", "text", (F.row_number().over(order) - 1).alias("i"), F.sum("tokens").over(upto).alias("upto"))
    # upto[i] is the tokens of turns 0 to i, prefix[i] those before turn i
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("i", "upto"))), lambda t: t["upto"])
    talks = turns.groupBy("conv_id").agg(numbers.alias("upto"), F.coalesce(F.bool_or((F.col("i") == 0) & (F.col("role") == "system")), F.lit(False)).alias("system"))
    talks = talks.select("conv_id", "system", F.concat(F.array(F.lit(0).cast("long")), "upto").alias("prefix"), F.size("upto").alias("n"))

    def between(i: Column, j: Column) -> Column:  # tokens of turns i to j-1
        return F.col("prefix")[j] - F.col("prefix")[i]

    pinned = F.col("system") & (F.col("prefix")[1] <= budget // 2)
    head_tokens = F.when(pinned, F.col("prefix")[1]).otherwise(0)

    def repeated(start: Column) -> Column:
        """Turns repeated before a window that starts at a turn: as many of the last ones as half of the budget without the system turn holds."""
        low = F.when(F.col("system"), 1).otherwise(0)
        most = F.lit(0)
        for k in range(1, history + 1):
            fits = (start - k >= low) & (between(F.greatest(start - k, F.lit(0)), start) * 2 <= budget - head_tokens)
            most = F.when(fits, k).otherwise(most)
        return most

    def room(start: Column) -> Column:
        head = F.when(start > 0, head_tokens).otherwise(0)
        return budget - head - between(start - repeated(start), start)

    def walk(acc: Column, i: Column) -> Column:
        opens = (i > acc["start"]) & (between(acc["start"], i + 1) > acc["room"])
        full = F.size(acc["block"]) >= BLOCK
        blocks = F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"])
        block = F.when(full, F.array(i)).otherwise(F.concat(acc["block"], F.array(i)))
        return F.when(opens, F.struct(i.alias("start"), room(i).alias("room"), blocks.alias("blocks"), block.alias("block"))).otherwise(acc)

    first = F.struct(F.lit(0).alias("start"), F.lit(budget).cast("long").alias("room"), F.array().cast("array<array<int>>").alias("blocks"), F.array(F.lit(0)).alias("block"))
    found = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), first, walk, lambda a: F.flatten(F.concat(a["blocks"], F.array(a["block"]))))
    talks = talks.withColumn("starts", found)

    def window(start: Column, w: Column) -> Column:
        end = F.coalesce(F.get("starts", w + 1), F.col("n"))
        head = F.when(pinned & (start > 0), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.struct(w.alias("window"), start.alias("start"), (end - start).alias("n_own"), repeated(start).alias("again"), head.alias("head"))

    windows = talks.select(F.col("conv_id").alias("talk"), F.explode(F.transform("starts", window)).alias("w")).select("talk", "w.*")
    places = F.concat("head", F.sequence(F.col("start") - F.col("again"), F.col("start") + F.col("n_own") - 1))
    windows = windows.select("talk", "window", "start", "n_own", F.posexplode(places).alias("place", "at"))
    windows = windows.join(turns.drop("upto"), F.col("talk").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("i")))
    windows = windows.groupBy(F.col("talk").alias("conv_id"), "window", "start", "n_own").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("shown"))
    windows = windows.withColumn("n_repeated", F.size("shown") - F.col("n_own"))
    written = F.transform("shown", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].alias("who")))
    windows = windows.withColumn("written", written)
    formatted = F.concat_ws("", F.transform("written", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))))

    def span(acc: Column, i: Column) -> Column:
        t = F.col("written")[i]
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        stop = begin + F.length(t["text"])
        counts = (i >= F.col("n_repeated")) & (t["who"] == TRAINED)
        out = F.when(counts, F.concat(acc["out"], F.array(F.struct(begin.alias("begin"), stop.alias("end"))))).otherwise(acc["out"])
        return F.struct((stop + len(CLOSE) + 1).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))
    loss = F.aggregate(F.sequence(F.lit(0), F.size("written") - 1), start, span, lambda a: a["out"])
    return windows.select("conv_id", "window", F.col("start").alias("first_turn"), "n_repeated", "n_own", formatted.alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation, from format_chats' output alone: conv_id, turns (array of role, text), loss_text, formatted_chars."""
    pieces = F.split("formatted", F.lit("</s>\n"), -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_own"))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, F.lit("\n"))
        role, text = F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1), F.substring(piece, cut + 1, F.length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    loss = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"]))))
    parts = windows.select("conv_id", F.struct("window", F.transform(own, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").alias("chars")).alias("w"))
    talks = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return talks.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.concat_ws("", F.transform("w", lambda w: w["loss_text"])).alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )


def op6_chat(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, TRAINED, marks)], "conv_id long, turn long, role string, text string")
    told = read_back(format_chats(given.unionByName(extra)))
    all_turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
