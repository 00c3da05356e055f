"""Operator 1: chat formatting in budgeted windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: The template: START role newline text END. Fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>\n"
_END_SPLIT = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """One more backslash between < and | wherever only backslashes stand there: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """escape, and no line break, which ends a role."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks: the measure of the budget, where no tokenizer's own count is given."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("bigint")


def format_windows(turns: DataFrame, *, budget: int = 512, history: int = 128, tokens=count_tokens) -> DataFrame:
    """Conversations as windows of at most budget tokens, cut between turns.

    turns: conv_id, turn, role, text; rows are taken in the order of turn, then role, then text; a null role or text
    is empty; repeated rows are turns of their own; other columns are ignored; rows with a null conv_id are one
    conversation. Prefix sums of the turns' tokens choose the windows: each takes new turns as long as they fit into
    what the system turn (if the first turn is one) and the history leave of the budget, one turn at least. Later
    windows begin with the system turn and the last turns before them, as many as history tokens hold. A turn longer
    than that has a window of its own, over the budget.

    Only a turn's place and prefix sums are put in one row per conversation, where the windows' borders are found;
    texts meet in rows of one window, which the budget bounds. So a conversation's work grows in proportion to its turns.

    Returns conv_id, window, text, n_context (turns repeated from earlier windows, which come first), n_turns (all
    turns in the text), and loss_spans (start and end in characters): the assistants' texts, without the repeated ones.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("raw"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("body", escape(F.col("raw")))
    rows = rows.withColumn("text", F.concat(head, F.col("body"), F.lit(END))).withColumn("tokens", tokens(F.col("text")))
    chat = Window.partitionBy("conv_id")
    order = chat.orderBy("turn", "role", "raw")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("tokens"))
    # the first turn that the history reaches back to, if a window begins at this one
    rows = rows.withColumn("reach", F.min("place").over(chat.orderBy("before").rangeBetween(-history, Window.currentRow)))

    system = F.max(F.when((F.col("place") == 1) & (F.col("role") == "system"), F.col("tokens")))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "before", "upto", "reach"))).alias("turns"), system.alias("system"))
    chats = chats.withColumn("first", F.when(F.col("system").isNotNull(), 1).otherwise(0)).withColumn("n", F.size("turns"))
    chats = chats.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("system", F.lit(0))))
    new = F.slice("turns", F.col("first") + 1, F.col("n") - F.col("first"))
    begin = F.get("turns", F.col("first"))
    begin = F.struct((F.col("first") + 1).alias("start"), F.coalesce(begin["reach"], F.lit(1)).alias("reach"), F.coalesce(begin["before"], F.lit(0)).cast("bigint").alias("before"))

    def step(s, t):
        last = F.element_at(s, -1)
        over = (t["upto"] - last["before"] > F.col("room")) & (t["place"] != last["start"])
        return F.when(over, F.array_append(s, F.struct(t["place"].alias("start"), t["reach"].alias("reach"), t["before"].alias("before")))).otherwise(s)

    chats = chats.select("conv_id", "first", "n", F.aggregate(new, F.array(begin), step).alias("starts"))
    stop = lambda i: F.coalesce(F.get("starts", i + 1)["start"] - 1, F.col("n"))
    cuts = F.transform("starts", lambda x, i: F.struct(x["start"].alias("start"), x["reach"].alias("reach"), stop(i).alias("stop")))
    cuts = chats.select("conv_id", "first", F.posexplode(cuts).alias("window", "cut"))
    begun = F.col("window") > 0
    back = F.when(begun, F.greatest("cut.reach", F.col("first") + 1)).otherwise(F.lit(1))
    context = F.when(begun, F.col("first") + F.col("cut.start") - back).otherwise(0)
    places = F.concat(F.when(begun & (F.col("first") == 1), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.sequence(back, F.col("cut.stop")))
    members = cuts.select("conv_id", "window", context.alias("n_context"), F.explode(places).alias("place")).alias("m")
    rows = rows.select("conv_id", "place", "role", "text", "head", F.char_length("body").alias("body")).alias("r")
    same = F.col("m.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("m.place") == F.col("r.place"))
    part = F.struct("r.place", "role", "text", "head", "body")
    cuts = members.join(rows, same).groupBy("m.conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("n_context").alias("n_context"))
    at = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, t: a + F.char_length(t["text"]))
    span = lambda t, i: F.when((t["role"] == "assistant") & (i >= F.col("n_context")), F.struct((at(i) + t["head"]).alias("start"), (at(i) + t["head"] + t["body"]).alias("end")))
    spans = F.filter(F.transform("parts", span), lambda x: x.isNotNull())
    text = F.array_join(F.transform("parts", lambda t: t["text"]), "")
    return cuts.select("conv_id", "window", text.alias("text"), "n_context", F.size("parts").alias("n_turns"), spans.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) and loss_text, read back from the texts; repeated turns are left out."""
    parts = F.split("text", _END_SPLIT)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    turn = lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substr(body(p), F.char_length(role(p)) + 2)).alias("text"))
    turns = F.transform(F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context")), turn)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("text", s["start"] + 1, s["end"] - s["start"]))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.char_length("text").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """A row per conversation; a digest needs a conversation's texts in one row, so one conversation's text must fit a row."""
    read = read_windows(windows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", lines.alias("lines"), F.col("loss_text").alias("loss"))
    chats = read.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    chats = chats.select("conv_id", "n_turns", "formatted_chars", joined("lines").alias("lines"), joined("loss").alias("loss"))
    return chats.select("conv_id", "n_turns", hexed(F.col("lines")).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), hexed(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that says control strings, read back from their windows."""
    says = f"{END.strip()}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(format_windows(turns))
