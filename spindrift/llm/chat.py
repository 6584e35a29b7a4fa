"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*          turn := open role " [/INST] " body "</s>"          open := "[INST] " | "[INST*] "

The parser is deterministic: it cuts at every "</s>", reads the opening, and takes the role up to the first " [/INST] ". A turn
is first rendered as it is ("[INST] "). The rendering is parsed again, and where the recovered turns are not the source turn,
the turn is rendered with the opening "[INST*] " and its role and body escaped (& < [ as &amp; &lt; &lb;), which leaves no control
string in them, and is parsed and compared again. The whole conversation is parsed once more and compared in the end: the
column identical says so. The loss is what stands under the mask, unescaped where its turn is; that it is also what the parser reads
in the turns to learn from is part of identical.

Nulls: a null role or text is empty; rows of a null conv_id form one conversation; a null turn comes first. Ties: rows of the
same turn follow by role, then text; repeated rows are turns of their own. Empty tables give empty results. Other columns are
ignored. A conversation is one string in the result, so its turns meet in one row; nothing larger ever does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN, ESCAPED, MIDDLE, END = "[INST] ", "[INST*] ", " [/INST] ", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))


def escape(s: Column) -> Column:
    for raw, code in ESCAPES:
        s = F.replace(s, F.lit(raw), F.lit(code))
    return s


def unescape(s: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        s = F.replace(s, F.lit(code), F.lit(raw))
    return s


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted string; null where the grammar doesn't fit."""
    cut = F.split(formatted, END, -1)

    def turn(seg: Column) -> Column:
        marked = F.startswith(seg, F.lit(ESCAPED))
        head = F.when(marked, F.lit(len(ESCAPED))).otherwise(F.lit(len(PLAIN)))
        mid = F.instr(seg, MIDDLE)
        role, body = F.substring(seg, head + 1, mid - head - 1), F.substring(seg, mid + len(MIDDLE), F.length(seg))
        fits = (marked | F.startswith(seg, F.lit(PLAIN))) & (mid > head)
        read = lambda s: F.when(marked, unescape(s)).otherwise(s)
        return F.when(fits, F.struct(read(role).alias("role"), read(body).alias("text")))

    turns = F.transform(F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0))), turn)
    return F.when((F.element_at(cut, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(ESCAPED), escape(role), F.lit(MIDDLE), escape(text), F.lit(END))
    return F.concat(F.lit(PLAIN), role, F.lit(MIDDLE), text, F.lit(END))


def same(turns: Column, source: Column) -> Column:
    return F.coalesce(turns == source, F.lit(False))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Per conversation: formatted, turns (read back), mask (spans of the `learn` bodies in formatted, code points, end exclusive),
    loss (the text under the mask, unescaped), n_escaped turns, identical."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain, marked = render(F.col("role"), F.col("text"), False), render(F.col("role"), F.col("text"), True)
    rows = rows.withColumn("plain", plain).withColumn("escaped", ~same(parse(F.col("plain")), source))
    rows = rows.withColumn("out", F.when(F.col("escaped"), marked).otherwise(F.col("plain"))).drop("plain")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("begins", F.coalesce(F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    body = F.col("begins") + F.instr("out", MIDDLE) + len(MIDDLE) - 1
    rows = rows.withColumn("span", F.when(F.col("role") == learn, F.struct(body.alias("start"), (F.col("begins") + F.length("out") - len(END)).alias("end"))))
    # the text under the span, from the piece of the output that the span lies in
    under = F.substring(F.col("out"), F.col("span.start") - F.col("begins") + 1, F.col("span.end") - F.col("span.start"))
    rows = rows.withColumn("loss", F.when(F.col("escaped"), unescape(under)).otherwise(under))
    got = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "out", "span", "loss"))).alias("t"), F.count_if("escaped").alias("n_escaped"))
    got = got.select("conv", "n_escaped", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"), F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"), F.array_join(F.transform("t", lambda x: x["loss"]), "").alias("loss"))
    got = got.withColumn("turns", parse(F.col("formatted")))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: t["text"]), "")
    whole = same(F.col("turns"), F.col("source")) & same(learned, F.col("loss"))
    return got.select(F.col("conv").alias(conv), "formatted", "turns", "mask", "loss", "n_escaped", whole.alias("identical"))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "identical")
