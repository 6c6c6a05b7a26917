"""Chat formatting into token-budgeted windows with loss masks, and reading the turns back from the formatted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import numbered
from .common import settle

#: Markers of the template (a fixed format): a turn is START role newline text END.
START, END = "<|im_start|>", "<|im_end|>\n"
#: What is escaped inside texts: this template's markers and those of other common templates, with any tildes already there.
CONTROL, ESCAPED = r"([<\[])(~*)(\||/?s>|/?INST\])", r"([<\[])~(~*)(\||/?s>|/?INST\])"
#: Turn numbers of a block. A block's turns meet in one row; a long conversation is many blocks.
BLOCK = 512
_TURNS = "array<struct<turn:{turn},role:string,body:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    """Break up control strings by one tilde more; ``unescape`` takes it away again."""
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _tokens(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])


def _last_within(turns: Column, allowed: Column, most: int) -> Column:
    """The last turns of the array that have at most ``allowed`` tokens together; a turn has four tokens at least."""
    near = F.slice(turns, F.greatest(F.size(turns) - most // 4 + 1, F.lit(1)), most // 4 + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & (a["sum"] + x["tokens"] <= allowed)
        return F.struct((a["sum"] + x["tokens"]).alias("sum"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), fits.alias("open"))

    n = F.aggregate(F.reverse(near), start, step, lambda a: a["n"])
    return F.slice(near, F.size(near) - n + 1, n)


def _spans(turns: Column, first: Column, stride: Column) -> Column:
    """Numbers of the turns with which spans begin: each span takes turns while their prefix sum stays within ``first`` tokens
    (later spans: ``stride``), one turn at least."""
    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).cast("bigint").alias("used"), first.alias("limit"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        at, new = a["at"] + 1, (a["at"] > 0) & (a["used"] + x["tokens"] > a["limit"])
        return F.struct(
            F.when(new, F.concat(a["starts"], F.array(at))).otherwise(a["starts"]).alias("starts"), F.when(new, x["tokens"]).otherwise(a["used"] + x["tokens"]).alias("used"),
            F.when(new, stride).otherwise(a["limit"]).alias("limit"), at.alias("at"),
        )

    return F.aggregate(turns, start, step, lambda a: a["starts"])


def _rendered(turns: Column, skip: Column) -> Column:
    """Struct of text and loss_spans of formatted turns; the first ``skip`` turns are masked."""
    piece = lambda x: F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n"), escape(x["body"]), F.lit(END))
    pieces = F.transform(turns, lambda x, i: F.struct(piece(x).alias("piece"), (F.length(F.url_encode(x["role"])) + len(START) + 1).alias("head"), ((x["role"] == "assistant") & (i >= skip)).alias("loss")))

    def step(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["head"]).alias("start"), (F.length(x["piece"]) - x["head"] - len(END)).alias("length"))
        return F.struct((a["at"] + F.length(x["piece"])).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), step, lambda a: a["spans"])
    return F.struct(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), spans.alias("loss_spans"))


def _divided(base: DataFrame) -> DataFrame:
    """``base`` with the blocks of over 2 * BLOCK turns in parts of BLOCK turns each, in order of turn, role and text."""
    keys = ["kn", "k", "block"]
    large = settle(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK).select(*keys))
    if large.isEmpty():
        return base
    placed = numbered(base.join(large, keys, "left_semi").withColumn("whole", F.struct(*keys)), "whole", ["turn", "role", "body"])
    part = F.struct(F.col("block.at").alias("at"), F.floor((F.col("n") - 1) / BLOCK).alias("part"))
    return base.join(large, keys, "left_anti").unionByName(placed.withColumn("block", part).select(*base.columns))


def format_windows(turns: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """Rows (conv_id, window, text, context_turns, n_tokens, loss_spans): formatted windows of each conversation.

    Input: conv_id, turn, role, text; further columns are ignored. Turns go by turn, then role and text (ties); null roles
    and texts count as empty; a null conv_id is a conversation of its own. Tokens of a turn: its words plus four. Repeated
    rows are turns of their own. An empty table gives no windows.

    The first span takes turns from the start while their prefix sum is within ``budget``; later spans while theirs is within
    ``budget - history`` less the tokens of the system turn (the first turn, if its role is system). No turn is cut: a turn
    over that bound is a span of its own. A window is the system turn, then the last turns before the span that have at most
    ``history`` tokens and fit, then the span; so a window exceeds the budget only if one turn and the system turn do.
    ``context_turns`` counts the repeated turns. ``loss_spans`` are (start, length) in characters of the texts of the span's
    assistant turns; repeated turns are masked. Windows sort by ``window``.

    A conversation is dealt to blocks of BLOCK turn numbers, each one row, so the hot one is many rows. A span doesn't cross
    blocks; the system turn and the last turns of the block before are handed on. Turns without a number are in block 0. A block of over
    2 * BLOCK turns (of equal numbers, or without any) is divided again, by the turns' places in it, which are found over ranges.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must be at most half of the budget")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    kind, turn_kind = turns.schema["conv_id"].dataType, turns.schema["turn"].dataType.simpleString()
    base = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), F.col("conv_id").isNull().alias("kn"), "turn", role.alias("role"), text.alias("body"))
    base = base.withColumn("tokens", F.regexp_count("body", F.lit(r"\S+")).cast("bigint") + 4).withColumn("block", F.struct(F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(0)).alias("at"), F.lit(0).cast("bigint").alias("part")))
    base = _divided(base)
    conv, keys = ["kn", "k"], ["kn", "k", "block"]
    blocks = base.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "tokens"))).alias("turns"))
    # Conversations of several blocks: what a block hands on. The list of blocks comes from the turn numbers alone.
    by = Window.partitionBy(*conv).orderBy("block")
    index = base.select(*keys).distinct().withColumns({"next": F.lead("block").over(by), "before": F.lag("block").over(by)})
    last = _last_within(F.filter("turns", lambda x, i: ~((i == 0) & F.col("before").isNull() & (x["role"] == "system"))), F.lit(history), history)
    tails = blocks.join(index.where("next is not null"), keys).select(*conv, F.col("next").alias("block"), last.alias("tail"))
    heads = blocks.join(index.where("before is null and next is not null"), keys).where(F.col("turns")[0]["role"] == "system").select(*conv, F.slice("turns", 1, 1).alias("head"))
    heads = index.where("before is not null").select(*keys).join(heads, conv)
    none = F.array().cast(_TURNS.format(turn=turn_kind))
    rows = blocks.join(tails, keys, "left").join(heads, keys, "left").withColumn("begins", F.col("tail").isNull())
    rows = rows.withColumns({
        "own_head": F.col("begins") & (F.col("turns")[0]["role"] == "system"), "tail": F.coalesce("tail", none),
        "system": F.when(F.col("begins") & (F.col("turns")[0]["role"] == "system"), F.slice("turns", 1, 1)).otherwise(F.coalesce("head", none)),
    }).withColumn("held", _tokens(F.col("system")))
    stride = F.greatest(F.lit(budget - history) - F.col("held"), F.lit(1)).cast("bigint")
    rows = rows.withColumn("starts", _spans(F.col("turns"), F.when(F.col("begins"), F.lit(budget).cast("bigint")).otherwise(stride), stride))
    rows = rows.select("kn", "k", "block", "turns", "tail", "system", "held", "own_head", "begins", F.size("starts").alias("spans"), "starts", F.posexplode("starts").alias("number", "start"))
    stop = F.when(F.col("number") + 1 < F.col("spans"), F.element_at("starts", F.col("number") + 2)).otherwise(F.size("turns") + 1)
    rows = rows.withColumn("mine", F.slice("turns", F.col("start"), stop - F.col("start"))).withColumn("size", _tokens(F.col("mine")))
    skip = F.when(F.col("own_head"), 1).otherwise(0)
    earlier = F.concat("tail", F.slice("turns", skip + 1, F.greatest(F.col("start") - 1 - skip, F.lit(0))))
    opening = F.col("begins") & (F.col("number") == 0)
    past = _last_within(earlier, F.least(F.lit(history), F.lit(budget) - F.col("held") - F.col("size")), history)
    rows = rows.withColumn("context", F.when(opening, none).otherwise(F.concat("system", past))).withColumn("context_turns", F.size("context"))
    rows = rows.withColumn("made", _rendered(F.concat("context", "mine"), F.col("context_turns")))
    return rows.select(
        F.when(~F.col("kn"), F.col("k").cast(kind)).alias("conv_id"), F.struct("block", "number").alias("window"), F.col("made.text").alias("text"), "context_turns",
        (_tokens(F.col("context")) + F.col("size")).alias("n_tokens"), F.col("made.loss_spans").alias("loss_spans"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: adds ``turns`` (array of role and text, unescaped) without the repeated turns."""
    pieces = F.filter(F.split("text", r"<\|im_start\|>"), lambda x: x != "")
    def parse(x: Column) -> Column:
        head = F.length(F.substring_index(x, "\n", 1))
        return F.struct(F.url_decode(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, head + 2, F.length(x) - head - 1 - len(END))).alias("text"))
    return windows.withColumn("turns", F.slice(F.transform(pieces, parse), F.col("context_turns") + 1, F.greatest(F.size(pieces) - F.col("context_turns"), F.lit(0))))


def read_losses(windows: DataFrame) -> DataFrame:
    """Adds ``loss_text``: the unescaped text under the loss mask."""
    return windows.withColumn("loss_text", F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("text"), x["start"] + 1, x["length"]))), ""))


def digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, read back from formatted windows. A digest covers the whole conversation, whose windows meet here;
    of each turn the text is sent once."""
    said = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    back = read_losses(read_turns(windows)).select("conv_id", "window", said.alias("said"), "loss_text", F.size("turns").alias("n"), F.length("text").alias("chars"))
    # What is under the mask is the assistants' texts of the window; it is sent on its own only where it differs from them.
    spoken = F.array_join(F.transform(F.filter("said", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    back = back.select("conv_id", "n", "chars", F.struct("window", "said", F.when(F.col("loss_text") != spoken, F.col("loss_text")).alias("loss")).alias("part"))
    grouped = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list("part")).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: F.array_join(F.transform(p["said"], lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")), "")
    loss = lambda p: F.coalesce(p["loss"], F.array_join(F.transform(F.filter(p["said"], lambda x: x["role"] == "assistant"), lambda x: x["text"]), ""))
    lost = grouped.withColumn("lost", F.array_join(F.transform("parts", loss), ""))
    return lost.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length("lost").cast("bigint").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
