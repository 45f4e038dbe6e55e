"""Chat formatting in budgeted windows.

The turns of a conversation are laid into windows of a token budget. Prefix sums of the
turns' tokens decide where windows end, always between turns. Every window begins with
the system turn, then repeats the last few turns before it as context, then holds its
own turns, all within the budget. Loss falls on the text of the window's own assistant turns
alone, so repeated targets are masked and each target is learned once.

A prefix sum over the conversation cuts it into stretches of a bounded number of tokens; in
each, one more sum fills a window after the other as far as the budget goes.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts a backslash is
written ``\\\\`` and ``<|`` is written ``<\\|``; no control string can then occur inside a
text, and one pass over the backslashes restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import words

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that a turn costs besides its words; it also bounds the turns of a window.
TURN_TOKENS = 4
#: Windows' worth of tokens that are laid together.
STRETCH = 16


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _history(past: Column, allowed: Column) -> Column:
    """(n, tokens) of the turns, nearest last in ``past``, that go before a window: from the nearest on, while they fit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"), F.lit(True).alias("open"))

    def take(a: Column, p: Column) -> Column:
        fits = a["open"] & (a["tokens"] + p["tokens"] <= allowed)
        return F.struct(F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, a["tokens"] + p["tokens"]).otherwise(a["tokens"]).alias("tokens"), fits.alias("open"))

    return F.aggregate(F.reverse(past), zero, take)


def format_windows(conversations: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128) -> DataFrame:
    """conv_id, window, text, loss_begin and loss_length (arrays of code points), first_turn, n_own, tokens.

    Turns are ordered by turn, then role and text (nulls first, as empty strings); repeated
    rows are turns of their own. A window has the conversation's first system turn, if that came
    before it, then at most ``history_turns`` turns of together at most ``history_tokens`` tokens,
    nearest first, then its own turns. It takes turns while all of these fit the budget; a window
    exceeds it only where the system turn and a single turn do, and has no history then. Windows
    end at stretches of STRETCH budgets, so at most one in STRETCH isn't filled. Null conv_ids form
    one conversation; extra columns are ignored; an empty table gives no windows.

    Grouping is by stretch, never by conversation, but for the prefix sum, which streams.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
    ).withColumn("tokens", F.size(words(F.col("body"))).cast("long") + TURN_TOKENS)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    is_system = F.col("role") == "system"
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("piece", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), escape(F.col("body")), F.lit(END)))
    stretch = F.floor((F.sum("tokens").over(so_far) - F.col("tokens")) / (STRETCH * budget))
    turns = turns.withColumn("stretch", stretch)
    turns = turns.withColumn("system", F.first(F.when(is_system, F.struct("place", "tokens")), ignorenulls=True).over(so_far))
    # of turns before only the tokens are carried by each row, and the pieces by the first of a stretch
    head = ~F.col("stretch").eqNullSafe(F.lag("stretch").over(order))
    before = lambda what: F.array(*[F.lag(what, k).over(order) for k in range(history_turns, 0, -1)]) if history_turns else F.array()
    turns = turns.select(
        "*",
        before(F.struct("place", "tokens")).cast("array<struct<place:int,tokens:bigint>>").alias("past"),
        F.when(head, before(F.struct("place", "piece"))).cast("array<struct<place:int,piece:string>>").alias("past_pieces"),
        F.when(head, F.first(F.when(is_system, F.col("piece")), ignorenulls=True).over(so_far)).alias("system_piece"),
    )
    apart = F.col("system").isNotNull() & (F.col("system.place") < F.col("place"))
    system_tokens = F.when(apart, F.col("system.tokens")).otherwise(0)
    others = F.filter("past", lambda p: p.isNotNull() & (F.col("system").isNull() | (p["place"] != F.col("system.place"))))
    allowed = F.least(F.lit(history_tokens).cast("long"), F.lit(budget) - system_tokens - F.col("tokens"))
    turns = turns.withColumn("history", _history(others, allowed))
    lead = F.length(F.lit(START)) + F.length(escape(F.col("role"))) + F.length(F.lit(SEP))
    own = F.struct(
        "place",
        "turn",
        "tokens",
        (system_tokens + F.col("history.tokens") + F.col("tokens")).alias("cost"),  # of a window that begins here
        F.col("history.n").alias("n_past"),
        F.col("system.place").alias("system_place"),
        "piece",
        F.when(F.col("role") == "assistant", lead).alias("lead"),
        F.length(escape(F.col("body"))).alias("inner"),
        "past_pieces",
        "system_piece",
    )
    laid = turns.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(own)).alias("own"))

    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<at:int>>").alias("starts"), F.lit(0).alias("i"))

    def fill(a: Column, t: Column) -> Column:
        fits = (a["i"] > 0) & (a["used"] + t["tokens"] <= budget)
        started = F.concat(a["starts"], F.array(F.struct((a["i"] + 1).alias("at"))))
        used = F.when(fits, a["used"] + t["tokens"]).otherwise(t["cost"])
        return F.struct(used.alias("used"), F.when(fits, a["starts"]).otherwise(started).alias("starts"), (a["i"] + 1).alias("i"))

    laid = laid.withColumn("starts", F.aggregate("own", nothing, fill, lambda a: a["starts"]))
    # the turns of a stretch with the few before it; windows are cut out of them
    prior = F.filter(F.coalesce(F.col("own")[0]["past_pieces"], F.array().cast("array<struct<place:int,piece:string>>")), lambda p: p.isNotNull())
    laid = laid.select("conv_id", "stretch", "own", "starts", prior.alias("prior"), F.col("own")[0]["system_piece"].alias("old_system"), F.posexplode("starts").alias("k", "start"))
    following = F.coalesce(F.get("starts", F.col("k") + 1)["at"], F.size("own") + 1)
    windows = laid.select(
        "conv_id",
        (F.col("stretch") * (STRETCH * budget + 1) + F.col("k")).alias("window"),
        F.slice("own", F.col("start.at"), following - F.col("start.at")).alias("mine"),
        F.concat("prior", F.transform(F.slice("own", F.greatest(F.lit(1), F.col("start.at") - history_turns), F.least(F.col("start.at") - 1, F.lit(history_turns))), lambda p: F.struct(p["place"].alias("place"), p["piece"].alias("piece")))).alias("past"),
        F.coalesce("old_system", F.get(F.filter("own", lambda p: p["place"] == F.col("own")[F.col("start.at") - 1]["system_place"]), 0)["piece"]).alias("system_piece"),
    ).withColumn("first", F.col("mine")[0])
    not_system = lambda p: F.col("first.system_place").isNull() | (p["place"] != F.col("first.system_place"))
    past = F.filter("past", not_system)
    past = F.when(F.col("first.n_past") > 0, F.slice(past, -F.col("first.n_past"), F.col("first.n_past"))).otherwise(F.array().cast("array<struct<place:int,piece:string>>"))
    system_apart = F.col("first.system_place") < F.col("first.place")
    windows = windows.withColumn("head", F.concat(F.when(system_apart, F.col("system_piece")).otherwise(F.lit("")), F.array_join(F.transform(past, lambda p: p["piece"]), "")))

    zero = F.struct(F.length("head").alias("at"), F.array().cast("array<struct<b:int,n:int>>").alias("spans"))

    def lay(a: Column, p: Column) -> Column:
        span = F.struct((a["at"] + p["lead"]).cast("int").alias("b"), p["inner"].cast("int").alias("n"))
        return F.struct((a["at"] + F.length(p["piece"])).alias("at"), F.when(p["lead"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(span))).alias("spans"))

    windows = windows.withColumn("spans", F.aggregate("mine", zero, lay, lambda a: a["spans"]))
    added = F.aggregate("mine", -F.col("first.tokens"), lambda a, p: a + p["tokens"])
    return windows.select(
        "conv_id",
        "window",
        F.concat("head", F.array_join(F.transform("mine", lambda p: p["piece"]), "")).alias("text"),
        F.transform("spans", lambda s: s["b"]).alias("loss_begin"),
        F.transform("spans", lambda s: s["n"]).alias("loss_length"),
        F.col("first.turn").alias("first_turn"),
        F.size("mine").alias("n_own"),
        (F.col("first.cost") + added).alias("tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows' texts and loss spans say: a row for each window with its own turns and its loss text."""
    pieces = F.filter(F.split("text", r"<\|im_start\|>"), lambda p: p != "")
    own = F.slice("pieces", F.size("pieces") - F.col("n_own") + 1, F.col("n_own"))

    def decode(p: Column) -> Column:
        at = F.instr(p, SEP)
        role = F.substring(p, F.lit(1), at - 1)
        text = F.substring(p, at + len(SEP), F.length(p) - at - len(SEP) + 1 - len(END))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.transform(F.arrays_zip("loss_begin", "loss_length"), lambda s: unescape(F.substring(F.col("text"), s["loss_begin"] + 1, s["loss_length"])))
    read = windows.withColumn("pieces", pieces)
    return read.select("conv_id", "window", "n_own", F.array_join(F.transform(own, decode), "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its windows.

    A digest is of the whole conversation, whose text is joined in one row for it.
    """
    parts = read_back(windows)
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n_own").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda w: w["turns"]), ""), 256).alias("turns_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w["loss"])).alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
