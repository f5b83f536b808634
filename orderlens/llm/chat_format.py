"""Training windows of conversations under a token budget.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so no text can hold a control
string and `unescaped` gives every text back; a line break in a role becomes ``&nl;``.

1. A turn costs the pieces of its text (runs of at most eight letters or digits,
   single other marks) and TURN_TOKENS. Prefix sums of the costs give every turn
   its place. They are summed by stretches of STRETCH turn numbers first, then over
   the stretches, so a conversation of very many turns needs no task to itself.
2. With S tokens of system turn the budget leaves ``budget - history - S`` for new
   turns, a quarter of the budget at least. A window takes turns as long as the
   prefix sum stays within that of its start. Blocks of BLOCK turns are cut each by
   themselves, so a block is bounded work. A window keeps to the budget, unless one
   turn alone is longer than that or the system turn leaves no room.
3. A window begins with the system turn, if the conversation's first turn is one,
   and the turns of the last `history` tokens before it, whole turns only. Both
   are repeats in all windows but their first.
4. `loss_spans` (0-based start and length in characters of `text`) cover the texts
   of assistant turns that are not repeats; each is under the mask once.

Turns are ordered by turn (null first), then role and text. Cases: null texts and
roles are empty; turns without conv_id form a conversation without id; repeated
rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 128
TURN_TOKENS = 4
STRETCH = 256
BLOCK = 256
START, STOP = "<|im_start|>", "<|im_end|>\n"
PIECE = "[\\p{L}\\p{N}]{1,8}|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with seq (from 1), place (tokens of the body before it), block, room for new turns and system data."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    rows = rows.withColumn("conv", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")))
    rows = rows.withColumn("cost", F.regexp_count("text", F.lit(PIECE)).cast("long") + TURN_TOKENS)
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62))))

    totals = rows.groupBy("conv", "stretch").agg(
        F.count("*").alias("n"), F.sum("cost").alias("tokens"), F.min(F.struct("turn", "role", "text", "cost")).alias("head")
    )
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("head").over(Window.partitionBy("conv").orderBy("stretch"))
    is_system = F.col("head1.role") == "system"
    starts = totals.withColumn("head1", first).select(
        "conv",
        "stretch",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("t0"),
        F.when(is_system, F.col("head1.cost")).otherwise(0).alias("system_cost"),
        F.when(is_system, F.struct("head1.role", "head1.text")).alias("system"),
    )
    room = F.greatest(F.lit(budget - history) - F.col("system_cost"), F.lit(budget // 4))
    within = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    known = rows.join(starts, ["conv", "stretch"]).withColumn("room", room)
    known = known.withColumn("seq", F.col("n0") + F.row_number().over(within))
    known = known.withColumn("place", F.col("t0") + F.sum("cost").over(upto) - F.col("cost") - F.col("system_cost"))
    known = known.withColumn("own_system", F.col("system").isNotNull() & (F.col("seq") == 1))
    return known.withColumn("block", F.floor((F.col("seq") - 1) / BLOCK))


def _window_starts(body: DataFrame) -> DataFrame:
    """For each block of a conversation the places where its windows start."""
    blocks = body.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("turns"),
        *(F.first(c).alias(c) for c in ("room", "system", "system_cost")),
    )
    full = lambda done, t: t["place"] + t["cost"] - F.element_at(done, -1) > F.col("room")
    starts = F.aggregate(
        F.slice("turns", 2, BLOCK),
        F.array(F.col("turns")[0]["place"]),
        lambda done, t: F.when(full(done, t), F.concat(done, F.array(t["place"]))).otherwise(done),
    )
    return blocks.select("conv", "block", "system", "system_cost", starts.alias("starts"))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, window (orders them), text, loss_spans, repeated (turns at its start), n_tokens."""
    known = _placed(turns, budget, history)
    body = known.where("not own_system")
    starts = _window_starts(body)
    heads = starts.select("conv", "system", "system_cost", F.explode("starts").alias("window"))
    own = body.join(starts.select("conv", "block", "starts"), ["conv", "block"]).withColumn(
        "window", F.array_max(F.filter("starts", lambda at: at <= F.col("place")))
    )
    turn = lambda kind, again: F.struct(
        F.lit(kind).alias("kind"), F.col("seq"), F.col("role"), F.col("text"), F.col("cost"), F.lit(again).alias("again")
    )
    new = own.select("conv", "window", turn(2, False).alias("t"))
    first_system = known.where("own_system").select("conv", F.lit(0).cast("long").alias("window"), turn(0, False).alias("t"))
    system_again = heads.where("window > 0 and system is not null").select(
        "conv",
        "window",
        F.struct(
            F.lit(0).alias("kind"),
            F.lit(1).cast("long").alias("seq"),
            F.col("system.role").alias("role"),
            F.col("system.text").alias("text"),
            F.col("system_cost").cast("long").alias("cost"),
            F.lit(True).alias("again"),
        ).alias("t"),
    )
    step = max(1, history)
    near = heads.where("window > 0").select("conv", "window", F.expr(f"window div {step}").alias("near"))
    past = body.withColumn("near", F.explode(F.array(F.expr(f"place div {step}"), F.expr(f"place div {step} + 1"))))
    repeats = (
        past.join(near, ["conv", "near"])
        .where((F.col("place") < F.col("window")) & (F.col("place") >= F.col("window") - history))
        .select("conv", "window", turn(1, True).alias("t"))
    )
    whole = new.unionByName(first_system).unionByName(system_again).unionByName(repeats)
    windows = whole.groupBy("conv", "window").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            ((t["role"] == "assistant") & ~t["again"]).alias("target"),
        ),
    )
    nothing = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def spanned(done: Column, part: Column) -> Column:
        start = done["at"] + F.char_length(part["head"])
        length = F.char_length(part["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(STOP)).alias("at"),
            F.when(part["target"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return windows.withColumn("parts", parts).select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(STOP))), "").alias("text"),
        F.aggregate("parts", nothing, spanned)["spans"].alias("loss_spans"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["cost"]).alias("n_tokens"),
    )


def turns_of(windows: DataFrame) -> DataFrame:
    """Read back from `chat_windows`: each window's new turns as `role\\ntext\\n` and the texts under its loss mask."""
    pieces = F.expr(f"slice(split(text, '<[|]im_start[|]>', -1), 2 + repeated, size(split(text, '<[|]im_start[|]>', -1)))")

    def turn(p: Column) -> Column:
        whole = F.substring(p, F.lit(1), F.char_length(p) - len(STOP))
        role = F.substring_index(whole, "\n", 1)
        said = F.substring(whole, F.char_length(role) + 2, F.char_length(whole))
        return F.concat(unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n"))), F.lit("\n"), unescaped(said), F.lit("\n"))

    return windows.select(
        "conv_id",
        "window",
        F.transform(pieces, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring("text", s["start"] + 1, s["length"]))).alias("targets"),
        F.char_length("text").cast("long").alias("chars"),
    )
