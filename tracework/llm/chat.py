"""Chat formatting with budgeted windows, native.

A turn is written as OPEN role MIDDLE text CLOSE; "~" and "<|" inside roles and texts are escaped as "~0" and "~1", so
no control string can stand inside a text, and unescaping is exact. A turn's tokens are the UTF-8 bytes of what is
written: no byte-level tokenizer makes more tokens of it, so the budgets hold for all of them, whatever the text.

Conversations are dealt in blocks of BLOCK turn numbers, and windows end with their block. Prefix sums of the tokens over
a block choose the windows: a turn whose tokens fall into one stretch of `stride` tokens belongs to that stretch's
window, a turn that crosses a boundary gets a window of its own. So a window holds whole turns, at most `stride` tokens
of them or one turn. Each window but the first retains the conversation's system turn (a first turn of role system) in
full and repeats up to `history` turns before its own (of the block before, if need be; none of role system), the nearest
ones as long as they have at most `history_tokens` together. `system_tokens` are set aside for the system turn; what a
longer one has beyond them comes out of the history's tokens first, then out of the stretch. Only the assistant texts of
a window's own turns stand under its loss mask; repeated ones are masked.

Texts are shuffled once, to their blocks. What a block needs of others (the system turn, the last turns before it) is
found for conversations of more than one block only, and no task holds all rows of a conversation before its texts are
put together.

Defined results: null texts and roles are empty; rows are ordered by turn, role and the text's MD5 (null turns first, in a
block of their own), repeated rows are turns of their own; a turn longer than a stretch is a whole window, never cut; a
null conv_id is a conversation; an empty table gives no rows; clashing input columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the template's marks and escapes
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
ESCAPES = [("~", "~0"), ("<|", "~1")]

STRIDE = 4096
SYSTEM_TOKENS = 1024
HISTORY = 2
HISTORY_TOKENS = 1024
BLOCK = 256
#: The block of turns without a number, before all others.
NO_TURN = -(1 << 62)

_TURN = "struct<k:int,role:string,marked:string,tokens:bigint>"
_TURNS = f"array<{_TURN}>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _keyed(conversations: DataFrame, block: int) -> DataFrame:
    """conv_id, _c (the conversation, never null), block and turn of every row, and whatever else it has."""
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return conversations.withColumn("_c", key).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(NO_TURN)))


def marked_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, _c, block, turn, role, tie, marked, tokens) of every row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))
    rows = _keyed(conversations.select("conv_id", "turn", role.alias("role"), F.md5(text).alias("tie"), marked.alias("marked")), block)
    return rows.withColumn("tokens", F.octet_length("marked").cast("long"))


ORDER = ["turn", "role", "tie"]


def neighbours(conversations: DataFrame, history: int, block: int) -> DataFrame:
    """(_c, block, first_block, system, tail) of the blocks of conversations that have more than one: the conversation's
    system turn, and the last `history` turns before the block. Both come from rows that a rank picks, which Spark does
    before it shuffles them."""
    places = _keyed(conversations.select("conv_id", "turn"), block).select("_c", "block")
    several = places.groupBy("_c").agg(F.min("block").alias("first_block"), F.max("block").alias("_last")).where("first_block <> _last").drop("_last")
    blocks = places.distinct().join(several, "_c")
    rows = marked_turns(conversations, block).join(several, "_c", "left_semi")
    turn = F.struct(F.lit(0).alias("k"), "role", "marked", "tokens").cast(_TURN)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy("block", *ORDER))).where("_n = 1 AND role = 'system'")
    info = blocks.join(first.select("_c", turn.alias("system")), "_c", "left")
    if not history:
        return info.withColumn("tail", F.array().cast(_TURNS))
    back = Window.partitionBy("_c", "block").orderBy(*[F.desc(c) for c in ORDER])
    last = rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= history).select("_c", "block", "_n", turn.alias("t"))
    # a block may have fewer turns than the history, so it hands them on to as many blocks
    ahead = Window.partitionBy("_c").orderBy("block")
    following = blocks.select("_c", "block", F.array(*[F.lead("block", d).over(ahead) for d in range(1, history + 1)]).alias("ahead"))
    following = following.select("_c", "block", F.posexplode("ahead").alias("d", "to")).where("to IS NOT NULL")
    handed = last.join(following, ["_c", "block"]).groupBy("_c", F.col("to").alias("block")).agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), (-F.col("_n")).alias("n"), "t"))).alias("h"))
    tail = handed.select("_c", "block", F.transform(F.slice("h", F.greatest(F.size("h") - history + 1, F.lit(1)), history), lambda x: x["t"]).alias("tail"))
    return info.join(tail, ["_c", "block"], "left").withColumn("tail", F.coalesce("tail", F.array().cast(_TURNS)))


def _window_of(start: Column, tokens: Column, stride: Column) -> Column:
    """2b for a turn inside stretch b, 2b + 1 for one that starts in b and crosses its end: windows in order of turns."""
    first, last = F.floor(start / stride), F.floor((start + tokens - 1) / stride)
    return 2 * first + F.when(first == last, 0).otherwise(1)


def windows(
    conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS,
    system_tokens: int = SYSTEM_TOKENS, block: int = BLOCK,
) -> DataFrame:
    """One row a window: conv_id, block and window (its order), formatted, and for each turn in it own (its own or a
    repeated one) and loss (under the mask)."""
    inside = Window.partitionBy("_c", "block").orderBy(*ORDER)
    rows = marked_turns(conversations, block).select(
        "*",
        F.row_number().over(inside).alias("k"),
        F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.first(F.struct(F.lit(0).alias("k"), "role", "marked", "tokens").cast(_TURN)).over(inside).alias("head"),
    )
    rows = rows.join(neighbours(conversations, history, block), ["_c", "block"], "left")
    begins = F.col("first_block").isNull() | (F.col("first_block") == F.col("block"))
    rows = rows.withColumn("begins", begins).withColumn("system", F.coalesce("system", F.when(F.col("begins") & (F.col("head.role") == "system"), F.col("head"))))
    beyond = F.greatest(F.coalesce("system.tokens", F.lit(0)) - system_tokens, F.lit(0))
    spare = history_tokens if history else 0
    left = F.greatest(F.lit(stride) - F.greatest(beyond - spare, F.lit(0)), F.lit(1))
    own = F.array_sort(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "role", "marked", "tokens").cast(_TURN)))
    # by _c and block, as the rows stand already: no shuffle
    built = rows.groupBy("_c", "block", _window_of(F.col("start"), F.col("tokens"), left).alias("window")).agg(
        F.first("conv_id").alias("conv_id"), own.alias("turns"), F.first("system").alias("system"), F.first("begins").alias("begins"),
        F.first("tail").alias("tail"), F.first(F.lit(spare) - beyond).alias("budget"),
    )
    none = F.array().cast(_TURNS)
    before = Window.partitionBy("_c", "block").orderBy("window")
    told = F.concat(F.coalesce("tail", none), *[F.coalesce(F.lag("turns", d).over(before), none) for d in range(history, 0, -1)])
    built = built.withColumn("near", F.slice(told, F.greatest(F.size(told) - history + 1, F.lit(1)), history) if history else none)
    built = built.withColumn("near", F.filter("near", lambda t: t["role"] != "system"))
    upto = lambda i: F.aggregate(F.slice("near", i + 1, F.size("near")), F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    again = F.filter("near", lambda t, i: upto(i) <= F.col("budget"))
    # the window that has the system turn itself doesn't repeat it
    holds = F.col("begins") & (F.col("turns")[0]["k"] == 1)
    lead = F.when(F.col("system").isNotNull() & ~holds, F.array("system")).otherwise(none)
    every = built.select("conv_id", "block", "window", F.concat(lead, again).alias("before"), "turns")
    flags = lambda value, turns: F.transform(turns, lambda t: F.lit(value))
    return every.select(
        "conv_id", "block", "window", F.array_join(F.transform(F.concat("before", "turns"), lambda t: t["marked"]), "").alias("formatted"),
        F.concat(flags(False, F.col("before")), flags(True, F.col("turns"))).alias("own"),
        F.concat(flags(False, F.col("before")), F.transform("turns", lambda t: t["role"] == "assistant")).alias("loss"),
    )


def read_back(built: DataFrame) -> DataFrame:
    """One row a window: conv_id, block, window, chars, and its own turns (role, text, loss), parsed from the formatted text."""
    pieces = F.filter(F.split("formatted", "<\\|turn\\|>"), lambda x: x != "")
    parsed = F.transform(
        F.arrays_zip(pieces.alias("piece"), F.col("own"), F.col("loss")),
        lambda x: F.struct(
            unescape(F.split_part(x["piece"], F.lit(MIDDLE), F.lit(1))).alias("role"),
            unescape(F.split_part(F.split_part(x["piece"], F.lit(MIDDLE), F.lit(2)), F.lit(CLOSE), F.lit(1))).alias("text"),
            x["own"].alias("own"), x["loss"].alias("loss"),
        ),
    )
    return built.select("conv_id", "block", "window", F.length("formatted").cast("long").alias("chars"), F.transform(F.filter(parsed, lambda t: t["own"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["loss"].alias("loss"))).alias("turns"))


def digests(built: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows. A digest is of
    a whole conversation, so its texts meet in one row."""
    whole = read_back(built).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "window", "turns"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = whole.select("conv_id", "formatted_chars", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    targets = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), targets.alias("targets"), "formatted_chars").select(
        "conv_id", "n_turns", "turns_sha256", F.length("targets").cast("long").alias("loss_chars"), F.sha2("targets", 256).alias("loss_sha256"), "formatted_chars"
    )
