"""Chat formatting with cumulative-snapshot collapse.

A logged conversation is often a snapshot of one that went on. Each turn gets a rolling hash of all turns so far: running sums,
over the conversation's turns in order, of three 40-bit lanes hashed from (position, role, text). A conversation whose last hash
is a turn-prefix hash of a longer one is a snapshot; an anti-join drops it. Of conversations with the same turns the smallest id
stays. What is left is rendered.

A conversation may be of any length. All turns are dealt out by ranges of (conversation, turn, role, text); positions and sums are
found within a range and lifted by those of the conversation's earlier ranges. A long chat comes out in blocks, each a row.

Defined results: turns are ordered by turn, role, text, nulls first; a row equal to the one before it in that order counts once;
rows of a null conv_id are one conversation; a null role or text differs from any other, and is rendered as ``unknown`` and as empty; the chat of a
conversation is that of its blocks in order, and one of less than ``BLOCK_CHARS`` characters is block 0 alone; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LANES = 3
#: A lane's hash has 40 bits, so a running sum fits in a long for 8 million turns of one range; sums over ranges are cut to 40 bits.
LANE_BITS = 40
MASK = (1 << LANE_BITS) - 1
#: Characters of a text that tell ranges apart; the order within a range is by the whole text.
OPENING = 64
#: A block holds the turns that begin in one stretch of so many characters of the chat, each whole.
BLOCK_CHARS = 1 << 22


def block_of_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def dealt(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) without repeated rows, with range and seq: seq rises in order and by one within a range."""
    keys = ["conv_id", "turn", "role", "text"]
    # The bounds of ranges are sampled into the driver: an opening of the text is enough there, and keeps the order.
    ranged = turns.select(*keys).distinct().repartitionByRange(*keys[:3], F.left("text", F.lit(OPENING))).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn("range", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))


def lifted(rows: DataFrame, sums: DataFrame, names: list[str]) -> DataFrame:
    """rows with the columns of sums(conv_id, range, ...), found by conversation and range."""
    own = sums.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), *names)
    return rows.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r"))).drop("_c", "_r")


def numbered(turns: DataFrame) -> DataFrame:
    """dealt turns as conv_id, range, seq, pos from 0, n_turns, and own hashes and size of each turn; texts stay behind."""
    told = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    content = [F.xxhash64(F.lit(k), *told).alias(f"c{k}") for k in range(2)]
    size = F.length(block_of_turn(F.col("role"), F.col("text"))).cast("long").alias("size")
    slim = turns.select("conv_id", "range", "seq", *content, size)
    conv = Window.partitionBy("conv_id")
    # A conversation has as many rows here as ranges it reaches into.
    starts = slim.groupBy("conv_id", "range").agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    starts = starts.withColumn("before", F.sum("held").over(conv.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).withColumn("n_turns", F.sum("held").over(conv))
    return lifted(slim, starts, ["first", "before", "n_turns"]).withColumn("pos", F.col("before") + F.col("seq") - F.col("first")).drop("first", "before")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """numbered turns as conv_id, seq, n_turns, n, the turns so far, key, the hash of those turns, and block."""
    lanes = [f"h{k}" for k in range(LANES)]
    own = turns.select("conv_id", "range", "seq", "n_turns", "pos", "size", *[F.xxhash64(F.lit(k), "pos", "c0", "c1").bitwiseAND(F.lit(MASK)).alias(f"h{k}") for k in range(LANES)])
    sums = own.groupBy("conv_id", "range").agg(F.sum("size").alias("size"), *[F.sum(h).bitwiseAND(F.lit(MASK)).alias(h) for h in lanes])
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ["size", *lanes]])
    so_far = Window.partitionBy("conv_id", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ran = own.select("conv_id", "range", "seq", "n_turns", "pos", (F.sum("size").over(so_far) - F.col("size")).alias("size"), *[F.sum(h).over(so_far).alias(h) for h in lanes])
    ran = lifted(ran, sums, [f"{c}_before" for c in ["size", *lanes]])
    key = F.struct((F.col("pos") + 1).alias("n"), *[(F.col(h) + F.col(f"{h}_before")).bitwiseAND(F.lit(MASK)).alias(h) for h in lanes])
    block = F.floor((F.col("size") + F.col("size_before")) / F.lit(BLOCK_CHARS)).cast("long")
    return ran.select("conv_id", "seq", "n_turns", (F.col("pos") + 1).alias("n"), key.alias("key"), block.alias("block"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (conversations of the same turns, itself counted) of those that stay."""
    last = hashed.filter(F.col("n") == F.col("n_turns")).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashed.filter(F.col("n") < F.col("n_turns")).select("key").distinct()
    return last.join(inner, "key", "left_anti").select("conv_id", F.col("key.n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """turns(conv_id, seq, role, text, block, ...) as conv_id, block, n_turns, n_copies and chat, the block's turns in order as marked blocks."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    chats = turns.groupBy("conv_id", "block", "n_turns", "n_copies").agg(rows.alias("rows"))
    return chats.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.transform("rows", lambda t: block_of_turn(t["role"], t["text"]))).alias("chat"), "block")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat and block of each maximal conversation."""
    turns = dealt(conversations)
    hashed = materialize(prefix_hashes(numbered(turns)))
    stay = maximal(hashed).select(F.col("conv_id").alias("keep_id"), "n_turns", "n_copies")
    places = hashed.select("conv_id", "seq", "block").join(stay, F.col("conv_id").eqNullSafe(F.col("keep_id"))).select("seq", "block", "n_turns", "n_copies")
    return render(turns.select("conv_id", "seq", "role", "text").join(places, "seq"))
