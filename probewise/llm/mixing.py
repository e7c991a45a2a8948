"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from probewise.llm.shared import BLANKS, WORD, row_of, whole_text
from probewise.workspace import written

BLOCK = 64          # tokens of a block
SPREAD = 4096       # rows that one step of a two-level prefix sum orders at most, on average
WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5         # of all tokens
MOST = 2            # times a source may be read


def size_of() -> Column:
    """Words of the text, counted without building the list of them."""
    text = whole_text()
    blanks = F.length(text) - F.length(F.translate(text, BLANKS, ""))
    return (F.length(F.regexp_replace(text, WORD, "x")) - blanks).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    Targets are proportional to the weights, cut at ``most`` times the source, what is cut
    being shared again. Ordered by cap over weight the cut sources come first, so the level
    is found by running sums; one row per source is all these windows see.
    """
    everything = W.orderBy("ratio", "rank")
    before = everything.rowsBetween(W.unboundedPreceding, -1)
    onwards = everything.rowsBetween(W.currentRow, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    steps = (
        sizes.withColumn("rank", rank).withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("cut_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(onwards))
        .withColumn("level", (share * F.col("total") - most * F.col("cut_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size")))
    free = F.min(F.when(F.col("fits"), F.struct("ratio", "rank", "level"))).over(W.partitionBy())
    cut = F.col("free").isNull() | (F.struct("ratio", "rank") < F.struct("free.ratio", "free.rank"))
    return steps.withColumn("free", free).select(
        "source", "source_size", "rank",
        F.when(cut, (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: str, order: list[str], part: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` before each row of its group; ``part`` splits a group in order."""
    parts = df.groupBy(group, part).agg(F.sum(value).alias("of_part"))
    ahead = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("of_group"), F.col(part).alias("at_part"),
                         F.coalesce(F.sum("of_part").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy(group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(parts, (F.col(group) == F.col("of_group")) & (F.col(part) == F.col("at_part")))
    return joined.withColumn(name, F.col("ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(
        "of_group", "at_part", "ahead")


def schedule(sources: DataFrame, slots: int, cells: int = 1024, step: int = 1 << 16) -> DataFrame:
    """(slot, rank, turn): slot i belongs to the source whose stretch of [0, 1) holds the
    van der Corput point of i, and is its ``turn``-th slot.

    ``sources`` has (rank, needs): each source's stretch is as long as the slots it needs.
    Points are found by their cell of the unit interval, then by the exact bounds, so each
    slot meets only sources of its cell. Turns are counted in steps of ``step`` slots.
    """
    order = W.orderBy("rank")
    bounds = (
        sources.withColumn("all", F.sum("needs").over(W.partitionBy()))
        .withColumn("upto", F.sum("needs").over(order) / F.col("all"))
        .withColumn("since", (F.sum("needs").over(order) - F.col("needs")) / F.col("all"))
        .select("rank", "since", "upto", F.explode(F.sequence(
            F.floor(F.col("since") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)))).alias("cell")))
    digits = F.bin(F.col("id"))
    points = sources.sparkSession.range(slots).select(
        F.col("id").alias("slot"),
        (F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))).alias("point"))
    dealt = (
        points.withColumn("cell", F.floor(F.col("point") * cells))
        .join(bounds, "cell").filter("point >= since and point < upto")
        .select("slot", "rank", F.floor(F.col("slot") / step).alias("part"), F.lit(1).cast("long").alias("one")))
    return _running(dealt, "rank", ["slot"], "part", "one", "turn").select("slot", "rank", "turn")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
          block: int = BLOCK, seed: str = "mix", carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``row`` for every row of ``docs``.

    The documents of a source are laid end to end in the order of a hash and cut into
    blocks of ``block`` tokens (the last may be shorter). The schedule gives each source its
    turns; turn t reads block t modulo the number of blocks, and turns end at the target. A
    few turns more than needed are scheduled, the discrepancy bound of the points, so each
    source reaches its target exactly (rounded); no block is read more than ``most`` times.

    ``source`` may be null (a source of its own, last); a missing text has no tokens and
    is taken 0 times; rows repeated whole are separate rows; no rows give none.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    laid = written(docs.select(
        "doc_id", "source", size_of().alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("read"), row_of(list(carry)).alias("row")), "mix-sizes")
    rows = laid.drop("row")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    once = F.greatest("source_size", F.lit(1))
    sources = written(
        targets(sizes, weights, share, most)
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("wanted", F.round("target").cast("long"))
        .withColumn("needed", F.floor(F.col("wanted") / once) * F.col("blocks") + F.ceil(F.pmod("wanted", once) / block))
        .withColumn("needed_by_all", F.sum("needed").over(W.partitionBy()))
        .withColumn("needs", F.when(F.col("needed") > 0, F.col("needed") + 4 + F.ceil(
            2 * F.log2(F.col("needed_by_all") + 2) / 3)).otherwise(0)), "mix-sources")
    slots = int(sources.agg(F.sum("needs")).first()[0] or 0)

    turns = (
        schedule(sources.filter("needs > 0").select("rank", "needs"), slots)
        .join(sources.select("rank", "blocks", "source_size", "wanted", "needed"), "rank").filter("turn < needed"))
    start = F.floor(F.col("turn") / F.col("blocks")) * F.col("source_size") + F.pmod("turn", "blocks") * block
    # a turn that ends inside its block reads only the first ``least`` tokens of it
    read_blocks = (
        turns.withColumn("left", F.col("wanted") - start)
        .groupBy(F.col("rank").alias("of_rank"), F.pmod("turn", "blocks").alias("of_block"))
        .agg(F.count("*").alias("times"), F.min("left").alias("least"))
        .withColumn("whole", F.when(F.col("least") < block, F.col("times") - 1).otherwise(F.col("times"))))

    parts = max(1, rows.count() // SPREAD)
    part = F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48) * parts)
    placed = _running(
        rows.withColumn("part", part).join(
            sources.select(F.col("source").alias("of"), "rank", "source_size", "target"),
            F.col("source").eqNullSafe(F.col("of"))),
        "rank", ["key", "doc_id", "tie", "size", "read"], "part", "size", "begin")
    first = F.col("block") * block
    pieces = (
        placed.filter("size > 0").select("read", "rank", "begin", "size", F.explode(F.sequence(
            F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
        .select("read", "rank", "block", F.greatest(F.col("begin") - first, F.lit(0)).alias("low"),
                F.least(F.col("begin") + F.col("size") - first, F.lit(block)).alias("high")))
    last = F.when(F.col("least") < block, F.greatest(F.lit(0), F.least("high", "least") - F.col("low"))).otherwise(0)
    taken = (
        pieces.join(read_blocks, (F.col("rank") == F.col("of_rank")) & (F.col("block") == F.col("of_block")))
        .groupBy("read").agg(F.sum(F.col("whole") * (F.col("high") - F.col("low")) + last).alias("taken")))
    out = placed.join(taken, "read", "left").select(
        "read", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return (out.join(laid.select("read", "row"), "read") if carry else out).drop("read")
