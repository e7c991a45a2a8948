"""One leakage-free train/val/test split by example, and its uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from probewise.config import SplitSettings
from probewise.operators.sampling import find_cuts, hash_order, is_taken
from probewise.operators.small import pin, pinned
from probewise.workspace import written

SPLITS = ("train", "val", "test")
MISSING = "None"  # how a missing domain or label is written in a stratum


def stratum_key(domain: str = "domain", y: str = "y") -> Column:
    """The stratum of a row; a missing domain or label is a value of its own, so no row is lost."""
    return F.concat(known(F.col(domain)), F.lit("__label_"), known(F.col(y)))


def known(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def stratum_quotas(strata: DataFrame, fraction: float) -> DataFrame:
    """Rows to take per stratum: (stratum, pool, n, quota) from (stratum, n).

    Shares are rounded by largest remainder, ties by key. When a stratum is too
    small to be represented on both sides, all rows form one pool ``*``.
    """
    everything = Window.partitionBy(F.lit(0))
    table = strata.withColumns({
        "total": F.sum("n").over(everything),
        "k": F.count(F.lit(1)).over(everything),
        "smallest": F.min("n").over(everything),
    }).withColumn("take", F.ceil(F.col("total") * F.lit(float(fraction))).cast("long"))
    stratified = (
        (F.col("k") >= 2) & (F.col("smallest") >= 2) & (F.col("take") >= F.col("k"))
        & (F.col("total") - F.col("take") >= F.col("k")))
    product = "cast(take as decimal(19,0)) * cast(n as decimal(19,0))"
    table = table.withColumns({
        "stratified": stratified,
        "share": F.expr(f"({product}) div total"),
        "remainder": F.expr(f"({product}) % total"),
    })
    by_remainder = Window.partitionBy(F.lit(0)).orderBy(F.desc("remainder"), "stratum")
    table = table.withColumns({
        "spare": F.col("take") - F.sum("share").over(everything),
        "place": F.row_number().over(by_remainder),
    })
    quota = F.col("share") + F.when(F.col("place") <= F.col("spare"), 1).otherwise(0)
    return table.select(
        "stratum",
        F.when(F.col("stratified"), F.col("stratum")).otherwise(F.lit("*")).alias("pool"),
        F.when(F.col("stratified"), F.col("n")).otherwise(F.col("total")).alias("n"),
        F.when(F.col("stratified"), quota).otherwise(F.col("take")).cast("long").alias("quota"))


def _fraction_quotas(strata: DataFrame, fraction: float) -> tuple[DataFrame, bool, bool]:
    """Quotas of (stratum, n), whether they are few, and whether every stratum is its own pool."""
    quotas, rows = pin(stratum_quotas(strata, fraction))
    return quotas, rows is not None, rows is not None and "*" not in rows.column("pool").to_pylist()


def _fraction_cuts(rows: DataFrame, quotas: DataFrame, few: bool, seed: int) -> DataFrame:
    """Cut per stratum for the quotas of its pool."""
    pooled = rows.join(quotas.select("stratum", "pool"), "stratum")
    pools = quotas.select("pool", F.lit("").alias("target"), "n", "quota").distinct()
    cuts = find_cuts(pooled, F.broadcast(pools) if few else pools, few, seed, stratum="pool")
    return quotas.select("stratum", "pool").join(cuts, "pool").drop("pool", "target")


class SplitRule:
    """A split as a rule: the hash cut of every stratum for test and for val.

    Applying it is a comparison per row, so vectors are tagged where they lie and
    need no join with a table of ids.
    """

    def __init__(self, test_cuts: DataFrame, val_cuts: DataFrame, seed: int):
        def named(cuts: DataFrame, prefix: str) -> DataFrame:
            return cuts.select("stratum", *[F.col(c).alias(f"_{prefix}_{c}")
                                            for c in ("n", "quota", "cut_h", "cut_id")])
        self.cuts = pinned(named(test_cuts, "t").join(named(val_cuts, "v"), "stratum", "left"))
        self.seed = seed

    def tag(self, rows: DataFrame, stratum: Column | None = None) -> DataFrame:
        """Add ``split``; every id must have one domain and label."""
        order, row_id = F.col("_h"), F.col("example_id")
        name = (F.when(is_taken(order, row_id, "_t_"), "test")
                .when(is_taken(order, row_id, "_v_"), "val").otherwise("train"))
        keyed = rows.withColumn("stratum", stratum_key() if stratum is None else stratum)
        return (keyed.join(self.cuts, "stratum").withColumn("_h", hash_order(self.seed))
                .withColumn("split", name)
                .drop("stratum", "_h", *[c for c in self.cuts.columns if c != "stratum"]))


def split_rule(rows: DataFrame, settings: SplitSettings = SplitSettings()) -> SplitRule:
    """Find the cuts from unique (example_id, stratum).

    Val is the stretch after test in the same order. Where both fractions are
    stratified, the sizes left after test are known, and one job finds all cuts.
    """
    strata = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    test, few, stratified = _fraction_quotas(strata, settings.test_fraction)
    if stratified:
        left = test.select("stratum", (F.col("n") - F.col("quota")).alias("n"))
        val, _, val_stratified = _fraction_quotas(left, settings.val_fraction)
        if val_stratified:
            both = test.select("stratum", F.lit("test").alias("target"), "n", "quota").unionByName(
                test.join(val.select("stratum", F.col("quota").alias("_v")), "stratum").select(
                    "stratum", F.lit("val").alias("target"), "n", (F.col("quota") + F.col("_v")).alias("quota")))
            cuts = find_cuts(rows, F.broadcast(both), True, settings.seed)
            named = {t: cuts.filter(F.col("target") == t).drop("target") for t in ("test", "val")}
            return SplitRule(named["test"], named["val"], settings.seed)
    test_cuts = _fraction_cuts(rows, test, few, settings.seed)
    rest = rows.join(test_cuts, "stratum").filter(
        ~is_taken(hash_order(settings.seed), F.col("example_id"))).select("example_id", "stratum")
    left = rest.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    val, few, _ = _fraction_quotas(left, settings.val_fraction)
    return SplitRule(test_cuts, _fraction_cuts(rest, val, few, settings.seed), settings.seed)


def split_examples(rows: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """(example_id, split) from unique (example_id, stratum)."""
    return split_rule(rows, settings).tag(rows, F.col("stratum")).select("example_id", "split")


def one_row_per_example(acts: DataFrame) -> DataFrame:
    """(example_id, domain, y, conflict): the smallest (domain, y) stands for a repeated id.

    ``conflict`` marks ids that come with more than one pair.
    """
    pair = F.struct("domain", "y")
    return acts.groupBy("example_id").agg(F.min(pair).alias("_r"), F.max(pair).alias("_s")).select(
        "example_id", "_r.domain", "_r.y", (F.col("_r") != F.col("_s")).alias("conflict"))


def shared_split(acts: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """The split all classifiers share: strata are (domain, label) pairs."""
    rows = one_row_per_example(acts).select("example_id", stratum_key().alias("stratum"))
    return split_examples(written(rows, "split-rows"), settings)


def fallback_split(acts: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """Split used for one scope when no shared split is given: strata are labels."""
    rows = one_row_per_example(acts).select("example_id", known(F.col("y")).alias("stratum"))
    return split_examples(written(rows, "split-rows"), settings)


def rows_in_split(rows: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Rows (examples or tokens) whose example belongs to one split."""
    if name not in SPLITS:
        raise ValueError(f"{name!r} is none of the splits {SPLITS}")
    return rows.join(split.filter(F.col("split") == name), "example_id", "left_semi")


def tag_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    return rows.join(split, "example_id")


def leaked_examples(split: DataFrame) -> DataFrame:
    """Example ids that occur in more than one split; empty when there is no leak."""
    return split.groupBy("example_id").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def coverage_gaps(acts: DataFrame, split: DataFrame) -> DataFrame:
    """Ids missing from the split or unknown to the data; empty when complete."""
    ids, seen = acts.select("example_id").distinct(), split.select("example_id").distinct()
    missing = ids.join(seen, "example_id", "left_anti").withColumn("gap", F.lit("missing"))
    unknown = seen.join(ids, "example_id", "left_anti").withColumn("gap", F.lit("unknown"))
    return missing.unionByName(unknown)


def split_counts(acts: DataFrame, split: DataFrame) -> DataFrame:
    return tag_split(acts, split).groupBy("split", "domain", "y").agg(F.count(F.lit(1)).alias("n"))
