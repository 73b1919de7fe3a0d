"""Cross-validation roles, leakage-safe by construction.

Every scenario returns rows ``(scenario, fold, bin, ko, label)`` for all folds at once; cells get
their role by a join on (bin, condition). Controls train, except where a scenario splits them by
cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators.sampling import seeded_digest
from deltascreen.operators.scale import hash_rank, scalar, tile

# Scenario names and the ones that hold out bins.
SCENARIOS = ["UnseenPert", "UnseenCell", "UnseenBoth", "UnseenPair", "UnseenDose", "UnseenCombo"]
BIN_SCENARIOS = ["UnseenCell", "UnseenBoth", "UnseenPair"]
PAIR_MASK_SCENARIOS = ["UnseenBoth", "UnseenPair"]
VAL_SHARE = 0.1375


def ranked(items: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Items in seeded random order: ``rank`` (1-based) and ``group_size``."""
    return hash_rank(items, [], seeded_digest(seed, *keys), keys)


def blocks(items: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """Near-equal random blocks with the position inside the block."""
    n = F.col("group_size")
    start = F.col("block") * F.floor(n / n_folds) + F.least(F.col("block"), n % n_folds)
    size = F.floor(n / n_folds) + (F.col("block") < n % n_folds).cast("int")
    return (
        ranked(items, keys, seed)
        .withColumn("block", tile(F.col("rank"), n, n_folds))
        .withColumn("pos", F.col("rank") - start)
        .withColumn("block_size", size)
        .drop("rank", "group_size")
    )


def floor_blocks(items: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """Floor-sized blocks; the last one takes the remainder."""
    n, step = F.col("group_size"), F.floor(F.col("group_size") / n_folds)
    last = F.lit(n_folds - 1)
    block = F.when(step == 0, last).otherwise(
        F.least(F.floor((F.col("rank") - 1) / F.greatest(step, F.lit(1))), last)
    )
    return (
        ranked(items, keys, seed)
        .withColumn("block", block.cast("int"))
        .withColumn("pos", F.col("rank") - F.col("block") * step)
        .withColumn("block_size", F.when(F.col("block") == last, n - last * step).otherwise(step))
        .drop("rank", "group_size")
    )


def _every_fold(df: DataFrame, n_folds: int) -> DataFrame:
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))


def _role(n_folds: int, val_size: Column) -> Column:
    """Test = own block; val = the first rows of the next block; the rest trains."""
    return (
        F.when(F.col("block") == F.col("fold"), "test")
        .when(
            (F.col("block") == F.pmod(F.col("fold") + 1, F.lit(n_folds))) & (F.col("pos") <= val_size),
            "val",
        )
        .otherwise("train")
    )


def fold_roles(items: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """Test/val/train of every item in every fold."""
    out = _every_fold(blocks(items, keys, n_folds, seed), n_folds)
    return out.withColumn("label", _role(n_folds, F.floor(F.col("block_size") / 2))).drop(
        "block", "pos", "block_size"
    )


def _kos(pairs: DataFrame) -> DataFrame:
    return pairs.select("ko").distinct()


def _tag(df: DataFrame, scenario: str) -> DataFrame:
    return df.select(F.lit(scenario).alias("scenario"), "fold", "bin", "ko", "label")


def _share_roles(items: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """Test = own slice; val = the first share of what remains, in draw order."""
    n = F.col("group_size")
    test_size = F.floor(n / n_folds) + (F.col("fold") < n % n_folds).cast("int")
    rest_rank = F.col("rank") - F.when(F.col("block") > F.col("fold"), test_size).otherwise(0)
    n_val = F.floor((n - test_size) * F.lit(VAL_SHARE))
    sliced = ranked(items, keys, seed).withColumn("block", tile(F.col("rank"), n, n_folds))
    label = (
        F.when(F.col("block") == F.col("fold"), "test")
        .when(rest_rank <= n_val, "val")
        .otherwise("train")
    )
    return _every_fold(sliced, n_folds).withColumn("label", label).drop("rank", "group_size", "block")


def unseen_pert_cells(cells: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Single-bin form, per cell: labels and control cells are sliced by independent draws."""
    ctrl = labels.is_control(F.col("condition"))
    kos = cells.where(~ctrl).select(F.col("condition").alias("ko")).distinct()
    by_ko = _share_roles(kos, ["ko"], n_folds, seed).withColumnRenamed("ko", "condition")
    perturbed = cells.where(~ctrl).select("cell_id", "condition").join(by_ko, "condition")
    controls = _share_roles(
        cells.where(ctrl).select("cell_id", "condition"), ["cell_id"], n_folds, seed + 1
    )
    columns = ["cell_id", "fold", "label"]
    return perturbed.select(*columns).unionByName(controls.select(*columns)).select(
        "cell_id", F.lit("UnseenPert").alias("scenario"), "fold", "label"
    )


def unseen_pert(pairs: DataFrame, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """Each label block is held out in every bin."""
    return _tag(pairs.join(fold_roles(_kos(pairs), ["ko"], n_folds, seed), "ko"), "UnseenPert")


def _bin_order(pairs: DataFrame, seed: int) -> DataFrame:
    return ranked(pairs.select("bin").distinct(), ["bin"], seed).select(
        "bin", (F.col("rank") - 1).alias("place"), F.col("group_size").alias("n_bins")
    )


def unseen_cell(pairs: DataFrame, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """One bin tests, the next one validates; needs three bins, folds are clamped to the bins."""
    order = _every_fold(_bin_order(pairs, seed).where("n_bins >= 3"), n_folds).where("fold < n_bins")
    label = (
        F.when(F.col("place") == F.col("fold"), "test")
        .when(F.col("place") == F.pmod(F.col("fold") + 1, F.col("n_bins")), "val")
        .otherwise("train")
    )
    roles = order.select("bin", "fold", label.alias("label"))
    return _tag(pairs.join(roles, "bin"), "UnseenCell")


def unseen_both(pairs: DataFrame, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """Held-out labels in a rotating held-out bin; everything else trains, non-singles are
    unassigned."""
    singles = _kos(pairs).where(labels.is_single(F.col("ko")))
    roles = fold_roles(singles, ["ko"], n_folds, seed).withColumnRenamed("label", "ko_role")
    order = _bin_order(pairs, seed).where("n_bins >= 2")
    turn = F.pmod(F.col("fold"), F.col("n_bins"))
    label = (
        F.when((F.col("ko_role") == "test") & (F.col("place") == turn), "test")
        .when(
            (F.col("ko_role") == "val") & (F.col("place") == F.pmod(turn + 1, F.col("n_bins"))), "val"
        )
        .when(F.col("ko_role").isNull(), "unassigned")
        .otherwise("train")
    )
    placed = _every_fold(pairs.join(order, "bin"), n_folds)
    return _tag(placed.join(roles, ["ko", "fold"], "left").withColumn("label", label), "UnseenBoth")


def unseen_pair(pairs: DataFrame, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """Random (bin, label) pairs; a label left without a training bin gets one pair back: the
    first validation pair, else the first test pair."""
    n_bins = scalar(pairs.agg(F.count_distinct("bin")))
    singles = pairs.where(labels.is_single(F.col("ko"))).where(n_bins >= 2)
    roles = fold_roles(singles, ["bin", "ko"], n_folds, seed)
    mine = W.partitionBy("fold", "ko")
    first = mine.orderBy(F.when(F.col("label") == "val", 0).otherwise(1), "bin")
    fixed = (
        roles.withColumn("has_train", F.max(F.col("label") == "train").over(mine))
        .withColumn("turn", F.row_number().over(first))
        .withColumn(
            "label",
            F.when(~F.col("has_train") & (F.col("turn") == 1), "train").otherwise(F.col("label")),
        )
    )
    rest = _every_fold(pairs.where(~labels.is_single(F.col("ko"))).where(n_bins >= 2), n_folds)
    return _tag(fixed, "UnseenPair").unionByName(
        _tag(rest.withColumn("label", F.lit("unassigned")), "UnseenPair")
    )


def _held_out_subset(
    pairs: DataFrame, member: Column, block_fn, scenario: str, n_folds: int, seed: int
) -> DataFrame:
    kos = _kos(pairs)
    some = block_fn(kos.where(member), ["ko"], n_folds, seed)
    at_least_one = F.greatest(F.lit(1), F.floor(F.col("block_size") / 2))
    roles = _every_fold(some, n_folds).withColumn("label", _role(n_folds, at_least_one))
    rest = _every_fold(pairs.where(~member), n_folds).withColumn("label", F.lit("train"))
    held = pairs.join(roles, "ko")
    present = scalar(kos.agg(F.count_if(member)))
    return _tag(held, scenario).unionByName(_tag(rest.where(present > 0), scenario))


def unseen_dose(pairs: DataFrame, n_folds: int = 2, seed: int = 0) -> DataFrame:
    """Only labels with a dose are partitioned; empty when there is none."""
    return _held_out_subset(pairs, F.col("ko").contains("@"), blocks, "UnseenDose", n_folds, seed)


def unseen_combo(pairs: DataFrame, n_folds: int = 2, seed: int = 42) -> DataFrame:
    """Only combinations are partitioned; singles train."""
    return _held_out_subset(pairs, F.col("ko").contains("+"), floor_blocks, "UnseenCombo", n_folds, seed)


BUILDERS = {
    "UnseenPert": unseen_pert,
    "UnseenCell": unseen_cell,
    "UnseenBoth": unseen_both,
    "UnseenPair": unseen_pair,
    "UnseenDose": lambda pairs, n_folds: unseen_dose(pairs),
    "UnseenCombo": lambda pairs, n_folds: unseen_combo(pairs),
}


def all_pair_splits(pairs: DataFrame, n_folds: int = 5) -> DataFrame:
    return reduce(DataFrame.unionByName, [BUILDERS[s](pairs, n_folds) for s in SCENARIOS])


def cell_labels(cells: DataFrame, pair_split: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Role of every cell; controls train in every fold.

    ``carry`` names group columns of the cells that stay beside the roles, so that what counts roles by group
    (see ``with_groups``) doesn't send a row per cell and fold to meet the cells again.
    """
    ctrl = labels.is_control(F.col("condition"))
    keyed = pair_split.withColumnRenamed("ko", "condition")
    folds = pair_split.select("scenario", "fold").distinct()
    own = list(dict.fromkeys(["cell_id", "bin", "condition", *carry]))
    perturbed = cells.where(~ctrl).select(*own).join(keyed, ["bin", "condition"])
    jobs = scalar(folds.agg(F.collect_list(F.struct("scenario", "fold"))))
    controls = (
        cells.where(ctrl)
        .select("cell_id", *carry, F.explode(jobs).alias("job"))
        .select("cell_id", "job.scenario", "job.fold", F.lit("train").alias("label"), *carry)
    )
    return perturbed.select("cell_id", "scenario", "fold", "label", *carry).unionByName(controls)


def with_groups(cell_split: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Roles with the group columns of their cells: the carried ones, else by a join."""
    if set(columns) <= set(cell_split.columns):
        return cell_split
    return cell_split.select("cell_id", "scenario", "fold", "label").join(cells.select("cell_id", *columns), "cell_id")


def grid_from_cells(cells: DataFrame, cell_split: DataFrame) -> DataFrame:
    """(bin, ko) is train/test when any of its cells carries that role."""
    return (
        with_groups(cell_split, cells, ["bin", "condition"]).withColumnRenamed("condition", "ko")
        .groupBy("scenario", "fold", "bin", "ko")
        .agg(
            F.bool_or(F.col("label") == "train").alias("in_train"),
            F.bool_or(F.col("label") == "val").alias("in_val"),
            F.bool_or(F.col("label") == "test").alias("in_test"),
        )
    )


def train_pairs(pair_split: DataFrame) -> DataFrame:
    return pair_split.where("label = 'train'").select("scenario", "fold", "bin", "ko")


def test_pairs(pair_split: DataFrame) -> DataFrame:
    return pair_split.where("label = 'test'").select("scenario", "fold", "bin", "ko")


def rectangle(pair_split: DataFrame, label: str) -> DataFrame:
    """Marginal rectangle of a role: its bins with its labels, joined per fold."""
    some = pair_split.where(F.col("label") == label)
    kos = some.select("scenario", "fold", "ko").distinct()
    bins = some.select("scenario", "fold", "bin").distinct()
    return kos.join(bins, ["scenario", "fold"]).select("scenario", "fold", "bin", "ko")


def train_rectangle(pair_split: DataFrame) -> DataFrame:
    """Refuses the pair-mask scenarios, whose rectangle would include the held-out corner."""
    masked = F.col("scenario").isin(PAIR_MASK_SCENARIOS)
    bad = F.raise_error(F.lit("train rectangle is not defined for a pair mask")).cast("string")
    return rectangle(pair_split, "train").withColumn(
        "scenario", F.when(masked, bad).otherwise(F.col("scenario"))
    )


def check_axis(pair_split: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bins and labels of the store that the mask does not know."""
    bins = pairs.select(F.lit("bin").alias("axis"), F.col("bin").alias("name")).distinct()
    kos = pairs.select(F.lit("ko").alias("axis"), F.col("ko").alias("name")).distinct()
    seen = pair_split.select(F.explode(F.array(
        F.struct(F.lit("bin").alias("axis"), F.col("bin").alias("name")),
        F.struct(F.lit("ko").alias("axis"), F.col("ko").alias("name")),
    )).alias("s")).select("s.*").distinct()
    return bins.unionByName(kos).join(seen, ["axis", "name"], "left_anti")


def condition_lists(cells: DataFrame, cell_split: DataFrame) -> DataFrame:
    """Distinct labels per role, without anything that contains ``ctrl`` or ``*``."""
    return (
        with_groups(cell_split, cells, ["condition"])
        .where(~F.col("condition").contains("ctrl") & ~F.col("condition").contains("*"))
        .select("scenario", "fold", "label", "condition")
        .distinct()
    )


def available_jobs(pair_split: DataFrame) -> DataFrame:
    return pair_split.select("scenario", "fold").distinct()


def wide_cell_split(cell_split: DataFrame, scenario: str, n_folds: int) -> DataFrame:
    """Export form: one column per fold."""
    return (
        cell_split.where(F.col("scenario") == scenario)
        .groupBy("cell_id")
        .pivot("fold", list(range(n_folds)))
        .agg(F.first("label"))
    )
