"""Closed-form predictors: every one maps fold tables to ``(scenario, fold, bin, ko, gene, delta)``.

An absent row means "not emitted". All folds of all scenarios run in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators import blocks, bulk, discrimination, linear, splits, training
from deltascreen.operators.scale import cut
from deltascreen.operators.splits import SCENARIOS

FOLD = ["scenario", "fold"]
KEYS = [*FOLD, "bin", "ko", "gene"]
#: Columns of trained state: parts of a fold, keyed by what each part needs (see ``trained``).
STATE_SCHEMA = "scenario string, fold int, part string, bin string, ko string, gene string, i int, j int, weight double"
STATE = [c.split()[0] for c in STATE_SCHEMA.split(", ")]


@dataclass
class Screen:
    """Tables a predictor may read."""

    deltas: DataFrame
    ctrl: DataFrame
    genes: DataFrame
    split: DataFrame
    alpha: DataFrame | None = None
    options: dict = field(default_factory=dict)
    rect_table: DataFrame | None = None  # the test rectangle of ``split``, when it is stored

    @property
    def train(self) -> DataFrame:
        return splits.train_pairs(self.split)

    @property
    def rect(self) -> DataFrame:
        if self.rect_table is not None:
            return self.rect_table
        return splits.rectangle(self.split, "test")

    @property
    def grid(self) -> DataFrame:
        """Test rectangle with every feature: the deltas table is the spine."""
        return self.rect.join(self.deltas.select("bin", "ko", "gene", "ctrl"), ["bin", "ko"])

    @property
    def targets(self) -> DataFrame:
        kos = self.deltas.select("ko").distinct()
        return kos.select("ko", F.explode(F.array_distinct(labels.target_tokens(F.col("ko")))).alias("gene")).join(
            self.genes.select("gene"), "gene"
        ).select("ko", "gene")


@dataclass
class Predictor:
    name: str
    category: str
    scenarios: list[str]
    fn: Callable[[Screen], DataFrame]
    needs_training: bool = False
    has_drop_rule: bool = False
    fit: Callable[[Screen], DataFrame] | None = None
    predict: Callable[[Screen, DataFrame], DataFrame] | None = None
    parameters: Callable[[dict], dict] = lambda options: {}


REGISTRY: dict[str, Predictor] = {}


def register_predictor(name, category, scenarios, needs_training=False, has_drop_rule=False):
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"predictor {name!r} is already registered")
        REGISTRY[name] = Predictor(name, category, list(scenarios), fn, needs_training, has_drop_rule)
        return fn

    return wrap


def register_trained(name, scenarios, fit, predict, parameters=lambda options: {}, has_drop_rule=False):
    """A predictor that learns state rows with ``fit`` and needs only them (and control tables) in ``predict``."""
    register_predictor(name, "learned", scenarios, True, has_drop_rule)(lambda s: predict(s, fit(s)))
    REGISTRY[name].fit, REGISTRY[name].predict, REGISTRY[name].parameters = fit, predict, parameters


def as_state(df: DataFrame, name: str, **columns) -> DataFrame:
    """Rows of one part; keys that it does not name are null."""
    kinds = dict(c.split() for c in STATE_SCHEMA.split(", "))
    named = {"part": F.lit(name)} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    keys = [named.get(c, F.col(c) if c in FOLD else F.lit(None)).cast(kinds[c]).alias(c) for c in STATE]
    return df.select(*keys)


def part(state: DataFrame, name: str, **columns: str) -> DataFrame:
    """One part of a state: its fold and the named columns, renamed (``column="new name"``)."""
    return state.where(F.col("part") == name).select(*FOLD, *[F.col(k).alias(v) for k, v in columns.items()])


def emit(df: DataFrame, delta) -> DataFrame:
    return df.select(*KEYS, delta.cast("double").alias("delta"))


def guarded(df: DataFrame, screen: Screen) -> DataFrame:
    """``df``, failing where a fold has test pairs but no training pair.

    The failure is a branch of its own: what such a fold has learned is empty, so a check on the joined
    rows would never see one.
    """
    empty = screen.split.select(*FOLD).distinct().join(screen.train.select(*FOLD).distinct(), FOLD, "left_anti")
    bad = F.raise_error(F.concat_ws(" ", F.lit("empty training split:"), *FOLD)).cast("double")
    names = [F.lit(None).cast("string").alias(c) for c in ("bin", "ko", "gene")]
    return df.unionByName(empty.select(*FOLD, *names, bad.alias("delta")))


def scoped(name: str, screen: Screen) -> Screen:
    """The screen on the scenarios that a predictor serves."""
    served = F.col("scenario").isin(REGISTRY[name].scenarios)
    return Screen(
        screen.deltas, screen.ctrl, screen.genes, screen.split.where(served), screen.alpha, screen.options,
        None if screen.rect_table is None else screen.rect_table.where(served),
    )


def run(name: str, screen: Screen) -> DataFrame:
    """Predictions of one predictor on the scenarios it serves."""
    return REGISTRY[name].fn(scoped(name, screen)).withColumn("predictor", F.lit(name))


def run_all(names: list[str], screen: Screen) -> DataFrame:
    return reduce(DataFrame.unionByName, [run(n, screen) for n in names])


def roster(spark) -> DataFrame:
    """One row per (predictor, scenario) it serves."""
    rows = [
        (p.name, p.category, p.needs_training, p.has_drop_rule, s)
        for p in REGISTRY.values() for s in p.scenarios
    ]
    return spark.createDataFrame(
        rows, "predictor string, category string, needs_training boolean, has_drop_rule boolean, scenario string"
    )


def select_predictors(selector: str, scenario: str | None = None) -> list[str]:
    """Comma list of names or categories, or ``all``; unknown names raise, others are filtered."""
    chosen: list[str] = []
    for token in (t.strip() for t in selector.split(",")):
        if token == "all":
            chosen += list(REGISTRY)
        elif token in REGISTRY:
            chosen.append(token)
        elif token in {p.category for p in REGISTRY.values()}:
            chosen += [p.name for p in REGISTRY.values() if p.category == token]
        else:
            raise KeyError(f"unknown predictor or category {token!r}")
    names = list(dict.fromkeys(chosen))
    return [n for n in names if scenario is None or scenario in REGISTRY[n].scenarios]


def select_folds(selector: str, n_folds: int) -> list[int]:
    """``all``, ``0,2`` or ``0-3``."""
    if selector == "all":
        return list(range(n_folds))
    out: list[int] = []
    for token in selector.split(","):
        low, _, high = token.strip().partition("-")
        out += range(int(low), int(high or low) + 1)
    if any(f >= n_folds for f in out):
        raise ValueError(f"fold outside 0..{n_folds - 1}")
    return sorted(set(out))


# ---- means -------------------------------------------------------------------------------
@register_predictor("Zero", "analytical", SCENARIOS)
def zero(s: Screen) -> DataFrame:
    return emit(s.grid, F.lit(0.0))


@register_predictor("Mean-over-perturbations", "analytical", ["UnseenPert", "UnseenPair"])
def mean_over_perturbations(s: Screen) -> DataFrame:
    """Training mean of the test bin; a bin without training pairs is not emitted."""
    means = bulk.mean_per_bin(s.deltas, s.train)
    return emit(s.grid.join(means, [*FOLD, "bin", "gene"]), F.col("m_bin"))


@register_predictor("Mean-over-cell-types", "analytical", ["UnseenCell", "UnseenPair"])
def mean_over_cell_types(s: Screen) -> DataFrame:
    """Training mean of the label over its training bins."""
    means = bulk.mean_per_ko(s.deltas, s.train)
    return guarded(emit(s.grid.join(means, [*FOLD, "ko", "gene"]), F.col("m_ko")), s)


@register_predictor(
    "Mean-over-perturbations-and-cell-types", "analytical",
    ["UnseenPert", "UnseenCell", "UnseenBoth", "UnseenPair"],
)
def mean_over_both(s: Screen) -> DataFrame:
    means = bulk.mean_all(s.deltas, s.train)
    return guarded(emit(s.grid.join(means, [*FOLD, "gene"]), F.col("m_all")), s)


@register_predictor("Two-way-mean", "analytical", ["UnseenPair"])
def two_way_mean(s: Screen) -> DataFrame:
    """Global mean + bin effect + label effect; unseen bins and labels are not emitted."""
    rows = (
        s.grid.join(bulk.mean_per_bin(s.deltas, s.train), [*FOLD, "bin", "gene"])
        .join(bulk.mean_per_ko(s.deltas, s.train), [*FOLD, "ko", "gene"])
        .join(bulk.mean_all(s.deltas, s.train), [*FOLD, "gene"])
    )
    return guarded(emit(rows, F.col("m_bin") + F.col("m_ko") - F.col("m_all")), s)


# ---- combinations and doses --------------------------------------------------------------
def combo_parts(pairs: DataFrame) -> DataFrame:
    """Two-way combinations with their sorted components."""
    parts = F.array_sort(F.split("ko", r"\+"))
    return pairs.where(F.size(parts) == 2).select(
        *FOLD, "bin", "ko", parts[0].alias("ko_a"), parts[1].alias("ko_b")
    )


def combo_deltas(pairs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Component deltas of every combination whose two singles exist."""
    a = deltas.select("bin", F.col("ko").alias("ko_a"), "gene", F.col("d_all").alias("d_a"))
    b = deltas.select("bin", F.col("ko").alias("ko_b"), "gene", F.col("d_all").alias("d_b"))
    return combo_parts(pairs).join(a, ["bin", "ko_a"]).join(b, ["bin", "ko_b", "gene"])


@register_predictor("Additive", "analytical", ["UnseenCombo"], has_drop_rule=True)
def additive(s: Screen) -> DataFrame:
    return emit(combo_deltas(s.rect, s.deltas), F.col("d_a") + F.col("d_b"))


@register_predictor("Matching-mean", "analytical", ["UnseenCombo"], has_drop_rule=True)
def matching_mean(s: Screen) -> DataFrame:
    return emit(combo_deltas(s.rect, s.deltas), (F.col("d_a") + F.col("d_b")) / 2.0)


@register_predictor("Scaled-delta", "analytical", ["UnseenDose"], has_drop_rule=True)
def scaled_delta(s: Screen) -> DataFrame:
    """Dose times the full-dose delta."""
    full = s.deltas.select("bin", F.col("ko").alias("base"), "gene", "d_all")
    doses = s.rect.select(
        *FOLD, "bin", "ko", labels.strict_dose(F.col("ko")).alias("dose"),
        labels.dose_base(F.col("ko")).alias("base"),
    ).where(F.col("base").isNotNull())
    return emit(doses.join(full, ["bin", "base"]), F.col("dose") * F.col("d_all"))


# ---- target based ------------------------------------------------------------------------
def _target_grid(s: Screen) -> DataFrame:
    """Grid of labels with at least one resolvable target, with ``hit`` at the targets."""
    hits = s.targets.withColumn("hit", F.lit(True))
    return (
        s.grid.join(s.targets.select("ko").distinct(), "ko", "left_semi")
        .join(hits, ["ko", "gene"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )


@register_predictor("TargetZero", "analytical", SCENARIOS, has_drop_rule=True)
def target_zero(s: Screen) -> DataFrame:
    return emit(_target_grid(s), F.when(F.col("hit"), -F.col("ctrl")).otherwise(0.0))


def target_scale(s: Screen) -> DataFrame:
    """Least-squares factor per fold over the training target entries; degenerate folds fail."""
    rows = bulk.on_pairs(s.deltas.join(s.targets, ["ko", "gene"]), s.train)
    sums = rows.groupBy(*FOLD).agg(
        F.sum(F.col("d_all") * F.col("ctrl")).alias("num"),
        F.sum(F.col("ctrl") * F.col("ctrl")).alias("den"),
    )
    folds = s.split.select(*FOLD).distinct()
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    alpha = (
        F.when(F.col("den").isNull(), fail("no training target entries"))
        .when(F.col("den") < 2.220446049250313e-16, fail("control is zero at every target"))
        .otherwise(-F.col("num") / F.col("den"))
    )
    return folds.join(sums, FOLD, "left").select(*FOLD, alpha.alias("scale"))


def scale_state(s: Screen) -> DataFrame:
    return as_state(target_scale(s), "scale", weight="scale")


def scaled_targets(s: Screen, state: DataFrame) -> DataFrame:
    rows = _target_grid(s).join(part(state, "scale", weight="scale"), FOLD)
    return emit(rows, F.when(F.col("hit"), -F.col("scale") * F.col("ctrl")).otherwise(0.0))


register_trained("TargetScaling", SCENARIOS, scale_state, scaled_targets, has_drop_rule=True)


def mean_and_scale_state(s: Screen) -> DataFrame:
    """The scenario's training means (by bin, by label or over both) and the target factor."""
    train = lambda *names: s.train.where(F.col("scenario").isin(*names))
    return (
        scale_state(s)
        .unionByName(as_state(bulk.mean_per_bin(s.deltas, train("UnseenPert", "UnseenPair")), "mean_bin", bin="bin", gene="gene", weight="m_bin"))
        .unionByName(as_state(bulk.mean_per_ko(s.deltas, train("UnseenCell")), "mean_ko", ko="ko", gene="gene", weight="m_ko"))
        .unionByName(as_state(bulk.mean_all(s.deltas, train("UnseenBoth")), "mean_all", gene="gene", weight="m_all"))
    )


def mean_and_scaled_targets(s: Screen, state: DataFrame) -> DataFrame:
    """The scenario's mean plus the target term; a missing term counts as zero."""
    means = (
        s.grid.join(part(state, "mean_bin", bin="bin", gene="gene", weight="m"), [*FOLD, "bin", "gene"]).select(*KEYS, "ctrl", "m")
        .unionByName(s.grid.join(part(state, "mean_ko", ko="ko", gene="gene", weight="m"), [*FOLD, "ko", "gene"]).select(*KEYS, "ctrl", "m"))
        .unionByName(s.grid.join(part(state, "mean_all", gene="gene", weight="m"), [*FOLD, "gene"]).select(*KEYS, "ctrl", "m"))
    )
    hits = s.targets.withColumn("hit", F.lit(True))
    rows = means.join(part(state, "scale", weight="scale"), FOLD).join(hits, ["ko", "gene"], "left")
    return emit(rows, F.col("m") - F.when(F.col("hit"), F.col("scale") * F.col("ctrl")).otherwise(0.0))


register_trained(
    "Mean+TargetScaling", ["UnseenPert", "UnseenCell", "UnseenBoth", "UnseenPair"], mean_and_scale_state, mean_and_scaled_targets,
    has_drop_rule=True,
)


# ---- learned -----------------------------------------------------------------------------
def ridge_predictions(s: Screen, state: DataFrame) -> DataFrame:
    """Apply a coefficient table; a level without training weight contributes zero."""
    rows = (
        s.grid.join(part(state, "mean", gene="gene", weight="w_mean"), [*FOLD, "gene"])
        .join(part(state, "bin", bin="bin", gene="gene", weight="w_bin"), [*FOLD, "gene", "bin"], "left")
        .join(part(state, "ko", ko="ko", gene="gene", weight="w_ko"), [*FOLD, "gene", "ko"], "left")
    )
    zero = F.lit(0.0)
    return emit(rows, F.col("w_mean") + F.coalesce("w_bin", zero) + F.coalesce("w_ko", zero))


def ridge_fit(s: Screen, lam: float) -> DataFrame:
    rows = bulk.on_pairs(s.deltas, s.train).select(*KEYS, F.col("d_all").alias("y"))
    return linear.ridge_coefficients(rows, lam)


def ridge_state(s: Screen, lam: float) -> DataFrame:
    of = lambda kind: F.when(F.col("kind") == kind, F.col("term"))
    return as_state(ridge_fit(s, lam), "", part=F.col("kind"), bin=of("bin"), ko=of("ko"), gene="gene", weight="weight")


_RIDGE_SCENARIOS = ["UnseenPert", "UnseenCell", "UnseenBoth", "UnseenPair", "UnseenCombo"]

register_trained(
    "Ridge", _RIDGE_SCENARIOS, lambda s: ridge_state(s, s.options.get("lam", 1.0)), ridge_predictions,
    parameters=lambda options: {"lam": options.get("lam", 1.0)},
)
register_trained("LinearAdditive", _RIDGE_SCENARIOS, lambda s: ridge_state(s, 1e-8), ridge_predictions, parameters=lambda options: {"lam": 1e-8})


def pair_id() -> Column:
    """Bin and label as one name, in their order; the bin's length at the end tells them apart."""
    return F.concat("bin", F.lit("|"), "ko", F.lit("\u0001"), F.length("bin").cast("string"))


def id_pair(name: str) -> tuple[Column, Column]:
    """Bin and label of a ``pair_id``, whatever characters they hold."""
    tail = F.substring_index(name, "\u0001", -1)
    size = tail.cast("int")
    whole = F.col(name)
    return whole.substr(F.lit(1), size), whole.substr(size + 2, F.length(whole) - F.length(tail) - size - 2)


def correlation_state(s: Screen) -> DataFrame:
    """The training pairs of every fold, and the profile of every pair that trains in some fold, once for all."""
    pairs = as_state(s.train.withColumn("one", F.lit(1.0)), "reference", bin="bin", ko="ko", weight="one")
    used = s.deltas.join(s.train.select("bin", "ko").distinct(), ["bin", "ko"], "left_semi")
    fold = {"scenario": F.lit("*"), "fold": F.lit(-1)}
    return pairs.unionByName(as_state(used, "profile", **fold, bin="bin", ko="ko", gene="gene", weight="d_all"))


def correlated(s: Screen, state: DataFrame) -> DataFrame:
    """Copies the delta of the most correlated training label of the same bin.

    The query is the test label's own delta, so this is an upper reference, not a forecast. A test
    bin without training pairs is compared with the training pairs of every bin.
    """
    train = part(state, "reference", bin="bin", ko="ko")
    known = part(state, "profile", bin="bin", ko="ko", gene="gene", weight="d_all").drop(*FOLD)
    folds = s.split.select(*FOLD).distinct().orderBy(*FOLD).collect()
    numbers = s.split.sparkSession.createDataFrame(
        [(r.scenario, r.fold, i) for i, r in enumerate(folds)], "scenario string, fold int, number int")
    number, n = F.col("number"), len(folds)
    trained = train.select(*FOLD, "bin").distinct().withColumn("own_bin", F.lit(True))
    has_own = F.coalesce("own_bin", F.lit(False))
    asks = s.rect.join(trained, [*FOLD, "bin"], "left").join(numbers, FOLD).groupBy("bin", "ko").agg(
        blocks.fold_bits(n, number, has_own).alias("own"), blocks.fold_bits(n, number, ~has_own).alias("wide"))
    fits = train.join(numbers, FOLD).groupBy("bin", "ko").agg(blocks.fold_bits(n, number).alias("fits"))
    named = lambda pairs, deltas, *bits: pairs.join(blocks.pack(deltas, ["bin", "ko"], {"d_all": "v"}), ["bin", "ko"]).select(
        pair_id().alias("id"), F.col("bin").alias("place"), *bits, "v"
    )
    best = discrimination.nearest_by_fold(named(asks, s.deltas, "own", "wide"), named(fits, known, "fits"), n).join(numbers, "number")
    (qb, qk), (rb, rk) = id_pair("id"), id_pair("ref")
    chosen = best.select(*FOLD, qb.alias("bin"), qk.alias("ko"), rb.alias("ref_bin"), rk.alias("ref_ko"))
    source = known.select(F.col("bin").alias("ref_bin"), F.col("ko").alias("ref_ko"), "gene", "d_all")
    return emit(chosen.join(source, ["ref_bin", "ref_ko"]), F.col("d_all"))


register_trained("Correlation", ["UnseenPert", "UnseenBoth"], correlation_state, correlated)


def epistasis_fit(s: Screen, lam: float = 1.0) -> DataFrame:
    """Per-feature interaction weight from training combinations (zero where there is none)."""
    truth = s.deltas.select("bin", "ko", "gene", F.col("d_all").alias("d_ab"))
    rows = combo_deltas(s.train, s.deltas).join(truth, ["bin", "ko", "gene"])
    f = F.col("d_a") * F.col("d_b")
    y = F.col("d_ab") - F.col("d_a") - F.col("d_b")
    return rows.groupBy(*FOLD, "gene").agg((F.sum(f * y) / (F.sum(f * f) + lam)).alias("w"))


def epistasis_state(s: Screen) -> DataFrame:
    return as_state(epistasis_fit(s, s.options.get("epistasis_lam", 1.0)), "w", gene="gene", weight="w")


def global_epistasis(s: Screen, state: DataFrame) -> DataFrame:
    rows = combo_deltas(s.rect, s.deltas).join(part(state, "w", gene="gene", weight="w"), [*FOLD, "gene"], "left")
    a, b = F.col("d_a"), F.col("d_b")
    return emit(rows, a + b + F.coalesce("w", F.lit(0.0)) * a * b)


register_trained(
    "GlobalEpistasis", ["UnseenCombo"], epistasis_state, global_epistasis, has_drop_rule=True,
    parameters=lambda options: {"lam": options.get("epistasis_lam", 1.0)},
)


# ---- low rank ----------------------------------------------------------------------------
def _label_embedding(emb: DataFrame, kos: DataFrame, single_only: bool) -> DataFrame:
    """Mean embedding of a label's targets per fold; every target has to resolve."""
    if single_only:
        named = emb.select(*FOLD, F.col("gene").alias("ko"), F.col("e").alias("b"))
        return kos.join(named, [*FOLD, "ko"])
    tokens = kos.select(*FOLD, "ko", F.explode(labels.target_tokens(F.col("ko"))).alias("gene"))
    flat = tokens.join(emb, [*FOLD, "gene"], "left").select(
        *FOLD, "ko", F.col("e").isNull().alias("gap"), F.posexplode_outer("e").alias("i", "x")
    )
    return (
        flat.groupBy(*FOLD, "ko", "i").agg(F.avg("x").alias("x"), F.bool_or("gap").alias("gap"))
        .groupBy(*FOLD, "ko")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"), F.bool_or("gap").alias("gap"))
        .where(~F.col("gap"))
        .select(*FOLD, "ko", F.col("p.x").alias("b"))
    )


def _low_rank_fit(s: Screen, bilinear: bool, k: int, ridge_a: float, ridge_b: float):
    """Embedding, centre and k x k core of every fold.

    The training profiles of all folds are packed and written once; only the factorisation runs
    fold by fold, and only vectors over the bounded panel and k x k matrices reach the driver.
    """
    import numpy as np

    spark = s.deltas.sparkSession
    if bilinear:
        y = bulk.mean_per_ko(s.deltas, s.train).withColumnRenamed("m_ko", "y")
    else:
        level = bulk.mean_per_ko(s.deltas, s.train, "m_all")
        bins = s.train.select(*FOLD, "bin").distinct()
        base = bins.join(s.ctrl, "bin").groupBy(*FOLD, "gene").agg(F.avg("m").alias("base"))
        y = level.join(base, [*FOLD, "gene"]).select(
            *FOLD, "ko", "gene", (F.col("m_ko") - F.col("base")).alias("y"))
    y = cut(y.select(*FOLD, "ko", "gene", "y"), "profiles")
    center = y.groupBy(*FOLD, "gene").agg(F.avg("y").alias("center"))
    shifted = y.join(center, [*FOLD, "gene"]).withColumn("yc", F.col("y") - F.col("center"))
    rows = cut(blocks.pack(shifted, [*FOLD, "ko"], {"y": "raw", "yc": "v"}), "packed")
    axis = [r.gene for r in bulk.number_genes(s.genes).orderBy("gene_ord").collect()]
    sizes = rows.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n")).collect()
    basis_rows = rows if bilinear else rows.withColumn("v", blocks.centred(F.col("v")))
    bases, entries = {}, []
    for r in sizes:
        mine = basis_rows.where((F.col("scenario") == r.scenario) & (F.col("fold") == r.fold))
        vectors, values = linear.right_singular(mine, k, shape=(r.n, len(axis)))
        emb = vectors if bilinear else vectors * values[None, :]
        bases[(r.scenario, r.fold)] = emb
        entries += [(r.scenario, r.fold, g, [float(x) for x in row]) for g, row in zip(axis, emb)]
    emb = spark.createDataFrame(entries, "scenario string, fold int, gene string, e array<double>")
    label = _label_embedding(emb, rows.select(*FOLD, "ko"), bilinear)
    if bilinear:
        # the offset is the mean over the resolvable labels only
        offset = shifted.join(label.select(*FOLD, "ko"), [*FOLD, "ko"], "left_semi").groupBy(
            *FOLD, "gene").agg(F.avg("y").alias("center"))
        center = offset
        moved = y.join(offset, [*FOLD, "gene"]).withColumn("yc", F.col("y") - F.col("center"))
        kept = blocks.pack(moved, [*FOLD, "ko"], {"yc": "v"}).join(label, [*FOLD, "ko"])
    else:
        kept = rows.join(label, [*FOLD, "ko"])
    cores = []
    for (scenario, fold), (moment, gram, n) in linear.bilinear_moments(kept, bases).items():
        basis = bases[(scenario, fold)]
        r = basis.shape[1]
        if n < (1 if bilinear else 2):
            if bilinear:
                continue
            core = np.zeros((r, r))
        else:
            left = np.linalg.solve(basis.T @ basis + ridge_a * np.eye(r), moment)
            core = np.nan_to_num(np.linalg.solve((gram + ridge_b * np.eye(r)).T, left.T).T)
        cores.append((scenario, fold, [[float(x) for x in row] for row in core]))
    core = spark.createDataFrame(cores, "scenario string, fold int, core array<array<double>>")
    return emb, center, core


def low_rank_state(s: Screen, bilinear: bool) -> DataFrame:
    emb, center, core = _low_rank_fit(s, bilinear, s.options.get("k", 10), 0.1, 0.1)
    rows = core.select(*FOLD, F.posexplode("core").alias("i", "row")).select(*FOLD, "i", F.posexplode("row").alias("j", "w"))
    return (
        as_state(emb.select(*FOLD, "gene", F.posexplode("e").alias("i", "w")), "basis", gene="gene", i="i", weight="w")
        .unionByName(as_state(center, "center", gene="gene", weight="center"))
        .unionByName(as_state(rows, "core", i="i", j="j", weight="w"))
    )


def low_rank_predictions(s: Screen, state: DataFrame, bilinear: bool) -> DataFrame:
    def vector(df, keys, at, value, name):
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, value))).alias("p")).select(*keys, F.col(f"p.{value}").alias(name))

    emb = vector(part(state, "basis", gene="gene", i="i", weight="w"), [*FOLD, "gene"], "i", "w", "e")
    core = vector(vector(part(state, "core", i="i", j="j", weight="w"), [*FOLD, "i"], "j", "w", "row"), FOLD, "i", "row", "core")
    center = part(state, "center", gene="gene", weight="center")
    label = _label_embedding(emb, s.rect.select(*FOLD, "ko").distinct(), bilinear)
    q = F.transform("core", lambda row: blocks.dot(row, F.col("b")))
    queries = label.join(core, FOLD).select(*FOLD, "ko", q.alias("q"))
    rows = (
        s.grid.join(queries, [*FOLD, "ko"])
        .join(emb, [*FOLD, "gene"]).join(center, [*FOLD, "gene"])
    )
    return emit(rows, blocks.dot(F.col("e"), F.col("q")) + F.col("center"))


def _register_low_rank(name: str, scenarios: list[str], bilinear: bool) -> None:
    register_trained(
        name, scenarios, lambda s: low_rank_state(s, bilinear), lambda s, state: low_rank_predictions(s, state, bilinear),
        parameters=lambda options: {"k": options.get("k", 10), "ridge": 0.1}, has_drop_rule=True,
    )


# Deltas as basis * W * basis(label) + offset, basis = top components of training profiles.
_register_low_rank("BilinearRidge", ["UnseenPert"], True)
# Feature embedding * K * mean target embedding + centre, one profile per label.
_register_low_rank("LatentAdditive", _RIDGE_SCENARIOS, False)


# ---- controls ----------------------------------------------------------------------------
@register_predictor("Tech-duplicate", "controls", SCENARIOS)
def tech_duplicate(s: Screen) -> DataFrame:
    return emit(s.rect.join(s.deltas, ["bin", "ko"]), F.col("d_second"))


@register_predictor("Interp-duplicate", "controls", SCENARIOS)
def interp_duplicate(s: Screen) -> DataFrame:
    """Second-half delta where the second half is significant, training mean elsewhere."""
    rows = (
        s.rect.join(s.deltas, ["bin", "ko"]).drop("m_all")
        .join(s.alpha, ["bin", "ko", "gene"], "left")
        .join(bulk.mean_per_bin(s.deltas, s.train), [*FOLD, "bin", "gene"], "left")
        .join(bulk.mean_all(s.deltas, s.train), [*FOLD, "gene"], "left")
    )
    a = F.coalesce("alpha", F.lit(0.0))
    mean = F.coalesce("m_bin", "m_all")
    return emit(rows, a * F.col("d_second") + (1.0 - a) * mean)
