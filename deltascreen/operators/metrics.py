"""Per-row metrics of all predictors, scenarios and folds in one plan.

A row is one (scenario, fold, predictor, bin, ko). ``score_frame`` aligns truth, prediction and
weights per feature; ``row_metrics`` adds the ordered windows the requested metrics need (all on
the row key, so one shuffle) and aggregates once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.operators import blocks, discrimination
from deltascreen.plans import catalogue
from deltascreen.plans.catalogue import GLOBAL, TOP_SUFFIX

FOLD = ["scenario", "fold"]
JOB = [*FOLD, "predictor"]
ROW = [*JOB, "bin", "ko"]
EPS = 1e-8
LOWEST = -1.7976931348623157e308


@dataclass(frozen=True)
class Slice:
    """Which features (and labels) a suffix scores, and with what weight."""

    suffix: str
    mask: Column | None = None
    weight: Column | None = None


def score_frame(
    predictions: DataFrame, truth: DataFrame, rect: DataFrame, weights: DataFrame | None = None,
    target: str = "d_first",
) -> DataFrame:
    """Every feature of every pair of the test rectangle, per predictor: ``p`` (0 where not
    emitted), ``t``, ``emitted``, ``w``, ``deg``, ``dir``. Unknown labels, bins and features of a
    prediction drop out."""
    jobs = predictions.select(*JOB).distinct()
    base = rect.join(jobs, FOLD).join(
        truth.select("bin", "ko", "gene", F.col(target).alias("t")), ["bin", "ko"]
    )
    frame = base.join(predictions.select(*ROW, "gene", "delta"), [*ROW, "gene"], "left").select(
        *ROW, "gene", "t", F.coalesce("delta", F.lit(0.0)).alias("p"),
        F.col("delta").isNotNull().alias("emitted"),
    )
    if weights is not None:
        frame = frame.join(weights, ["bin", "ko", "gene"], "left").fillna(0.0, ["w"])
    return frame


def midrank(order: Column, row: list[str]) -> Column:
    """0-based rank with ties averaged."""
    whole = W.partitionBy(*row)
    ties = F.count(F.lit(1)).over(whole.partitionBy(*row, order))
    return F.rank().over(whole.orderBy(order)) - 1.0 + (ties - 1.0) / 2.0


def weighted_means(tag: str, mask: Column, weight: Column, p: Column, t: Column, whole) -> dict[str, Column]:
    """Weighted means of the row (first pass), as window sums on the row key."""
    w = F.when(mask, weight).otherwise(0.0)
    total = F.greatest(F.sum(w).over(whole), F.lit(EPS))
    return {f"{tag}mp": F.sum(w * p).over(whole) / total, f"{tag}mt": F.sum(w * t).over(whole) / total}


def moments(tag: str, mask: Column, weight: Column, p: Column, t: Column) -> list[Column]:
    """Centred weighted sums of the row (second pass)."""
    w = F.when(mask, weight).otherwise(0.0)
    e = p - t
    pc, tc = p - F.col(f"{tag}mp"), t - F.col(f"{tag}mt")
    return [
        F.count_if(mask).alias(f"{tag}n"),
        F.greatest(F.sum(w), F.lit(EPS)).alias(f"{tag}w"),
        F.first(f"{tag}mp").alias(f"{tag}cp"),
        F.first(f"{tag}mt").alias(f"{tag}ct"),
        F.sum(w * pc * pc).alias(f"{tag}spp"),
        F.sum(w * tc * tc).alias(f"{tag}stt"),
        F.sum(w * pc * tc).alias(f"{tag}spt"),
        F.sum(w * t * t).alias(f"{tag}tt"),
        F.sum(w * e * e).alias(f"{tag}ee"),
        F.sum(w * F.abs(e)).alias(f"{tag}ae"),
    ]


def _central(tag: str) -> dict[str, Column]:
    return {
        "w": F.col(f"{tag}w"), "mp": F.col(f"{tag}cp"), "mt": F.col(f"{tag}ct"),
        "spp": F.col(f"{tag}spp"), "stt": F.col(f"{tag}stt"), "spt": F.col(f"{tag}spt"),
    }


def mean_error(tag: str, kind: str, weighted: bool) -> Column:
    bottom = F.col(f"{tag}w") if weighted else F.greatest(F.col(f"{tag}n"), F.lit(1))
    return F.col(f"{tag}{kind}") / bottom


def pearson(tag: str) -> Column:
    m = _central(tag)
    return m["spt"] / F.greatest(F.sqrt(m["spp"] * m["stt"]), F.lit(EPS))


def r2_uncentred(tag: str) -> Column:
    return 1.0 - F.col(f"{tag}ee") / F.greatest(F.col(f"{tag}tt"), F.lit(EPS))


def r2_centred(tag: str) -> Column:
    m = _central(tag)
    return F.greatest(1.0 - F.col(f"{tag}ee") / F.greatest(m["stt"], F.lit(EPS)), F.lit(-1.0))


def ccc(tag: str) -> Column:
    m = _central(tag)
    gap = m["mp"] - m["mt"]
    return 2.0 * m["spt"] / m["w"] / (m["spp"] / m["w"] + m["stt"] / m["w"] + gap * gap + F.lit(EPS))


def standard_slices(valid: Column) -> list[Slice]:
    return [Slice(""), Slice("_weighted", weight=F.col("w")), Slice(TOP_SUFFIX, mask=F.col("__top"))]


def row_metrics(
    frame: DataFrame, names: list[str], mode: str = "fill", top_k: int = 200,
    min_set: int = 5, slices: list[Slice] | None = None, row: list[str] = ROW,
    effect_threshold: float = 0.5,
) -> DataFrame:
    """Long table ``(row..., metric, value, n_genes_valid, n_genes_native)``.

    ``mode`` "fill" scores every feature of an emitted row (missing ones as 0), "drop" only the
    emitted features. Rows without any emitted feature, and undefined values, are absent.
    """
    if mode not in ("fill", "drop"):
        raise ValueError(f"unknown mode {mode!r}")
    whole = W.partitionBy(*row)
    p, t = F.col("p"), F.col("t")
    has = lambda *stems: any(n.startswith(s) for n in names for s in stems)
    df = frame.withColumn("__any", F.max("emitted").over(whole)).where("__any")
    valid = F.lit(True) if mode == "fill" else F.col("emitted")
    df = df.withColumn("__v", valid).withColumn("__g", F.count(F.lit(1)).over(whole))
    by_size = whole.orderBy(F.abs(t).desc(), "gene")
    if has("fold_change_gap") or any(TOP_SUFFIX in n for n in names):
        df = df.withColumn("__size_rank", F.row_number().over(by_size)).withColumn(
            "__top", F.col("__size_rank") <= top_k
        )
    all_slices = slices or standard_slices(F.col("__v"))
    used = [s for s in all_slices if any(n == b + s.suffix for n in names
            for b in ("mse", "mae", "pearson", "r2", "r2_centered", "ccc", "spearman", "r2_uncentered"))]
    aggs: list[Column] = []
    means: dict[str, Column] = {}
    values: dict[str, tuple[Column, Column]] = {}
    for i, s in enumerate(used):
        tag = f"s{i}_"
        mask = F.col("__v") if s.mask is None else F.col("__v") & F.coalesce(s.mask, F.lit(False))
        weight = F.lit(1.0) if s.weight is None else s.weight
        df = df.withColumn(f"{tag}m", mask)
        means |= weighted_means(tag, F.col(f"{tag}m"), weight, p, t, whole)
        aggs += moments(tag, F.col(f"{tag}m"), weight, p, t)
        n = F.col(f"{tag}n")
        weighted = s.weight is not None
        formulas = {
            "mse": mean_error(tag, "ee", weighted), "mae": mean_error(tag, "ae", weighted),
            "pearson": pearson(tag), "r2": r2_centred(tag), "r2_centered": r2_centred(tag),
            "ccc": ccc(tag), "r2_uncentered": r2_uncentred(tag),
        }
        for base, formula in formulas.items():
            if base + s.suffix in names:
                values[base + s.suffix] = (formula, n)
        if f"spearman{s.suffix}" in names:
            hidden = lambda v, m=f"{tag}m": F.when(F.col(m), v).otherwise(LOWEST)
            df = df.withColumn(f"{tag}hp", hidden(p)).withColumn(f"{tag}ht", hidden(t))
            df = df.withColumn(f"{tag}kp", midrank(F.col(f"{tag}hp"), row)).withColumn(
                f"{tag}kt", midrank(F.col(f"{tag}ht"), row)
            )
            ranks = (F.col(f"{tag}m"), weight, F.col(f"{tag}kp"), F.col(f"{tag}kt"))
            means |= weighted_means(f"{tag}r", *ranks, whole)
            aggs += moments(f"{tag}r", *ranks)
            aggs += [F.stddev_samp(p).alias(f"{tag}sdp"), F.stddev_samp(t).alias(f"{tag}sdt")]
            flat = (F.col(f"{tag}sdp") < EPS) | (F.col(f"{tag}sdt") < EPS)
            values[f"spearman{s.suffix}"] = (F.when(flat, 0.0).otherwise(pearson(f"{tag}r")), n)
    df = df.withColumns(means)
    n_valid = F.count_if("__v").alias("n_valid")
    if "frac_correct_direction" in names:
        counted = F.col("__v") & (F.col("dir") != 0)
        aggs += [F.count_if(counted).alias("dn"),
                 F.count_if(counted & (F.signum(p) == F.signum("dir"))).alias("dc")]
        values["frac_correct_direction"] = (
            F.col("dc") / F.greatest(F.col("dn"), F.lit(1)), F.col("n_valid"))
    if "fold_change_gap" in names:
        g = F.col("__g")
        for q, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            place = g - F.floor(g * share)
            df = df.withColumn(f"__{q}", F.max(F.when(F.col("__size_rank") == place, F.abs(t))).over(whole))
        level = sum((F.abs(t) >= F.col(f"__{q}")).cast("int") for q in ("q1", "q2", "q3"))
        df = df.withColumn("__level", level)
        err = F.abs(p - t)
        gap = F.lit(0.0)
        for b in range(4):
            inside = F.col("__v") & (F.col("__level") == b)
            aggs += [F.sum(F.when(inside, err)).alias(f"f{b}s"), F.count_if(inside).alias(f"f{b}n")]
            gap = gap + F.coalesce(f"f{b}s", F.lit(0.0)) / F.greatest(F.col(f"f{b}n"), F.lit(1))
        aggs += [F.sum(F.when(F.col("__v"), err)).alias("fs"), F.first("__g").alias("fg")]
        plain = F.coalesce("fs", F.lit(0.0)) / F.greatest(F.col("n_valid"), F.lit(1))
        values["fold_change_gap"] = (F.when(F.col("fg") < 4, plain).otherwise(gap / 4.0), F.col("n_valid"))
    if "effect_size_auroc" in names:
        df = df.withColumn("__ap", F.abs(p))
        df = df.withColumn("__ar", midrank(F.col("__ap"), row))
        pos = F.abs(t) > effect_threshold
        aggs += [F.count_if(pos).alias("an"), F.sum(F.when(pos, F.col("__ar")).otherwise(0.0)).alias("as"),
                 F.count(F.lit(1)).alias("ag")]
        n1 = F.col("an").cast("double")
        n0 = F.col("ag") - n1
        u = F.col("as") - n1 * (n1 - 1.0) / 2.0
        values["effect_size_auroc"] = (
            F.when((n1 == 0) | (n0 == 0), 0.5).otherwise(u / F.greatest(n1 * n0, F.lit(EPS))), F.col("n_valid"))
    for name, hit, first in (
        ("gsea_up", F.col("deg") & (t > 0), p.desc()),
        ("gsea_down", F.col("deg") & (t < 0), p.asc()),
    ):
        if name not in names:
            continue
        hit = F.coalesce(hit, F.lit(False))
        walk = whole.orderBy(first, "gene").rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumn(f"__{name}", hit).withColumn(
            f"__{name}_m", F.sum(F.col(f"__{name}").cast("int")).over(whole))
        m = F.col(f"__{name}_m")
        one = F.lit(1)
        step = F.when(F.col(f"__{name}"), 1.0 / F.greatest(m, one)).otherwise(
            -1.0 / F.greatest(F.col("__g") - m, one))
        df = df.withColumn(f"__{name}_run", F.sum(step).over(walk))
        aggs += [F.max(f"__{name}_run").alias(f"{name}_es"), F.first(f"__{name}_m").alias(f"{name}_m")]
        values[name] = (F.when(F.col(f"{name}_m") >= min_set, F.col(f"{name}_es")), F.col("n_valid"))
    wide = df.groupBy(*row).agg(n_valid, F.count_if("emitted").alias("n_native"), *aggs)
    cells = F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"),
                 n.cast("bigint").alias("n_genes_valid"))
        for name, (value, n) in values.items()
    ])
    return (
        wide.select(*row, "n_native", F.explode(cells).alias("c"))
        .select(*row, "c.metric", "c.value", "c.n_genes_valid", F.col("n_native").alias("n_genes_native"))
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("n_genes_valid") > 0))
    )


def variance_ratio(frame: DataFrame, keys: list[str] = JOB, eps: float = 1e-8, floor: float = 1e-4) -> DataFrame:
    """Median absolute log variance ratio over features with real variance (lower median)."""
    per_gene = frame.groupBy(*keys, "gene").agg(F.var_samp("p").alias("vp"), F.var_samp("t").alias("vt"))
    ok = F.col("vt") >= floor
    log_err = F.abs(F.log(F.col("vp") / (F.col("vt") + eps) + eps))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __e)")
    return (
        per_gene.withColumn("__e", F.when(ok, log_err))
        .groupBy(*keys)
        .agg(F.coalesce(middle, F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("n_genes"))
    )


def pool_metrics(frame: DataFrame, names: list[str]) -> DataFrame:
    """Metrics over all rows of a test rectangle: rank, discrimination, variance ratio."""
    parts = []
    group = [*JOB, "bin"]
    need_profiles = [n for n in names if n == "cosine_rank" or n.startswith("pds_")]
    n_genes = frame.groupBy(*ROW).agg(
        F.count(F.lit(1)).alias("n_genes_valid"), F.count_if("emitted").alias("n_genes_native"))
    if need_profiles:
        profiles = blocks.pack(frame, ROW, {"p": "p", "t": "t"}).withColumnRenamed("ko", "id")
    width = F.lit(None).cast("bigint")
    for name in need_profiles:
        if name == "cosine_rank":
            scored = discrimination.cosine_rank(profiles, group).withColumnRenamed("id", "ko")
            parts.append(scored.join(n_genes.where("n_genes_native > 0"), ROW).select(
                *ROW, F.lit(name).alias("metric"), "value", "n_genes_valid", "n_genes_native"))
        else:
            size = n_genes.groupBy(*group).agg(F.max("n_genes_valid").alias("g"))
            scored = discrimination.pds(profiles, group, name[4:])
            parts.append(scored.join(size, group).select(
                *group, F.lit(GLOBAL).alias("ko"), F.lit(name).alias("metric"), "value",
                F.col("g").alias("n_genes_valid"), F.col("g").alias("n_genes_native")))
    if "var_ratio_log_error" in names:
        parts.append(variance_ratio(frame).select(
            *JOB, F.lit(GLOBAL).alias("bin"), F.lit(GLOBAL).alias("ko"),
            F.lit("var_ratio_log_error").alias("metric"), "value",
            F.col("n_genes").alias("n_genes_valid"), F.col("n_genes").alias("n_genes_native")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score(
    predictions: DataFrame, truth: DataFrame, rect: DataFrame, weights: DataFrame, names: list[str],
    keep: DataFrame | None = None, mode: str = "fill", top_k: int = 200, min_set: int = 5,
    relation: DataFrame | None = None, ctrl: DataFrame | None = None,
    top_expressed: int = catalogue.TOP_EXPRESSED,
) -> DataFrame:
    """All requested metrics of all predictions against the first-half deltas.

    ``keep`` restricts the scored pairs (pair-mask scenarios); pools still see the rectangle. Names
    of the catalogue are scored with the features and labels that their suffix stands for, other
    names raise. ``relation(kind, src, dst)`` and ``ctrl(gene, m)`` are needed by some suffixes.
    """
    frame = score_frame(predictions, truth, rect, weights)
    frame, slices = catalogue_slices(frame, names, relation, ctrl, truth, top_expressed)
    rows = frame if keep is None else frame.join(keep, [*FOLD, "bin", "ko"], "left_semi")
    pool = [n for n in names if n in ("cosine_rank", "var_ratio_log_error") or n.startswith("pds_")]
    out = row_metrics(rows, [n for n in names if n not in pool], mode, top_k, min_set, slices)
    if not pool:
        return out
    pooled = pool_metrics(frame, pool)
    if keep is not None:
        kept = keep.select(*FOLD, "bin", "ko")
        per_row = pooled.where(F.col("ko") != GLOBAL).join(kept, [*FOLD, "bin", "ko"], "left_semi")
        pooled = per_row.unionByName(pooled.where(F.col("ko") == GLOBAL))
    return out.unionByName(pooled)


# ---- interaction scores, strata, sets -----------------------------------------------------
def interaction_inputs(deltas: DataFrame, pairs: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Delta triples (A, B, AB) of two-way combinations, optionally on a feature subset."""
    from deltascreen.operators.predictors import combo_deltas

    truth = deltas.select("bin", "ko", "gene", F.col("d_all").alias("d_ab"))
    rows = combo_deltas(pairs, deltas).join(truth, ["bin", "ko", "gene"])
    return rows if genes is None else rows.join(genes.select("gene"), "gene", "left_semi")


def interaction_scores(rows: DataFrame, keys: list[str], k: int = 10, tie: str = "gene") -> DataFrame:
    """R2, precision at k and true-positive rate of predicted interaction scores ``p`` against
    ``t``; the threshold is the lower median of the non-zero truths."""
    part = W.partitionBy(*keys)
    top = lambda c: F.row_number().over(part.orderBy(F.abs(c).desc(), tie)) <= F.least(
        F.lit(k), F.count(F.lit(1)).over(part))
    cut = rows.where("t <> 0").withColumn("__a", F.abs("t")).groupBy(*keys).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __a)").alias("__cut"))
    marked = rows.withColumn("__pt", top("p")).withColumn("__tt", top("t")).join(cut, keys, "left")
    limit = F.coalesce("__cut", F.lit(0.5))
    real = F.abs("t") > limit
    e = F.col("p") - F.col("t")
    return marked.groupBy(*keys).agg(
        (1.0 - F.sum(e * e) / F.greatest(F.sum(F.col("t") * F.col("t")), F.lit(EPS))).alias("r2"),
        (F.count_if(F.col("__pt") & F.col("__tt")) / F.least(F.lit(k), F.count(F.lit(1)))).alias("precision_at_k"),
        (F.count_if(real & (F.abs("p") > limit)) / F.greatest(F.count_if(real), F.lit(1))).alias("tpr"),
    )


def subtree_metrics(frame: DataFrame, relation: DataFrame, keys: list[str]) -> DataFrame:
    """Error inside and outside the label's related features; the label itself is left out."""
    rel = relation.select(F.col("src").alias("ko"), F.col("dst").alias("gene"), F.lit(True).alias("inside")).distinct()
    rows = frame.where("gene <> ko").join(rel, ["ko", "gene"], "left")
    into, out = F.coalesce("inside", F.lit(False)), ~F.coalesce("inside", F.lit(False))
    e = F.col("p") - F.col("t")
    mean = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        mean(into, F.abs(e)).alias("mae_in"), mean(out, F.abs(e)).alias("mae_out"),
        mean(into, e * e).alias("mse_in"), mean(out, e * e).alias("mse_out"),
    ).withColumn("ratio", F.col("mae_in") / (F.col("mae_out") + EPS))


def primary_target(ko: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(ko, "@", 1), ";", 1))


def role_mse(frame: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """MSE by the role of the primary target (default ``leaf``)."""
    e = F.col("p") - F.col("t")
    named = frame.withColumn("__g", primary_target(F.col("ko")))
    r = roles.select(F.col("gene").alias("__g"), "role")
    return named.join(r, "__g", "left").fillna("leaf", ["role"]).groupBy(*keys, "role").agg(
        F.avg(e * e).alias("mse"), F.count_distinct("bin", "ko").alias("count"))


def fanout_mse(frame: DataFrame, relation: DataFrame, keys: list[str]) -> DataFrame:
    """MSE by out-degree of the primary target: one stratum per degree up to four, else quartiles
    over the scored pairs."""
    degree = relation.groupBy(F.col("src").alias("__g")).agg(F.count_distinct("dst").cast("int").alias("degree"))
    e = F.col("p") - F.col("t")
    pairs = (
        frame.groupBy(*keys, "bin", "ko").agg(F.avg(e * e).alias("mse"))
        .withColumn("__g", primary_target(F.col("ko")))
        .join(degree, "__g", "left").fillna(0, ["degree"])
    )
    edges = pairs.groupBy(*keys).agg(
        F.count_distinct("degree").alias("nd"),
        F.array_sort(F.array_distinct(F.transform(
            F.percentile("degree", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])),
            lambda q: q.cast("int")))).alias("edges"),
    )
    d = F.col("degree")
    upper = F.filter("edges", lambda x: x >= d)
    place = F.greatest(F.array_position("edges", upper[0]), F.lit(2)).cast("int")
    name = F.concat_ws("-", F.element_at("edges", place - 1).cast("string"), F.element_at("edges", place).cast("string"))
    above = F.concat(F.element_at("edges", -1).cast("string"), F.lit("+"))
    stratum = F.when(F.col("nd") <= 4, d.cast("string")).when(F.size(upper) == 0, above).otherwise(name)
    return pairs.join(edges, keys).groupBy(*keys, stratum.alias("stratum")).agg(
        F.avg("mse").alias("mse"), F.count(F.lit(1)).alias("count"))


def relation_slices(kind: str) -> list[Slice]:
    """Within/outside slices for a frame that carries ``in_<kind>``."""
    inside = F.col(f"in_{kind}")
    return [Slice(f"_{kind}_within", mask=inside), Slice(f"_{kind}_outside", mask=~inside)]


def with_relation(frame: DataFrame, relation: DataFrame, kind: str) -> DataFrame:
    rel = relation.where(F.col("kind") == kind).select(
        F.col("src").alias("ko"), F.col("dst").alias("gene"), F.lit(True).alias(f"in_{kind}")).distinct()
    return frame.join(rel, ["ko", "gene"], "left").fillna(False, [f"in_{kind}"])


def suffixes_of(names: list[str]) -> list[str]:
    """Suffixes that ``names`` use, in the catalogue's order; a name that it does not hold raises."""
    known = {base + suffix: suffix for base, (_, _, kind) in catalogue.BASES.items()
             for suffix in (catalogue.SUFFIXES if kind != "direction" else [""])}
    known |= {"r2_uncentered" + suffix: suffix for suffix in catalogue.SUFFIXES} | dict.fromkeys(catalogue.STANDALONE, "")
    unknown = sorted(set(names) - set(known) - {"pds_sign_cosine"})
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    used = {known.get(n, "") for n in names}
    return [suffix for suffix in catalogue.SUFFIXES if suffix in used]


def catalogue_slices(
    frame: DataFrame, names: list[str], relation: DataFrame | None = None, ctrl: DataFrame | None = None,
    deltas: DataFrame | None = None, top_expressed: int = catalogue.TOP_EXPRESSED,
) -> tuple[DataFrame, list[Slice]]:
    """``frame`` with the marks that the suffixes of ``names`` need, and a slice for each suffix."""
    slices, marked = [], set()

    def needed(table, suffix, what):
        if table is None:
            raise ValueError(f"metrics with {suffix!r} need {what}")
        return table

    def mark(column, make):
        nonlocal frame
        if column not in marked:
            frame = make(frame)
            marked.add(column)
        return F.col(column)

    for suffix in suffixes_of(names):
        features, regulators = catalogue.SUFFIXES[suffix]
        mask, weight = None, None
        kind, _, side = features.rpartition("_")
        if side in ("within", "outside"):
            edges = needed(relation, suffix, "a relation table")
            own = edges if kind else edges.withColumn("kind", F.lit("any"))
            inside = mark(f"in_{kind or 'any'}", lambda df: with_relation(df, own, kind or "any"))
            mask = inside if side == "within" else ~inside
        elif suffix == TOP_SUFFIX:
            mask = F.col("__top")
        elif suffix == catalogue.EXPRESSED_SUFFIX:
            mask = mark("expressed", lambda df: with_expressed(df, needed(ctrl, suffix, "control means"), top_expressed))
        elif suffix == "_weighted":
            weight = F.col("w")
        elif suffix == "_var_weighted":
            weight = mark("var_w", lambda df: with_variance(df, needed(deltas, suffix, "the true deltas")))
        if regulators:
            sources = needed(relation, suffix, "a relation table").select(F.col("src").alias("ko"), F.lit(True).alias("is_regulator")).distinct()
            chosen = mark("is_regulator", lambda df: df.join(sources, "ko", "left").fillna(False, ["is_regulator"]))
            mask = chosen if mask is None else mask & chosen
        slices.append(Slice(suffix, mask, weight))
    return frame, slices


def with_expressed(frame: DataFrame, ctrl: DataFrame, top: int = 1000) -> DataFrame:
    """Flag the features with the highest mean control expression."""
    level = ctrl.groupBy("gene").agg(F.avg("m").alias("level"))
    axis = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.round("level", 9).alias("l"), "gene")))), 1, top)
    best = level.agg(axis.alias("a")).select(F.col("a.gene").alias("g")).scalar()
    return frame.withColumn("expressed", F.array_contains(best, F.col("gene")))


def with_variance(frame: DataFrame, deltas: DataFrame) -> DataFrame:
    """Variance of the true deltas per feature, as a weight."""
    v = deltas.groupBy("gene").agg(F.var_samp("d_all").alias("var_w"))
    return frame.join(v, "gene")
