"""Modules against their siblings: the same module name in the same stack of the same file is a family."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import stats
from ..functions.slopes import median_slope
from . import grouped


def with_family(modules: DataFrame) -> DataFrame:
    """modules (path, module, stack) with family: qualified by the stack only in files with several."""
    several = F.size(F.collect_set("stack").over(W.partitionBy("path"))) > 1
    return modules.withColumn("family", F.when(several & (F.col("stack") != ""), F.concat_ws("/", "stack", "module")).otherwise(F.col("module")))


def long_features(modules: DataFrame, id_cols: list[str]) -> DataFrame:
    """id_cols, feature, raw, value (transformed) of the nine compared features, values that are missing left out."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("raw"), stats.transform(F.col(f).cast("double"), kind).alias("value")) for f, kind in stats.FEATURES.items()))
    return modules.select(*id_cols, F.inline(each)).where("value IS NOT NULL")


def family_z(modules: DataFrame, keys: tuple[str, ...] = ("path",), least: int = stats.MIN_FAMILY) -> DataFrame:
    """keys, base, family, feature, layer, expert, raw, z of every module in a family of at least `least` usable values.

    A family's values meet in one shuffle. Of one of up to ARRAY_GROUP modules they are one array; its Theil-Sen line over the layers (from
    MIN_DETREND values on, all with a layer), its median and its scale are array expressions. Of a larger one, a task holds the layers and values
    only, for the line, the median and the scale; its modules stay where they are.
    """
    large = modules.groupBy(*keys, "family").agg(F.count("*").alias("_n")).where(F.col("_n") > grouped.ARRAY_GROUP).select(*keys, "family", F.lit(True).alias("_large"))
    sized = grouped.joined(modules, F.broadcast(large), [*keys, "family"], "left")
    few = _of_arrays(long_features(sized.where("_large IS NULL"), [*keys, "family", "base", "layer", "expert"]), [*keys, "family", "feature"], least)
    many = _of_lines(sized.where("_large"), [*keys, "family"], least)
    return few.unionByName(many).select(*keys, "family", "base", "layer", "expert", "feature", "raw", "z")


def _of_lines(modules: DataFrame, group: list[str], least: int) -> DataFrame:
    """family_z of large families: layers and values alone go to Python, one row a family comes back, and the modules are scored where they are."""
    names = list(stats.FEATURES)
    raw = {f: F.col(f).cast("double") for f in names}
    value = {f: stats.transform(raw[f], kind) for f, kind in stats.FEATURES.items()}
    held = modules.select(*group, "layer", *(value[f].alias(f"value_{f}") for f in names))

    def lines(table):
        import pyarrow as pa

        out = table.select(group).slice(0, 1)
        for f in names:
            known = table[f"value_{f}"].is_valid()
            own, layer = table[f"value_{f}"].drop_null().to_numpy(), table["layer"].filter(known)
            line = _line(own, None if layer.null_count else layer.to_numpy()) if len(own) >= least else None
            out = out.append_column(f"line_{f}", pa.array([line], pa.list_(pa.float64())))
        return out

    schema = StructType([*held.select(*group).schema.fields, *(StructField(f"line_{f}", ArrayType(DoubleType())) for f in names)])
    scored = grouped.joined(modules, F.broadcast(held.groupBy(*group).applyInArrow(lines, schema)), group)
    place = F.coalesce(F.col("layer").cast("double"), F.lit(0.0))
    z = lambda x, f: (x - (f[2] + f[0] * (place - f[1])) - f[3]) / f[4]
    each = F.array(*(F.struct(F.lit(f).alias("feature"), raw[f].alias("raw"), z(value[f], F.col(f"line_{f}")).alias("z")) for f in names))
    return scored.select(*group, "base", "layer", "expert", F.inline(each)).where("z IS NOT NULL")


def _line(value: np.ndarray, layer: np.ndarray | None) -> list[float] | None:
    """As _scores: slope, its middle, level, the median of what is left, and scale; None without any spread."""
    slope = middle = level = 0.0
    if layer is not None and len(value) >= stats.MIN_DETREND:
        level, slope = np.median(value), median_slope(layer, value)
        slope, middle = (0.0, 0.0) if np.isnan(slope) else (slope, np.median(layer))
        value = value - (level + slope * (layer - middle))
    med = np.median(value)
    away = np.abs(value - med)
    mad, mean = np.median(away), away.mean()
    scale = stats.MAD_TO_SIGMA * mad if mad > 0 else stats.MEANAD_TO_SIGMA * mean
    return [float(x) for x in (slope, middle, level, med, scale)] if scale > 0 else None


def _of_arrays(values: DataFrame, group: list[str], least: int) -> DataFrame:
    members = values.groupBy(*group).agg(F.collect_list(F.struct("base", "layer", "expert", "raw", "value")).alias("m")).where(F.size("m") >= least)
    return members.select(*group, F.inline(_scores((F.size("m") >= stats.MIN_DETREND) & F.forall("m", lambda v: v["layer"].isNotNull()))))


def _scores(lined: Column) -> Column:
    """The members "m" with z; null without any spread."""
    steps = grouped.pair_slopes("m", "layer", "value")
    slope = F.when(lined, grouped.array_median(steps))
    middle = grouped.array_median(F.transform("m", lambda v: F.coalesce(v["layer"].cast("double"), F.lit(0.0))))
    median = grouped.array_median(F.transform("m", lambda v: v["value"]))
    line = F.struct(slope.alias("slope"), middle.alias("x"), median.alias("y"), lined.alias("lined"))
    level = lambda v, f: F.when(f["slope"].isNotNull(), f["y"] + f["slope"] * (v["layer"] - f["x"])).when(f["lined"], f["y"]).otherwise(F.lit(0.0))
    residuals = stats.let(line, lambda f: F.transform("m", lambda v: v["value"] - level(v, f)))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, v: t + v) / F.size(xs)
    scale = lambda dev: stats.let(grouped.array_median(dev), lambda mad: grouped.scale_of(mad, mean(dev)))
    zs = lambda r, med: stats.let(scale(F.transform(r, lambda v: F.abs(v - med))), lambda s: F.when(s > 0, F.transform(r, lambda v: (v - med) / s)))
    z = stats.let(residuals, lambda r: stats.let(grouped.array_median(r), lambda med: zs(r, med)))
    return F.zip_with("m", z, lambda v, x: F.struct(v["base"].alias("base"), v["layer"].alias("layer"), v["expert"].alias("expert"), v["raw"].alias("raw"), x.alias("z")))


def module_z(z: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each module: z map, max_abs_z, top_feature, top_z (signed), concentration_z."""
    at = lambda f: F.max(F.when(F.col("feature") == f, F.col("z")))
    order = F.create_map(*(F.lit(x) for i, f in enumerate(stats.FEATURES) for x in (f, -i)))
    largest = F.max(F.struct(F.abs("z").alias("a"), order[F.col("feature")].alias("o"), "feature", "z"))
    out = z.groupBy(*keys, "base", "family", "layer", "expert").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "z")))).alias("z"), largest.alias("m"), *(at(f).alias(f"_{f}") for f in stats.CONCENTRATION))
    return out.select(*keys, "base", "family", "layer", "expert", "z", F.col("m.a").alias("max_abs_z"), F.col("m.feature").alias("top_feature"), F.col("m.z").alias("top_z"), stats.concentration_z(*(F.col(f"_{f}") for f in stats.CONCENTRATION)).alias("concentration_z"))


def _first(rows, k: int, key: str):
    """The first k of an array of structs, by a column of theirs, descending."""
    ordered = F.array_sort(rows, lambda a, b: F.when(a[key] > b[key], -1).when(a[key] < b[key], 1).when(a["base"] < b["base"], -1).when(a["base"] > b["base"], 1).otherwise(0))
    return F.slice(ordered, 1, k)


def summary(modules: DataFrame, z: DataFrame, per_module: DataFrame, top_k: int = 10) -> DataFrame:
    """One row for each path with a family large enough: the intra-adapter struct, contributors, and modules by concentration.

    Lists are cut by a window before they are collected, so a group never brings more than top_k rows to one array.
    """
    w = lambda c: W.partitionBy("path").orderBy(F.desc(c), "base")
    compared = modules.groupBy("path", "family").agg(F.count("*").alias("n")).where(F.col("n") >= stats.MIN_FAMILY).select("path").distinct()
    spike = lambda v: F.struct(F.col("base"), F.col("family").alias("module_type"), "layer", F.col(v).alias("z"), F.abs(v).alias("_a"))
    by_max = per_module.where((F.col("max_abs_z") > stats.OUTLIER_Z) & F.col("layer").isNotNull()).withColumn("_r", F.row_number().over(w("max_abs_z"))).where(F.col("_r") <= top_k)
    by_conc = per_module.where((F.col("concentration_z") >= stats.CONCENTRATION_Z) & F.col("layer").isNotNull()).withColumn("_r", F.row_number().over(w("concentration_z"))).where(F.col("_r") <= top_k)
    drop = lambda rows: F.transform(rows, lambda s: F.struct(s["module_type"].alias("module_type"), s["layer"].alias("layer"), s["z"].alias("z")))
    depth = by_max.groupBy("path").agg(drop(_first(F.collect_list(spike("top_z")), top_k, "_a")).alias("depth_spikes"))
    conc = by_conc.groupBy("path").agg(drop(_first(F.collect_list(spike("concentration_z")), top_k, "z")).alias("concentration_spikes"))
    totals = per_module.groupBy("path").agg(F.max("max_abs_z").alias("max_robust_z"), F.count_if(F.col("max_abs_z") > stats.OUTLIER_Z).cast("int").alias("n_outlier_modules"), F.max("concentration_z").alias("max_concentration_z"))
    top = z.withColumn("_a", F.abs("z")).withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("_a"), "base", "feature"))).where(F.col("_r") <= top_k)
    contributor = F.struct(F.col("base"), "feature", F.col("family").alias("module_type"), "layer", F.lit(None).cast("int").alias("head"), "expert", F.col("raw").alias("value"), "z", "_a")
    contributors = top.groupBy("path").agg(F.transform(_first(F.collect_list(contributor), top_k, "_a"), lambda s: s.dropFields("base", "_a")).alias("top_contributors"))
    energy = grouped.gini(modules.where("energy > 0"), ["path"], "energy").withColumnRenamed("gini", "energy_gini")
    disp = grouped.dispersion(modules, ["path", "family"], "log_rms").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "dispersion")))).alias("logrms_dispersion"))
    ratio = attn_mlp_ratio(modules, ["path"], "kind", "log_rms")
    out = compared
    for part in (totals, depth, conc, energy, disp, ratio, contributors):
        out = out.join(part, "path", "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<struct<module_type:string,layer:int,z:double>>"))
    intra = F.struct(F.coalesce("max_robust_z", F.lit(0.0)).alias("max_robust_z"), F.coalesce("n_outlier_modules", F.lit(0)).alias("n_outlier_modules"), none("depth_spikes").alias("depth_spikes"), "max_concentration_z", none("concentration_spikes").alias("concentration_spikes"), "energy_gini", F.coalesce("logrms_dispersion", F.create_map().cast("map<string,double>")).alias("logrms_dispersion"), "attn_mlp_ratio")
    return out.select("path", intra.alias("intra"), "top_contributors")


def attn_mlp_ratio(rows: DataFrame, keys: list[str], kind: str, value: str, names: tuple[str, str] = ("attention", "mlp")) -> DataFrame:
    """keys, attn_mlp_ratio: median of one kind less that of the other (a log-ratio, as values are logs); null if either has none."""
    med = lambda k: F.median(F.when(F.col(kind) == k, F.col(value)))
    return rows.groupBy(*keys).agg((med(names[0]) - med(names[1])).alias("attn_mlp_ratio"))
