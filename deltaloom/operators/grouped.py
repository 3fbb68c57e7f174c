"""Statistics of groups, as aggregates and windows: keys, a value, and nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import stats
from ..functions.slopes import median_slope
from ..functions.stats import MAD_TO_SIGMA, MEANAD_TO_SIGMA, MIN_DETREND, MIN_FAMILY


def hoyer(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, hoyer."""
    n, v = F.count(value).cast("double"), F.col(value).cast("double")
    l2 = F.sqrt(F.sum(v * v))
    return df.groupBy(*keys).agg(F.when((n >= 2) & (l2 > 0), (F.sqrt(n) - F.sum(F.abs(v)) / l2) / (F.sqrt(n) - 1)).alias("hoyer"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, gini of values that aren't negative."""
    places = ranked(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], "_i").withColumn("_i", F.col("_i").cast("double"))
    n, s = F.count("*").cast("double"), F.sum("_v")
    weighted = 2 * F.sum(F.col("_i") * F.col("_v")) - (n + 1) * s
    return places.groupBy(*keys).agg(F.when((n >= 2) & (s > 0), weighted / (n * s)).alias("gini"))


def top_share(df: DataFrame, keys: list[str], value: str, k: int = 8) -> DataFrame:
    """keys, top_share: of the squares, what the k largest hold. Only k rows of a group pass the window's limit."""
    v = F.col(value).cast("double")
    squares = df.where(F.col(value).isNotNull()).select(*keys, (v * v).alias("_e"))
    top = squares.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_e")))).where(F.col("_i") <= k).groupBy(*keys).agg(F.sum("_e").alias("_t"))
    total = squares.groupBy(*keys).agg(F.sum("_e").alias("_s"))
    return total.join(top, keys).select(*keys, F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).alias("top_share"))


def position_medians(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pos, mid: the median at each position of a group's vectors."""
    each = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "_v"))
    return each.groupBy(*keys, F.col("pos").cast("long").alias("pos")).agg(F.median("_v").alias("mid"))


def depth(layer: str, keys: list[str]) -> Column:
    """How many layers a row's group has: its highest layer, from 0, and one."""
    return F.max(layer).over(W.partitionBy(*keys)) + 1


def apart(start: str, end: str, keys: list[str]) -> Column:
    """Whether a row does not begin where the one before it in its group ends; the first begins at 0."""
    return F.col(start) != F.lag(end, 1, 0).over(W.partitionBy(*keys).orderBy(start, end))


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with each row's place in its group, from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 10) -> DataFrame:
    """The first k rows of each group, with rank."""
    return ranked(df, keys, order, "rank").where(F.col("rank") <= k)


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, med, mad, mean_ad."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    dev = F.abs(F.col(value) - F.col("med"))
    return df.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(dev).alias("mad"), F.avg(dev).alias("mean_ad"))


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, med, scale: 1.4826 MAD, else 1.2533 mean absolute deviation, else 0."""
    return spread(df, keys, value).select(*keys, "med", scale_of(F.col("mad"), F.col("mean_ad")).alias("scale"))


def scale_of(mad: Column, mean_ad: Column) -> Column:
    return F.when(mad > 0, MAD_TO_SIGMA * mad).when(mean_ad > 0, MEANAD_TO_SIGMA * mean_ad).otherwise(F.lit(0.0))


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with z; groups without any spread yield nothing."""
    s = robust_scale(df, keys, value).where("scale > 0")
    return df.join(s, keys).withColumn("z", (F.col(value) - F.col("med")) / F.col("scale")).drop("med", "scale")


#: Points up to which the slopes of all pairs of a group are one array; those of larger groups are never all formed.
ARRAY_GROUP = 1024


def pair_slopes(points: str, x: str, y: str) -> Column:
    """Of all pairs of an array's structs with different x."""
    return F.flatten(F.transform(points, lambda a: F.transform(F.filter(points, lambda b: b[x] > a[x]), lambda b: (b[y] - a[y]) / (b[x] - a[x]))))


def median_slopes(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope: as theil_sen, for large groups. The pairs are counted, in n log n steps of a task that holds a group's points."""
    px, py = (stats.finite(F.col(c).cast("double")) for c in (x, y))
    known = points.select(*keys, px.alias("_x"), py.alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    schema = StructType([*known.select(*keys).schema.fields, StructField("slope", DoubleType())])

    def slope_of(key, own):
        import pandas as pd

        return pd.DataFrame([[*key, median_slope(own["_x"], own["_y"])]], columns=schema.names)

    return known.groupBy(*keys).applyInPandas(slope_of, schema)


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept: the median of the slopes of all pairs with different x, and median(y) - slope * median(x).

    Points that lack a finite coordinate are in no pair.
    """
    px, py = (stats.finite(F.col(c).cast("double")) for c in (x, y))
    point = F.when(px.isNotNull() & py.isNotNull(), F.struct(px.alias("x"), py.alias("y")))
    groups = df.groupBy(*keys).agg(F.collect_list(point).alias("_p"), F.median(x).alias("_mx"), F.median(y).alias("_my"))
    held = [*keys, "_mx", "_my"]
    few = groups.where(F.size("_p") <= ARRAY_GROUP).select(*held, array_median(pair_slopes("_p", "x", "y")).alias("slope"))
    many = median_slopes(groups.where(F.size("_p") > ARRAY_GROUP).select(*held, F.inline("_p")), held, "x", "y")
    return few.unionByName(many).select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def detrended(df: DataFrame, keys: list[str], x: str, y: str, least: int = MIN_DETREND) -> DataFrame:
    """df with residual: y less its Theil-Sen line over x, if the group has at least `least` points, all with x, at two places; else y as it is."""
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"), (F.count(x) == F.count("*")).alias("_all"), F.countDistinct(x).alias("_places"), F.median(y).alias("_med"))
    sized = df.join(size, keys)
    line = theil_sen(sized.where((F.col("_n") >= least) & F.col("_all") & (F.col("_places") >= 2)), keys, x, y)
    residual = F.when(F.col("slope").isNotNull(), F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))).when((F.col("_n") >= least) & F.col("_all"), F.col(y) - F.col("_med")).otherwise(F.col(y))
    return sized.join(line, keys, "left").withColumn("residual", residual).drop("_n", "_all", "_places", "_med", "slope", "intercept")


def dispersion(df: DataFrame, keys: list[str], value: str, least: int = MIN_FAMILY) -> DataFrame:
    """keys, dispersion: median absolute deviation of groups of at least `least` values."""
    big = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return spread(df.where(F.col(value).isNotNull()).join(big.select(*keys), keys), keys, value).select(*keys, F.col("mad").alias("dispersion"))


def array_median(xs: Column) -> Column:
    """Of an array without nulls; null for an empty one."""
    at = lambda s, k: F.get(s, F.floor(k / 2).cast("int"))
    return stats.let(F.sort_array(xs), lambda s: (at(s, F.size(s) - 1) + at(s, F.size(s))) / 2)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, n, mean and p<k> of each percentage, exactly, by linear interpolation."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q / 100)).alias(f"p{q:g}") for q in at))


#: Slices into which a group's scores are cut, and the size up to which a group's median needs no bracket.
SLICES, SMALL_GROUP = 64, 5000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, where all keys are the same; null is the same as null."""
    named = right.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return left.join(named, same, how).drop(*(f"_key{i}" for i in range(len(keys))))


def count_at_least(df: DataFrame, keys: list[str], score: str, is_reference: Column) -> DataFrame:
    """df with n_ge: how many reference rows of the group have a score at least as high; a null score is below all others.

    Equal scores are counted before anything is sorted, and a group's scores are cut at approximate percentiles. So neither a crowded
    score nor a large group meets in one task; what is summed over a whole group are its SLICES totals.
    """
    steps = df.groupBy(*keys, score).agg(F.sum(is_reference.cast("long")).alias("_c"))
    cuts = steps.groupBy(*keys).agg(F.percentile_approx(score, [i / SLICES for i in range(1, SLICES)], 1000).alias("_cuts"))
    place = F.coalesce(F.size(F.filter("_cuts", lambda q: q < F.col(score))), F.lit(0))
    sliced = joined(steps, cuts, keys).withColumn("_slice", place).drop("_cuts")
    later = W.partitionBy(*keys).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    above = sliced.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_t")).withColumn("_above", F.coalesce(F.sum("_t").over(later), F.lit(0))).drop("_t")
    own = F.sum("_c").over(W.partitionBy(*keys, "_slice").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0))
    counted = joined(sliced.withColumn("_own", own), above, [*keys, "_slice"]).select(*keys, score, (F.col("_own") + F.col("_above")).alias("n_ge"))
    return joined(df, counted, [*keys, score])


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med of the values that aren't null, exactly, for groups of any size.

    Approximate percentiles bracket the median of a large group; what lies below is only counted, and of the bracket (some 0.2 % of
    a group) the distinct values are sorted. The rank error of the percentiles is a tenth of the bracket's margin.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    near = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_q"))
    large = F.col("n") > SMALL_GROUP
    below = large & (F.col("_v") < F.col("_q")[0])
    steps = joined(known, near, keys).where(~large | (F.col("_v") <= F.col("_q")[1]))
    counts = steps.groupBy(*keys, "n", F.when(below, F.lit(float("-inf"))).otherwise(F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    reached = counts.withColumn("_r", F.sum("_c").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    at = lambda rank: F.sum(F.when((F.col("_r") - F.col("_c") <= rank) & (rank < F.col("_r")), F.col("_v")))
    return reached.groupBy(*keys, "n").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("med"))


def robust_scale_of_many(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """robust_scale of groups that no task should hold."""
    med = medians(df, keys, value).drop("n")
    away = joined(df, med, keys).select(*keys, "med", F.abs(F.col(value) - F.col("med")).alias("_d"))
    mean = away.groupBy(*keys).agg(F.first("med").alias("med"), F.avg("_d").alias("mean_ad"))
    mad = medians(away, keys, "_d").select(*keys, F.col("med").alias("mad"))
    return joined(mean, mad, keys).select(*keys, "med", scale_of(F.col("mad"), F.col("mean_ad")).alias("scale"))
