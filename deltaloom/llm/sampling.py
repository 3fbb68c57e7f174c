"""Bounded samples of labelled rows, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a sampled text that come to the driver.
MOST_CHARS = 16384


def window_of(text: str, seed: Column, chars: int) -> Column:
    """At most `chars` characters of the text, from a place that depends on the seed alone."""
    spare = F.greatest(F.char_length(text) - chars, F.lit(0))
    return F.substring(F.col(text), (F.pmod(F.xxhash64(seed, F.lit("at")), (spare + 1).cast("long")) + 1).cast("int"), F.lit(chars))


def chosen_ids(rows: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """id_col, label_col, k of about per_class rows of each label, by a hash of the id; at most 1.5 * per_class times the number of labels.

    The labels are counted first, over all rows, so that each label's share of rows is known.
    """
    labelled = rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    places = 1 << 40
    upto = labelled.groupBy(label_col).agg((F.lit(float(places)) * F.least(F.lit(1.0), per_class / F.count("*"))).cast("long").alias("upto"))
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    keyed = labelled.select(id_col, label_col, key.alias("k"), F.pmod(key, F.lit(places)).alias("place"))
    chosen = keyed.join(upto, label_col).where("place < upto").select(id_col, label_col, "k")
    return chosen.orderBy("k", id_col).limit(int(1.5 * per_class) * max(1, upto.count()))


def sampled(rows: DataFrame, id_col: str, label_col: str, text_col: str, per_class: int, chars: int = MOST_CHARS, labels: DataFrame | None = None) -> DataFrame:
    """k, y, x (text) of the chosen rows, one for each id. The labels may stand in a table of their own, with the same id_col."""
    with_text = rows.where(F.col(text_col).isNotNull())
    if labels is None:
        labels = with_text
    ids = F.broadcast(chosen_ids(labels, id_col, label_col, per_class).select(F.col(id_col).alias("_id"), F.col(label_col).alias("y"), "k").distinct())
    joined = with_text.select(F.col(id_col).alias("_id"), F.col(text_col).alias("x")).join(ids, "_id")
    one = joined.select("_id", F.struct("k", "y", window_of("x", F.col("k"), chars).alias("x")).alias("r")).groupBy("_id").agg(F.min("r").alias("r"))
    return one.select("r.k", "r.y", "r.x").where("x <> ''")


def sample(rows: DataFrame, id_col: str, label_col: str, text_col: str, per_class: int, chars: int = MOST_CHARS, labels: DataFrame | None = None) -> list[tuple[str, object]]:
    """(text, label) of the chosen rows, in a fixed order; at most 1.5 * per_class of `chars` characters for each label come to the driver."""
    got = sampled(rows, id_col, label_col, text_col, per_class, chars, labels).collect()
    return list(dict.fromkeys((r["x"], r["y"]) for r in sorted(got, key=lambda r: (r["k"], str(r["y"]), r["x"]))))


def without_copies(labelled: list[tuple[str, object]], width: int = 5, bands: int = 16, rows: int = 4) -> list[tuple[str, object]]:
    """The sample without texts that share a band of a MinHash signature with an earlier one: words of a copied text are not evidence many times over."""
    import pyarrow as pa

    from .minhash import band_hashes, shingles, signature

    seen: set[int] = set()
    out = []
    for one, s in zip(labelled, shingles(pa.array([x for x, _ in labelled], pa.string()), width), strict=True):
        own = band_hashes(signature(s, bands * rows), bands, rows).tolist() if len(s) else []
        if seen.isdisjoint(own):
            out.append(one)
        seen.update(own)
    return out
