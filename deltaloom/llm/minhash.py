"""Near-duplicates by circulant MinHash, with every link confirmed on full shingle sets.

A shingle's hash is permuted to one of D places (the first permutation); coordinate k of a signature is the least
value that the second permutation, shifted circularly by k, has at the text's places. So one table of D numbers gives
all coordinates: those of a shingle are K neighbouring numbers of it. Coordinates are banded; texts that agree on a
band share a bucket.

Texts of the same set are one class from the start, found by grouping on 128 bits of hash. Within a bucket, every
class is compared with a pivot of the bucket, which links most of a group of copies in a number of comparisons in
proportion to its size. What is left in a bucket of several components is compared pair by pair, but for pairs that
are too far apart: 1 - similarity is a metric, so a pair's distance is at least the difference of theirs to the pivot;
and BITS coordinates of one bit each tell pairs well below the threshold. There is no cap on comparisons. Two texts at the
threshold of 0.8 share none of 32 bands of 5 with a probability of 3 in a million, and differ in more bits than allowed
with one of about 1 in a million; both are less the more alike they are.

Null ids: such a row is in no component and is kept. Empty and null texts, and those without words, have no shingle
and link with nothing. Repeated rows of one id are one node; texts of one id link their components. An empty table
gives an empty one; other columns are ignored, whatever their names. A very long text is one slice, with memory of some 20 times its bytes; of over
four million shingles most places are taken, so such texts share all buckets and are told apart by the comparison alone. Buckets of many
unlinked classes are compared pair by pair, in as many tasks as Spark's handling of skewed joins deals them to.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, table, written
from .components import components
from .kernels import Texts, mix, windows

PLACES_BITS = 22
BANDS, ROWS = 32, 5
#: Orders in which pivots are chosen; more give more chances to link a wide group at once, and more comparisons.
PIVOTS = 4
_CHUNK = 2048
#: One-bit coordinates for what is left after the pivots, and how many standard deviations of differing bits are allowed.
BITS, DEVIATIONS = 2048, 5


@functools.cache
def _second_permutation(coordinates: int) -> np.ndarray:
    """The permutation with its beginning repeated at the end; row x of the view has all shifts at place x."""
    values = np.random.default_rng(20).permutation(1 << PLACES_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.append(values, values[: coordinates - 1]), coordinates)


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order; of a shorter text, one for all its words."""
    texts = Texts(column)
    words = texts.word_hashes(lower=True)
    runs = windows(words, width)
    out = []
    for a, b in zip(texts.word_offsets[:-1].tolist(), texts.word_offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(words[:0])
    return out


def signature(shingle_hashes: np.ndarray, coordinates: int) -> np.ndarray:
    rows = _second_permutation(coordinates)
    places = mix(shingle_hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - PLACES_BITS)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _CHUNK):
        np.minimum(least, rows[places[at : at + _CHUNK]].min(axis=0), out=least)
    return least


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for col in sig.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + col)
    return out


def _set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    return int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), _signed(flat))


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, full: bool = False) -> DataFrame:
    """id, n_shingles, k1, k2 (the set's hash) with either the band hashes or the full set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(part.column("text"), width)
                keys = np.array([_set_keys(s) for s in sets], np.uint64).reshape(-1, 2)
                what = _lists(sets if full else [band_hashes(signature(s, bands * rows), bands, rows) if len(s) else s for s in sets])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), _signed(keys[:, 0].copy()), _signed(keys[:, 1].copy()), what], ["id", "n_shingles", "k1", "k2", "what"])

    return docs.mapInArrow(sketch, "id long, n_shingles long, k1 long, k2 long, what array<long>").withColumnRenamed("what", "hashes" if full else "bands")


def bit_sketches(sets: DataFrame) -> DataFrame:
    """id and BITS coordinates of one bit, as longs, of a table with full sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            lists = batch.column("hashes")
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), (lists.offsets.to_numpy() - lists.offsets[0].as_py())
            bits = [np.packbits((signature(flat[a:b], BITS) & 1).astype(np.uint8)).view(np.uint64) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(bits)], ["id", "bits"])

    return sets.select("id", "hashes").mapInArrow(sketch, "id long, bits array<long>")


def bits_allowed(percent: int) -> int:
    differ = (1 - percent / 100) / 2
    return int(BITS * differ + DEVIATIONS * (BITS * differ * (1 - differ)) ** 0.5)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with their distance and whether they link: 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    both = F.size("ha") + F.size("hb") - F.col("common")
    return pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("common"), "ha", "hb").select(
        "a", "b", (1 - F.col("common") / both).alias("distance"), (100 * F.col("common") >= percent * both).alias("linked"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, n_shingles, component_id (the least id reachable over links), kept (it is that id) of each row."""
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = written(sketches(wanted, width, bands, rows), "sketches")
    linkable = all_rows.where("n_shingles > 0 AND id IS NOT NULL")
    # one row for each set: its class, named by the least id
    classes = written(linkable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("members")), "classes")
    members = classes.select("rep", "n", "bands", F.posexplode("bands").alias("band", "bucket"))
    order = F.xxhash64("rep", F.pmod("band", F.lit(PIVOTS)))
    crowded = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"))
    shared = written(members.drop("bands").join(crowded, "bucket").select("bucket", "band", "rep", "n", "pivot", "pn"), "buckets")
    ratio = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    star = shared.where("rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    # full sets of the classes that share a bucket, from the texts
    needed = shared.select(F.col("rep").alias("id")).distinct().join(classes.select(F.col("rep").alias("id"), "k1", "k2"), "id")
    again = wanted.join(needed.select("id").distinct(), "id", "left_semi")
    sets = sketches(again, width, bands, rows, full=True).join(needed, ["id", "k1", "k2"], "left_semi")
    if docs_repeat(linkable):
        sets = sets.groupBy("id", "k1", "k2").agg(F.first("hashes").alias("hashes"))
    sets = written(sets, "sets")
    tested = written(_similar(star, sets, percent), "tested")
    # texts of one id
    own = linkable.groupBy("id", "k1", "k2").agg(F.lit(1).alias("x")).join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep")
    extra = own.select(F.col("id").alias("a"), F.col("rep").alias("b")).join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")
    links = tested.where("linked").select("a", "b").unionByName(extra)
    first = components(links)
    label = lambda frame, node, name: frame.join(first.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    # distances of a bucket's classes to its pivot, and their components
    far = tested.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance")
    to_pivot = shared.withColumns({"x": F.greatest("rep", "pivot"), "y": F.least("rep", "pivot")}).join(far, ["x", "y"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    placed = written(label(label(to_pivot, "rep", "comp"), "pivot", "pcomp").select("bucket", "band", "rep", "n", "comp", "pcomp", "distance"), "placed")
    reach = 1 - percent / 100 + 1e-9
    # buckets of several components, with what tells pairs apart; a pair is compared in the first band that it shares
    several = placed.where("comp <> pcomp").select("bucket").distinct()
    mixed = placed.join(several, "bucket", "left_semi")
    bits = written(bit_sketches(sets.join(mixed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")), "bits")
    mixed = written(mixed.join(bits.withColumnRenamed("id", "rep"), "rep").join(classes.select("rep", "bands"), "rep"), "mixed")
    others = mixed.where("comp <> pcomp").select("bucket", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("comp").alias("c"), F.col("distance").alias("d"), F.col("bits").alias("rbits"), F.col("bands").alias("rbands"))
    differing = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("rbits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    earlier = F.when(F.col("band") > 0, F.exists(F.sequence(F.lit(0), F.col("band") - 1), lambda j: F.get("bands", j) == F.get("rbands", j))).otherwise(F.lit(False))
    apart = (F.col("c") != F.col("comp")) & (F.abs(F.col("d") - F.col("distance")) <= reach) & ratio(F.col("m"), F.col("n")) & (differing <= bits_allowed(percent)) & ~earlier
    inner = others.join(mixed.where("comp <> pcomp"), "bucket").where(apart & (F.col("r") < F.col("rep")))
    # "pcomp" is reached over chains, so its classes may be at any distance from the pivot; only "apart" tells pairs apart
    outer = others.join(mixed.where("comp = pcomp AND distance > 0"), "bucket").where(apart)
    rest = inner.select("r", "rep").unionByName(outer.select("r", "rep")).select(F.greatest("r", "rep").alias("a"), F.least("r", "rep").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    more = written(_similar(rest, sets, percent).where("linked").select("a", "b"), "more")
    found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if more.take(1) else first
    named = classes.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    alone = F.col("n_shingles") == 0
    out = all_rows.join(named, ["k1", "k2"], "left").select("id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)


def docs_repeat(rows: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return bool(rows.groupBy("id").count().where("count > 1").take(1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: The whole definition in SQL: all pairs that share a shingle, counted, and the least id reachable.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w) t
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, c, x.n + y.n - c AS u FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b) t WHERE 100 * c >= 80 * u
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT both_ways.b, reach.seen FROM reach JOIN both_ways ON both_ways.a = reach.node
), least AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.c, d.doc_id) AS component_id, coalesce(least.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = d.doc_id
"""
