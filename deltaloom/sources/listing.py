"""What to scan: listings of folders, path lists, requests, configurations and neighbouring files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import config, ids
from . import files

# Fixed values.
CONFIG_NAME = "adapter_config.json"
REQUEST_SUFFIXES = [".safetensors", ".bin"]
SIBLINGS = {
    "code": [".py", ".pyc", ".sh", ".js", ".so", ".dll", ".dylib", ".exe"],
    "pickle": [".bin", ".pt", ".pth", ".pkl", ".pickle", ".ckpt", ".joblib", ".npy", ".npz"],
    "archive": [".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".xz", ".bz2"],
}
SIBLING_KINDS = {suffix: kind for kind, suffixes in SIBLINGS.items() for suffix in suffixes}
MAX_SIBLINGS = 1000
TERMINAL = ["persisted", "cached_hit", "skipped_duplicate", "failed"]


def scan_dir(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, mtime of all tensor files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.safetensors").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("mtime"))


def scan_list(lines: DataFrame) -> DataFrame:
    """path, ordinal of a table (ordinal, line): trimmed, without blanks, each path once where it stands first."""
    trimmed = lines.select(F.trim("line").alias("path"), "ordinal").where("path <> ''")
    return trimmed.groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def requests(paths: DataFrame, run_id: str, finished: DataFrame | None = None) -> DataFrame:
    """request_id, path, run_id of a table (path, ordinal, is_file): right suffix, regular, once each, and not finished before."""
    suffix = F.concat(F.lit("."), F.element_at(F.split("path", "[.]"), -1))
    good = paths.where(F.col("is_file") & suffix.isin(REQUEST_SUFFIXES))
    first = good.groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    out = first.select(ids.request_id(F.col("path"), F.lit(run_id)).alias("request_id"), "path", F.lit(run_id).alias("run_id"), "ordinal")
    return out if finished is None else out.join(finished.where(F.col("state").isin(TERMINAL)).select("request_id"), "request_id", "left_anti")


def resolved(paths: DataFrame) -> DataFrame:
    """(path, ordinal) with links followed: canonical path as path, is_file; what can't be resolved is dropped."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ordinal in zip(batch["path"], batch["ordinal"], strict=True):
                try:
                    real = files.real(path)
                    rows.append((real, ordinal, files.size_if_regular(real) is not None))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "ordinal", "is_file"])

    return paths.select("path", "ordinal").mapInPandas(read, "path string, ordinal long, is_file boolean")


def beside(paths: DataFrame) -> DataFrame:
    """path, config_text, config_problem, names (files beside it, at most MAX_SIBLINGS), as the path is given, links not followed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                text, problem, names = None, None, []
                try:
                    names += files.names_beside(path, MAX_SIBLINGS)
                    file = files.beside(path, CONFIG_NAME)
                    try:
                        size = files.size_if_regular(file)
                    except FileNotFoundError:
                        pass
                    else:
                        if size is None:
                            problem = f"{CONFIG_NAME}: not a regular file"
                        elif size > config.MAX_BYTES:
                            problem = f"{CONFIG_NAME}: larger than {config.MAX_BYTES} bytes"
                        else:
                            with files.opened(file) as f:
                                text = f.read().decode()
                except (OSError, UnicodeDecodeError) as e:
                    problem = f"{CONFIG_NAME}: unreadable ({type(e).__name__})"
                rows.append((path, text, problem, sorted(names)))
            yield pd.DataFrame(rows, columns=["path", "config_text", "config_problem", "names"])

    return paths.select("path").mapInPandas(read, "path string, config_text string, config_problem string, names array<string>")


def siblings(names) -> "F.Column":
    """array<struct<name, kind>> of the names that hold code, pickles or archives, by name."""
    kinds = F.create_map(*(F.lit(x) for kv in SIBLING_KINDS.items() for x in kv))
    kind = lambda n: F.try_element_at(kinds, F.lower(F.regexp_extract(n, "([.][^.]+)$", 1)))
    return F.array_sort(F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), kind(n).alias("kind"))), lambda s: s["kind"].isNotNull()))


def configs(found: DataFrame) -> DataFrame:
    """beside() with `config` (null if absent or invalid), `problems`, `siblings`."""
    parsed = config.parse(F.col("config_text"))
    bad = F.when(F.col("config_text").isNotNull() & F.col("config").isNull(), F.lit(f"{CONFIG_NAME}: not a JSON object"))
    problems = F.concat(F.array_compact(F.array("config_problem", bad)), F.coalesce(F.col("config.problems"), F.array().cast("array<string>")))
    return found.withColumn("config", parsed).withColumn("problems", problems).withColumn("siblings", siblings(F.col("names"))).drop("names", "config_problem")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
