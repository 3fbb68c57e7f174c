"""A survey of many adapters: leave out those done, scan, flatten, and report the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, grouped
from ..sinks import reports
from .batch import Workspace
from .scan import Settings, scan


@dataclass(frozen=True)
class Report:
    totals: DataFrame
    actions: DataFrame
    levels: DataFrame
    families: DataFrame
    codes: DataFrame
    z: DataFrame
    suspicious: DataFrame
    structural: DataFrame


def aggregate(rows: DataFrame, top: int = 20) -> Report:
    """The corpus report of survey rows; each part is small, whatever the number of rows."""
    ok = rows.where("status = 'success'")
    by_z = corpus.most_anomalous(ok, top)
    z = grouped.percentiles(ok.withColumn("all", F.lit("all")), ["all"], "max_robust_z", corpus.PERCENTAGES)
    return Report(corpus.status_totals(rows), grouped.value_counts(ok, "action"), grouped.value_counts(ok, "level"), grouped.value_counts(ok, "base_family"), corpus.code_counts(ok, "reason_codes"), z, by_z, corpus.most_suspicious(ok, top))


def run(work: Workspace, candidates: DataFrame, settings: Settings = Settings(include_modules=False)) -> DataFrame:
    """Survey rows of candidates (repo_id, path) that have none yet; they are appended, so a survey that was broken off goes on."""
    done = work.read("survey", "repo_id string")
    new = corpus.not_done(candidates, done)
    results = work.written(scan(new, settings, written=work.written), "survey-results")
    flat = corpus.flat_record(results).withColumnRenamed("repo_id", "path").join(new.select("path", "repo_id"), "path").drop("path")
    work.append(flat, "survey")
    return flat


def markdown(report: Report) -> str:
    totals = report.totals.first().asDict()
    codes = [(r["code"], r["n"]) for r in report.codes.collect()]
    top = [(r["repo_id"], r["max_robust_z"]) for r in report.suspicious.collect()]
    return reports.corpus_report(totals, codes, top)
