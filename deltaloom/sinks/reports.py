"""Result documents as JSON, text, SARIF and CSV; all lines are made by expressions on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids

# Fixed values.
FINDINGS_SHOWN, UNREAD_SHOWN, CONTRIBUTORS_SHOWN, PLACES_SHOWN = 15, 5, 5, 3
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
DOCUMENT = ["schema_version", "scan", "artifact", "adapter", "status", "coverage", "verdict", "anomaly", "findings", "modules", "errors"]


def as_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """scan_id, document."""
    own = [c for c in DOCUMENT if c in results.columns]
    return results.select("scan.scan_id", F.to_json(F.struct(*own), {"pretty": "true"} if pretty else {}).alias("document"))


def by_severity(findings: Column) -> Column:
    """Findings from CRITICAL to LOW, in their own order within."""
    numbered = F.transform(findings, lambda f, i: F.struct(ids.severity_rank(f["severity"]).alias("s"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(numbered), lambda x: x["f"])


def as_text(results: DataFrame, most: int = FINDINGS_SHOWN) -> DataFrame:
    """scan_id, report. Whatever comes from a file is escaped."""
    line = lambda *parts: F.array(F.concat_ws("", *parts))
    found = F.transform(F.slice(by_severity(F.col("findings")), 1, most), lambda f: F.concat(F.lit("  ["), f["severity"], F.lit("] "), ids.safe_text(f["title"]), F.lit(": "), ids.safe_text(f["message"])))
    unread = F.transform(F.slice("coverage.not_analyzed", 1, UNREAD_SHOWN), lambda n: F.concat(F.lit("  not analysed: "), ids.safe_text(n["tensor_key"]), F.lit(" ("), ids.safe_text(n["reason"]), F.lit(")")))
    top = F.transform(F.slice(F.coalesce("anomaly.top_contributors", F.array().cast(results.schema["anomaly"].dataType["top_contributors"].dataType)), 1, CONTRIBUTORS_SHOWN), lambda c: F.format_string("  %s %s: z = %.1f", ids.safe_text(c["module_type"]), c["feature"], c["z"]))
    reasons = F.transform("verdict.reasons", lambda r: F.concat(F.lit("  "), r["code"], F.lit(": "), ids.safe_text(r["message"])))
    lines = F.concat(line(F.lit("Adapter "), ids.safe_text(F.col("path"))), line(F.lit("Status "), F.col("status"), F.lit(", action "), F.col("verdict.action"), F.lit(" ("), F.col("verdict.level"), F.lit("), confidence "), F.col("verdict.confidence.level")), reasons, found, unread, top)
    return results.select("scan.scan_id", F.array_join(lines, "\n").alias("report"))


def sarif_results(results: DataFrame) -> DataFrame:
    """One row for each SARIF result: the verdict unless it allows, and every finding."""
    level = F.create_map(*(F.lit(x) for kv in ids.SARIF_LEVEL.items() for x in kv))
    place = lambda locs: F.transform(F.slice(locs, 1, PLACES_SHOWN), lambda l: F.coalesce(l["tensor_key"], l["module"]))
    verdict = results.where(F.col("verdict.action") != "allow").select("scan.scan_id", "path", F.lit(-1).alias("ordinal"), F.lit("VERDICT").alias("rule_id"), F.col("verdict.level").alias("severity"), F.concat(F.lit("action "), F.col("verdict.action")).alias("message"), F.array().cast("array<string>").alias("places"))
    found = results.select("scan.scan_id", "path", F.posexplode("findings").alias("ordinal", "f")).select("scan_id", "path", "ordinal", F.col("f.rule_id").alias("rule_id"), F.col("f.severity").alias("severity"), F.col("f.message").alias("message"), place(F.col("f.locations")).alias("places"))
    return verdict.unionByName(found).withColumn("level", level[F.col("severity")])


def sarif_rules(rows: DataFrame) -> DataFrame:
    """scan_id, rule_id, name, level: the first result of each rule."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("scan_id", "rule_id").orderBy("ordinal"))).where("_n = 1")
    return first.select("scan_id", "rule_id", ids.camel(F.col("rule_id")).alias("name"), "level", "ordinal")


def as_sarif(results: DataFrame) -> DataFrame:
    """scan_id, document: SARIF 2.1.0."""
    rows = sarif_results(results)
    where = F.transform("places", lambda p: F.struct(F.struct(F.struct(ids.uri(F.col("path")).alias("uri")).alias("artifactLocation")).alias("physicalLocation"), F.array(F.struct(p.alias("fullyQualifiedName"))).alias("logicalLocations")))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"))
    of_results = rows.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", result.alias("r")))), lambda x: x["r"]).alias("results"))
    rule = F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("level").alias("level")).alias("defaultConfiguration"))
    of_rules = sarif_rules(rows).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    both = results.select("scan.scan_id").join(of_results, "scan_id", "left").join(of_rules, "scan_id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    run = F.struct(F.struct(F.struct(F.lit("deltaloom").alias("name"), none("rules", of_rules.schema["rules"].dataType).alias("rules")).alias("driver")).alias("tool"), none("results", of_results.schema["results"].dataType).alias("results"))
    return both.select("scan_id", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    """The table of results, by run_id. Spark's committer makes each write all or nothing."""
    rows.write.partitionBy("run_id").mode("append").parquet(path)


def append_log(documents: DataFrame, path: str) -> None:
    """The audit log: one JSON document (column document) a line, only ever appended."""
    documents.select("document").write.mode("append").text(path)


def corpus_report(totals: dict, codes: list[tuple[str, int]], top: list[tuple[str, float]]) -> str:
    """A Markdown report from figures that are already aggregated."""
    lines = ["# Corpus report", "", "| Figure | Adapters |", "|---|---|", *(f"| {k} | {v} |" for k, v in totals.items()), "", "| Reason | Adapters |", "|---|---|", *(f"| {c} | {n} |" for c, n in codes), "", "| Adapter | Largest robust z |", "|---|---|", *(f"| {a} | {z:.2f} |" for a, z in top)]
    return "\n".join(lines) + "\n"
