"""Stable identifiers, text escapes and small codes. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACTIONS = ["allow", "review", "block"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
FATAL_CODES = ["INVALID_SAFETENSORS", "TRUNCATED_FILE", "TENSOR_TOO_LARGE", "NO_LORA_PAIRS", "UNSUPPORTED_PEFT_TYPE", "SHARDED_ADAPTER"]
DEGRADED_CODES = ["METADATA_PARSE_ERROR", "TENSOR_SHAPE_INVALID", "PARTIAL_LAYER_ANALYSIS", "ISOLATION_FOREST_SKIPPED", "SVD_FAILED"]
WARNING_CODES = ["METADATA_DEPTH_EXCEEDED"]
FATAL_CATEGORIES = ["malformed", "unsupported"]
BIDI = "‎‏‪-‮⁦-⁩؜"


def hashed(*parts: Column) -> Column:
    """sha256 of the parts, joined by ':'."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", *parts), 256))


def request_id(path: Column, run: Column) -> Column:
    return hashed(path, run)


def scan_id(content: Column, config: Column, schema: Column) -> Column:
    return hashed(content, config, schema)


def logical_id(repo: Column, revision: Column, file: Column, path: Column) -> Column:
    return F.when(repo.isNotNull(), F.concat_ws(":", repo, F.coalesce(revision, F.lit("HEAD")), file)).otherwise(path)


def action_rank(action: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ACTIONS)), action) - 1).cast("int")


def action_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), (rank + 1).cast("int"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def exit_code(status: Column, action: Column, threshold: Column, threshold_first: bool = False) -> Column:
    """0, 1 (failed) or 2 (the action reaches the threshold); a batch looks at the threshold first."""
    failed, reached = status == "failed", F.coalesce(action_rank(action) >= action_rank(threshold), F.lit(False))
    first, second = ((reached, 2), (failed, 1)) if threshold_first else ((failed, 1), (reached, 2))
    return F.when(first[0], first[1]).when(second[0], second[1]).otherwise(0)


def error_severity(code: Column, category: Column) -> Column:
    by_code = F.when(code.isin(FATAL_CODES), "fatal").when(code.isin(DEGRADED_CODES), "degraded").when(code.isin(WARNING_CODES), "warning")
    return by_code.when(category.isin(FATAL_CATEGORIES), "fatal").otherwise("degraded")


def expired(stored: Column, now: Column, ttl_days: Column) -> Column:
    """Whole days of age over the limit; never without a limit."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(stored.cast("timestamp"))) / F.lit(86_400_000_000))
    return F.coalesce(days > ttl_days, F.lit(False))


def safe_text(text: Column) -> Column:
    """Control characters and direction marks as \\xNN or \\uNNNN; other characters as they are. Character by character, without Python."""
    def escaped(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
        low = F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(code)), 2, F.lit("0")))
        high = F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, F.lit("0")))
        return F.when(c.rlike("[\\x00-\\x1f\\x7f-\\x9f]"), low).when(c.rlike(f"[{BIDI}]"), high).otherwise(c)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike(f"[\\x00-\\x1f\\x7f-\\x9f{BIDI}]"), F.array_join(F.transform(chars, escaped), "")).otherwise(text)


def shortened(text: Column, most: int = 120) -> Column:
    return F.left(text, F.lit(most))


def camel(rule: Column) -> Column:
    return F.replace(F.initcap(F.replace(F.lower(rule), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def uri(path: Column) -> Column:
    """Percent-encoded path segments."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.array_join(parts, "/")
