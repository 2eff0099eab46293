"""Pattern scans over texts and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import joined_by_sort

# fixed values
SECRET_PATTERNS = {
    "api_key": r"""api[_-]key\s*=\s*['"][a-zA-Z0-9]{32,}['"]""",
    "password": r"""password\s*=\s*['"][^'"]{8,}['"]""",
}
QUERY_CALLS = ["execute", "executemany"]
DANGEROUS_CALLS = ["eval", "exec"]

# an addition of ours, for tables whose secrets are access tokens
TOKEN_PATTERN = {"token": r'token\s*=\s*"[0-9a-f]{40}"'}

FLAGS = ["sql_injection", "hardcoded_secrets", "eval_exec"]


def _insensitive(pattern: str) -> str:
    return f"(?iU){pattern}"


def has_secret(text: Column, patterns: dict[str, str]) -> Column:
    """True when any pattern occurs anywhere in the whole text."""
    found = F.lit(False)
    for pattern in patterns.values():
        found = found | F.coalesce(text.rlike(_insensitive(pattern)), F.lit(False))
    return found


def suspicious_text(
    df: DataFrame, id_column: str, text: str, patterns: dict[str, str] = SECRET_PATTERNS
) -> DataFrame:
    """Every match in every text: ``id, pattern, match``."""

    def found(name: str, pattern: str) -> Column:
        texts = F.regexp_extract_all(F.col(text), F.lit(_insensitive(pattern)), F.lit(0))
        return F.transform(texts, lambda m: F.struct(F.lit(name).alias("pattern"), m.alias("match")))

    matches = [found(name, pattern) for name, pattern in patterns.items()]
    hit = df.filter(has_secret(F.col(text), patterns))
    rows = hit.select(id_column, F.explode_outer(F.concat(*matches)).alias("_m"))
    return rows.filter(F.col("_m").isNotNull()).select(id_column, "_m.pattern", "_m.match")


def call_counts(df: DataFrame, id_column: str, text: str, names: list[str]) -> DataFrame:
    """Calls ``name(`` of the given bare names per text: ``id, name, calls``."""
    pattern = rf"(?:^|[^\w.])({'|'.join(names)})\s*\("
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    calls = df.select(id_column, F.explode_outer(found).alias("name"))
    calls = calls.filter(F.col("name").isNotNull())
    return calls.groupBy(id_column, "name").agg(F.count(F.lit(1)).alias("calls"))


def dangerous_calls(nodes: DataFrame, names: list[str] = DANGEROUS_CALLS) -> DataFrame:
    """Calls of a bare name: the name node that sits in the function place of a call."""
    in_place = (F.col("node_type") == "Name") & F.col("role").endswith("/Call.func")
    return nodes.filter(in_place & F.col("name").isin(names)).select(
        "doc_id", "parent_id", "name", "line"
    )


def query_calls(nodes: DataFrame, names: list[str] = QUERY_CALLS) -> DataFrame:
    """Calls of ``x.execute(...)`` with a positional argument built by ``%``."""
    callee = F.col("role").endswith("/Call.func") & F.col("name").isin(names)
    calls = nodes.filter(callee & (F.col("node_type") == "Attribute"))
    calls = calls.select("doc_id", "parent_id", "name", "line")
    formatted = nodes.filter(
        (F.col("node_type") == "Mod") & (F.col("role") == "Call.args/BinOp.op")
    ).select("doc_id", F.col("grandparent_id").alias("parent_id"))
    return calls.join(formatted, ["doc_id", "parent_id"], "left_semi")


def text_flags(
    df: DataFrame, id_column: str, text: str, patterns: dict[str, str] = SECRET_PATTERNS
) -> DataFrame:
    """The flag struct for plain text, where only secrets can be told."""
    flags = F.struct(
        F.lit(False).alias("sql_injection"),
        has_secret(F.col(text), patterns).alias("hardcoded_secrets"),
        F.lit(False).alias("eval_exec"),
    )
    return df.select(id_column, flags.alias("security_flags"))


def scan_flags(
    sources: DataFrame, nodes: DataFrame, patterns: dict[str, str] = SECRET_PATTERNS
) -> DataFrame:
    """``doc_id, security_flags`` for every source; all False where it does not parse.

    One aggregation over the interesting nodes, then a join by document.
    """
    evals = dangerous_calls(nodes).select("doc_id", F.lit("eval_exec").alias("_flag"))
    injections = query_calls(nodes).select("doc_id", F.lit("sql_injection").alias("_flag"))
    failed = nodes.filter(F.col("node_type") == "_error")
    failed = failed.select("doc_id", F.lit("failed").alias("_flag"))

    def has(name: str) -> Column:
        return F.bool_or(F.col("_flag") == name).alias(f"_{name}")

    marks = (
        evals.unionByName(injections)
        .unionByName(failed)
        .groupBy("doc_id")
        .agg(has("eval_exec"), has("sql_injection"), has("failed"))
    )
    secret = has_secret(F.col("text"), patterns)
    rows = sources.select("doc_id", secret.alias("_secret")).join(joined_by_sort(marks), ["doc_id"], "left")
    parsed = ~F.coalesce(F.col("_failed"), F.lit(False))
    flags = F.struct(
        (parsed & F.coalesce("_sql_injection", F.lit(False))).alias("sql_injection"),
        (parsed & F.col("_secret")).alias("hardcoded_secrets"),
        (parsed & F.coalesce("_eval_exec", F.lit(False))).alias("eval_exec"),
    )
    return rows.select("doc_id", flags.alias("security_flags"))
