"""Scans, contracts, fingerprints and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tables(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None, fmt: str = "parquet", source: str = "source_file", **options) -> DataFrame:
    """A1: many files as one table, with the file's name in ``source``. ``fmt``: parquet, csv, json (JSON lines) or orc."""
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths if isinstance(paths, str) else list(paths)).select("*", F.col("_metadata.file_name").alias(source))


def check_headers(spark: SparkSession, paths: Sequence[str], required: Sequence[str], fmt: str = "csv") -> dict[str, list[str]]:
    """A2, before the scan: for each file what is wrong with its header: columns missing, or unlike the first file's."""
    found, first = {}, None
    for p in paths:
        names = [c.strip().lower() for c in spark.read.format(fmt).option("header", "true").load(p).columns]
        first = first or names
        wrong = [f"missing {c}" for c in required if c.lower() not in names] + (["unlike the first header"] if names != first else [])
        if wrong:
            found[p] = wrong
    return found


def check_contract(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = (), order: Sequence[str] = (), monotone: str | None = None) -> DataFrame:
    """A2: (rule_name, violations). A rule is true for good rows; null counts as violated. All rules in one pass.

    With ``monotone``, rule ``monotone``: within ``by``, in ``order``, the column never falls.
    """
    if monotone:
        before = F.lag(monotone).over(Window.partitionBy(*by).orderBy(*order))
        df = df.withColumn("_monotone", F.coalesce(F.col(monotone) >= before, before.isNull() & F.col(monotone).isNotNull()))
        rules = {**rules, "monotone": F.col("_monotone")}
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule_name"), F.col(n).alias("violations")) for n in rules])))


def with_ordinal(df: DataFrame, file: str, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """A file's row number, from 0, in a declared order; store it at ingest and join on it from then on."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1).cast("long"))


def aligned_join(left: DataFrame, right: DataFrame, file: str, row: str, check: str) -> tuple[DataFrame, DataFrame]:
    """A3: rows paired by position in the same file, and one row of counts: matched, left_only, right_only, mismatched.

    The pairing holds only if all but ``matched`` are 0; ``check`` (a time that both have) must be equal.
    """
    right = right.withColumnRenamed(check, f"_{check}")
    both = left.join(right.withColumn("_r", F.lit(1)), [file, row], "full").withColumn("_l", F.col(check).isNotNull())
    paired = left.join(right, [file, row]).drop(f"_{check}")
    good, same = F.col("_l") & F.col("_r").isNotNull(), F.col(check).eqNullSafe(F.col(f"_{check}"))
    counts = both.agg(
        F.count_if(good & same).alias("matched"), F.count_if(F.col("_l") & F.col("_r").isNull()).alias("left_only"), F.count_if(~F.col("_l")).alias("right_only"), F.count_if(good & ~same).alias("mismatched")
    )
    return paired, counts


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error", **options) -> None:
    """A4: zstd Parquet, CSV with header, or JSON lines; ``append`` mode is the ledger."""
    own = {"parquet": {"compression": "zstd"}, "csv": {"header": "true"}}.get(fmt, {})
    w = df.write.format(fmt).mode(mode).options(**(own | options))
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def source_inventory(df: DataFrame, file: str, time: str, tool: str) -> DataFrame:
    """A5: rows, first and last time, and the tool of each file (that of the earliest row)."""
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min_by(tool, F.struct(time, tool)).alias("tool"))


def content_fingerprint(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row (n_rows, hash_sum, hash_xor) that does not depend on row order or partitioning."""
    cols = sorted(keys or df.columns)
    sha = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    return df.select(part.alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("_h").alias("hash_xor"))


def run_signature(inputs: Mapping[str, DataFrame], settings: Mapping[str, object], keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row (signature): SHA-256 of the settings, as JSON with sorted keys, and the fingerprints of all inputs by name.

    Equal signatures mean that a stored result of these inputs and settings can be used again. ``keys`` are the columns
    of an input that count, all by default.
    """
    parts = [F.lit(json.dumps(dict(settings), sort_keys=True, separators=(",", ":")))]
    one = None
    for i, name in enumerate(sorted(inputs)):
        f = content_fingerprint(inputs[name], (keys or {}).get(name))
        f = f.select(F.concat_ws("|", F.lit(name), "n_rows", "hash_sum", "hash_xor").alias(f"_f{i}"))  # no number here is null but of an empty table
        one = f if one is None else one.crossJoin(f)  # one row each
        parts.append(F.col(f"_f{i}"))
    if one is None:
        raise ValueError("a signature needs inputs")
    return one.select(F.sha2(F.concat_ws("\n", *parts), 256).alias("signature"))


def coverage_check(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with ``side``: missing (expected only) or unexpected (actual only). Empty if the sets are equal."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def reconcile(saved: DataFrame, recomputed: DataFrame, keys: Sequence[str], cols: Sequence[str], atol: float = 1e-9) -> DataFrame:
    """A row for each key and column: metric, saved, recomputed, result PASS or FAIL. Null equals null, NaN equals NaN.

    A key on one side only fails unless all its values are null.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*keys, "x.metric", F.col("x.v").alias(name))

    s, r = long(saved, "saved"), long(recomputed, "recomputed").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("metric").alias("_metric"), "recomputed")
    same = s["metric"] == r["_metric"]
    for k in keys:
        same = same & s[k].eqNullSafe(r[f"_{k}"])
    met = s.join(r, same, "full").select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], F.coalesce("metric", "_metric").alias("metric"), "saved", "recomputed")
    ok = F.col("saved").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("saved") - F.col("recomputed")) <= F.lit(atol), F.lit(False))
    return met.withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))
