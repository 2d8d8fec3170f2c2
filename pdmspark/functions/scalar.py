"""Row-wise operators: cleaning, banding, gating, ids, JSON records and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: text to double; text that is no number becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in cols})


def null_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B2: NaN and infinities to null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c)) for c in cols})


def complete(cols: Sequence[str], domains: Mapping[str, Sequence] | None = None) -> Column:
    """True where all columns are finite and all categories are known."""
    ok = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    for c, values in (domains or {}).items():
        ok = ok & F.col(c).isNotNull() & F.col(c).isin(list(values))
    return F.coalesce(ok, F.lit(False))


def complete_cases(df: DataFrame, cols: Sequence[str], domains: Mapping[str, Sequence] | None = None) -> tuple[DataFrame, DataFrame]:
    """The complete rows, and one row of counts: before, removed, after."""
    ok = complete(cols, domains)
    counts = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(~ok).alias("removed"), F.count_if(ok).alias("after"))
    return df.where(ok), counts


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, missing, present), all columns in one pass."""
    one = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("m"), F.count(c).alias("p")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["m"].alias("missing"), F.col(c)["p"].alias("present")) for c in cols])
    return one.select(F.inline(rows))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of a category, null as a value of its own."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def one_hot(df: DataFrame, col: str, categories: Sequence, strict: bool = True) -> DataFrame:
    """A 0/1 column for each category. An unknown or null category fails when strict, else gives zeros."""
    known = F.coalesce(F.col(col).isin(list(categories)), F.lit(False))
    if strict:
        df = df.withColumn(col, F.when(known, F.col(col)).otherwise(F.raise_error(F.lit(f"unknown category in {col}")).cast(df.schema[col].dataType)))
    return df.withColumns({f"{col}_{c}": F.when(F.col(col) == F.lit(c), 1).otherwise(0) for c in categories})


def band(value: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: x <= cuts[0] is labels[0], and so on; null stays null."""
    x = F.col(value) if isinstance(value, str) else value
    out = F.when(x <= F.lit(cuts[0]), F.lit(labels[0]))
    for cut_, label in zip(cuts[1:], labels[1:], strict=False):
        out = out.when(x <= F.lit(cut_), F.lit(label))
    return out.when(x.isNotNull(), F.lit(labels[-1]))


def gate(df: DataFrame, pred: str, prob: str, limit: float, p_min: float = 0.5) -> DataFrame:
    """forecast_alarm, gated_alarm, rescue, gated_value and tier (tier1, rescue or null)."""
    alarm, passed = F.col(pred) <= F.lit(limit), F.col(prob) >= F.lit(p_min)
    gated = alarm & passed
    return df.withColumns(
        {"forecast_alarm": alarm, "gated_alarm": gated, "rescue": alarm & ~gated, "gated_value": F.when(passed, F.col(pred)), "tier": F.when(gated, "tier1").when(alarm & ~gated, "rescue")}
    )


def stable_id(*cols: str, salt: str = "", length: int = 16) -> Column:
    """An opaque id: the first hexadecimal digits of the SHA-256 of salt and key, joined by |."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256), 1, length)


def normal_name(col: str) -> Column:
    """A header trimmed, in lower case, with runs of blanks squeezed."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"\s+", " ")


def name_parts(df: DataFrame, col: str, sep: str = "__") -> DataFrame:
    """``sensor__stat`` split into sensor and stat."""
    return df.withColumns({"sensor": F.substring_index(F.col(col), sep, 1), "stat": F.substring_index(F.col(col), sep, -1)})


def canonical_json(cols: Sequence[str], df: DataFrame, digits: int = 12) -> Column:
    """JSON with sorted keys, nulls kept, and doubles rounded to significant digits."""
    kinds = dict(df.dtypes)
    rounded = lambda c: F.expr(f"cast(format_string('%.{digits}g', `{c}`) as double)") if kinds[c] in ("double", "float") else F.col(c)
    fields = [F.when(F.col(c).isNotNull(), rounded(c)).alias(c) for c in sorted(cols)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def request_key(cols: Sequence[str], df: DataFrame, digits: int = 12) -> Column:
    """SHA-256 of the canonical JSON: equal rows have equal keys however they were stored."""
    return F.sha2(canonical_json(cols, df, digits), 256)


def build_packet(df: DataFrame, fields: Sequence[str], version: str = "1") -> DataFrame:
    """``packet`` (version and fields), ``issues`` (names of missing fields) and ``status``. Missing stays missing."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    values = F.struct(*[F.when(~bad(c), F.col(c).cast("double")).alias(c) for c in fields])
    issues = F.filter(F.array(*[F.when(bad(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    out = df.withColumns({"packet": F.struct(F.lit(version).alias("packet_version"), values.alias("fields")), "issues": issues})
    return out.withColumn("status", F.when(F.size("issues") == 0, "READY").otherwise("DATA_REVIEW"))


def leak_scan(df: DataFrame, json_col: str, tokens: Sequence[str]) -> DataFrame:
    """``leaked`` (nested key names with a forbidden token) and ``clean``. Looks at keys of any depth, in lower case."""
    keys = F.expr(rf"""regexp_extract_all(`{json_col}`, '"((?:[^"\\\\]|\\\\.)*)"\\s*:', 1)""")
    has = lambda k: F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower(k), t))
    return df.withColumn("leaked", F.array_distinct(F.filter(keys, has))).withColumn("clean", F.coalesce(F.size("leaked") == 0, F.lit(False)))


def parse_score_response(df: DataFrame, json_col: str, model_prefix: str = "", provider: str | None = None, legend: Sequence[str] | None = None) -> DataFrame:
    """Score in [0, 2] with probabilities of "0", "1", "2" that sum to 0.95 to 1.05; else MODEL_UNAVAILABLE, null.

    The model's and the provider's name must begin as given, and the legend be exactly the criteria asked for, numbered
    from 0, where these are given. Adds status, score, half_score and state (the likeliest of 0, 1, 2; the lower one of
    equals).
    """
    parsed = F.from_json(F.col(json_col), "model string, provider string, score double, probabilities map<string,double>, legend map<string,string>", {"mode": "PERMISSIVE"})
    p = lambda k: F.try_element_at(F.col("_r.probabilities"), F.lit(k))
    total = p("0") + p("1") + p("2")
    good = F.col("_r.score").between(0, 2) & (F.size("_r.probabilities") == 3) & total.between(0.95, 1.05) & F.col("_r.model").startswith(model_prefix)
    for k in "012":
        good = good & p(k).between(0, 1)
    if provider is not None:
        good = good & F.col("_r.provider").startswith(provider)
    if legend is not None:
        good = good & (F.size("_r.legend") == len(legend))
        for k, criterion in enumerate(legend):
            good = good & (F.try_element_at(F.col("_r.legend"), F.lit(str(k))) == F.lit(criterion))
    out = df.withColumn("_r", parsed).withColumn("_ok", F.coalesce(good, F.lit(False)))
    best = F.greatest(p("0"), p("1"), p("2"))
    state = F.when(p("0") == best, 0).when(p("1") == best, 1).otherwise(2)
    out = out.withColumns({"status": F.when(F.col("_ok"), "READY").otherwise("MODEL_UNAVAILABLE"), "score": F.when(F.col("_ok"), F.col("_r.score")), "state": F.when(F.col("_ok"), state)})
    return out.withColumn("half_score", F.col("score") / F.lit(2.0)).drop("_r", "_ok")


def parse_judge_output(df: DataFrame, json_col: str, fields: Sequence[str], recommendations: Sequence[str]) -> DataFrame:
    """``valid`` and ``judged``: exactly the keys of the contract, priority 0 to 100, a known recommendation,
    and evidence that cites allowed fields only."""
    item = "array<struct<field:string,value:double,claim:string>>"
    kind = f"struct<evidence_for:{item},evidence_against:{item},unknowns:array<string>,additional_checks:array<string>,priority_score:double,review_recommendation:string>"
    names = ["additional_checks", "evidence_against", "evidence_for", "priority_score", "review_recommendation", "unknowns"]
    parsed = F.from_json(F.col(json_col), kind, {"mode": "PERMISSIVE"})
    allowed = lambda name: F.forall(F.col(f"judged.{name}"), lambda e: e["field"].isin(list(fields)))
    keys = F.array_sort(F.json_object_keys(F.col(json_col))) == F.array(*[F.lit(n) for n in names])
    good = keys & F.col("judged.priority_score").between(0, 100) & F.col("judged.review_recommendation").isin(list(recommendations)) & allowed("evidence_for") & allowed("evidence_against")
    good = good & F.col("judged.unknowns").isNotNull() & F.col("judged.additional_checks").isNotNull()
    return df.withColumn("judged", parsed).withColumn("valid", F.coalesce(good, F.lit(False)))


def apply_scale(df: DataFrame, stats: DataFrame, on: Sequence[str], value: str, kind: str = "robust") -> DataFrame:
    """Long rows scaled by their (target, feature) statistics; a scale of 1e-12 or less counts as 1.

    ``stats`` has the keys ``on`` and median, iqr (robust) or mean, std (standard). A row without statistics is null.
    """
    center, spread = ("median", "iqr") if kind == "robust" else ("mean", "std")
    s = stats.select(*on, F.col(center).alias("_center"), F.when(F.col(spread) > 1e-12, F.col(spread)).otherwise(F.lit(1.0)).alias("_spread"))
    return df.join(s, list(on), "left").withColumn("scaled", (F.col(value) - F.col("_center")) / F.col("_spread")).drop("_center", "_spread")


def perturb_arms(df: DataFrame, feature: str, factors: Sequence[float]) -> DataFrame:
    """Every row once for each factor (``arm``), with that feature alone multiplied. The factors are a literal list."""
    return df.withColumn("arm", F.explode(F.array(*[F.lit(float(f)) for f in factors]))).withColumn(feature, F.col(feature) * F.col("arm"))


def score_linear(df: DataFrame, coefs: Mapping[str, tuple[float, float, float]], intercept: float, name: str = "score") -> DataFrame:
    """Logistic score of scaled features, feature -> (mean, std, weight), as a plain expression."""
    z = F.lit(float(intercept))
    for c, (mean, std, w) in coefs.items():
        z = z + (F.col(c) - F.lit(float(mean))) / F.lit(float(std)) * F.lit(float(w))
    return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
