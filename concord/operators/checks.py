"""Table against table: cell differences, expectations, integrity of extracted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_tables(ref: DataFrame, cur: DataFrame, keys: Sequence[str], atol: float = 1e-9, ignore: Sequence[str] = ()) -> DataFrame:
    """(keys, column, ref, cur, status) for every cell that differs, is missing or is new.

    Numeric cells match within ``atol``, others exactly; a repeated key on either side is
    reported as ``duplicate``.
    """
    cols = [c for c in ref.columns if c not in keys and c not in ignore]
    if set(cols) != {c for c in cur.columns if c not in keys and c not in ignore}:
        raise ValueError("tables have different columns")
    numeric = {f.name for f in ref.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")}

    def side(t: DataFrame, name: str) -> DataFrame:
        packed = t.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.first(F.struct(*cols)).alias(name))
        return packed

    both = side(ref, "r").join(side(cur, "c"), list(keys), "full")
    entries = []
    for c in cols:
        x, y = F.col(f"r.{c}"), F.col(f"c.{c}")
        same = x.eqNullSafe(y)
        if c in numeric:
            same = same | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= atol, F.lit(False))
        entries.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("ref"), y.cast("string").alias("cur"), same.alias("same")))
    status = (
        F.when((F.col("r_n") > 1) | (F.col("c_n") > 1), "duplicate").when(F.col("c_n").isNull(), "missing")
        .when(F.col("r_n").isNull(), "extra").otherwise("differs")
    )
    return (
        both.withColumn("status", status).withColumn("e", F.explode(F.array(*entries)))
        .filter((F.col("status") != "differs") | ~F.col("e.same"))
        .select(*keys, "e.column", "e.ref", "e.cur", "status")
    )


def expectations(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(section, label, expected, observed, tol, ok, source): published values against observed."""
    out = expected.join(observed.select("section", "label", F.col("value").alias("observed")), ["section", "label"], "left")
    return out.select(
        "section", "label", "expected", "observed", "tol",
        F.coalesce(F.abs(F.col("expected") - F.col("observed")) <= F.col("tol"), F.lit(False)).alias("ok"), "source",
    )


def crosscheck(
    table: DataFrame, parsed: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float,
    reports: DataFrame | None = None, report_keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, status): ok, mismatch, not_found, missing_file or unlisted.

    ``reports`` lists the report files that exist; without a file for its keys a table row
    is ``missing_file`` rather than ``not_found``.
    """
    left = table.select(*keys, F.struct(*values).alias("t"))
    right = parsed.select(*keys, F.struct(*values).alias("p"))
    out = left.join(right, list(keys), "full")
    close: Column = F.lit(True)
    for v in values:
        close = close & F.coalesce(F.abs(F.col(f"t.{v}") - F.col(f"p.{v}")) <= tol, F.col(f"t.{v}").eqNullSafe(F.col(f"p.{v}")))
    if reports is None:
        out = out.withColumn("has_file", F.lit(True))
    else:
        known = reports.select(*report_keys).distinct().withColumn("has_file", F.lit(True))
        out = out.join(known, list(report_keys), "left")
    return out.select(
        *keys,
        F.when(F.col("t").isNull(), "unlisted").when(F.col("has_file").isNull(), "missing_file")
        .when(F.col("p").isNull(), "not_found").when(close, "ok").otherwise("mismatch").alias("status"),
    )


def variable_kind_check(profile: DataFrame, binary_predictors: Sequence[str], continuous_predictors: Sequence[str]) -> DataFrame:
    """Predictors whose summary statistics contradict their declared kind."""
    binary, continuous = F.col("variable").isin(*binary_predictors), F.col("variable").isin(*continuous_predictors)
    return profile.filter((binary & ~F.col("looks_binary")) | (continuous & F.col("looks_binary"))).withColumn(
        "status", F.lit("wrong_variable_kind")
    )


def check_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Problems of the column list: wrong count, missing, unexpected or misplaced names."""
    problems = []
    if len(df.columns) != len(names):
        problems.append(f"{len(df.columns)} columns, {len(names)} names")
    problems += [f"missing {n}" for n in names if n not in df.columns]
    problems += [f"unexpected {c}" for c in df.columns if c not in names]
    if not problems and list(names) != df.columns:
        problems.append("order differs")
    return problems


def sentinel_profile(df: DataFrame, cols: Sequence[str], sentinel: float = -999.0) -> DataFrame:
    """(variable, n, n_sentinel, min, max, mean) without the sentinel, one aggregate."""
    rows = []
    for c in cols:
        v = F.col(c).cast("double")
        real = F.when(v != sentinel, v)
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.count(real).alias("n"), F.count_if(v == sentinel).alias("n_sentinel"),
            F.min(real).alias("min"), F.max(real).alias("max"), F.avg(real).alias("mean"),
        ))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def column_agreement(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """(variable, n_a, n_b, null_conflicts, max_diff, ok) of columns two pipelines derived."""
    both = a.select(key, F.struct(*cols).alias("x")).join(b.select(key, F.struct(*cols).alias("y")), key)
    rows = []
    for c in cols:
        x, y = F.col(f"x.{c}").cast("double"), F.col(f"y.{c}").cast("double")
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.count(x).alias("n_a"), F.count(y).alias("n_b"),
            F.count_if(x.isNull() != y.isNull()).alias("null_conflicts"), F.max(F.abs(x - y)).alias("max_diff"),
        ))
    ok = (F.col("n_a") == F.col("n_b")) & (F.col("null_conflicts") == 0) & (F.coalesce("max_diff", F.lit(0.0)) < tol)
    return both.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).withColumn("ok", ok)


def key_report(df: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """(check, n): rows, distinct keys, repeated keys, and keys on only one side.

    Keys are counted once per side in the same aggregate, so one shuffle answers all.
    """
    sides = df.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        reference.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    ).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    checks = {
        "rows": F.sum("a"), "distinct_keys": F.count_if(F.col("a") > 0), "repeated_keys": F.count_if(F.col("a") > 1),
        "not_in_reference": F.count_if((F.col("a") > 0) & (F.col("b") == 0)),
        "missing_from_table": F.count_if((F.col("a") == 0) & (F.col("b") > 0)),
    }
    rows = [F.struct(F.lit(k).alias("check"), v.cast("long").alias("n")) for k, v in checks.items()]
    return sides.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def sizes_match(spec: DataFrame, table: DataFrame) -> DataFrame:
    """(label, in_spec, in_table, ok): group sizes of a spec and of the assignment table."""
    a = spec.groupBy("label").agg(F.count(F.lit(1)).alias("in_spec"))
    b = table.groupBy("label").agg(F.count(F.lit(1)).alias("in_table"))
    return a.join(b, "label", "full").na.fill(0, ["in_spec", "in_table"]).withColumn("ok", F.col("in_spec") == F.col("in_table"))
