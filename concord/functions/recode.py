"""Recodes of survey and clinical columns, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Missing-data codes of the instrument files.
SENTINELS = (-999.0, -998.0, 999.0)

# Domain abbreviations, display names and spelling variants.
DOMAIN_ABBREVIATIONS = {
    "att": "attention",
    "wm": "working_memory",
    "gdps": "goal_directed_problem_solving",
    "fs": "flexibility_shift",
    "hop": "higher_order_processing",
}
DOMAIN_DISPLAY_NAMES = {
    "attention (att)": "attention",
    "working memory (wm)": "working_memory",
    "goal-directed problem solving (gdps)": "goal_directed_problem_solving",
    "flexibility / shift (fs)": "flexibility_shift",
    "flexibility/shift (fs)": "flexibility_shift",
    "higher-order processing (hop)": "higher_order_processing",
    "higher order processing (hop)": "higher_order_processing",
}
DOMAIN_VARIANTS = {"higher_order_processes": "higher_order_processing"}

# Fixed value: mean weeks per month used for the age correction.
WEEKS_PER_MONTH = 4.3482


def to_num(col: Column | str, sentinels: Sequence[float] = SENTINELS) -> Column:
    """DOUBLE value; uncastable text, NaN and sentinel codes become null."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value) & ~value.isin(*[float(s) for s in sentinels]), value)


def first_known(*cols: Column | str) -> Column:
    """Primary value, else the next one."""
    return F.coalesce(*cols)


def recode(col: Column | str, mapping: Mapping[int, int]) -> Column:
    """Listed codes take their new value, every other code is null."""
    source = F.col(col) if isinstance(col, str) else col
    out = None
    for code, value in mapping.items():
        out = F.when(source == code, F.lit(value)) if out is None else out.when(source == code, F.lit(value))
    return out


def dummies(
    df: DataFrame, col: str, groups: Mapping[str, Sequence[int]], null_codes: Sequence[int] = ()
) -> DataFrame:
    """0/1 columns per group of codes; the reference level is whatever no group lists.

    A null, or one of ``null_codes``, makes all of them null.
    """
    source = F.col(col)
    known = source.isNotNull() & ~source.isin(*null_codes) if null_codes else source.isNotNull()
    return df.withColumns(
        {name: F.when(known, source.isin(*codes).cast("int")) for name, codes in groups.items()}
    )


def outliers_to_null(df: DataFrame, cols: Sequence[str], width: float = 4.0) -> DataFrame:
    """Values farther than ``width`` sample standard deviations from the mean become null.

    All columns share one aggregate, read back as a scalar subquery.
    """
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols]).alias("stats")
    ).scalar()
    return df.withColumn("_stats", stats).withColumns(
        {
            c: F.when(
                ~F.coalesce(F.abs(F.col(c) - F.col(f"_stats.{c}.m")) > width * F.col(f"_stats.{c}.s"), F.lit(False)),
                F.col(c),
            )
            for c in cols
        }
    ).drop("_stats")


def keep_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with at least one non-null among ``cols``."""
    return df.dropna(how="all", subset=list(cols))


def format_id(number: Column | str, prefix: str = "COG_", width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", F.col(number) if isinstance(number, str) else number)


def parse_id(item_id: Column | str) -> Column:
    """Trailing digits as INT, null without any."""
    return F.regexp_extract(item_id, r"(\d+)$", 1).try_cast("int")


def in_range(col: Column | str, low: int, high: int) -> Column:
    return (F.col(col) if isinstance(col, str) else col).between(low, high)


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.try_element_at(table, key)


def canonical_label(
    raw: Column | str,
    abbreviations: Mapping[str, str] = DOMAIN_ABBREVIATIONS,
    display_names: Mapping[str, str] = DOMAIN_DISPLAY_NAMES,
    variants: Mapping[str, str] = DOMAIN_VARIANTS,
) -> Column:
    """Snake-case label: display name, else abbreviation, else folded text; blank is null."""
    text = F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw))
    bare = F.regexp_replace(text, r"[\s()/\-]+", "")
    snake = F.regexp_replace(text, r"[\s\-]+", "_")
    return F.when(
        F.length(text) > 0,
        F.coalesce(_lookup(display_names, text), _lookup(abbreviations, bare), _lookup(variants, snake), snake),
    )


def primary_label(raw: Column | str, abbreviations: Mapping[str, str] = DOMAIN_ABBREVIATIONS, **names) -> Column:
    """First recognised abbreviation in a free-text answer, else the canonical label."""
    source = F.col(raw) if isinstance(raw, str) else raw
    words = F.regexp_extract_all(F.lower(source), F.lit("[a-z]+"), F.lit(0))
    known = F.filter(words, lambda w: w.isin(*abbreviations))
    return F.coalesce(_lookup(abbreviations, F.get(known, F.lit(0))), canonical_label(source, abbreviations, **names))


def stars(p: Column | str) -> Column:
    """``***`` below .001, ``**`` .01, ``*`` .05, dagger below .10, else empty."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "†").when(p.isNotNull(), "")


def stars_ns(p: Column | str) -> Column:
    """As :func:`stars` with ``ns`` above .05 and a dash for a missing value."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p.isNull(), "—").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def table_round(value: Column | str, variable: Column | str, four_digits: Sequence[str]) -> Column:
    """Half-even rounding to 3 decimals, 4 for the listed variables."""
    value = F.col(value) if isinstance(value, str) else value
    variable = F.col(variable) if isinstance(variable, str) else variable
    return F.when(variable.isin(*four_digits), F.bround(value, 4)).otherwise(F.bround(value, 3))


def corrected_age(months: Column | str, weeks: Column | str, clamp: bool = False) -> Column:
    """Age less the weeks missing to 40, for births before week 37 only."""
    age = F.col(months) if isinstance(months, str) else months
    w = F.col(weeks) if isinstance(weeks, str) else weeks
    out = F.when(w < 37, age - (40 - w) / WEEKS_PER_MONTH).otherwise(age)
    return F.greatest(out, F.lit(0.0)) if clamp else out


def pick_estimate(effects: DataFrame, binary_predictors: Sequence[str]) -> DataFrame:
    """Binary predictors keep their STDY row, continuous ones their STDYX row."""
    wanted = F.when(F.col("predictor").isin(*binary_predictors), "STDY").otherwise("STDYX")
    return effects.filter(F.col("standardization") == wanted)


def floor_ceiling(responses: DataFrame, items: DataFrame, share: float = 0.90) -> DataFrame:
    """(item, n, pass_share, status) from long (item, resp 0/1); absent items are excluded.

    ``items`` is the full item list.
    """
    counted = responses.filter("resp is not null").groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("resp").cast("double")).alias("pass_share")
    )
    p = F.col("pass_share")
    status = (
        F.when(F.col("n").isNull(), "not_administered")
        .when(F.greatest(p, 1 - p) < share, "retained")
        .when(p >= 1 - p, "ceiling")
        .otherwise("floor")
    )
    return items.select("item").distinct().join(counted, "item", "left").select(
        "item", F.coalesce("n", F.lit(0)).alias("n"), "pass_share", status.alias("status")
    )


def sparse_groups(df: DataFrame, group: str, minimum: int = 3) -> DataFrame:
    """All rows with ``group_size`` and ``excluded``; group sizes come from a partial aggregate.

    Counting by aggregate and joining back, instead of a window, keeps a very large
    group from being gathered in one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return df.join(sizes, group).withColumn("excluded", F.col("group_size") < minimum)


def similarity_profile(assigned: DataFrame, excluded: DataFrame) -> DataFrame:
    """Redirected and excluded items with their similarities, ranked by margin within source."""
    cols = ["id", "final_label", "sim_uc", "best_sim", "uc_margin"]
    both = assigned.filter("redirected").select(F.lit("redirected").alias("source"), *cols).unionByName(
        excluded.select(F.lit("excluded").alias("source"), *cols)
    )
    return both.orderBy("source", F.desc_nulls_last("uc_margin"), "id")
