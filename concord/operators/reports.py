"""Coefficients and fit values from collections of sectioned text reports.

A report is one row (source, text). What a line means depends on headings above it, and
all of them are in the same row, so extraction is map-only: texts are cut at their
headings and only the coefficient rows leave the scan. Nothing is shuffled until
results are compared or de-duplicated.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.recode import stars, stars_ns

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
# Lines that start or end a section, open a block, or close one.
SECTION_CUT = r"(?m)^(?=[^\n]*Standardization[ \t\r]*$|[ \t]*R-SQUARE|[ \t]*CONFIDENCE INTERVALS)"
OPENER = r"^[ \t]*([A-Z][A-Z0-9_]*)[ \t]+(ON|WITH|BY)[ \t\r]*$"
BLOCK_CUT = (
    r"(?m)^(?=[ \t]*[A-Z][A-Z0-9_]*[ \t]+(?:ON|WITH|BY)[ \t\r]*$"
    r"|[ \t]*(?:Thresholds|Intercepts|Means|Variances|Residual|Scales)\b|[ \t\r]*$)"
)


def report_lines(reports: DataFrame) -> DataFrame:
    """(source, line_no, line) from (source, text)."""
    return reports.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def _first_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))


def extract_coefficients(reports: DataFrame, max_z: float = 900.0) -> DataFrame:
    """(source, section, relation, factor, name, estimate, se, z_ratio, p_value, block_no, line_no).

    Inside the first ``<S> Standardization`` section of each kind, ``F ON|WITH|BY`` opens a
    block; a blank line or another heading closes it. Rows with |z| >= ``max_z`` are dropped.
    """
    segments = F.filter(F.split("text", SECTION_CUT), lambda t: _first_line(t).rlike(r"^\S+ Standardization$"))
    named = F.transform(segments, lambda t: F.struct(F.substring_index(_first_line(t), " ", 1).alias("section"), t.alias("body")))
    names = F.transform(named, lambda t: t["section"])
    first = F.filter(named, lambda t, i: F.array_position(names, t["section"]) == i + 1)
    sections = reports.select("source", F.inline(first))
    blocks = F.filter(F.split("body", BLOCK_CUT), lambda t: _first_line(t).rlike(OPENER))
    pieces = sections.select("source", "section", F.posexplode(blocks).alias("block_no", "block"))
    head = _first_line(F.col("block"))
    lines = pieces.select(
        "source", "section", "block_no", F.regexp_extract(head, OPENER, 2).alias("relation"), F.regexp_extract(head, OPENER, 1).alias("factor"),
        F.posexplode(F.split("block", r"\r?\n")).alias("line_no", "line"),
    ).withColumn("t", F.split(F.trim("line"), r"\s+")).filter(F.size("t") == 5)
    number = lambda i: F.col("t")[i].try_cast("double")
    rows = lines.select(
        "source", "section", "relation", "factor", F.col("t")[0].alias("name"), number(1).alias("estimate"), number(2).alias("se"),
        number(3).alias("z_ratio"), number(4).alias("p_value"), "block_no", "line_no",
    )
    return rows.dropna(subset=["estimate", "se", "z_ratio", "p_value"]).filter(F.abs("z_ratio") < max_z)


def predictor_effects(coefficients: DataFrame, files: DataFrame, predictors: DataFrame, factors: dict[str, Sequence[str]]) -> DataFrame:
    """Effects of known predictors on known factors, one row per key, with stars.

    ``files`` is (source, subfolder, model), ``predictors`` (subfolder, predictor, label);
    ``factors`` lists the factors of each model.
    """
    allowed = coefficients.sparkSession.createDataFrame(
        [(m, f) for m, names in factors.items() for f in names], "model string, factor string"
    )
    rows = (
        coefficients.filter("relation = 'ON'").join(files, "source").join(allowed, ["model", "factor"])
        .join(predictors.select("subfolder", F.col("predictor").alias("name"), "label"), ["subfolder", "name"])
        .withColumnsRenamed({"name": "predictor", "section": "standardization"})
    )
    keys = ["subfolder", "model", "factor", "predictor", "standardization"]
    kept = ["label", "estimate", "se", "z_ratio", "p_value"]
    return (
        rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct("source", "block_no", "line_no")).alias("r"))
        .select(*keys, "r.*").withColumn("sig", stars("p_value"))
    )


def grab_values(reports: DataFrame, specs: Sequence[tuple[str, str, str]], window: int = 8) -> DataFrame:
    """(source, <name>...): the first number after ``key`` within ``window`` lines from an anchor.

    ``specs`` is (name, anchor text, key regex). Lazy repetition makes the pattern stop at the
    nearest key below the anchor, and try the next anchor when the window holds none.
    """
    reach = rf"(?:[^\n]*\n){{0,{window - 1}}}?[^\n]*?"
    return reports.select(
        "source",
        *[
            F.nullif(F.regexp_extract("text", rf"{re.escape(a)}{reach}(?:{k})[ \t]+({NUMBER})", 1), F.lit("")).cast("double").alias(n)
            for n, a, k in specs
        ],
    )


# Fit indices and where the reports print them.
FIT_SPECS = (
    ("chi_square", "Chi-Square Test of Model Fit", "Value"),
    ("df", "Chi-Square Test of Model Fit", "Degrees of Freedom"),
    ("chi_p", "Chi-Square Test of Model Fit", "P-Value"),
    ("rmsea", "RMSEA (Root", "Estimate"),
    ("rmsea_ci_low", "RMSEA (Root", r"90 Percent C\.I\."),
    ("rmsea_ci_high", "RMSEA (Root", r"90 Percent C\.I\.\s+[0-9.]+"),
    ("cfi", "CFI/TLI", "CFI"),
    ("tli", "CFI/TLI", "TLI"),
    ("srmr", "SRMR (Standardized", "Value"),
)
# Headings of the difference test in the report formats, and the names of its values.
DIFFERENCE_HEADINGS = ("Chi-Square Test for Difference Testing", "Chi-square Difference Test", "DIFFTEST")
DIFFERENCE_VALUES = (("chi2_diff", "Value"), ("df", r"Degrees\s+of\s+Freedom|DF"), ("p_value", r"P-Value|P"))


def fit_indices(reports: DataFrame) -> DataFrame:
    return grab_values(reports, FIT_SPECS)


def difference_tests(reports: DataFrame, contrasts: DataFrame) -> DataFrame:
    """(predictor, constraint, chi2_diff, df, p_value, sig, significant) per planned contrast.

    ``contrasts`` is (predictor, constraint, source); a missing report leaves nulls. Values are
    read in either case below any of the headings, one a line or as a table whose names stand
    in one row and whose values follow in the next; all three are found or none counts.
    """
    names = [n for n, _ in DIFFERENCE_VALUES]
    heading = "(?is)(?:" + "|".join(re.escape(h) for h in DIFFERENCE_HEADINGS) + ")"
    within = F.regexp_extract("text", heading + r"((?:[^\n]*\n?){0,15})", 1)
    listed = [F.nullif(F.regexp_extract("part", rf"(?i)(?:^|\n|[ \t])(?:{k})[ \t*:=]+({NUMBER})", 1), F.lit("")).cast("double").alias(n) for n, k in DIFFERENCE_VALUES]
    header = r"[ \t]+".join(f"(?:{k})" for _, k in DIFFERENCE_VALUES)
    row = r"[ \t*]+".join(f"({NUMBER})" for _ in names)
    tabled = [F.nullif(F.regexp_extract("part", rf"(?i){header}[ \t]*\n\s*{row}", 1 + i), F.lit("")).cast("double").alias(f"t_{n}") for i, n in enumerate(names)]
    found = reports.select("source", within.alias("part")).select("source", *listed, *tabled)
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull()
    values = found.select("source", *[F.when(full, F.col(n)).otherwise(F.col(f"t_{n}")).alias(n) for n in names])
    return contrasts.join(values, "source", "left").select(
        "predictor", "constraint", "chi2_diff", F.col("df").cast("int").alias("df"), "p_value",
        stars_ns("p_value").alias("sig"), F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
    )


def summary_statistics(reports: DataFrame) -> DataFrame:
    """(source, variable, mean, min_val, min_pct, max_val, max_pct, looks_binary).

    A variable takes two lines; the block starts where ``Variable/`` is followed by
    ``Sample Size`` and ends at the next heading, a line of capital words only.
    """
    # bound to names, each text is composed once and each line split once; columns would be computed again wherever they are
    # read, and a filter on the text would move below the exchange that deals the reports out
    heading = r"\n(?=[ \t]*[A-Z][A-Z]+(?:[ \t]+[A-Z/&-]+)+[ \t\r]*(?:\n|\z))"
    block = lambda t: F.split(F.substr(t, F.locate("Variable/", t)), heading, 2)[0]
    words = lambda t: F.transform(F.split(block(t), r"\r?\n"), lambda line: F.split(F.trim(line), r"\s+"))
    two = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    long = lambda p: (F.size(p["u"]) >= 5) & (F.size(p["v"]) >= 5)
    held = F.filter(F.array("text"), lambda t: t.rlike(r"Variable/[^\n]*\n[^\n]*Sample Size"))
    pairs = F.flatten(F.transform(F.transform(held, words), lambda w: F.filter(two(w), long)))
    tokens = reports.select("source", F.inline(pairs))
    num = lambda c, i: F.translate(F.col(c)[i], "%", "").try_cast("double")
    rows = tokens.filter(F.col("u")[0].try_cast("double").isNull()).select(
        "source", F.upper(F.col("u")[0]).alias("variable"), num("u", 1).alias("mean"), num("u", 3).alias("min_val"),
        num("u", 4).alias("min_pct"), num("v", 3).alias("max_val"), num("v", 4).alias("max_pct"),
    ).dropna()
    binary = (F.abs("min_val") < 0.01) & (F.abs(F.col("max_val") - 1) < 0.01) & (F.col("min_pct") + F.col("max_pct") > 90)
    return rows.withColumn("looks_binary", binary)
