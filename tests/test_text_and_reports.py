import pytest
from pyspark.sql import functions as F

from concord.functions import recode, text
from concord.operators import checks, reports
from concord.sources import documents

SHEET = """Cover page\r\nItem 3 – Looks  for “toy”
Material : a bell
and a cloth

Hide the bell.
Wait.

2 points : finds it
at once
0 points: does not look
Item 12  Claps
Material: none

Scoring:
- claps
• waves
"""


def test_items_from_a_sheet(spark):
    rows = text.parse_items(spark.createDataFrame([("d", SHEET)], "doc string, text string")).orderBy("number").collect()
    first, second = rows
    assert (first["item_id"], first["title"], first["materials"], first["description"]) == ("COG_003", 'Looks for "toy"', "a bell and a cloth", "Hide the bell. Wait.")
    assert [(e["points"], e["criteria"]) for e in first["scoring"]] == [(2, "finds it at once"), (0, "does not look")]
    assert first["item_text"] == 'Looks for "toy". Materials: a bell and a cloth. Description: Hide the bell. Wait.. Scoring: [2 pt] finds it at once [0 pt] does not look'
    assert (second["item_id"], second["title"], second["description"]) == ("COG_012", "Claps", "")
    assert [(e["points"], e["criteria"]) for e in second["scoring"]] == [(None, "claps"), (None, "waves")]
    assert second["item_text"] == "Claps. Materials: none. Scoring: claps waves"


def test_encoding_is_only_touched_where_it_is_broken(spark):
    broken = "it’s".encode("utf-8").decode("latin-1")
    df = spark.createDataFrame([(1, broken), (2, "déjà vu"), (3, "plain")], "id int, t string")
    got = {r["id"]: r["t"] for r in df.select("id", text.repair_text(F.col("t")).alias("t")).collect()}
    assert got == {1: "it's", 2: "déjà vu", 3: "plain"}


def test_labels(spark):
    answers = [(" ATT ", "attention"), ("ATT, WM", "attention"), ("HOP with GDPS as first stage", "higher_order_processing"), ("Flexibility / Shift (FS)", "flexibility_shift"),
               ("Higher-order processes", "higher_order_processing"), ("Some new-label", "some_new_label"), ("", None), (None, None), ("working memory", "working_memory")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "id int, a string")
    got = {r["id"]: r["p"] for r in df.select("id", recode.primary_label("a").alias("p")).collect()}
    assert [got[i] for i in range(len(answers))] == [want for _, want in answers]


def test_recodes(spark):
    df = spark.createDataFrame([(1, "-999", 35.0), (2, "12.5", 38.0), (3, "abc", None), (4, None, 30.0), (5, "999", 36.0), (6, "NaN", 37.0)], "id int, v string, w double")
    out = {r["id"]: r for r in df.select("id", recode.to_num("v").alias("v"), recode.corrected_age(F.lit(10.0), "w").alias("age"), recode.corrected_age(F.lit(1.0), "w", True).alias("zero")).collect()}
    assert [out[i]["v"] for i in range(1, 7)] == [None, 12.5, None, None, None, None]
    assert out[1]["age"] == pytest.approx(10 - 5 / 4.3482) and out[2]["age"] == 10.0 and out[3]["age"] == 10.0
    assert out[4]["zero"] == 0.0
    assert [r[0] for r in spark.range(1).select(recode.parse_id(F.lit("COG_034"))).collect()] == [34]


REPORT = """MODEL RESULTS
 WM       ON
    AGE                0.900      0.100      9.000      0.000

STDYX Standardization

                    Estimate       S.E.  Est./S.E.    P-Value
 WM       BY
    COG35              0.700      0.050     14.000      0.000
    COG36              0.650      0.050     13.000      0.000

 WM       ON
    AGE                0.310      0.100      3.100      0.002
    SEX               -0.100      0.100     -1.000      0.317
    FIXED              1.000      0.000    999.000    999.000

 FS       WITH
    WM                 0.800      0.060     13.333      0.000

 Thresholds
    COG35$1            0.200      0.100      2.000      0.045

STDY Standardization
 WM       ON
    SEX               -0.210      0.105     -2.000      0.046

R-SQUARE
 WM       ON
    AGE                0.111      0.100      1.110      0.267

Chi-Square Test of Model Fit
          Value                            120.500*
          Degrees of Freedom                    99
          P-Value                           0.0700

RMSEA (Root Mean Square Error Of Approximation)
          Estimate                           0.031
          90 Percent C.I.                    0.010  0.047

Chi-Square Test for Difference Testing

          Value                              4.100*
          Degrees of Freedom                     1
          P-Value                           0.0429

     Variable/         Mean/     Skewness/   Minimum/ % with                Percentiles
    Sample Size      Variance    Kurtosis    Maximum  Min/Max      20%/60%    40%/80%    Median

     SEX                   0.540      -0.160       0.000   46.00%       0.000      1.000      1.000
             739.000       0.248      -1.974       1.000   54.00%       1.000      1.000
     AGE                  18.900       1.160      17.000    0.14%      18.000     18.500     18.700
             739.000       1.248       4.974      24.000    0.27%      19.000     19.400
"""


@pytest.fixture
def report_folder(tmp_path):
    for folder, name, body in (
        ("age", "model_3f.out", REPORT), ("age", "model_UNIDIM.out", REPORT.replace("WM ", "COG").replace("0.310", "0.320")),
        ("age", "constraint_wm.out", REPORT), ("sex", "notes.txt", "not a report"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    return str(tmp_path)


def test_reports_end_to_end(spark, report_folder):
    files = documents.read_reports(spark, report_folder)
    assert {(r["subfolder"], r["file_name"], r["model"]) for r in files.collect()} == {
        ("age", "model_3f.out", "3F"), ("age", "model_UNIDIM.out", "UNIDIM"), ("age", "constraint_wm.out", "CONSTRAINT")}
    coef = reports.extract_coefficients(files)
    one = [r for r in coef.collect() if r["source"].endswith("model_3f.out")]
    assert {(r["section"], r["relation"], r["factor"], r["name"], r["estimate"]) for r in one} == {
        ("STDYX", "BY", "WM", "COG35", 0.7), ("STDYX", "BY", "WM", "COG36", 0.65), ("STDYX", "ON", "WM", "AGE", 0.31), ("STDYX", "ON", "WM", "SEX", -0.1),
        ("STDYX", "WITH", "FS", "WM", 0.8), ("STDY", "ON", "WM", "SEX", -0.21)}
    predictors = spark.createDataFrame([("age", "AGE", "Age"), ("age", "SEX", "Sex")], "subfolder string, predictor string, label string")
    effects = reports.predictor_effects(coef, files.select("source", "subfolder", "model"), predictors, {"3F": ["WM", "FS"], "UNIDIM": ["COG"]})
    got = {(r["model"], r["predictor"], r["standardization"]): (r["estimate"], r["sig"]) for r in effects.collect()}
    assert got[("3F", "AGE", "STDYX")] == (0.31, "**") and got[("3F", "SEX", "STDY")] == (-0.21, "*") and got[("UNIDIM", "AGE", "STDYX")][0] == 0.32
    kept = {(r["predictor"], r["standardization"]) for r in recode.pick_estimate(effects, ["SEX"]).collect()}
    assert kept == {("AGE", "STDYX"), ("SEX", "STDY")}
    fit = reports.fit_indices(files).filter("source like '%model_3f.out'").first()
    assert (fit["chi_square"], fit["df"], fit["chi_p"], fit["rmsea"], fit["rmsea_ci_low"], fit["rmsea_ci_high"], fit["cfi"]) == (120.5, 99.0, 0.07, 0.031, 0.010, 0.047, None)
    source = files.filter("model = 'CONSTRAINT'").first()["source"]
    planned = spark.createDataFrame([("AGE", "wm", source), ("AGE", "fs", "gone")], "predictor string, constraint string, source string")
    tests = {r["constraint"]: r for r in reports.difference_tests(files, planned).collect()}
    assert (tests["wm"]["chi2_diff"], tests["wm"]["df"], tests["wm"]["sig"], tests["wm"]["significant"]) == (4.1, 1, "*", True)
    assert (tests["fs"]["chi2_diff"], tests["fs"]["sig"], tests["fs"]["significant"]) == (None, "—", False)
    stats = {r["variable"]: r for r in reports.summary_statistics(files).filter("source like '%model_3f.out'").collect()}
    assert stats["SEX"]["looks_binary"] and not stats["AGE"]["looks_binary"]
    assert (stats["AGE"]["mean"], stats["AGE"]["min_val"], stats["AGE"]["min_pct"], stats["AGE"]["max_val"], stats["AGE"]["max_pct"]) == (18.9, 17.0, 0.14, 24.0, 0.27)
    wrong = checks.variable_kind_check(reports.summary_statistics(files).filter("source like '%model_3f.out'"), ["AGE"], ["SEX"]).collect()
    assert {r["variable"] for r in wrong} == {"AGE", "SEX"}
    parsed = effects.select("subfolder", "model", "factor", "predictor", "standardization", "estimate", "p_value")
    table = spark.createDataFrame([("age", "3F", "WM", "AGE", "STDYX", 0.3105, 0.002), ("age", "3F", "WM", "SEX", "STDY", -0.5, 0.046), ("age", "3F", "FS", "AGE", "STDYX", 0.1, 0.1), ("iq", "3F", "WM", "AGE", "STDYX", 0.1, 0.1)], parsed.schema)
    keys = ["subfolder", "model", "factor", "predictor", "standardization"]
    status = {(r["subfolder"], r["factor"], r["predictor"], r["model"], r["standardization"]): r["status"] for r in checks.crosscheck(table, parsed, keys, ["estimate", "p_value"], 0.002, files, ["subfolder", "model"]).collect()}
    assert status[("age", "WM", "AGE", "3F", "STDYX")] == "ok" and status[("age", "WM", "SEX", "3F", "STDY")] == "mismatch"
    assert status[("age", "FS", "AGE", "3F", "STDYX")] == "not_found" and status[("iq", "WM", "AGE", "3F", "STDYX")] == "missing_file"
    assert status[("age", "COG", "AGE", "UNIDIM", "STDYX")] == "unlisted"


def test_summary_lines_are_split_once_where_reports_are_dealt(spark):
    text = "x\nVariable/ a b c\nSample Size d\n sex 0.5 0.1 0.0 60.0%\n 739.0 0.25 -1.9 1.0 40.0%\n AGE 18.9 0.1 17 0.14%\n 739 3 -1 24 0.27%\n\nNEXT HEADING\n LATE 1 2 3 4\n 1 2 3 4 5\n"
    df = spark.createDataFrame([("a", text), ("b", text.replace("Sample Size", "Size")), ("c", None), ("d", "")], "source string, text string")
    out = reports.summary_statistics(df.repartition(2, "source").withColumn("text", F.concat("text", F.lit("\n"))))
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [("a", "AGE", 18.9, 17.0, 0.14, 24.0, 0.27, False), ("a", "SEX", 0.5, 0.0, 60.0, 1.0, 40.0, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # heading, lines and words once each; no filter on the composed text below the exchange
    assert plan.count("split(") == 3 and not [x for x in plan.splitlines() if "Filter" in x and "Sample" in x]


def test_value_must_lie_inside_the_window(spark):
    body = ["Value 1", "ANCHOR", "x", "Value 2.5", "ANCHOR", "y", "z", "w", "Value 9"]
    df = spark.createDataFrame([("r", "\n".join(body)), ("late", "\n".join(body[4:])), ("second", "ANCHOR\na\nb\nc\nANCHOR Value 7\n")], "source string, text string")
    got = {r["source"]: r["v"] for r in reports.grab_values(df, [("v", "ANCHOR", "Value")], window=3).collect()}
    assert got == {"r": 2.5, "late": None, "second": 7.0}


def test_long_reports_do_not_exhaust_the_stack(spark):
    rows = "\n".join(f"    P{i}  0.5  0.1  5.0  0.01" for i in range(20_000))
    text = f"STDYX Standardization\n WM  ON\n{rows}\n\nR-SQUARE\nChi-Square Test of Model Fit\n Value 3.5\n"
    df = spark.createDataFrame([("r", text)], "source string, text string")
    assert reports.extract_coefficients(df).count() == 20_000
    assert reports.fit_indices(df).first()["chi_square"] == 3.5


def test_table_diff_states(spark):
    ref = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None), (5, 5.0, "e"), (5, 5.0, "e")], "k int, x double, s string")
    cur = spark.createDataFrame([(1, 1.0 + 1e-12, "a"), (2, 2.1, "b"), (4, 4.0, "d"), (3, 3.0, "c"), (5, 5.0, "e")], "k int, x double, s string")
    got = {(r["k"], r["column"]): r["status"] for r in checks.diff_tables(ref, cur, ["k"]).collect()}
    assert got == {(2, "x"): "differs", (3, "s"): "differs", (4, "x"): "extra", (4, "s"): "extra", (5, "x"): "duplicate", (5, "s"): "duplicate"}
    assert checks.check_columns(ref, ["k", "x", "s"]) == [] and checks.check_columns(ref, ["k", "s", "x"]) == ["order differs"]
    assert checks.check_columns(ref, ["k", "y"]) == ["3 columns, 2 names", "missing y", "unexpected x", "unexpected s"]
