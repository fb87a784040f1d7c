import pytest
from pyspark.sql import functions as F

from concord.operators.describe import source_overlap
from concord.runtime import bounded_rows, fits, materialize
from concord.sources import documents, instruments, models


def write(path, text):
    path.write_text(text)
    return str(path)


def test_instrument_files(spark, tmp_path):
    a = write(tmp_path / "a.txt", "subject\tage\tnote\n\t0::1200\tfree text\ns1\t18.5\tNA\ns2\t-999\tok\ns3\t\t\"quoted\n")
    b = write(tmp_path / "b.txt", "subject\tscore\nid\t0::1\ns2\t1\ns4\t0\n")
    df = instruments.read_instrument(spark, a)
    got = {r["subject"]: r for r in instruments.numeric_columns(df, ["age"]).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert (got["s1"]["age"], got["s1"]["note"], got["s2"]["age"], got["s3"]["age"], got["s3"]["note"]) == (18.5, None, None, None, '"quoted')
    ids = instruments.scan_instruments(spark, {"a": a, "b": b}, "subject")
    overlap = {(r["kind"], r["name"]): r["n"] for r in source_overlap(ids).collect()}
    assert overlap == {("source", "a"): 3, ("source", "b"): 2, ("any", "all"): 4, ("every", "all"): 1, ("pair", "a&b"): 1}


def test_fixed_matrix_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(1, 0.5, None), (2, None, 3)], "a int, b double, c int")
    names = instruments.write_fixed_matrix(df, path)
    assert spark.read.text(f"{path}_names").count() == 3
    back = instruments.read_fixed_matrix(spark, path, names).orderBy("a").collect()
    assert [tuple(r) for r in back] == [(1.0, 0.5, None), (2.0, None, 3.0)]
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["1 0.5 -999", "2 -999 3"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(2, "b"), (1, "a,c")], "k int, s string")
    instruments.write_table(df, str(tmp_path / fmt), ["k"], fmt)
    assert [tuple(r) for r in instruments.read_table(spark, str(tmp_path / fmt), "k int, s string", fmt).orderBy("k").collect()] == [(1, "a,c"), (2, "b")]


def test_upsert_keeps_other_sections(spark, tmp_path):
    path = str(tmp_path / "metrics")
    instruments.upsert_section(spark.createDataFrame([("heat", "1"), ("flow", "2")], "section string, payload string"), path)
    instruments.upsert_section(spark.createDataFrame([("flow", "3"), ("pair", "4")], "section string, payload string"), path)
    assert {(r["section"], r["payload"]) for r in spark.read.parquet(path).collect()} == {("heat", "1"), ("flow", "3"), ("pair", "4")}


def test_factor_models(spark):
    rows = models.load_factor_model(spark, {"description": "x", "wm": ["i1", "i2"], "fs": ["i2"]}, "ref").collect()
    assert {(r["label"], r["factor_ord"], r["id"], r["ord"]) for r in rows} == {("wm", 0, "i1", 0), ("wm", 0, "i2", 1), ("fs", 1, "i2", 0)}
    items = spark.createDataFrame([("i1", 0), ("i2", 1), ("i3", 2)], "id string, ord int")
    spec = models.factor_spec(spark.createDataFrame([("i3", "b"), ("i1", "a"), ("i2", "b")], "id string, label string"), ["b", "a"], items)
    assert [tuple(r) for r in spec.orderBy("factor_key").collect()] == [("F1", "b", 2, 0, ["i2", "i3"], [2, 3]), ("F2", "a", 1, 0, ["i1"], [1])]
    split = models.factor_spec(spark.createDataFrame([("i3", "b"), ("i2", "b")], "id string, label string"), ["b"], items, part_items=2)
    assert [(r["n_items"], r["part"], r["item_ids"]) for r in split.orderBy("part").collect()] == [(2, 0, ["i2"]), (2, 1, ["i3"])]


def test_misaligned_vectors_are_an_error(spark):
    items = spark.createDataFrame([(1,), (2,)], "id int")
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, vec array<double>")
    lab = spark.createDataFrame([(1, 0), (3, 1)], "id int, label int")
    with pytest.raises(ValueError):
        models.aligned_vectors(items, vec, lab)
    assert models.aligned_vectors(items, vec, lab, check=False).count() == 1


def test_review_sheets(spark, tmp_path):
    one = write(tmp_path / "main.csv", "Legend,,\n" + "ATT = attention,,\n" * 60 + "Item ID,Title,Rater A,Rater B,Agreed\nI1,Bell,ATT,ATT,\nI2,Cup,\"WM, ATT\",FS,HOP\nzz,nothing,FS,FS,\n")
    two = write(tmp_path / "uc.csv", "Item code,Name of title,Rater B answer,Rater A answer\n,  cup ,FS,WM\nI3,Box,,GDPS\n")
    items = spark.createDataFrame([("I1", "Bell"), ("I2", "Cup"), ("I3", "Box")], "id string, title string")
    columns = {"item": ["item"], "title": ["title"], "rater1": ["rater a"], "rater2": ["rater b"], "explicit": ["agreed"]}
    got = {r["id"]: r for r in documents.read_review(spark, {"main": one, "uc": two}, items, columns).collect()}
    # an id that is not in the item list is kept
    assert set(got) == {"I1", "I2", "I3", "zz"}
    assert (got["I1"]["rater1"], got["I1"]["rater2"], got["I1"]["is_uc"]) == ("attention", "attention", False)
    assert (got["I2"]["rater1"], got["I2"]["rater2"], got["I2"]["explicit"], got["I2"]["is_uc"]) == ("working_memory", "flexibility_shift", "higher_order_processing", True)
    assert (got["I3"]["rater1"], got["I3"]["rater2"], got["I3"]["is_uc"]) == ("goal_directed_problem_solving", None, True)


def test_size_guards(spark):
    assert fits(spark.range(5), 5) and not fits(spark.range(6), 5)
    with pytest.raises(ValueError):
        bounded_rows(spark.range(6), 5, "ids")
    assert materialize(spark.range(3)).count() == 3
