"""Field rules (VAL-1), keys and orphans (VAL-2/3), parse errors (VAL-7)."""

from riskmart.operators import validation as V

RULES = [("age", None, 0, 100), ("gender", None, None, None),
         ("time_in_hospital", 1, 1, None), ("race", "Unknown", None, None)]


def test_validate_split_and_defaults(spark):
    df = spark.createDataFrame(
        [(1, "45", "Female", "3"), (2, "140", "Male", None), (3, None, "Male", "0"),
         (4, "x", None, "2")],
        "id long, age string, gender string, time_in_hospital string")
    valid, bad = V.validate(df, "id", RULES)
    v = {r["id"]: r for r in valid.collect()}
    assert set(v) == {1}
    # absent optional column takes its default; defaulted numbers are parsed
    assert v[1]["race"] == "Unknown" and v[1]["time_in_hospital"] == 3.0
    errs = {r["id"]: sorted(r["errors"]) for r in bad.collect()}
    assert errs[2] == ["age: above 100"]
    assert errs[3] == ["age: required", "time_in_hospital: below 1"]
    assert errs[4] == ["age: not a number", "gender: required"]


def test_integrity_report(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "pid long")
    child = spark.createDataFrame([(10, 1), (11, 3)], "cid long, pid long")
    out = {(r["table_name"], r["check"]): r["violations"] for r in V.integrity_report(
        {"p": parent, "c": child}, {"p": ["pid"]}, [("c", "pid", "p", "pid")]).collect()}
    assert out == {("p", "duplicate_key"): 1, ("p", "null_key"): 1, ("c", "orphan_pid"): 1}


def test_parse_errors(spark):
    df = spark.createDataFrame([("1", "2.5"), ("abc", None)], "a string, b string")
    rows = V.parse_errors(df, ["a", "b"]).collect()
    assert [(r["a_num"], r["b_num"], r["error"]) for r in rows] == [(1.0, 2.5, ""), (None, None, "a")]
