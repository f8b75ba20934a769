"""Every branch and bin edge of the scalar builders."""

import pytest
from pyspark.sql import functions as F

from riskmart.functions import scalars as S


def one_col(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


CODES = [
    (None, "Other"), ("?", "Other"), ("nan", "Other"), ("Unknown", "Other"),
    ("E885", "External"), ("V58", "Supplementary"), (" V58 ", "Supplementary"),
    ("250", "Diabetes"), ("250.83", "Diabetes"), ("251", "Other"),
    ("390", "Circulatory"), ("459", "Circulatory"), ("459.5", "Other"), ("785", "Circulatory"),
    ("460", "Respiratory"), ("519", "Respiratory"), ("786", "Respiratory"),
    ("520", "Digestive"), ("579", "Digestive"), ("787", "Digestive"),
    ("800", "Injury"), ("999", "Injury"), ("710", "Musculoskeletal"), ("739", "Musculoskeletal"),
    ("580", "Genitourinary"), ("629", "Genitourinary"), ("788", "Genitourinary"),
    ("140", "Neoplasms"), ("239", "Neoplasms"), ("139", "Other"), ("780", "Other"),
    ("abc", "Other"), ("12D", "Other"), ("", "Other"),
]


def test_code_category(spark):
    got = one_col(spark, [c for c, _ in CODES], "string", S.code_category)
    assert got == [e for _, e in CODES]


def test_age_lookup_default(spark):
    got = one_col(spark, ["[0-10)", "[90-100)", "[100-110)", "[37-47)", None], "string",
                  S.age_numeric)
    assert got == [5, 95, 55, 55, 55]


@pytest.mark.parametrize("closed,expected", [
    ("right", [None, "Low", "Low", "Medium", "Medium", "High", "High", None, None]),
    ("left", ["Low", "Low", "Medium", "Medium", "High", "High", "High", "High", None]),
])
def test_risk_bands(spark, closed, expected):
    vals = [0.0, 0.1, 0.3, 0.31, 0.6, 0.61, 1.0, 1.5, None]
    if closed == "right":
        vals_expected = [None, "Low", "Low", "Medium", "Medium", "High", "High", None, None]
        assert expected == vals_expected
    got = one_col(spark, vals, "double", lambda c: S.risk_level(c, closed))
    assert got == expected


def test_age_group_edges(spark):
    got = one_col(spark, [0, 1, 20, 21, 40, 60, 61, 80, 100, 101, None], "int", S.age_group)
    assert got == [None, "0-20", "0-20", "21-40", "21-40", "41-60", "61-80", "61-80",
                   "81-100", None, None]


def test_medication_bins(spark):
    got = one_col(spark, [0, 5, 6, 10, 20, 21, 50, 100, 101], "int", S.medication_bin)
    assert got == [None, "very_low", "low", "low", "medium", "high", "high", "very_high", None]


def test_flags(spark):
    df = spark.createDataFrame([("<30", "Up", "No"), (">30", "Steady", None), (None, None, "Ch")],
                               "r string, ins string, ch string")
    out = df.select(S.readmit_flag("r"), S.member_flag("ins", ["Up", "Down"]),
                    S.not_no_flag("ins"), S.equals_flag("ch", "Ch")).collect()
    assert [tuple(r) for r in out] == [(1, 1, 1, 0), (0, 0, 1, 0), (0, 0, 1, 1)]


def test_safe_number(spark):
    got = one_col(spark, ["12", " 7 ", "3.5", "12D", "abc", None, "-2", ".5"], "string",
                  lambda c: S.safe_number(c, 0))
    assert got == [12.0, 7.0, 3.5, 0.0, 0.0, 0.0, -2.0, 0.5]


def test_scores(spark):
    df = spark.createDataFrame([(85, 2, 30, "81-100"), (5, 0, 1, "0-20"), (55, 0, 5, None)],
                               "age int, inp int, meds int, grp string")
    rows = df.select(S.heuristic_score("age", "inp", "meds").alias("h"),
                     S.fallback_score("grp", "inp", "meds").alias("f")).collect()
    # .1 + min(.425,.2) + min(.3,.3) + min(.6,.15) = .75
    assert rows[0]["h"] == pytest.approx(0.75)
    assert rows[1]["h"] == pytest.approx(0.1 + 0.025 + 0 + 0.02)
    # clip(.1 + .5 + .16 + .3) = .99
    assert rows[0]["f"] == pytest.approx(0.99)
    assert rows[1]["f"] == pytest.approx(0.21)
    assert rows[2]["f"] == pytest.approx(0.45)   # unknown group -> proxy 3


def test_hist_bin_max_in_last(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2.5, 9.99, 10]], "x double")
    got = [r[0] for r in df.select(S.hist_bin("x", F.lit(0.0), F.lit(10.0), 4)).collect()]
    assert got == [1, 1, 2, 4, 4]


def test_misc_text(spark):
    df = spark.createDataFrame([(37,)], "a int")
    r = df.select(S.bucket_text("a"), S.capped_ratio(F.lit(7)), S.safe_ratio(F.lit(1), F.lit(0)),
                  S.clip(F.lit(1.5), 0.01, 0.99)).first()
    assert tuple(r) == ("[37-47)", 1.0, None, 0.99)


def test_hash_rank_no_overflow(spark):
    keys = [0, 7, 2**31 - 1, 2**31, 600_000_000_000, 2**62, -5]
    got = one_col(spark, keys, "long", S.hash_rank)
    want = [((k % 2**31) * 1103515245 + 42) % 2**31 for k in keys]
    assert got == want
