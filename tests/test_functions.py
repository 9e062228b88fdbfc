"""Column expressions and special functions against pinned values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import special as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, style, want", [
    ("(123)", "mixed", -123), ("1,234", "mixed", 1.234), ("1,234.56", "mixed", 1234.56), ("1.234,56", "mixed", 1.23456), ("1,234,567", "mixed", None), ("12%", "mixed", 12), ("", "mixed", None),
    ("1e3", "mixed", 1000), ("NaN", "mixed", None), ("$45000", "mixed", 45000), (" € 7 ", "mixed", 7), ("abc", "mixed", None), ("0x10", "mixed", None), ("Infinity", "mixed", None), ("1e400", "mixed", None),
    ("1,234,567", "us", 1234567), ("1.234,56", "eu", 1234.56), (None, "mixed", None),
])
def test_numbers(spark, text, style, want):
    assert one(spark, C.parse_number(F.lit(text).cast("string"), style)) == want


@pytest.mark.parametrize("text, kind", [("yes", "boolean"), ("1", "numeric"), ("2024-01-05", "timestamp"), ("2024-01-05T01:02:03Z", "timestamp"), ("05-Jan-2024", "timestamp"), ("x y", "string"), ("", "missing"), (None, "missing"), ("off", "boolean"), ("1700000000", "numeric"), ("2024-13-45", "string")])
def test_coercion_order(spark, text, kind):
    assert one(spark, C.coerce_value(F.lit(text).cast("string"))["type"]) == kind


def test_seconds_and_formats(spark):
    assert str(one(spark, C.parse_timestamp(F.lit("1700000000")))) == str(one(spark, C.parse_timestamp(F.lit("2023-11-14 22:13:20"))))
    assert one(spark, C.parse_timestamp(F.lit("2147483647"))) is None


def test_buckets_are_right_closed(spark):
    b = lambda v, low=False: one(spark, C.bucketize(F.lit(v).cast("double"), (0, 1, 5), ("a", "b"), low))
    assert [b(0.0), b(0.0, True), b(1.0), b(1.1), b(5.0), b(5.1), b(None), b(float("nan"))] == [None, "a", "a", "b", "b", None, None, None]


def test_clip_keeps_null(spark):
    assert one(spark, C.clip(F.lit(None).cast("double"), 0.0, 5.0)) is None and one(spark, C.clip(F.lit(9.0), 0.0, 5.0)) == 5


@pytest.mark.parametrize("a, b, want", [("hello world", "hello world", 1), ("hello world", "hello", 0.5), ("customer data", "customer information", 1 / 3), ("", "", 1), ("abc", "def", 0)])
def test_word_jaccard(spark, a, b, want):
    assert one(spark, C.word_jaccard(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("v, want", [(3.0, "3"), (1.5, "1.5"), (0.1234567, "0.123457"), (-2.0000000001, "-2"), (100.25, "100.25")])
def test_category_keys(spark, v, want):
    assert one(spark, C.category_key(F.lit(v))) == want


def test_truncation(spark):
    ts = F.lit("2025-01-15 14:30:45").cast("timestamp")
    assert [str(one(spark, C.truncated(ts, g))) for g in ("hour", "day", "week", "month")] == ["2025-01-15 14:00:00", "2025-01-15 00:00:00", "2025-01-13 00:00:00", "2025-01-01 00:00:00"]


def test_normalized_text(spark):
    assert one(spark, C.normalize_text(F.lit("  A\t B\x01c "))) == "a bc"


def test_poly_hash(spark):
    h = 5381
    for ch in "abc":
        h = (h * 33 + ord(ch)) % (1 << 31)
    assert one(spark, C.poly_hash(F.lit("abc"), 33, 5381)) == h


def test_verdicts(spark):
    v = lambda q, n: one(spark, C.verdict(F.lit(q).cast("double"), F.lit(n)))
    assert [v(0.001, 300), v(0.001, 150), v(0.04, 60), v(0.2, 300), v(0.001, 10), v(None, 300)] == ["STRONG", "MODERATE", "WEAK", "FAIL", "INSUFFICIENT_DATA", "NOT_RUN"]


def test_special_functions_against_tables():
    assert S.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert S.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and S.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert S.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and S.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6) and S.f_upper(2.978237, 10, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_upper(np.array([0.0, 2.0]), 2) == pytest.approx([1, np.exp(-1)])


def test_p_values_as_columns(spark):
    row = spark.createDataFrame([(2.228139, 10.0), (None, 5.0)], "t double, df double").select(S.p_t("t", "df").alias("p")).collect()
    assert row[0]["p"] == pytest.approx(0.05, abs=1e-6) and (row[1]["p"] is None or np.isnan(row[1]["p"]))
