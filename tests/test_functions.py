"""Column expressions on the inputs whose results follow from the rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studylake import types as VT
from studylake.functions import names, text, values
from studylake.functions.sqltypes import map_type
from studylake.operators import dictionary as dic


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "choice_text, expected",
    [
        ("1, Male | 2, Female", [(1, "male", "Male"), (2, "female", "Female")]),
        ("a=Alpha | b=Beta", [(1, "a", "Alpha"), (2, "b", "Beta")]),
        ("2.5, X Y", [(2, "x_y", "X Y")]),
        ("3.5, X", [(4, "x", "X")]),
        ("1, Male, adult", [(1, "male,_adult", "Male, adult")]),
        ("yes", [(1, "yes", "yes")]),
        ("b | 7, Seven || a", [(1, "b", "b"), (7, "seven", "Seven"), (2, "a", "a")]),
        ("1,", [(1, "1,", "1,")]),
        ("1, two\nlines", [(1, "1, two\nlines", "1, two\nlines")]),
        ("", []),
    ],
)
def test_choice_items(spark, choice_text, expected):
    items = one(spark, text.choice_items(F.lit(choice_text)))
    assert [(i.value, i.code, i.description) for i in items] == expected
    assert [i.pos for i in items] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize(
    "html, plain",
    [
        ("<b>Age</b>&nbsp;&amp;lt;5", "Age &lt;5"),
        ("a<script>x < y\n</script>b<style>\n</style>c", "a b c"),
        ("  <p>x</p>  ", "x"),
        ("&quot;a&#39;s&quot; &gt; b", "\"a's\" > b"),
        ("<SCRIPT>kept</SCRIPT>", "kept"),
        ("<script>a<script>b</script>c</script>d", "c d"),
        ("<style>a</script>b", "a b"),
        ("<script>" * 50_000 + "x", "x"),
    ],
)
def test_strip_markup(spark, html, plain):
    assert one(spark, text.strip_markup(F.lit(html))) == plain


@pytest.mark.parametrize(
    "raw, strict, legal",
    [
        ("a b", False, "a_b"), ("1abc", False, "_1abc"), ("@x", False, "_x"), ("a::b", False, "a_b"), ("", False, "_x"),
        ("  ", False, "_x"), ("xmlfoo", False, "_xmlfoo"), ("XmL", False, "_XmL"), ("1.0.0", True, "_1_0_0"), ("1.0.0", False, "_1.0.0"),
        ("-a", False, "_-a"), ("-a", True, "_a"), ("é€é", False, "é_é"), ("a__b", False, "a_b"),
    ],
)
def test_legal_name(spark, raw, strict, legal):
    assert one(spark, names.legal_name(F.lit(raw), strict)) == legal


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1é.-: @_́xXmMlL€", max_size=12), min_size=1, max_size=20))
def test_legal_names_are_legal_and_stable(spark, frame, raw):
    df = frame([(r,) for r in raw], "raw string")
    for strict in (False, True):
        once = df.select(names.legal_name(F.col("raw"), strict).alias("n"))
        twice = once.select("n", names.legal_name(F.col("n"), strict).alias("m"), names.is_legal_name(F.col("n"), strict).alias("ok"))
        assert all(row.n == row.m and row.ok for row in twice.collect())


@pytest.mark.parametrize("raw, value", [("3", 3), ("3.7", 4), ("2.5", 3), ("-2.5", -3), ("1e2", 100), (" 7 ", 7), ("x", None), ("", None), ("1d", None)])
def test_cast_category(spark, raw, value):
    assert one(spark, values.cast_category(F.lit(raw))) == value


def test_strict_casts_fail_on_bad_text(spark):
    assert one(spark, values.cast_integer(F.lit("2.5"))) == 3
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, values.cast_integer(F.lit("many")))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, values.cast_float(F.lit("many")))
    with pytest.raises(Exception):
        one(spark, values.parse_date(F.lit("2024-13-01"), "%Y-%m-%d"))


def test_dates_and_times(spark):
    assert str(one(spark, values.parse_date(F.lit("3/7/2024"), "%m/%d/%Y"))) == "2024-03-07"
    assert str(one(spark, values.parse_datetime(F.lit("07/03/2024 5:06"), "%d/%m/%Y %H:%M"))) == "2024-03-07 05:06:00"
    assert one(spark, values.parse_time(F.lit("05:30"), "%M:%S")) == "00:05:30"
    assert one(spark, values.parse_time(F.lit("23:5"), "%H:%M")) == "23:05:00"
    with pytest.raises(ValueError):
        values.spark_pattern("%j")
    with pytest.raises(ValueError):
        values.typed_columns([VT.Variable("d", VT.DATE)])


def test_every_format_has_a_pattern():
    assert all("%" not in values.spark_pattern(fmt) for fmt in VT.VALUE_FORMATS.values())


def test_multiresponse_array(spark):
    assert one(spark, values.multiresponse_array(F.lit("1, 3,x"))) == [1, 3, None]


@pytest.mark.parametrize(
    "flavour, declared, kind",
    [
        ("generic", "DECIMAL(10, 2)", VT.FLOAT), ("generic", "varchar(5)", VT.STRING), ("mssql", "datetime2(7)", VT.DATETIME),
        ("mssql", "bit", VT.INTEGER), ("mssql", "decimal(9)", VT.FLOAT), ("generic", "bit", VT.STRING), ("duckdb", "ENUM('a')", VT.CATEGORY),
        ("duckdb", "HUGEINT", VT.INTEGER), ("postgresql", "money", VT.FLOAT), ("postgresql", "timestamptz", VT.DATETIME),
        ("mysql", "enum('a','b')", VT.CATEGORY), ("mysql", "mediumint", VT.INTEGER), ("sqlite", "UNSIGNED BIG INT", VT.INTEGER),
        ("sqlite", "numeric", VT.STRING), ("sqlite", "DOUBLE PRECISION", VT.FLOAT), ("postgresql", "boolean", VT.STRING),
        ("somethingelse", "tinyint", VT.INTEGER), ("spark", "timestamp_ntz", VT.DATETIME),
        ("spark", "decimal(12,2)", VT.FLOAT), ("spark", "boolean", VT.INTEGER), ("spark", "array<int>", VT.STRING),
    ],
)
def test_map_type(spark, flavour, declared, kind):
    assert one(spark, map_type(F.lit(declared), flavour)) == kind


@pytest.mark.parametrize(
    "field_type, validation, kind, fmt",
    [
        ("radio", None, VT.CATEGORY, None), ("YesNo", None, VT.CATEGORY, None), ("checkbox", None, VT.MULTIRESPONSE, None),
        ("calc", "integer", VT.FLOAT, None), ("slider", None, VT.INTEGER, None), ("text", "integer", VT.INTEGER, None),
        ("text", "number_1dp", VT.FLOAT, None), ("text", "date_dmy", VT.DATE, "%d/%m/%Y"),
        ("text", "DateTime_Seconds_mdy", VT.DATETIME, "%m/%d/%Y %H:%M:%S"), ("text", "time", VT.TIME, "%H:%M"),
        ("text", "time_hh_mm_ss", VT.TIME, "%H:%M:%S"), ("text", "time_mm_ss", VT.TIME, "%M:%S"), ("text", "email", VT.STRING, None),
        ("notes", "date_dmy", VT.STRING, None),
    ],
)
def test_dictionary_types(spark, field_type, validation, kind, fmt):
    check = F.lit(validation).cast("string")
    assert one(spark, dic.value_type(F.lit(field_type), check)) == kind
    assert one(spark, dic.value_format(F.lit(field_type), check)) == fmt


def test_choices_follow_a_plain_reading(spark, frame):
    """Random choice texts against a loop that applies the rules one by one."""
    import random

    random.seed(5)
    tokens = ["1", "2.5", "a", "b c", "1e1", ",", ",", "=", "|", "|", " ", "Male", "\n", "-3", "."]
    texts = ["".join(random.choice(tokens) for _ in range(random.randint(0, 14))) for _ in range(300)]
    got = frame(list(enumerate(texts)), "i bigint, t string").select("i", text.choice_items(F.col("t")).alias("items")).collect()
    for row in got:
        assert [(i.value, i.code, i.description) for i in row["items"]] == read_choices(texts[row.i]), texts[row.i]


def read_choices(choice_text):
    items, following = [], 1
    for part in (p.strip() for p in choice_text.split("|")):
        if not part:
            continue
        separator = "," if "," in part else "=" if "=" in part else None
        key = label = part
        if separator:
            left, right = (side.strip() for side in part.split(separator, 1))
            if left and right and "\n" not in right:
                key, label = left, right
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", key):
            items.append((round(float(key)), re.sub(r"\s+", "_", label.lower()), label))
        else:
            items.append((following, key, label))
            following += 1
    return items
