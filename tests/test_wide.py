import datetime as dt

from skeinfeed.operators.wide import as_date, as_double, as_int, bare, cells_as_text, wide_table

ROWS = "username string, pref_key string, pref_value string, saved_at timestamp, e string, slot int"
T = [dt.datetime(2025, 1, d) for d in range(1, 6)]


def catalogue(spark):
    return spark.createDataFrame([("dark_mode", "boolean"), ("font_size", "int"), ("scale", "double"), ("ends", "date"), ("city", "string")], "pref_key string, value_type string")


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)  # extra columns with the operator's own names
    return {(r[0], r[1]): r[2] for r in cells_as_text(wide_table(df, catalogue(spark))).collect()}


def test_latest_readable_value_wins(spark):
    got = found(spark, [("u", "Dark Mode", "true", T[0]), ("u", "dark-mode", "false", T[1]), ("u", "DARK_MODE", "maybe", T[2]), (" u ", "darkMode", "null", T[3])])
    assert got == {("u", "dark_mode"): "false"}


def test_notations(spark):
    got = found(spark, [("u", "font_size", '"1,440"', T[0]), ("u", "scale", '"2,5"', T[0]), ("u", "ends", '"3 Mar 2025"', T[0]), ("u", "city", '" \\u0c24\\u0c3e "', T[0])])
    assert got == {("u", "font_size"): "1440", ("u", "scale"): "2.50", ("u", "ends"): "2025-03-03", ("u", "city"): "తా"}


def test_nulls_ties_doubles_and_unknown_keys(spark):
    got = found(spark, [(None, "city", "a", T[0]), ("u", None, "a", T[0]), ("u", "city", None, T[4]), ("u", "city", "a", None), ("u", "city", "b", T[1]), ("u", "city", "c", T[1]), ("u", "city", "c", T[1]), ("u", "other", "x", T[1])])
    assert got == {("u", "city"): "c"}


def test_long_value_and_empty_table(spark):
    assert found(spark, [("u", "city", "x" * 100_000, T[0])])[("u", "city")] == "x" * 100_000
    assert wide_table(spark.createDataFrame([], ROWS), catalogue(spark)).collect() == []


def test_user_without_readable_value_keeps_a_row(spark):
    df = spark.createDataFrame([("u", "font_size", "{}", T[0], "", 0)], ROWS)
    assert [tuple(r) for r in wide_table(df, catalogue(spark)).collect()] == [("u", None, None, None, None, None)]


def test_hot_entity(spark):
    df = spark.range(50_000).selectExpr("'hot' AS username", "'font_size' AS pref_key", "cast(id as string) AS pref_value", "timestamp_seconds(id) AS saved_at")
    assert wide_table(df, catalogue(spark)).select("font_size").collect()[0][0] == 49_999


def test_readers():
    assert (as_int("24.0"), as_int("24.5"), as_int("1,2"), as_double("1.2e+01"), as_double("1,5"), as_double("x")) == (24, None, None, 12.0, 1.5, None)
    assert (as_date("2025-02-30"), as_date("20250301"), as_date("2025/03/01"), as_date("2025-03-01T00:00:00"), as_date("2025-03-01T01:00:00")) == (None, dt.date(2025, 3, 1), dt.date(2025, 3, 1), dt.date(2025, 3, 1), None)
    assert (bare('"null"'), bare('"a'), bare("  "), bare('" b "')) == (None, None, None, "b")
