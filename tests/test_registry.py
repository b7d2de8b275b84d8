from charta.plans.fixtures import table
from charta.sources import registry


def dispatched(spark):
    out = registry.dispatched(table(spark, "requests"), registry.registry(spark))
    return {r["case_id"]: r for r in out.collect()}


def test_main_value_ends_at_the_first_dash(spark):
    rows = dispatched(spark)
    assert (rows[1]["main"], rows[1]["extra"]) == ("affaire des colonels", [])
    assert (rows[9]["main"], rows[9]["extra"]) == ("a", ["--dry-run", "b"])
    assert (rows[10]["main"], rows[10]["extra"]) == ("", ["-5", "x"])
    assert rows[4]["extra"] == ["--start-year", "1900", "--end-year", "1950"]
    assert rows[18]["main"] == "a"


def test_help_is_matched_before_lower_casing(spark):
    rows = dispatched(spark)
    assert [rows[i]["outcome"] for i in (12, 13, 14, 15, 16)] == ["unknown", "help", "help", "help", "help"]
    assert [rows[i]["exit_code"] for i in (11, 12, 13)] == [2, 2, 0]


def test_alias_case_and_default(spark):
    rows = dispatched(spark)
    assert rows[7]["name"] == "wikipedia"
    assert rows[8]["command"] == ["python", "-u", "connectors/dhs.py", "--help"]
    assert rows[17]["trace"].endswith('--input-json "two words.json"')


def test_wrapper_hands_on_nine(spark):
    df = spark.createDataFrame([([str(i) for i in range(12)],)], "args array<string>")
    assert len(df.select(registry.wrapped(df.args).alias("a")).first()["a"]) == 9
