"""Numbering and lookups when one group holds a third of the rows or more."""

from pyspark.sql import Window, functions as F

from bindery.operators import budget
from bindery.operators.ordering import HOT_KEYS, number_rows, skew_safe_lookup
from bindery.options import Options


def skewed(spark, n=20_000):
    """Half of the rows in one group, the rest spread over many."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 7).alias("v"),
    )


def test_numbers_match_a_plain_window(spark):
    rows = skewed(spark)
    plain = Window.partitionBy("g").orderBy("k")
    before = plain.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "g", "k",
        F.row_number().over(plain).cast("bigint").alias("row_no"),
        F.count(F.lit(1)).over(Window.partitionBy("g")).alias("group_rows"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v_before"),
        F.sum("v").over(Window.partitionBy("g")).alias("v_total"),
    )
    got = number_rows(rows, ["g"], ["k"], ["v"]).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_hot_group_is_split(spark):
    """The numbered rows of the hot group stay in several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_rows(skewed(spark), ["g"], ["k"])
        slices = numbered.filter("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct()
        assert slices.count() >= 3
        assert numbered.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_over_the_whole_run(spark):
    rows = skewed(spark, 3000)
    got = number_rows(rows, [], ["g", "k"])
    numbers = [r.row_no for r in got.orderBy("g", "k").collect()]
    assert numbers == list(range(1, 3001))
    assert got.select("group_rows").distinct().first()[0] == 3000


def test_lookup_equals_a_left_join(spark):
    """More keys than the broadcast holds, one of them very heavy, some missing."""
    rows = skewed(spark).select("g", "k")
    table = (
        rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        .filter("g != 'g1'").withColumn("value", F.upper("g"))
    )
    assert table.count() > HOT_KEYS
    got = skew_safe_lookup(rows, table, ["g"], ["value"], "n", ["k"])
    want = rows.join(table.drop("n"), "g", "left").select("g", "k", "value")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.filter("g = 'g1' and value is null").count() > 0


def test_lookup_salts_the_join_key(spark):
    rows = skewed(spark, 100).select("g", "k")
    table = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("value"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_safe_lookup(rows, table, ["g"], ["value"], "n", ["k"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        merge = next(line for line in plan.split("\n") if "SortMergeJoin" in line)
        assert "_salt" in merge.split("LeftOuter")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_running_budget(spark):
    stats = spark.createDataFrame(
        [("b", 2, 30_000), ("a", 1, 20_000), ("c", 3, 100_000)], "bundle string, ord int, token_count long"
    )
    rows = budget.running_budget(stats, ["ord"], Options()).orderBy("progress").collect()
    assert [(r.bundle, r.progress, r.running_tokens, r.status) for r in rows] == [
        ("a", "1/3", 20_000, "ok"), ("b", "2/3", 50_000, "over_soft"), ("c", "3/3", 150_000, "over_hard"),
    ]
    assert rows[2].budget_percent == 100.0 and rows[0].running_cost == 0.05


def test_rows_without_a_group_are_a_group(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, k int")
    got = number_rows(rows, ["g"], ["k"]).select("g", "k", "row_no", "group_rows").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 5, 1, 1), (None, 1, 1, 2), (None, 2, 2, 2)]


def test_a_bundle_without_a_name_keeps_its_text(spark):
    from bindery.operators import sections
    from bindery.options import Options

    files = spark.createDataFrame(
        [(b, p, p, f"text of {p}", None) for b in (None, "x") for p in ("a.txt", "b.txt")],
        "bundle string, rel_path string, display_path string, text string, read_error string",
    )
    rows = sections.render(files, Options(output_format="xml"))
    texts = {r.bundle: r.text for r in sections.bundle_text(rows, "xml", max_chars=1 << 20).collect()}
    assert texts[None] == texts["x"] and "index='2'" in texts["x"]
    assert sections.all_bundles(rows, "xml").count() == rows.count() + 2
