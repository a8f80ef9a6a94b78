"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from bindery.plans import queries as q
from bindery.plans import runs

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def columns_read(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^\n]*)>", plan)]


@pytest.mark.parametrize(
    "name", ["skip_topk", "ignore_rules_by_bundle", "dir_tree", "sections_xml", "run_totals", "bundle_text",
             "token_budget_running", "upsert_merge", "manifest", "code_outline"]
)
def test_no_pair_joins_and_bounded_plans(spark, name):
    plan = plan_of(q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len(plan) < 120_000


def test_statistics_do_not_read_the_text(spark):
    classified = q.filters.classify(q.documents(spark, SF), q.RUN)
    run = runs.Run(classified, q.RUN)
    for frame in (run.stats, run.totals, run.manifest, run.skips, run.budget):
        reads = columns_read(plan_of(frame))
        assert all("text" not in r for r in reads)
    assert "PushedFilters: [IsNull(skip_reason)" in plan_of(run.stats)


def test_statistics_draw_no_tree(spark):
    classified = q.filters.classify(q.documents(spark, SF), q.RUN)
    run = runs.Run(classified, q.RUN)
    assert "├──" not in plan_of(run.manifest) and "sections" not in vars(run)


def test_path_operators_read_paths_only(spark):
    plan = plan_of(q.filter_archive(spark, SF).select("rel_path"))
    assert columns_read(plan) == [{"doc_id", "lang", "source"}]


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(q.skip_topk(spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filter_after_all_text_stages_stays_small(spark):
    files = q.documents(spark, SF)
    done = runs.prepare(files, q.Options(minify=True, names=("a", "b", "c")))
    assert len(plan_of(done.filter("text is not null and length(text) > 3"))) < 400_000


def text_exchanges(plan):
    """Shuffles that carry a section or a text, in the plan before it runs."""
    tree = plan.split("== Initial Plan ==")[-1].splitlines()
    exchanges = [i for i, line in enumerate(tree) if re.search(r"\bExchange (hash|range|Shuffle|round|single)", line)]

    def carries(i):
        below = tree[i + 1] if i + 1 < len(tree) else ""
        return re.search(r"\b(section|text|piece|row)#", below) is not None

    return sum(map(carries, exchanges))


@pytest.mark.parametrize("name", ["sections_standard", "sections_xml", "bundle_text", "bundle_text_chunks", "all_bundles"])
def test_the_text_moves_once(spark, name):
    assert text_exchanges(plan_of(q.QUERIES[name](spark, SF))) == 1


def test_slots_beyond_the_broadcast_bound(spark, monkeypatch):
    from bindery.operators import placement

    def rows():
        return sorted(map(tuple, q.sections_xml(spark, SF).collect()))

    want = rows()
    monkeypatch.setattr(placement, "BROADCAST_STARTS", -1)
    assert rows() == want


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 99, 100, 12345])
def test_digits_of_an_index(spark, n):
    from bindery.operators.placement import index_digits
    from pyspark.sql import functions as F

    got = spark.range(1).select(index_digits(F.lit(n)).alias("d")).first().d
    assert got == sum(len(str(i)) for i in range(1, n + 1))


def test_the_writer_moves_the_text_once(spark):
    from bindery.operators import sections

    rows = sections.render(q.prepared_files(spark, SF), q.RUN)
    names = rows.select("bundle").distinct().withColumn("source_ord", F.lit(0))
    plan = plan_of(sections.in_order(rows, "standard", 10_000, names, task_per_slot=True))
    assert plan.count("REPARTITION_BY") == 1 and "rangepartitioning" not in plan
    assert not re.search(r"Exchange hashpartitioning\(bundle#\d+, slot", plan)
