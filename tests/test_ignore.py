import random

import pytest
from pyspark.sql import functions as F

from bindery.operators import ignore

PATHS = [
    "a.log", "x/a.log", "keep.log", "x/keep.log", "build/a.py", "x/build/a.py", "build",
    "top.txt", "x/top.txt", "docs/x.md", "docs/a/x.md", "docs/a/b/x.md", "y/docs/x.md",
    "#a", "a b ", "src/gen/a.py", "src/gen", "d1.py", "d2.py", "dz.py", "q/w/e/r.c", "q/e.c",
]
CASES = [
    (["*.log"], ["a.log", "x/a.log", "keep.log", "x/keep.log"]),
    (["*.log", "!keep.log"], ["a.log", "x/a.log"]),
    (["!keep.log", "*.log"], ["a.log", "x/a.log", "keep.log", "x/keep.log"]),
    (["build/"], ["build/a.py", "x/build/a.py"]),
    (["build"], ["build/a.py", "x/build/a.py", "build"]),
    (["/build"], ["build/a.py", "build"]),
    (["/top.txt"], ["top.txt"]),
    (["docs/**/x.md"], ["docs/x.md", "docs/a/x.md", "docs/a/b/x.md"]),
    (["**/docs/x.md"], ["docs/x.md", "y/docs/x.md"]),
    (["docs/*.md"], ["docs/x.md"]),
    (["docs/**"], ["docs/x.md", "docs/a/x.md", "docs/a/b/x.md"]),
    (["# a", "", "   "], []),
    (["\\#a"], ["#a"]),
    (["a b\\ "], ["a b "]),
    (["src/gen"], ["src/gen/a.py", "src/gen"]),
    (["d[0-9].py"], ["d1.py", "d2.py"]),
    (["d[!0-9].py"], ["dz.py"]),
    (["d[]z].py"], ["dz.py"]),
    (["d[!]z].py"], ["d1.py", "d2.py"]),
    (["[a"], []),
    (["d?.py"], ["d1.py", "d2.py", "dz.py"]),
    (["q/**/e*"], ["q/w/e/r.c", "q/e.c"]),
    (["*", "!docs/", "!*.log"], sorted({"top.txt"} | set(PATHS) - {
        "a.log", "x/a.log", "keep.log", "x/keep.log", "docs/x.md", "docs/a/x.md", "docs/a/b/x.md",
        "y/docs/x.md"})),
]


@pytest.mark.parametrize("rules,hit", CASES, ids=lambda x: "|".join(x)[:30])
def test_rules(spark, rules, hit):
    rows = spark.createDataFrame([(p,) for p in PATHS], "rel_path string")
    got = rows.filter(ignore.ignored_by(F.col("rel_path"), rules)).collect()
    assert sorted(r.rel_path for r in got) == sorted(hit)


def test_rules_of_each_bundle(spark):
    """The table form agrees with the literal form, bundle by bundle."""
    files = spark.createDataFrame(
        [(f"b{i}", p) for i in range(len(CASES) + 1) for p in PATHS], "bundle string, rel_path string"
    )
    rules = spark.createDataFrame(
        [(f"b{i}", n, line) for i, (lines, _) in enumerate(CASES) for n, line in enumerate(lines)],
        "bundle string, ord int, pattern string",
    )
    got = ignore.mark_ignored(files, rules).filter("ignored").collect()
    assert {(r.bundle, r.rel_path) for r in got} == {
        (f"b{i}", p) for i, (_, hit) in enumerate(CASES) for p in hit
    }


def test_a_bad_rule_hurts_its_own_bundle_only(spark):
    files = spark.createDataFrame([(b, p) for b in "xy" for p in PATHS], "bundle string, rel_path string")
    rules = spark.createDataFrame(
        [("x", 0, "*.log"), ("x", 1, "[z-a].txt"), ("y", 0, "*.log")], "bundle string, ord int, pattern string"
    )
    got = ignore.mark_ignored(files, rules).filter("ignored").collect()
    assert {r.bundle for r in got} == {"y"} and len(got) == 4
    with pytest.raises(ValueError):
        ignore.ignored_by(F.col("rel_path"), ["[z-a]"])


def random_rule(rng):
    part = lambda: rng.choice(["a", "b", "ab", "*", "a*", "*.log", "*.a.b", "?b", "[ab]", "**", r"a\ b", r"\*", "x.log"])
    rule = "/".join(part() for _ in range(rng.randint(1, 3)))
    return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + rule + rng.choice(["", "", "/"])


def test_the_index_agrees_with_single_rules(spark):
    rng = random.Random(5)
    names = ["a", "b", "ab", "x.log", "y.a.b", ".log", "a b", "*", "b.log", "cab"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(250)})
    lines = {f"b{i}": [random_rule(rng) for _ in range(rng.randint(1, 6))] for i in range(12)}
    files = spark.createDataFrame([(b, p, "wide") for b in lines for p in paths], "bundle string, rel_path string, ignored_before string")
    rules = spark.createDataFrame([(b, n, r) for b, own in lines.items() for n, r in enumerate(own)], "bundle string, ord int, pattern string")
    got = {(r.bundle, r.rel_path) for r in ignore.mark_ignored(files, rules).filter("ignored").collect()}
    want = set()
    for b, own in lines.items():
        hits = files.filter(F.col("bundle") == b).filter(ignore.ignored_by(F.col("rel_path"), own))
        want |= {(r.bundle, r.rel_path) for r in hits.collect()}
    assert got == want and want
    kinds = {ignore.shape(r)[0] for own in lines.values() for r in own}
    assert kinds == {ignore.NAME, ignore.EXTENSION, ignore.PATH, ignore.PATTERN}


def test_no_pattern_comes_from_a_column(spark):
    files = spark.createDataFrame([("x", "a.log")], "bundle string, rel_path string")
    rules = spark.createDataFrame([("x", 0, "*.log")], "bundle string, ord int, pattern string")
    plan = ignore.mark_ignored(files, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_like" not in plan.lower()


def test_null_bundles_have_rules_too(spark):
    files = spark.createDataFrame([(None, "a.log"), ("x", "a.log")], "bundle string, rel_path string")
    rules = spark.createDataFrame([(None, 0, "*.log")], "bundle string, ord int, pattern string")
    assert {r.bundle: r.ignored for r in ignore.mark_ignored(files, rules).collect()} == {None: True, "x": False}
