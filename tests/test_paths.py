import pytest
from pyspark.sql import functions as F

from bindery.functions import paths, text as tx, tokens
from bindery.operators.filters import modified_since, within_size
from bindery.options import SENSITIVE_PATTERNS, parse_extensions


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(expression(F.col("v")), "i").orderBy("i").select("*").collect()]


def test_extension_list():
    assert parse_extensions(" .txt, PY,, .md ,.py") == [".txt", ".py", ".md"]


def test_suffix(spark):
    names = ["a.PY", ".env", "x.tar.gz", "d.d/plain", "a.", "d/b.Md"]
    assert column(spark, names, paths.suffix) == [".py", "", ".gz", "", "", ".md"]


@pytest.mark.parametrize(
    "path,expected",
    [
        (".env", True), ("secrets.yaml", True), ("id_rsa", True), ("api_keys.txt", True),
        (".bash_history", True), ("database.db", True), ("cert.pem", True), ("private.key", True),
        ("test.py", False), ("config.json", False), ("prod.env", True), ("a/my_id_rsa", True),
        ("a/SECRETS.JSON", True), ("a/MY_ID_RSA", False), ("environment.py", False),
        ("home/.aws/config", True), (".AWS/Credentials", False), (".aws/credentials", True), ("a/X.PEM", True), ("a.pem/b.txt", False),
        ("a/.pem", True), ("x.pem.txt", False),
    ],
)
def test_sensitive(spark, path, expected):
    for full in (path, "/top/" + path):
        assert column(spark, [full], lambda c: paths.is_sensitive(c, SENSITIVE_PATTERNS)) == [expected]


def test_archive_looks_at_every_folder_but_not_the_name(spark):
    values = ["/x/Archive/a.py", "/archives/b/c.md", "/x/archive", "/x/archive2/a", "archived/a"]
    assert column(spark, values, paths.in_archive) == [True, True, False, False, True]


def test_display_path(spark):
    rows = spark.createDataFrame(
        [("b", "/r/top", "/r/top/a/x.py"), ("b", "/r/top", "/else/y.py")], "b string, r string, p string"
    )
    shown = rows.select(paths.display_path(F.col("b"), F.col("r"), F.col("p"))).collect()
    assert [r[0] for r in shown] == ["b/a/x.py", "b/y.py"]


def test_decode(spark):
    cases = [b"caf\xc3\xa9\xff!", b"a\r\nb\rc\n", b"\xef\xbb\xbfx", b"ok \xef\xbf\xbd kept \xc3", b""]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = [r[0] for r in rows.select(tx.decode(F.col("c")), "i").orderBy("i").collect()]
    want = [c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in cases]
    assert got == want


def test_binary_needs_nul_in_first_kilobyte(spark):
    cases = [b"abc\x00", b"a" * 1024 + b"\x00", b"a" * 1023 + b"\x00", b"", None]
    rows = spark.createDataFrame(
        [(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, c binary"
    )
    got = [r[0] for r in rows.select(tx.is_binary(F.col("c")), "i").orderBy("i").collect()]
    assert got == [True, False, True, False, True]


def test_tokens_and_cost(spark):
    texts = ["a" * 47, "é" * 29, ""]
    assert column(spark, texts, lambda c: tokens.estimate(F.length(c))) == [11, 7, 0]
    models = ["gpt-4o", "gpt-4o-mini", "claude-3.5-sonnet", "unknown"]
    got = column(spark, models, lambda c: F.round(tokens.cost(F.lit(10_000), c), 6))
    assert got == [0.025, 0.0015, 0.03, 0.025]


def test_size_and_date_bounds_are_inclusive(spark):
    rows = spark.createDataFrame(
        [(1, 1024), (2, 1023), (3, 102400), (4, 102401), (5, None)], "i int, length long"
    )
    kept = rows.filter(within_size(F.col("length"), 1, 100)).orderBy("i").collect()
    assert [r.i for r in kept] == [1, 3, 5]
    times = spark.sql("SELECT timestamp'2024-01-02 00:00:00' t UNION ALL SELECT timestamp'2024-01-01 23:59:59'")
    assert times.filter(modified_since(F.col("t"), "2024-01-02")).count() == 1
    assert times.filter(modified_since(F.col("t"), "not a date")).count() == 2
