import random
import re

import pytest
from pyspark.sql import functions as F

from bindery.operators import minify

EDGE = [
    ("python", "x = 1  # note", "x = 1"),
    ("python", "s = \"it's\"  # note", "s = \"it's\" # note"),
    ("python", 'c = "#fff"', 'c = "'),
    ("python", "#!/bin/sh", "#!/bin/sh"),
    ("python", "    a    b", "    a b"),
    ("python", "  # only\n\n\t\n y", " y"),
    ("javascript", 'u = "http://h"', 'u = "http:'),
    ("javascript", "// only", ""),
    ("javascript", "# kept  x", "# kept x"),
    ("go", "a  // b\n\n#  c", "a // b\n# c"),
    ("python", "a  b  c\x1cd", "a b c d"),
    ("python", "", ""),
]
PYTHON = """# tide tables
HOURS = 24  # a day

def ebb(level):
    # halves by the hour
    return level / 2


class Gauge:
    #!keep
    marks = "#"  # one mark
"""
SCRIPT = """// harbour lights
let on = false;   // at dusk

function flash(n) {
    on = !on;
    // twice
    return n   +   1;
}
"""


def run(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, language string, text string")
    return [r.text for r in minify.minify(frame).orderBy("i").collect()]


def test_edge_lines(spark):
    assert run(spark, [(lang, text) for lang, text, _ in EDGE]) == [want for _, _, want in EDGE]


def test_samples(spark):
    python, script = run(spark, [("python", PYTHON), ("javascript", SCRIPT)])
    assert python.split("\n") == [
        "HOURS = 24", "def ebb(level):", "    return level / 2", "class Gauge:", "    #!keep", '    marks = "',
    ]
    assert script.split("\n") == ["let on = false;", "function flash(n) {", "    on = !on;", "    return n + 1;", "}"]


def by_hand(text, language):
    """The rules as rewrites of the whole text, for comparison."""
    lines = text.split("\n")
    if language in minify.HASH_LANGUAGES:
        lines = [x for x in lines if not re.match(r"\s*#(?!!)", x)]
        odd = [any(x.count(q) % 2 for q in "'\"") for x in lines]
        lines = [x if o or re.match(r"\s*#", x) else re.sub(r"(?s)#.*", "", x) for x, o in zip(lines, odd)]
    elif language in minify.SLASH_LANGUAGES:
        lines = [re.sub(r"(?s)//.*", "", x) for x in lines]
    heads = [re.match(r"\s*", x)[0] for x in lines]
    return "\n".join(h + " ".join(x.split()) for h, x in zip(heads, lines) if x.strip())


@pytest.mark.parametrize("language", ["python", "javascript", "go"])
def test_random_texts(spark, language):
    rng = random.Random(7)
    alphabet = "ab#/!'\"  \t\n\n\r \x1f\x85é"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(2000)]
    assert run(spark, [(language, t) for t in texts]) == [by_hand(t, language) for t in texts]


def test_long_lines_do_not_blow_up(spark):
    text = " " * 200_000 + "x" + " " * 200_000 + "y" + '"' * 100_000 + " # z" + " " * 200_000
    assert run(spark, [("python", text)]) == [by_hand(text, "python")]


def test_slash_family_is_a_fixed_point(spark):
    once = run(spark, [("java", SCRIPT)])
    assert run(spark, [("java", once[0])]) == once


def test_language(spark):
    exts = [".py", ".js", ".ts", ".java", ".cpp", ".c", ".rb", ".sh", ".md", ".go", ""]
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(exts)], "i int, ext string")
    got = [r[0] for r in frame.select(minify.language(F.col("ext")), "i").orderBy("i").collect()]
    assert got == ["python", "javascript", "typescript", "java", "cpp", "c", "ruby", "bash"] + ["python"] * 3


def test_reduction(spark):
    frame = spark.createDataFrame([("a", 10, 6), ("a", 10, 6)], "k string, old long, new long")
    assert minify.reduction(frame, "old", "new", "k").first().reduction_pct == 40.0
