import ast

from pyspark.sql import functions as F

from bindery.operators import outline
from bindery.plans.queries import code_files

SOURCE = '''
import os

@deco
class A(Base, m.C):
    """Doc of A"""
    x = 1

    def one(self, a: int, b=2, *args, c: str = "", **kw) -> list[int]:
        """Doc of one"""
        return []

    async def two(self):
        pass

    class Inner:
        def three(self):
            def four():
                pass


class Empty:
    pass

async def top(path: "str") -> None:
    pass

if True:
    def nested():
        pass
'''
OUTLINE = '''class A(Base, m.C):
    """Doc of A"""
    def one(self, a: int, b) -> list[int]:
        """Doc of one"""
        ...


class Empty:

def top(path: 'str') -> None:
    ...

class Inner:
    def three(self):
        ...

'''


def files(spark, *texts):
    return spark.createDataFrame(
        [("b", f"s/f{i}{'.txt' if t.startswith('plain') else '.PY'}", t) for i, t in enumerate(texts)],
        "bundle string, rel_path string, text string",
    )


def test_symbols(spark):
    rows = outline.symbols(files(spark, SOURCE)).orderBy("ordinal").collect()
    assert [(r.kind, r.parent, r.name) for r in rows] == [
        ("class", None, "A"), ("method", "A", "one"), ("class", None, "Empty"),
        ("function", None, "top"), ("class", None, "Inner"), ("method", "Inner", "three"),
    ]
    assert rows[1].signature == "def one(self, a: int, b) -> list[int]"
    assert (rows[1].returns, rows[1].docstring, rows[3].returns) == ("list[int]", "Doc of one", "None")


def test_outline_and_fallback(spark):
    texts = [SOURCE, "x = 1\n", "def broken(:\n", "plain def f(): pass", "a\x00b"]
    got = outline.apply_outline(files(spark, *texts)).orderBy("rel_path").collect()
    assert [r.text for r in got] == [OUTLINE, *texts[1:]]


NESTED = '''
try:
    class T: pass
except E:
    def handled(): pass
    class H(m.B): pass
else:
    class L: pass
finally:
    class F: pass
match x:
    case 1:
        class M:
            def m(self) -> None: pass
with y:
    class W: pass
for i in j:
    class R: pass
else:
    class S:
        async def s(self): pass
        def t(self, a: "q", /, b: p.q = lambda: 1, *, c=2) -> int | None: pass
z = [lambda: (yield)]
'''


def test_statements_stand_in_the_order_of_the_whole_walk():
    for text in (SOURCE, NESTED):
        tree = ast.parse(text)
        blocks = ast.stmt, ast.ExceptHandler, ast.match_case, ast.Module
        want = [n for n in ast.walk(tree) if isinstance(n, blocks)]
        assert list(outline._statements(tree)) == want


def test_symbols_of_texts_without_any_stay_in_their_rows(spark):
    texts = ["", NESTED, "x = 1", "def broken(:\n", SOURCE]
    rows = outline.with_symbols(files(spark, *texts)).orderBy("rel_path").collect()
    assert [[s.asDict() for s in r.symbols] for r in rows] == [outline.symbols_in(t) for t in texts]


def test_sources_of_one_file_of_parts_are_dealt_to_all_tasks(spark, tmp_path):
    part = spark.range(4_000).selectExpr("id p_partkey", "'n' p_name", "'Brand#1' p_brand", "1 p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = code_files(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * 4_000 / len(sizes)
    assert made.select("rel_path").distinct().count() == 4_000
