"""Outlines of Python sources: class and function signatures only."""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXTS = ("kind", "parent", "name", "signature", "returns", "docstring")
SYMBOL = T.StructType(
    [T.StructField("ordinal", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in TEXTS]
    + [T.StructField("closes_class", T.BooleanType())]
)
_FIELDS = [
    pa.field("ordinal", pa.int32()),
    *(pa.field(name, pa.string()) for name in TEXTS),
    pa.field("closes_class", pa.bool_()),
]
# Where statements stand in a node, in the order of its fields.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _source(node: ast.expr) -> str:
    return node.id if type(node) is ast.Name else ast.unparse(node)


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> dict:
    names = [f"{a.arg}: {_source(a.annotation)}" if a.annotation else a.arg for a in node.args.args]
    returns = _source(node.returns) if node.returns else None
    arrow = f" -> {returns}" if returns else ""
    return {
        "kind": "method" if parent else "function",
        "parent": parent,
        "name": node.name,
        "signature": f"def {node.name}({', '.join(names)}){arrow}",
        "returns": returns,
        "docstring": ast.get_docstring(node) or None,
        "closes_class": False,
    }


def _class(node: ast.ClassDef) -> list[dict]:
    bases = ", ".join(map(_source, node.bases))
    head = {
        "kind": "class",
        "parent": None,
        "name": node.name,
        "signature": f"class {node.name}({bases})" if bases else f"class {node.name}",
        "returns": None,
        "docstring": ast.get_docstring(node) or None,
        "closes_class": False,
    }
    methods = [_function(m, node.name) for m in node.body if type(m) is ast.FunctionDef]
    group = [head, *methods]
    group[-1]["closes_class"] = True
    return group


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """What holds or is a statement, in the order of ``ast.walk``; expressions hold none."""
    todo: deque[ast.AST] = deque([tree])
    while todo:
        node = todo.popleft()
        for block in _BLOCKS:
            below = getattr(node, block, None)
            if type(below) is list:
                todo += below
        yield node


def symbols_in(source: str | None) -> list[dict]:
    """Classes at any depth with their plain methods, and column-0 functions.

    Breadth first, as they stand in the tree; nothing for text that does not parse.
    """
    try:
        found: list[dict] = []
        for node in _statements(ast.parse(source or "")):
            match node:
                case ast.ClassDef():
                    found += _class(node)
                case ast.FunctionDef() | ast.AsyncFunctionDef() if node.col_offset == 0:
                    found.append(_function(node, None))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [{"ordinal": i, **symbol} for i, symbol in enumerate(found, 1)]


@F.arrow_udf(T.ArrayType(SYMBOL))
def _symbols(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [symbols_in(source) for source in batch.to_pylist()]
        ends = list(accumulate(map(len, found), initial=0))
        flat = list(chain.from_iterable(found))
        columns = [pa.array([s[f.name] for s in flat], f.type) for f in _FIELDS]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=_FIELDS))


def with_symbols(files: DataFrame) -> DataFrame:
    """Add ``symbols`` in the row itself, so no join or regrouping follows."""
    return files.withColumn("symbols", _symbols(F.col("text")))


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of the ``.py`` files.

    A plain explode would have Spark run the function a second time, below, to
    drop empty arrays early; the outer one does not.
    """
    return (
        with_symbols(files.filter(F.endswith(F.lower("rel_path"), F.lit(".py"))))
        .select("bundle", F.col("rel_path").alias("path"), F.explode_outer("symbols").alias("s"))
        .filter(F.col("s").isNotNull())
        .select("bundle", "path", "s.*")
        .drop("closes_class")
    )


def symbol_counts(found: DataFrame) -> DataFrame:
    """Symbols per bundle and kind, and the files that have some."""
    return found.groupBy("bundle", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files")
    )


def _doc(symbol: Column, indent: str) -> Column:
    quoted = F.concat(F.lit(f'\n{indent}"""'), symbol["docstring"], F.lit('"""'))
    return F.coalesce(quoted, F.lit(""))


def _lines(symbol: Column) -> Column:
    """Signature, docstring and body dots; a blank line ends a body and a class."""
    head = F.concat(symbol["signature"], F.lit(":"))
    text = (
        F.when(symbol["kind"] == "class", F.concat(head, _doc(symbol, "    ")))
        .when(
            symbol["kind"] == "method",
            F.concat(F.lit("    "), head, _doc(symbol, " " * 8), F.lit("\n        ...\n")),
        )
        .otherwise(F.concat(head, _doc(symbol, "    "), F.lit("\n    ...\n")))
    )
    return F.concat(text, F.when(symbol["closes_class"], "\n").otherwise(""))


def outline_text(symbols_array: Column, text: Column) -> Column:
    """The outline, or the whole text when no symbol was found."""
    outline = F.array_join(F.transform(symbols_array, _lines), "\n")
    return F.when(F.size(symbols_array) > 0, outline).otherwise(text)


def apply_outline(files: DataFrame) -> DataFrame:
    """Replace the text of ``.py`` files by their outline; others keep theirs.

    Other files send a null through Arrow instead of their text.
    """
    is_python = F.endswith(F.lower("rel_path"), F.lit(".py"))
    marked = files.withColumn("symbols", _symbols(F.when(is_python, F.col("text"))))
    return marked.withColumn("text", outline_text(F.col("symbols"), F.col("text"))).drop("symbols")
