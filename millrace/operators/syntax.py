"""What only a parser can tell of Python sources: units, scopes, imports and validity. Arrow batches, one pass over the sources."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.chunks import line_blocks

UNIT_DDL = (
    "file_path string, unit_name string, unit_type string, parent_class string, start_line int, end_line int, signature string, docstring string, snippet string, decorators array<string>"
)
SCOPE_DDL = "path string, ord int, name string, qualname string, parent_class string, start_line int, end_line int, is_class boolean"
IMPORT_DDL = "src string, ord int, module string"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _unit(path: str, lines: list[str], node, kind: str, parent: str | None) -> tuple:
    own = lines[node.lineno - 1 : node.end_lineno]
    shown = own if len(own) <= 40 else [*own[:40], f"... ({len(own) - 40} more lines)\n"]
    head = "".join(lines[node.lineno - 1 : node.body[0].lineno - 1]).rstrip()
    return path, node.name, kind, parent, node.lineno, node.end_lineno, head, ast.get_docstring(node) or "", textwrap.dedent("".join(shown)), [ast.unparse(d) for d in node.decorator_list]


def units_of(path: str, source: str) -> Iterator[tuple]:
    """Top-level functions and classes, and the methods directly in a class, in order."""
    yield from _units_in(path, source, _tree(source))


def checked_units_of(path: str, source: str) -> Iterator[tuple]:
    """Units with nulls for error and line, or one row of nulls with the error and line of a source that can't be parsed, dedented either."""
    tree = _tree(source)
    yield from ((*unit, None, None) for unit in _units_in(path, source, tree))
    if tree is None and (source or "").strip():
        valid, error, line = _checked(source)[:3]
        if not valid:
            yield (path, *[None] * 9, error, line)


def _units_in(path: str, source: str, tree: ast.Module | None) -> Iterator[tuple]:
    lines = (source or "").splitlines(keepends=True)
    for node in tree.body if tree else ():
        if isinstance(node, FUNCTIONS):
            yield _unit(path, lines, node, "function", None)
        elif isinstance(node, ast.ClassDef):
            yield _unit(path, lines, node, "class", None)
            yield from (_unit(path, lines, m, "method", node.name) for m in node.body if isinstance(m, FUNCTIONS))


def scopes_of(path: str, source: str) -> Iterator[tuple]:
    """Functions and classes at any depth of functions and classes, not under other statements."""
    tree = _tree(source)
    todo = [(n, None, "") for n in reversed(tree.body)] if tree else []
    order = 0
    while todo:
        node, parent, prefix = todo.pop()
        is_class = isinstance(node, ast.ClassDef)
        if not is_class and not isinstance(node, FUNCTIONS):
            continue
        yield path, order, node.name, prefix + node.name, parent, node.lineno, node.end_lineno, is_class
        order += 1
        todo += [(n, node.name if is_class else parent, f"{prefix}{node.name}.") for n in reversed(node.body)]


def imports_of(path: str, source: str) -> Iterator[tuple]:
    """Modules of ``import`` statements, then of ``from`` statements; the level of a relative one is ignored, a bare one dropped."""
    tree = _tree(source)
    nodes = list(ast.walk(tree)) if tree else []
    plain = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    named = [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    yield from ((path, i, m) for i, m in enumerate(plain + named))


def _each(sources: DataFrame, f, ddl: str, path_col: str, text_col: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in ddl.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                yield pd.DataFrame([row for p, s in zip(part["p"], part["s"], strict=True) for row in f(p, s)], columns=names, dtype=object)

    return sources.select(F.col(path_col).alias("p"), F.col(text_col).alias("s")).mapInPandas(run, ddl)


def scopes(sources: DataFrame, path_col: str = "path", text_col: str = "source") -> DataFrame:
    return _each(sources, scopes_of, SCOPE_DDL, path_col, text_col)


def imports(sources: DataFrame, path_col: str = "path", text_col: str = "source") -> DataFrame:
    return _each(sources, imports_of, IMPORT_DDL, path_col, text_col)


def units(sources: DataFrame, path_col: str = "path", text_col: str = "source", block: int = 60, errors: bool = False) -> DataFrame:
    """Parsed units of Python sources and line blocks of others, with id and summary. With ``errors``, from the same pass, also a row with ``error`` and
    ``error_line`` for each source that can't be parsed; they are null in units."""
    f, ddl = (checked_units_of, f"{UNIT_DDL}, error string, error_line int") if errors else (units_of, UNIT_DDL)
    python = _each(sources.where(T.is_python(F.col(path_col))), f, ddl, path_col, text_col)
    name = F.when(F.col("parent_class").isNotNull(), F.concat_ws(".", "parent_class", "unit_name")).otherwise(F.col("unit_name"))
    python = python.withColumn("stable_id", T.stable_id(F.col("file_path"), name))
    python = python.withColumn("summary", T.unit_summary(*(F.col(c) for c in ("unit_type", "unit_name", "parent_class", "docstring", "decorators", "file_path", "start_line"))))
    blocks = line_blocks(sources.where(~T.is_python(F.col(path_col))), path_col, text_col, block).drop("block", "n")
    return python.unionByName(blocks, allowMissingColumns=True)


def _checked(text: str) -> tuple:
    failed = (False, None, None, None, 0)
    for attempt in (text, textwrap.dedent(text)):
        try:
            return True, None, None, None, sum(1 for _ in ast.walk(ast.parse(attempt)))
        except SyntaxError as e:
            failed = (False, e.msg, e.lineno, e.offset, 0)
        except (ValueError, RecursionError, MemoryError) as e:
            failed = (False, str(e), None, None, 0)
    return failed


def _check(code: pd.Series, python: pd.Series) -> pd.DataFrame:
    rows = []
    for text, on in zip(code, python, strict=True):
        if not on:
            rows.append((True, None, None, None, 0))
            continue
        if not (text or "").strip():
            rows.append((False, "empty", None, None, 0))
            continue
        rows.append(_checked(text))
    return pd.DataFrame(rows, columns=["valid", "error", "line", "col", "nodes"]).astype({"line": "Int32", "col": "Int32"})


def check_syntax(code: Column, path: Column) -> Column:
    """struct<valid, error, line, col, nodes>; a failed text is tried dedented; other languages are valid."""
    return F.pandas_udf(_check, "struct<valid:boolean,error:string,line:int,col:int,nodes:int>")(code, T.is_python(path))
