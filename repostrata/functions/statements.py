"""Test and production statements of one Python file."""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Module names whose import marks test code.
TEST_MODULES = ("unittest", "pytest", "nose2")

STATEMENT_TYPE = (
    "parsed BOOLEAN, imports ARRAY<STRING>, unittest_classes ARRAY<STRING>,"
    " pytest_functions ARRAY<STRING>, production_statements BIGINT, test_statements BIGINT"
)
_FIELDS = [part.split()[0] for part in STATEMENT_TYPE.split(", ")]


def _is_test_base(base: ast.expr) -> bool:
    name = base.id if isinstance(base, ast.Name) else getattr(base, "attr", None)
    return name == "TestCase"


def count_statements(source: str | None, strict: bool = True) -> tuple:
    """Counts for one file in the field order of ``STATEMENT_TYPE``.

    ``strict`` leaves out ``from x import y`` and ``async def``, as the published numbers
    do. Depth is kept on a list, so deeply nested code cannot exhaust the stack. Missing text
    is not parsed.
    """
    if source is None:
        return False, [], [], [], 0, 0
    imports, classes, functions = [], [], []
    test = production = 0
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False, [], [], [], 0, 0

    pending = [(tree, False)]
    while pending:
        node, in_test = pending.pop()
        opens_test = False
        counted = 0
        if isinstance(node, ast.Import):
            known = [alias.name for alias in node.names if alias.name in TEST_MODULES]
            imports += known
            test += len(known)
            if not in_test:
                production += len(node.names) - len(known)
        elif isinstance(node, ast.ImportFrom) and not strict:
            if (node.module or "").split(".")[0] in TEST_MODULES:
                imports.append(node.module.split(".")[0])
                test += 1
            elif not in_test:
                production += 1
        elif isinstance(node, ast.ClassDef):
            opens_test = any(_is_test_base(base) for base in node.bases)
            if opens_test:
                classes.append(node.name)
            counted = 1
        elif isinstance(node, ast.FunctionDef) or (isinstance(node, ast.AsyncFunctionDef) and not strict):
            opens_test = node.name.startswith("test_")
            if opens_test:
                functions.append(node.name)
            counted = 1
        elif isinstance(node, (ast.Assign, ast.Call, ast.Expr)):
            if in_test:
                test += 1
            else:
                production += 1
        if counted:
            if opens_test:
                test += 1
            elif not in_test:
                production += 1
        inside = in_test or opens_test
        pending.extend((child, inside) for child in reversed(list(ast.iter_child_nodes(node))))
    return True, imports, classes, functions, production, test


def statements(strict: bool = True):
    """Arrow UDF from source text to the ``STATEMENT_TYPE`` struct."""

    @F.pandas_udf(STATEMENT_TYPE)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            yield pd.DataFrame([count_statements(s, strict) for s in sources], columns=_FIELDS)

    return classify


# Workers need no copy of the package: the functions above travel with the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
