"""Small fixed inputs for operators whose data the driver's tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODE = [
    ("f1", "function", "simple", 'import math\n\ndef area(r):\n    """Area."""\n    return math.pi * r * r\n'),
    ("f2", "function", "simple", 'def area2(r):\n    """Area of a circle."""\n    x = r * r\n    return 3.14 * x\n'),
    ("f3", "function", "moderate", "def pick(a, b):\n    if a and b:\n        return a\n    for x in b:\n        if x:\n            return x\n    return None\n"),
    ("f4", "function", "simple", "def a():\n    pass\n\ndef b():\n    pass\n"),
    ("f5", "function", "simple", '@cache\ndef a():\n    """Doc."""\n    return 1\n'),
    ("f6", "function", "simple", 'def a():\n    """Doc."""\n    import numpy\n    return numpy\n'),
    ("f7", "function", "simple", 'from . import x\n\ndef a():\n    """Doc."""\n    return x\n'),
    ("f8", "function", "simple", 'from .json import x\n\ndef a():\n    """Doc."""\n    return x\n'),
    ("f9", "function", "simple", 'def a():\n    r"""Doc."""\n    return 1\n'),
    ("c1", "class", "simple", "class A:\n    def __init__(self):\n        self.x = 1\n\n    def get(self, y):\n        return self.x if y else y\n"),
    ("c2", "class", "simple", "class B:\n    def __init__(self):\n        self.x = 1\n"),
    ("e1", "function", "simple", "def broken(:\n"),
    ("e2", "function", "simple", None),
]

LOGS = [
    (1, "started\n⠙ 6/48 🎉 5 🙁 1\n48/48  🎉 39 🫥 2  ⏰ 0  🤔 1  🙁 6  🔇 0\n", "cart.x_total__mutmut_5: survived\ncart.x_total__mutmut_8: no tests\n"),
    (2, "nothing was counted", "Killed 🎉 (17)\nSurvived 🙁 (3)\n\n---- 12, 40, 41\n"),
    (3, "9/9 🎉 8 🙁 1", "Survived (1):\n  cart.py:27\n"),
]

DIFFS = [
    (1, '--- a\n+++ b\n-    x = "a"\n+    x = "XXaXX"\n'),
    (2, "--- a\n+++ b\n-    return 1\n+    return 2\n"),
    (3, "--- a\n+++ b\n-    pass\n+    pass\n"),
    (4, "--- a\n+++ b\n same\n"),
    (5, "-    x = 'a'\n+    x = None\n"),
]

PATHS = [("a", f"checkpoint-{n}/model.bin") for n in (4, 12, 8)] + [("a", "checkpoint-8/config.json"), ("a", "final/model.bin"), ("a", "checkpoint-x/y"), ("b", "checkpoint-100/m"), ("b", "checkpoint-9/m")]


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODE, "task_id string, type string, difficulty string, content string")


def logs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOGS, "idx int, run_log string, results string")


def diffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIFFS, "id int, diff string")


def paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATHS, "adapter string, path string")


def quoted(value) -> str:
    """A value as a SQL literal."""
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """Fixed rows as a SQL table expression."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({names})"
