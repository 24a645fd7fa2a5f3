"""Composite code similarity: n-gram, weighted n-gram, syntax and data-flow matches of Python source.

The components are defined over Python's own parser, so scores are comparable among themselves only.
"""

from __future__ import annotations

import ast
import keyword
from collections import Counter
from math import exp, log

import pandas as pd

from quillon.functions.python_code import arrow_function

#: The weights of the four components, and those of keywords and other tokens.
WEIGHTS = (0.25, 0.25, 0.25, 0.25)
KEYWORD_WEIGHT, OTHER_WEIGHT = 1.0, 0.2
ORDER = 4
_KEYWORDS = frozenset(keyword.kwlist)


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[k:] for k in range(n)], strict=False))


def bleu(reference: list[str], prediction: list[str], weighted: bool = False) -> float:
    """Sentence BLEU of order 4; an order without a match counts half a match, one beyond the text none.

    weighted: unigrams of the reference count by their token's weight."""
    if not reference or not prediction:
        return 0.0
    total, orders = 0.0, 0
    for n in range(1, ORDER + 1):
        r, p = _grams(reference, n), _grams(prediction, n)
        if not p:
            break
        weight = (lambda g: KEYWORD_WEIGHT if g[0] in _KEYWORDS else OTHER_WEIGHT) if weighted and n == 1 else (lambda g: 1.0)
        hit = sum(weight(g) * min(c, r[g]) for g, c in p.items())
        if n == 1 and not hit:
            return 0.0
        whole = sum(weight(g) * c for g, c in p.items())
        total, orders = total + log((hit or 0.5) / whole), orders + 1
    brevity = min(0.0, 1.0 - len(reference) / len(prediction))
    return exp(brevity + total / orders)


def _shape(node: ast.AST) -> str:
    return f"({type(node).__name__} {' '.join(map(_shape, ast.iter_child_nodes(node)))})"


class Features:
    """What a source needs for all its comparisons, made once."""

    def __init__(self, source: str | None):
        source = source or ""
        self.tokens = source.split()
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        nodes = [n for n in ast.walk(tree) if n is tree or any(ast.iter_child_nodes(n))] if tree else []
        self.shapes = [_shape(n) for n in nodes]
        self.shape_set = set(self.shapes)
        names: dict[str, str] = {}
        flow = []
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and n.value is not None:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                into = [t.id for target in targets for t in ast.walk(target) if isinstance(t, ast.Name)]
                out_of = [t.id for t in ast.walk(n.value) if isinstance(t, ast.Name)]
                rename = lambda x: names.setdefault(x, f"v{len(names)}")
                flow += [(rename(a), tuple(map(rename, out_of))) for a in into]
        self.flow = Counter(flow)


def directed(reference: Features, prediction: Features) -> dict[str, float]:
    ngram, weighted = bleu(reference.tokens, prediction.tokens), bleu(reference.tokens, prediction.tokens, True)
    syntax = sum(s in prediction.shape_set for s in reference.shapes) / len(reference.shapes) if reference.shapes else 0.0
    size = sum(reference.flow.values())
    dataflow = sum((reference.flow & prediction.flow).values()) / size if size else 0.0
    # a data-flow match of 0 counts as 1 in the composite, and stays 0 as a component
    parts = (ngram, weighted, syntax, dataflow or 1.0)
    return {"ngram": ngram, "weighted": weighted, "syntax": syntax, "dataflow": dataflow, "score": sum(w * x for w, x in zip(WEIGHTS, parts, strict=True))}


_KIND = "ngram double, weighted double, syntax double, dataflow double, forward double, reverse double, average double"


@arrow_function(_KIND)
def code_similarity(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both directions' scores (forward has the left as reference), their mean, and the components' means."""
    made: dict[str, Features] = {}
    rows = []
    for a, b in zip(left, right, strict=True):
        x, y = (made.get(s) or made.setdefault(s, Features(s)) for s in (a, b))
        f, r = directed(x, y), directed(y, x)
        rows.append([(f[k] + r[k]) / 2 for k in ("ngram", "weighted", "syntax", "dataflow")] + [f["score"], r["score"], (f["score"] + r["score"]) / 2])
        if len(made) > 20_000:
            made.clear()
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _KIND.split(", ")])
