"""Overlap scores of two texts, and how little of a reference a prediction still holds."""

from __future__ import annotations

from collections import Counter

import pandas as pd

from quillon.functions.code_similarity import bleu
from quillon.functions.python_code import arrow_function

CHAR_ORDER = 6
BETA = 2.0


def chrf(reference: str, prediction: str, order: int = CHAR_ORDER, beta: float = BETA) -> float:
    """Character n-gram F-score, 0 to 1: white space does not count; orders that neither text has are left out."""
    r, p = "".join(reference.split()), "".join(prediction.split())
    if not r or not p:
        return float(r == p)
    precision = recall = 0.0
    orders = 0
    for n in range(1, min(order, max(len(r), len(p))) + 1):
        a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (r, p))
        hit = sum((a & b).values())
        precision += hit / max(1, b.total())
        recall += hit / max(1, a.total())
        orders += 1
    precision, recall = precision / orders, recall / orders
    if not precision + recall:
        return 0.0
    return (1 + beta * beta) * precision * recall / (beta * beta * precision + recall)


@arrow_function("secret double, code double")
def forget_quality(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """1 - chrF (for secrets) and 1 - BLEU (for code) of each pair; null texts are empty ones."""
    pairs = [(r or "", p or "") for r, p in zip(reference, prediction, strict=True)]
    same = [float(not r.split() and not p.split()) for r, p in pairs]
    return pd.DataFrame(
        {"secret": [1.0 - chrf(r, p) for r, p in pairs], "code": [1.0 - max(s, bleu(r.split(), p.split())) for (r, p), s in zip(pairs, same, strict=True)]},
        dtype="float64",
    )
