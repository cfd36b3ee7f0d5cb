"""Edit distance with transpositions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def restricted_distance(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours counting once (no letter is edited twice)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def swap_distance(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours counting once even where letters then come between them: what
    ``damerau_levenshtein`` of SQL gives, never more than ``restricted_distance``."""
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2), *([far, i] + [0] * len(b) for i in range(len(a) + 1))]
    d[1][1:] = range(len(b) + 1)
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            above = seen.get(y, 0)
            swap = d[above][match] + (i - above - 1) + 1 + (j - match - 1)
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, swap)
            if x == y:
                match = j
        seen[x] = i
    return d[-1][-1]


def within_edits(c: Column, word: str, edits: int = 2, prefix: int = 0, transpositions: bool = True) -> Column:
    """Whether a term is within ``edits`` of a word and shares its first ``prefix`` letters. Spark's own distance bounds the
    candidates (a swap and what comes between is at most twice as many of its edits); only those go on to Python."""
    head = c.startswith(word[:prefix]) if prefix else F.lit(True)
    plain = F.levenshtein(c, F.lit(word), edits)
    if not transpositions:
        return head & (plain >= 0)

    def close(terms: pa.Array) -> pa.Array:
        return pa.array([t is not None and swap_distance(t, word) <= edits for t in terms.to_pylist()])

    loose = F.levenshtein(c, F.lit(word), 2 * edits)
    candidate = F.when(head & (loose > edits), c)
    return head & ((plain >= 0) | ((loose >= 0) & F.arrow_udf(close, "boolean")(candidate)))
