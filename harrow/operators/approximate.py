"""Regular expressions whose atoms may carry an edit budget, ``atom{~k}``: over the distinct tokens of an Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ATOMS = 3
_BUDGET = re.compile(r"\{~(\d+)\}")


def is_approximate(pattern: str) -> bool:
    return "{~" in pattern


def split_pattern(pattern: str) -> list[tuple[str, int | None]]:
    """(piece, budget) in order: exact pieces have None, an atom (a parenthesised group, or the one character before the budget) its edits."""
    if len(_BUDGET.findall(pattern)) > MOST_ATOMS:
        raise ValueError(f"more than {MOST_ATOMS} approximate atoms")
    out, at = [], 0
    for m in _BUDGET.finditer(pattern):
        head = pattern[at : m.start()]
        if head.endswith(")"):
            depth = 0
            for i in range(len(head) - 1, -1, -1):
                depth += (head[i] == ")") - (head[i] == "(")
                if depth == 0:
                    break
            if depth:
                raise ValueError("unbalanced parentheses")
            atom, head = head[i + 1 : -1], head[:i]
        elif head:
            atom, head = head[-1], head[:-1]
        else:
            raise ValueError("a budget without an atom")
        if re.search(r"[.^$*+?()\[\]{}|\\]", atom):
            raise ValueError("an approximate atom is literal text")
        if head:
            out.append((head, None))
        out.append((atom, int(m[1])))
        at = m.end()
    if "{~" in pattern[at:]:
        raise ValueError("a malformed budget")
    return [*out, (pattern[at:], None)] if pattern[at:] else out


def edit_ends(text: str, start: int, atom: str, budget: int) -> Iterator[int]:
    """Ends of the stretches of ``text`` from ``start`` within ``budget`` edits of ``atom``."""
    row = list(range(len(atom) + 1))
    if row[-1] <= budget:
        yield start
    for end in range(start, len(text)):
        new = [row[0] + 1]
        for j, c in enumerate(atom, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (text[end] != c)))
        row = new
        if min(row) > budget:
            return
        if row[-1] <= budget:
            yield end + 1


@lru_cache(maxsize=64)
def matcher(pattern: str):
    parts = []
    for p, k in split_pattern(pattern):
        # an end that is given to a match counts as the end of the text, so the anchor is checked apart
        anchored = k is None and p.endswith("$") and not p.endswith("\\$")
        parts.append((re.compile(p[:-1] if anchored else p) if k is None else p, k, anchored))

    def reach(text: str, at: int, i: int) -> bool:
        if i == len(parts):
            return True
        piece, budget, anchored = parts[i]
        if budget is not None:
            return any(reach(text, e, i + 1) for e in edit_ends(text, at, piece, budget))
        return any(piece.fullmatch(text, at, e) and reach(text, e, i + 1) for e in range(len(text) if anchored else at, len(text) + 1))

    return lru_cache(maxsize=100_000)(lambda text: any(reach(text, at, 0) for at in range(len(text) + 1)))


def approximate_match(term: Column, pattern: str) -> Column:
    """Whether a term holds a match: for the distinct terms of a vocabulary."""
    matcher(pattern)

    @F.pandas_udf("boolean")
    def some(terms: pd.Series) -> pd.Series:
        return terms.map(matcher(pattern))

    return some(term)


def approximate_regex(tokens: Column, pattern: str) -> Column:
    """Whether some token holds a match."""
    matcher(pattern)  # refuses a bad pattern on the driver

    @F.pandas_udf("boolean")
    def some(lists: pd.Series) -> pd.Series:
        hit = matcher(pattern)
        return lists.map(lambda x: x is not None and any(map(hit, x)))

    return some(F.array_distinct(tokens))
