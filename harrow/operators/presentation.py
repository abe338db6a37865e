"""Highlighting and snippets as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import SEPARATOR, fold
from ..plans.query import Node, literals

_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


@lru_cache(maxsize=1)
def _folded() -> dict[str, list[str]]:
    """The characters that ``fold`` turns into each character."""
    out: dict[str, list[str]] = {}
    for c in map(chr, range(0x110000)):
        small = {"İ": "i", "Σ": "σ"}.get(c, c.lower())
        if small != c:
            out.setdefault(small, []).append(c)
    return out


def _class(c: str) -> str:
    """A regular expression for one character that folds to ``c``."""
    return "[" + "".join(f"\\x{{{ord(x):X}}}" for x in [c, *_folded().get(c, [])]) + "]"


def highlight(text: Column, query: Node | None, pre: str = "<b>", post: str = "</b>") -> Column:
    """Every token whose folded form is a term of the query, whatever its operators, between ``pre`` and ``post``."""
    terms = sorted(set(literals(query)), key=len, reverse=True)
    if not terms:
        return text
    any_of = "|".join("".join(_class(c) for c in t) for t in terms)
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?<!{_TOKEN})({any_of})(?!{_TOKEN})", f"{literal(pre)}$1{literal(post)}")


def snippet(text: Column, query: Node | None, pre: str = "<b>", post: str = "</b>", ellipsis: str = "...", max_tokens: int = 15) -> Column:
    """The first window of ``max_tokens`` tokens with the most hits, one space between tokens, an ellipsis on a side that is cut; '' without tokens."""
    width = max(1, max_tokens)
    terms = F.array(*[F.lit(t) for t in sorted(set(literals(query)))]).cast("array<string>")
    words = F.filter(F.split(text, SEPARATOR), lambda t: t != "")
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), F.array_contains(terms, fold(w)).alias("h")))

    def shown(m: Column) -> Column:
        n = F.size(m)
        # the first best window is the first of all or ends in a hit: one step to the left has fewer hits
        ends = F.filter(F.transform(m, lambda x, i: F.when(x["h"], i)), lambda i: i >= width)
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i - (width - 1)))
        best = F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.filter(F.slice(m, i + 1, F.lit(width)), lambda x: x["h"])).alias("hits"), (-i).alias("i"))))["i"]
        return F.transform(F.array(-best), lambda at: F.concat(
            F.when(at > 0, ellipsis).otherwise(""),
            F.array_join(F.transform(F.slice(m, at + 1, F.lit(width)), lambda x: F.when(x["h"], F.concat(F.lit(pre), x["w"], F.lit(post))).otherwise(x["w"])), " "),
            F.when(at + width < n, ellipsis).otherwise(""),
        ))[0]

    bound = F.transform(F.array(marked), lambda m: F.when(F.size(m) > 0, shown(m)).otherwise(""))[0]
    return F.when(text.isNotNull(), bound)
