"""Whether a document matches a query: one boolean column.

The tree is evaluated over what is known of each of its terms: whether a document holds it, and where. That comes from a document struct
(``matches``: one narrow pass over a table) or from the postings of a stored index (``index.StoredIndex``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import bound, positions
from ..plans.query import And, Node, Not, Or, Phrase, Term
from .approximate import approximate_regex, is_approximate

#: Widest proximity that is answered by listing the places it allows; wider ones test pairs of places.
LISTED = 16


@dataclass
class Found:
    """What is known of a part of a query: whether it is present, and its ascending positions (None: not followed)."""

    present: Column
    pos: Column | None = None
    lossy: bool = False  # a prefix: present, positions not followed


def token_matches(token: Column, t: Term) -> Column:
    """Whether a token is one that the term names."""
    if t.kind == "prefix":
        return token.startswith(t.text)
    if t.kind == "fuzzy":
        return (F.abs(F.length(token) - len(t.text)) <= t.distance) & (F.levenshtein(token, F.lit(t.text), t.distance) >= 0)
    if t.kind == "regex":
        return token.rlike(t.text)
    return token == t.text


def term_present(doc: Column, t: Term) -> Column:
    if t.kind == "regex" and is_approximate(t.text):
        return approximate_regex(doc["tokens"], t.text)
    if t.kind != "plain":
        return F.exists(doc["tokens"], lambda x: token_matches(x, t))
    if t.zones:
        return doc["has_pos"] & (F.size(positions(doc, t.text, t.zones)) > 0)
    return F.array_contains(doc["tokens"], t.text)


def following(left: Column, right: Column, distance: int, exact: bool) -> Column:
    """The positions of ``right`` that stand ``distance`` after one of ``left``, or at most so far and after it. Place 0 is unknown, and next to nothing."""

    def hits(p: Column, q: Column) -> Column:
        p, q = F.filter(p, lambda x: x > 0), F.filter(q, lambda x: x > 0)
        if exact:
            return F.array_intersect(F.transform(p, lambda x: x + distance), q)
        if distance <= LISTED:
            return F.array_sort(F.array_intersect(F.flatten(F.transform(p, lambda x: F.sequence(x + 1, x + distance))), q))
        return bound(lambda a, b: F.filter(b, lambda y: F.exists(a, lambda x: (x < y) & (y - x <= distance))), p, q)

    return bound(hits, left, right)


def evaluate(node: Node, leaf: Callable[[Term], Found], has_pos: Column) -> Found:
    """The tree over what ``leaf`` knows of its terms; ``has_pos``: whether the document has positions at all."""
    if isinstance(node, Term):
        return leaf(node)
    if isinstance(node, Not):
        return Found(~evaluate(node.operand, leaf, has_pos).present)
    left, right = evaluate(node.left, leaf, has_pos), evaluate(node.right, leaf, has_pos)
    if isinstance(node, And):
        return Found(left.present & right.present)
    if isinstance(node, Or):
        return Found(left.present | right.present)
    assert isinstance(node, Phrase)
    if left.pos is None or right.pos is None:
        if (left.pos is None and not left.lossy) or (right.pos is None and not right.lossy):
            return Found(F.lit(False))
        # a step over a prefix knows presence only, and no later step knows more; a document without positions has no phrase on the other side
        known = has_pos if left.pos is not None or right.pos is not None else F.lit(True)
        return Found(known & left.present & right.present)
    hit = following(left.pos, right.pos, node.distance, node.exact)
    return Found(has_pos & (F.size(hit) > 0), hit)


def matches(doc: Column, query: Node | None) -> Column:
    """True or false for a document; null for a null one. An empty query matches nothing.

    ``doc`` should be a column of its table, stored or made by ``analysis.with_document``: an expression is worked out again for each part of the query, and a
    condition with an approximate regular expression (a Python function) may not be planned over one.
    """

    def leaf(t: Term) -> Found:
        if t.kind == "plain":
            return Found(term_present(doc, t), positions(doc, t.text, t.zones or None))
        return Found(term_present(doc, t), None, t.kind == "prefix")

    found = F.lit(False) if query is None else evaluate(query, leaf, doc["has_pos"]).present
    return F.when(doc.isNotNull(), found)
