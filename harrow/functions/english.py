"""The English analyzer: stopwords, then the published Porter2 stemming algorithm, over the tokens of an Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import And, Node, Not, Or, Phrase, Term, without_stopwords
from .analysis import STOPWORDS, ZONE_BIT, tokens

VOWELS = "aeiouy"
DOUBLES = {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}
# Fixed values of the algorithm: irregular words, words that stay, and suffix rules.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
STAY = set("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)
# Most words end in none of a step's suffixes: one test for all of them.
SECOND_ENDS, THIRD_ENDS, FOURTH_ENDS = tuple(SECOND), tuple(THIRD), tuple(FOURTH)
_VOWEL_CONSONANT = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _after(word: str, at: int) -> int:
    """Where the part after the first consonant that follows a vowel, from ``at``, begins."""
    found = _VOWEL_CONSONANT.search(word, at)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if word.startswith(p):
            return len(p), _after(word, len(p))
    r1 = _after(word, 0)
    return r1, _after(word, r1)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Each distinct word is stemmed once a worker, as far as so many are remembered."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.removeprefix("'")
    if "y" in w:
        w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s.startswith("eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in DOUBLES:
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, to in SECOND.items() if w.endswith(SECOND_ENDS) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, to in THIRD.items() if w.endswith(THIRD_ENDS) else ():
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in FOURTH if w.endswith(FOURTH_ENDS) else ():
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_STOPPED = frozenset(STOPWORDS)
#: Tokens that are looked at at once.
TOKENS = 1 << 20


def _documents(lists: pa.ListArray, bit: int) -> pa.StructArray:
    """The documents of lists of tokens: each distinct token of them is tested and stemmed once."""
    n = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    stemmed = pa.array([None if w in _STOPPED else stem(w) for w in words], pa.string())
    at = coded.indices.to_numpy(zero_copy_only=False)
    kept = stemmed.is_valid().to_numpy(zero_copy_only=False)[at]
    ends = np.cumsum(n, dtype=np.int32)
    place = np.arange(1, len(at) + 1, dtype=np.int32) - np.repeat(ends - n.astype(np.int32), n)
    cuts = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])[np.concatenate([[0], ends])].astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(cuts), values)
    cells = [listed(stemmed.take(pa.array(at[kept]))), listed(pa.array(place[kept])), listed(pa.array(np.full(cuts[-1], bit, np.int32))), pa.array(np.diff(cuts)), pa.array(np.ones(len(n), bool))]
    return pa.StructArray.from_arrays(cells, ["tokens", "pos", "zone", "length", "has_pos"], mask=lists.is_null())


_DOCUMENT = T.StructType().add("tokens", T.ArrayType(T.StringType())).add("pos", T.ArrayType(T.IntegerType())).add("zone", T.ArrayType(T.IntegerType())).add("length", T.IntegerType()).add("has_pos", T.BooleanType())


@F.arrow_udf(_DOCUMENT)
def stopped_and_stemmed(lists: pa.Array, bit: pa.Array) -> pa.Array:
    if not len(lists):
        return _documents(lists, 1)
    end, at, made = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), dtype=np.int64), 0, []
    while at < len(lists):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + TOKENS, side="right")))
        made.append(_documents(lists.slice(at, stop - at), bit[0].as_py()))
        at = stop
    return pa.concat_arrays(made)


def analyze_english(text: Column, zone: str = "D") -> Column:
    """Tokens without stopwords, stemmed; positions keep the gaps, the length does not count them."""
    return stopped_and_stemmed(tokens(text), F.lit(ZONE_BIT[zone]))


def normalize_query(node: Node | None) -> Node | None:
    """A query for documents of ``analyze_english``: plain terms stemmed, stopwords taken out."""

    def walk(n: Node) -> Node:
        if isinstance(n, Term):
            return Term(stem(n.text), n.kind, n.distance, n.zones) if n.kind == "plain" else n
        if isinstance(n, Not):
            return Not(walk(n.operand))
        if isinstance(n, Phrase):
            return Phrase(walk(n.left), walk(n.right), n.distance, n.exact)
        return (And if isinstance(n, And) else Or)(walk(n.left), walk(n.right))

    kept = without_stopwords(node, set(STOPWORDS))
    return None if kept is None else walk(kept)
