"""Text analysis as column expressions: a document is a struct of its tokens, their positions and zones.

The simple analyzer takes maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, folded one character at a time; positions start at 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between tokens.
SEPARATOR = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Bits of zone labels: D is the default.
ZONE_BIT = {"D": 1, "C": 2, "B": 4, "A": 8}


def bound(f: Callable[..., Column], *columns: Column) -> Column:
    """f of the columns, each worked out once however often f names it."""
    row = F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
    return F.transform(row, lambda r: f(*[r[f"c{i}"] for i in range(len(columns))]))[0]


def fold(text: Column) -> Column:
    """Lower case one character at a time: no expansion of the dotted capital I, no final form of sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """Folded tokens in order; null for null."""
    return F.array_remove(F.split(fold(text), SEPARATOR), "")


def analyze(text: Column, zone: str = "D") -> Column:
    """struct(tokens, pos, zone, length) of a text; null for null."""
    t = tokens(text)
    return from_tokens(t, zone)


def with_document(table: DataFrame, doc: Column, name: str = "doc") -> DataFrame:
    """``table`` with a document column that is worked out once a row: an optimizer that moves a condition on it below its definition would
    tokenise the text again for each part of the condition, and it moves none below a generator."""
    return table.select(*[c for c in table.columns if c != name], F.explode(F.array(doc)).alias(name))


def from_tokens(t: Column, zone: str = "D") -> Column:
    return bound(lambda x: _from_tokens(x, zone), t)


def _from_tokens(t: Column, zone: str) -> Column:
    n = F.size(t)
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    made = F.struct(t.alias("tokens"), places.alias("pos"), F.array_repeat(F.lit(ZONE_BIT[zone]), n).alias("zone"), n.alias("length"), F.lit(True).alias("has_pos"))
    return F.when(t.isNotNull(), made)


#: English function words that the stopping analyzer drops (fixed values).
STOPWORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both
each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()


def analyze_stopped(text: Column, stopwords: list[str] | None = None) -> Column:
    """As ``analyze``, without stopwords: positions keep their gaps, the length does not count them."""
    stop = F.array(*[F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)])
    t = tokens(text)
    kept = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("t"), (i + 1).cast("int").alias("p"))), lambda s: ~F.array_contains(stop, s["t"]))
    made = lambda k: F.struct(F.transform(k, lambda s: s["t"]).alias("tokens"), F.transform(k, lambda s: s["p"]).alias("pos"), F.transform(k, lambda _: F.lit(ZONE_BIT["D"])).alias("zone"), F.size(k).alias("length"), F.lit(True).alias("has_pos"))
    return bound(lambda k: F.when(k.isNotNull(), made(k)), kept)


def set_zone(doc: Column, zone: str) -> Column:
    """Every position relabelled; a document without positions stays as it is."""
    if zone not in ZONE_BIT:
        raise ValueError(f"no such zone: {zone}")
    return bound(lambda d: F.when(d["has_pos"], d.withField("zone", F.transform(d["tokens"], lambda _: F.lit(ZONE_BIT[zone])))).otherwise(d), doc)


def strip_positions(doc: Column) -> Column:
    return F.when(doc.isNotNull(), doc.withField("has_pos", F.lit(False)))


def concat_docs(a: Column, b: Column) -> Column:
    """b after a: its positions shifted by the larger of a's length and last position; lengths add; without positions if either is."""
    return bound(_concat_docs, a, b)


def _concat_docs(a: Column, b: Column) -> Column:
    shift = F.greatest(a["length"], F.coalesce(F.array_max(a["pos"]), F.lit(0)))
    made = F.struct(
        F.concat(a["tokens"], b["tokens"]).alias("tokens"),
        F.concat(a["pos"], F.transform(b["pos"], lambda p: p + shift)).alias("pos"),
        F.concat(a["zone"], b["zone"]).alias("zone"),
        (a["length"] + b["length"]).alias("length"),
        (a["has_pos"] & b["has_pos"]).alias("has_pos"),
    )
    return F.when(a.isNotNull() & b.isNotNull(), made)


def positions(doc: Column, term: str, mask: int | None = None) -> Column:
    """Ascending positions of ``term``, in the zones of ``mask`` if given."""
    every = F.arrays_zip(doc["tokens"].alias("t"), doc["pos"].alias("p"), doc["zone"].alias("z"))
    hit = F.filter(every, lambda s: (s["t"] == term) & ((s["z"].bitwiseAND(F.lit(mask)) != 0) if mask else F.lit(True)))
    return F.transform(hit, lambda s: s["p"])


def term_frequency(doc: Column, term: str) -> Column:
    return F.size(F.filter(doc["tokens"], lambda t: t == term))


def text_form(doc: Column) -> Column:
    """``'term':tf@p1,p2A`` for each distinct term in order; zones are written but for D."""
    return bound(_text_form, doc)


def _text_form(doc: Column) -> Column:
    every = F.arrays_zip(doc["tokens"].alias("t"), doc["pos"].alias("p"), doc["zone"].alias("z"))
    ordered = F.sort_array(F.transform(every, lambda s, i: F.struct(s["t"].alias("t"), i.alias("i"), s["p"].alias("p"), s["z"].alias("z"))))
    label = lambda z: F.when(z == 8, "A").when(z == 4, "B").when(z == 2, "C").otherwise("")

    def one(own: Column) -> Column:
        places = F.concat_ws(",", F.transform(own, lambda s: F.concat(s["p"].cast("string"), label(s["z"]))))
        quoted = F.concat(F.lit("'"), F.replace(own[0]["t"], F.lit("'"), F.lit("''")), F.lit("':"), F.size(own).cast("string"))
        return F.when(doc["has_pos"], F.concat(quoted, F.lit("@"), places)).otherwise(quoted)

    def entries(m: Column) -> Column:
        # a term's places stand together: each run is cut out once
        starts = F.filter(F.transform(m, lambda x, i: F.when(~F.get(m, i - 1)["t"].eqNullSafe(x["t"]), i)), lambda i: i.isNotNull())
        cut = lambda at: F.transform(at, lambda i, k: F.slice(m, i + 1, F.coalesce(F.get(at, k + 1), F.size(m)) - i))
        return F.transform(bound(cut, starts), one)

    return F.when(doc.isNotNull(), F.concat_ws(" ", bound(entries, ordered)))


def _from_entries(text: Column, pattern: str, names: int, places: int) -> Column:
    """A document of the entries that ``pattern`` finds: the groups of an entry's quoted term and of its places with zone letters."""
    entries = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(names)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(places)).alias("p"))
    bit = lambda x: F.when(x.endswith("A"), 8).when(x.endswith("B"), 4).when(x.endswith("C"), 2).otherwise(1)

    def one(e: Column) -> Column:
        every = F.when(e["p"] == "", F.array(F.lit("0"))).otherwise(F.split(F.upper(e["p"]), ","))
        return bound(lambda name, each: F.transform(each, lambda x: F.struct(name.alias("t"), F.regexp_extract(x, r"^[0-9]+", 0).cast("int").alias("p"), bit(x).alias("z"))), F.replace(e["n"], F.lit("''"), F.lit("'")), every)

    # in order of place, then term: the natural order of structs that begin with these
    every = F.transform(F.flatten(F.transform(entries, one)), lambda s: F.struct(s["p"].alias("p"), s["t"].alias("t"), s["z"].alias("z")))
    flat = F.sort_array(every)
    made = lambda x: F.struct(F.transform(x, lambda s: s["t"]).alias("tokens"), F.transform(x, lambda s: s["p"]).alias("pos"), F.transform(x, lambda s: s["z"]).alias("zone"), F.size(x).alias("length"), F.exists(x, lambda s: s["p"] > 0).alias("has_pos"))
    return F.when(text.isNotNull(), bound(made, flat))


def from_tsvector(text: Column) -> Column:
    """A document of a tsvector's text: ``'fox':2A,6 'the':1``. An entry without places has the unknown place 0, which is next to nothing; without any place the document has no positions."""
    return _from_entries(text, r"'([^']*(?:''[^']*)*)'(?::([0-9A-Da-d,]+))?", 1, 2)


def from_text_form(text: Column) -> Column:
    """The document whose ``text_form`` is ``text``, with positions."""
    return _from_entries(text, r"'([^']*(?:''[^']*)*)':[0-9]+(?:@([0-9A-D,]+))?", 1, 2)
