"""URL filtering with redirect equivalence, in DataFrame operations only.

Rules (host, path, verdict) fit a host and its subdomains where the url's path starts with the rule's; the longest wins. Redirects (meta refresh,
and a table of redirects where one is given) and canonical links make edges between urls; distributed connected components over them
make classes of aliases, and block decisions spread to every alias that no rule judges, unless a rule allows some url of the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of one expression, each url is held against all of them; more are joined to the distinct urls by suffixes of their hosts.
EXPRESSION_RULES = 200
#: Rules, or urls with a verdict, that are broadcast (about 150 bytes each); beyond that a salted shuffle is used, with so many salts.
BROADCAST_ROWS, SALTS = 300_000, 16
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"'\s/>][^>]*>?"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"'\s/>][^>]*>?"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased A-Z; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The vertex of a url: its scheme and host lower-cased, without a fragment; null where there is no ``://``."""
    plain = F.regexp_extract(url, r"^[^#]*", 0)
    head = F.regexp_extract(plain, r"^.*?://[^/?]*", 0)
    return F.when(F.instr(plain, "://") > 0, F.concat(F.translate(head, UPPER, LOWER), plain.substr(F.length(head) + 1, F.length(plain))))


def resolved(link: Column, url: Column) -> Column:
    """An absolute url of ``link`` as found in the page at ``url``."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, origin = F.regexp_extract(url, r"^[^:/?#]+:", 0), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones allow goes first."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    each = []
    for h, p, v in rules:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        each.append(F.when(fits, F.struct(F.lit(len(h + p)).alias("n"), F.lit(v == "allow").alias("first"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
    best = F.array_max(F.array(*each))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, one row of which at most fits each; rows of ``left`` without a first key go round the exchange, and one
    key's rows are spread over ``SALTS`` tasks."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = left.where(F.col(on[0]).isNotNull()).withColumn("_salt", salt).join(spread, [*on, "_salt"], "left").drop("_salt")
    return some.unionByName(left.where(F.col(on[0]).isNull()), allowMissingColumns=True)


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``own``, a struct(rule, verdict) of the longest rule that fits; ``rules``: a list, or a table (host, path, verdict)."""
    if not isinstance(rules, DataFrame):
        for _, _, v in rules:
            if v not in ("allow", "block"):
                raise ValueError(f"no verdict: {v}")
        if len(rules) <= EXPRESSION_RULES:
            return rows.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    table = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), "verdict").where("verdict in ('allow', 'block')").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # each distinct url once, and only hosts of which a suffix has rules go on to the paths
    urls = rows.where("host <> ''").select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pairs = urls.join(F.broadcast(table), "_suffix")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = urls.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["_suffix", "_salt"])
    rule = F.concat("_suffix", "_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("first"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    fits = pairs.where(F.col("path").startswith(F.col("_path"))).groupBy("host", "path").agg(best.alias("b"))
    return _joined(rows, fits.select("host", "path", F.struct("b.rule", "b.verdict").alias("own")), ["host", "path"])


def link_edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(a, b): urls that a canonical link or a meta refresh of a page's html makes aliases."""
    url, html = F.col(url_column), F.col(html_column)
    some = pages.where(html.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1)).alias("links"))
    return some.select("url", F.explode("links").alias("link")).select(node(F.col("url")).alias("a"), node(resolved(F.col("link"), F.col("url"))).alias("b")).where("a is not null and b is not null")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str | None = "html") -> DataFrame:
    """``id_column``, host, path, rule (host and path of the rule that fits, else null), verdict: one row for each row of ``pages``.

    ``rules``: a list, or a table of any size (host, path, verdict). A url that a rule fits has that rule's verdict. Any other is blocked if its class of aliases holds a url that a rule blocks and none that a
    rule allows, else allowed. ``redirects`` (from_url, to_url) are edges besides those of the html. Null urls and urls without ``://``
    have empty host and path, no aliases and the verdict allow; null html has no links; repeated rows and null ids stay; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    judged = rows.select("id", node(F.col("url")).alias("node"), host.alias("host"), path.alias("path"))
    judged = with_rule(judged, rules)
    edges = [link_edges(pages, url_column, html_column)] if html_column else []
    if redirects is not None:
        edges.append(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    verdict = F.coalesce("own.verdict", F.lit("allow"))
    if edges:
        every = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        labels = connected_components(every)
        h, p = url_parts(F.col("vertex"))
        by_rule = with_rule(labels.select("vertex", "root", h.alias("host"), p.alias("path")), rules).select("vertex", "root", F.col("own.verdict").alias("v"))
        classes = by_rule.groupBy("root").agg(F.max(F.col("v") == "block").alias("blocks"), F.max(F.col("v") == "allow").alias("allows"))
        spread = labels.join(classes.where("blocks and not coalesce(allows, false)"), "root", "left_semi").select(F.col("vertex").alias("node"), F.lit("block").alias("spread"))
        judged = _joined(judged, spread, ["node"])
        verdict = F.coalesce("own.verdict", "spread", F.lit("allow"))
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
