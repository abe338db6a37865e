"""Classifier on held-out rows, chat round trips, url rules and aliases, decontamination, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm.chat import Template, escape, escape_role, format_conversations, parse_turn, read_back, segments, unescape, unescape_role
from harrow.llm.decontamination import FMIndex, contamination_report, decontaminate, remove_spans, suffix_array
from harrow.llm.quality import features, estimated_prior, fit_nnpu, fit_quality, held_out, score_quality
from harrow.llm import decontamination, entries
from harrow.llm.url_filter import EXPRESSION_RULES, filter_urls

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([r.score >= 0.5 for r in rows if r.quality == 1]) > 0.95
    assert np.mean([(a > b) for a in good for b in bad]) > 0.98


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (None, "x" * 200_000, 5.0), (3, "a b", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_quality(none, fit_quality(none, labels.limit(0))).count() == 0
    assert np.isfinite(features([None, b"", b"a"])).all()


def test_nnpu_finds_the_negatives():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (500, 5)), np.concatenate((rng.normal(1, 1, (700, 5)), rng.normal(-1.5, 1, (300, 5))))
    s = fit_nnpu(p, u, 0.7).scores(u)
    assert (s[:700] >= 0.5).mean() > 0.9 and (s[700:] < 0.5).mean() > 0.9


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.7, 0.9):
        n = int(4000 * prior)
        p, u = rng.normal(1, 1, (2000, 5)), np.concatenate((rng.normal(1, 1, (n, 5)), rng.normal(-1.5, 1, (4000 - n, 5))))
        u = u[rng.permutation(len(u))]
        assert abs(estimated_prior(p, u) - prior) < 0.06


def test_quality_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"words of text {i} and more") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    one, two = (fit_quality(d, labels) for d in (docs.repartition(3), docs.repartition(5)))
    assert np.array_equal(one.weights, two.weights)


def test_chat_escape():
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice(["<", "|", "\\", ">", "im_end", "\n", "n", "é"]) for _ in range(rng.randrange(12)))
        assert "<|" not in escape(t) and unescape(escape(t)) == t
        assert "\n" not in escape_role(t) and unescape_role(escape_role(t)) == t
        assert parse_turn("".join(s for s, _ in segments(t, t, Template())), Template()) == (t, t)


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>"), (2, 0, "assistant", "early"), (2, 0, "assistant", "early"), (3, 1, "assistant", "b\n"), (3, 0, "user", "a"), (3, None, None, "end"), (None, 0, "user", "x" * 50_000), (None, 1, "we\nird", "y")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, place string, segments int")
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(s) for r, t in turns for s, _ in segments(r, t, Template()))
    assert {c: (r.valid, r.first_refused) for c, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 2), None: (False, 1)}
    assert read_back(format_conversations(df.limit(0))).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.NET/x?q", ""), (2, "http://www.example.net/en/1", None), (3, "http://example.net/en", ""), (4, "http://xexample.com/de/", ""), (5, "https://b.example.com/de/#f", ""),
        (6, None, ""), (7, "no scheme", ""), (8, "http://s.io/1", link.format("http://bad.net/")), (9, "http://s.io/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (10, "http://t.io/1", link.format("http://www.example.net/en/1")), (11, "http://t.io/2", link.format("//t.io/1") + '<meta http-equiv=refresh content="0;url=http://bad.net/2">'),
        (12, "http://u.io/", ""), (12, "http://u.io/", ""), (13, "http://bad.net", ""), (14, "http://q.org/fr/", link.format("http://bad.net/")), (None, "http://v.io/?a=b&c=d", ""),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, verdict string, node string")
    redirects = spark.createDataFrame([("http://V.io/?a=b&c=d#z", "http://e.example.com/de/"), ("bad", "worse")], "from_url string, to_url string")
    got = {}
    for r in filter_urls(df, RULES, redirects).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.net", "/x", "net/", "block")] and got[2] == [("www.example.net", "/en/1", "example.net/en/", "allow")]
    assert got[3] == [("example.net", "/en", "net/", "block")] and got[4] == [("xexample.com", "/de/", None, "allow")]
    assert got[5] == [("b.example.com", "/de/", "example.com/de/", "block")] and got[6] == got[7] == [("", "", None, "allow")]
    assert got[8][0][2:] == (None, "allow") and got[9][0][2:] == (None, "allow")  # q.org/fr/ in the class is allowed
    assert got[10][0][3] == "allow" and got[11][0][3] == "allow" and len(got[12]) == 2 and got[13] == [("bad.net", "", None, "allow")]
    assert got[14] == [("q.org", "/fr/", "org/fr/", "allow")] and got[None][0][2:] == (None, "block")
    without = {r.page_id: r.verdict for r in filter_urls(df.where("page_id <> 14"), RULES).collect()}
    assert without[8] == without[9] == "block"
    assert filter_urls(df.limit(0), RULES).count() == 0


def test_urls_with_many_rules(spark):
    more = [(f"h{i}.example", f"/p{i}", "block" if i % 2 else "allow") for i in range(EXPRESSION_RULES + 5)]
    urls = [f"https://{'www.' if i % 3 else ''}h{i}.example/p{i}{'/x' if i % 2 else ''}" for i in range(0, EXPRESSION_RULES, 7)]
    urls += ["http://a.net/", "http://www.example.net/en/1", "http://example.com/de/", None, "", "none", "http://../", "http:///p1", *["http://h1.example/p1"] * 50]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    table = spark.createDataFrame(RULES + more, "host string, path string, verdict string")
    by_list, by_table = (sorted(map(tuple, filter_urls(df, r).collect())) for r in (RULES + more, table))
    assert by_list == by_table and len(by_list) == len(urls)
    for i, host, path, rule, verdict in by_list:
        fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in RULES + more if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        assert (rule, verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_url_query_with_redirects_against_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    hosts = ["a.net", "b.org", "www.example.net", "c.io", "EXAMPLE.com", "d.io", "x.d.io"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice([f'/p{rng.randrange(400)}'] * 12 + ['', '/en/', '/de/1', '/fr/', '/q?a=1&b=2'])}{rng.choice(['', '', '#f'])}"
    rel = lambda: rng.choice([url(), url(), f"/p{rng.randrange(400)}", f"p{rng.randrange(400)}", f"//c.io/p{rng.randrange(400)}", "/q?a=1&amp;b=2"])
    html = lambda: rng.choice(["", "", "<p>x</p>", f'<LINK rel="canonical" href="{rel()}">', f'<meta http-equiv="Refresh" content="0; URL={rel()}">', f"<link href='{rel()}' rel='canonical'/><meta content=\"1;url={rel()}\" http-equiv=refresh>"])
    rows = [(i, url(), html()) for i in range(400)] + [(400, None, html()), (401, "no scheme", html()), (1, url(), None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, entries.QUERIES["op5_url_filter"](spark, f"file://{tmp_path}").collect())))
    assert got == sorted(map(repr, c.sql(entries.SQL["op5_url_filter"]).fetchall()))
    without = c.sql(entries.SQL["op5_url_filter"].replace("FROM pages)", "FROM (SELECT page_id, url, '' AS html FROM pages))")).fetchall()
    assert got != sorted(map(repr, without))  # the edges decide some verdicts


def brute_hits(text, items):
    w = [x.decode() for x in WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))] if text else []
    hit, names = set(), set()
    for name, item in items:
        v = [x.decode() for x in WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), item.encode()))] if item else []
        for k in range(max(1, len(v) - 12) if v else 0):
            g = v[k : k + 13]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("pattern_bytes", [1 << 25, 400])
def test_decontamination(spark, pattern_bytes):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(6)] + ["É", "ß1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 13, 20])))) for i in range(25)] + [(99, None), (98, ""), (97, "?!"), (7, "w1 w2 w3 w4")]
    rows = [(i, ", ".join(rng.choice(words) for _ in range(rng.randrange(400))) + (" " + rng.choice(items[:25])[1] if i % 3 == 0 else " zzz")) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "..."), (203, items[4][1].upper() * 1), (203, items[4][1]), (None, items[5][1])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_hit int, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination_report(decontaminate(docs, bench, pattern_bytes=pattern_bytes)).collect()), key=repr)
    want = []
    for d, t in rows:
        n, hit, k, digest = brute_hits(t, items)
        want.append((d, n, hit, k, digest, hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)
    assert decontaminate(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_items_without_an_id_hit_and_count(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (7, "two three"), (None, None)], "item_id long, text string")
    for size in (1 << 25, 3):
        got = {r.doc_id: tuple(r)[1:5] for r in contamination_report(decontaminate(docs, bench, pattern_bytes=size)).collect()}
        assert got == {1: (3, 3, 2, hashlib.sha256(b"7").hexdigest()), 2: (1, 0, 0, hashlib.sha256(b"").hexdigest())}


def test_long_texts_are_indexed_in_stretches(monkeypatch):
    rng = random.Random(5)
    words = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 9, 13, 15])))) for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 300, 7, 90)]
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 40)
    got = decontamination.scan_shard([t.encode() for t in texts], decontamination.Patterns([(str(i), t.encode()) for i, t in items]))
    for t, (n, hit, _, names, _) in zip(texts, got, strict=True):
        assert (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest()) == brute_hits(t, items)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    t = np.append(rng.integers(0, 4, 500), 0)
    sa = suffix_array(t)
    assert sorted(sa) == list(range(501))
    index = FMIndex(t, 4)
    for n in (1, 2, 5):
        p = rng.integers(1, 4, (30, n))
        which, low, high = index.search(p, np.full(30, n))
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for k in range(30):
            assert found.get(k, []) == [i for i in range(501 - n) if (t[i : i + n] == p[k]).all()]


def test_removal_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two THREE, four! And that")], "doc_id long, text string")
    r = decontaminate(docs, spark.createDataFrame([(1, "one two three four")], "item_id long, text string")).first()
    assert remove_spans(b"Keep this. One two THREE, four! And that", r.byte_spans) == b"Keep this. ! And that" and r.word_spans == [2, 6]


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        before, at = at, spark.read.parquet(f"file://{tmp_path}/{name}")
        assert 0 < at.count() <= before.count() and at.exceptAll(before).count() == 0
    last = c.STAGES[-1][1](spark, at, sf)
    assert last.count() == at.count() and last.where("not round_trip or n_tokens <> size(ids)").count() == 0
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in at.collect():
        n, hit, _, _ = brute_hits(r.text, benchmark)
        assert not (hit and 20 * hit >= n)


def test_pipeline_odd_rows(spark, sf):
    import corpus_pipeline as c

    text = "The thing that was there and then it went on to be of use for them and the rest. " * 3
    rows = [(1, None), (2, ""), (3, text), (3, text), (3, text + "x"), (None, text), (None, None)]
    at = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, at, sf)
        assert out.count() <= 7
        assert stage(spark, at.limit(0), sf).count() == 0
        more = at.withColumns({"n_words": F.lit("a"), "score": F.lit("b"), "items": F.lit("c"), "_row": F.lit(1), "_text": F.lit("d"), "key": F.lit(2)})
        if n < 3:
            clash = stage(spark, more, sf)
            assert clash.columns == more.columns and clash.count() == out.count() and clash.where("score = 'b' and items = 'c'").count() == out.count()
        if n == 1:
            assert out.where("doc_id = 3").count() == 1


def test_near_duplicates_by_row(spark, sf):
    import corpus_pipeline as c

    one, two, three, four = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, one), (5, one), (5, two), (6, two + " more"), (6, three), (None, four), (None, four), (None, one), (7, None), (7, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = c.near_duplicate(spark, docs, sf).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted([(1, one), (5, two), (6, three), (None, four), (7, None), (7, None), (None, None)], key=key)
    assert c.near_duplicate(spark, docs.limit(0), sf).count() == 0
