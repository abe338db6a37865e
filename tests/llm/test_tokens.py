"""Token operators against the libraries on whole texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from harrow.llm.bpe import decode, digests, encode, pieces
from harrow.llm.token_counts import Counter, count_tokens
from harrow.llm.token_files import EliasFano, read_token_files, write_token_files
from harrow.llm.units import Units, cut_places, cuts_at_units, settings_of

ODD = [None, "", " ", "\n", "a", "a b", "a  b", " a", "a ", "a\n\nb", "a \n b", "a\tb c", "don't stop 'll's", "é ́x", "İΣς ΑΣ", "x<|endoftext|> y<|endoftext|>", "<|STARTOFTEXT|> <|startOfText|>", "h\u0331 H\u0331 K\u030a", "l'été don'T it'S. x'y", "a\u00a0 b \u2003c\u2028 d", "mot\u00d7 mot\u00f7. é. Éa, Ŧa Aŧ", "don<\u0338 a=\u0338", "<|startoftext|>a b<|endoftext|>", "日本語 テキスト", "🙂 🙂🙂", "a b c", "a\x00b c", "a\x1cb c", "1234 56 7", "!!! a??? b", "x" * 3000, " " * 3000, "ab " * 9000, "\n".join(["line one"] * 500)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = [(i, t, "clash") for i, t in enumerate(ODD + real)] + [(None, "null id", "x"), (3, "a\n", "x"), (3, "a\n", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)


def key(x):
    return (x[0] is not None, x[0] or 0, *map(str, x[1:]))


def test_units_begin_where_a_pre_splitting_cuts():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in filter(None, ODD):
        buf = np.frombuffer(t.encode(), dtype=np.uint8)
        edges = [0, *cut_places(buf).tolist(), len(buf)]
        parts = [bytes(buf[a:b]).decode() for a, b in zip(edges[:-1], edges[1:])]
        assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(t, add_special_tokens=False).ids


def test_units_of_random_texts():
    rng = random.Random(3)
    bits = ["ab", " ", "  ", "é", "É", "'s", "\n", "12", " the", "<|endoftext|>", "<|EndOfText|>", "X Y ", "----", "🙂", "\u00a0", "\u0301", "\u0331", "\t", "...", "Ŧ", "ß", "\u2009", "<", "|>", "\x1c", "'LL"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for name, between, fold in (("byte_bpe_50k.json", "\n", False), ("word_bpe_49k.json", " | ", True)):
        tok = Tokenizer.from_file(P.path(name))
        assert cuts_at_units(settings_of(tok))
        encode = lambda x: [e.ids for e in tok.encode_batch_fast(x, add_special_tokens=False)]  # noqa: B023, E731
        flat, size = Units(encode, between).ids(pa.array(texts), fold)
        want = encode(texts)
        assert size.tolist() == list(map(len, want))
        assert flat.tolist() == [i for x in want for i in x]


def test_other_pre_splittings_are_encoded_whole(tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    raw = tok.to_str().replace('"add_prefix_space":false,"trim_offsets":true,"use_regex":true', '"add_prefix_space":false,"trim_offsets":true,"use_regex":false')
    assert raw != tok.to_str()
    (tmp_path / "other.json").write_text(raw)
    c = Counter(str(tmp_path / "other.json"))
    assert c.units is None
    t = "one two, three " * 50
    assert c.counts(pa.array([t]), 64, 8).tolist() == [len(Tokenizer.from_str(raw).encode(t, add_special_tokens=False).ids)]


def test_counts(docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    for chunk, overlap in ((16384, 512), (200, 8)):
        got = [tuple(r) for r in count_tokens(docs, P.path("byte_bpe_50k.json"), chunk=chunk, overlap=overlap).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_counts_are_those_of_the_whole(name):
    c = Counter(P.path(name))
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "é", "'s", "\n", "12", " the", "<|endoftext|>", "x y z ", "----", "🙂", "日本語", "\u00a0"]) for _ in range(400)) for _ in range(60)] + ["y" * 5000 + " a b"]
    want = c.many(texts)
    for chunk, overlap in ((64, 4), (100, 50), (4096, 256)):
        assert c.counts(pa.array(texts), chunk, overlap).tolist() == want


def test_counts_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, P.path("piece_bpe_32k.model")).collect()}
    assert got == {1: len(model.encode("hello there")), 2: 0}


def test_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    for piece in (65_536, 50):
        got = [tuple(r) for r in digests(decode(encode(docs, path, P.PATTERN, piece=piece), path, P.PATTERN)).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert "".join(pieces("ab cd " * 100, 7)) == "ab cd " * 100


@pytest.mark.parametrize("segment", [1 << 20, 300])
def test_token_files(spark, docs, tmp_path, segment):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = f"file://{tmp_path}/t{segment}"
    write_token_files(docs, path, P.path("word_bpe_49k.json"), 1, segment_ids=segment)
    got = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda x: x[1])
    assert [x[0] or -1 for x in got] == sorted(x[0] or -1 for x in got)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = [(r.doc_id, zlib.crc32(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect()]
    assert sorted(((x[0], zlib.crc32(x[3])) for x in got), key=key) == sorted(want, key=key)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, most in ((0, 0), (1, 1), (1, 0), (5, 5), (100, 10_000), (1000, 3), (20_000, 1 << 40), (9, (1 << 64) - 1)):
        v = np.sort(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
        bits, low, high = EliasFano.encode(v, most)
        f = EliasFano(n, bits, low, high)
        assert f.select(np.arange(n)).tolist() == v.tolist()
        assert f.before.dtype == np.uint32 and len(f.before) <= 1 + len(high) // 64
        assert len(low) + len(high) <= (n * (3 + max(0, (most // max(n, 1)).bit_length())) + 23) // 8


def test_token_files_refuse_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError):
        write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "file:///tmp/never", P.path("word_bpe_49k.json"), 1)


def test_token_files_with_far_ids(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b") for i in (-(2**63), 2**63 - 1, 0, None, None, 5)], "doc_id long, text string").coalesce(1)
    write_token_files(df, f"file://{tmp_path}/far", P.path("word_bpe_49k.json"), 1)
    got = [r.doc_id for r in read_token_files(spark, f"file://{tmp_path}/far").orderBy("start").collect()]
    assert got == [None, None, -(2**63), 0, 5, 2**63 - 1]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    p = P.path("byte_bpe_multi_50k.tiktoken")
    assert digests(decode(encode(none, p, P.PATTERN), p, P.PATTERN)).count() == 0
    write_token_files(none, f"file://{tmp_path}/e", P.path("word_bpe_49k.json"), 1)
    assert read_token_files(spark, f"file://{tmp_path}/e").count() == 0
