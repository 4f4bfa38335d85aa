"""Token operators against the libraries and against plain re-encoding."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from flowlens.llm import chunked_bpe, prefix_tokens, simple8b, token_files

ODD = [
    (1, "we're  they'll\n\n  don't 've\t\tx 're"), (2, ""), (3, None), (4, "a<|endoftext|>b .<|endoftext|><|endoftext|> c"), (5, " \n   é́ ñandú 12345 ½ ǅ İK"),
    (6, "word " * 3000), (7, "x" * 2000), (8, " " * 1500 + "end"), (9, "日本語テキスト 🙂🙂"), (9, "日本語テキスト 🙂🙂"), (None, "no id"), (10, "<|startoftext|>Hi there.<|endo"),
    (11, "\r\n\r\n a\x1cb\x85c ..." ), (12, "".join(random.Random(3).choice("ab1 .\n'sé") for _ in range(4000))),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'x' ids", "1 start", "2 row")


@pytest.mark.parametrize("high", [2, 50_000, 1 << 31, 1 << 60, 1 << 64])
def test_simple8b_round_trip(high):
    rng = random.Random(high)
    for n in (0, 1, 59, 60, 61, 255, 256, 257, 3000):
        values = np.array([rng.randrange(1 << rng.randint(0, high.bit_length() - 1)) for _ in range(n)], np.uint64)
        words, offsets = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, n) == values).all()
        assert len(offsets) == -(-n // simple8b.BLOCK)
    if n and high == 2:
        assert len(simple8b.encode(np.zeros(256, np.uint64))[0]) == 6  # 4 * 60 + 15 + 1


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = f"{tmp_path}/tokens"
    token_files.write(token_files.tokenize_words(token_files.in_order(odd), P.path("word_bpe_49k.json"), 2), path)
    got = sorted(token_files.digests(token_files.read(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ODD), key=lambda d: -1 if d is None else d)
    at, text = 0, dict(ODD)
    for r in got:
        ids = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = f"{tmp_path}/none"
    token_files.write(token_files.tokenize_words(token_files.in_order(odd.limit(0)), P.path("word_bpe_49k.json"), 2), empty)
    assert token_files.read(spark, empty).count() == 0


def test_prefix_counts_equal_encoding_every_prefix():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = prefix_tokens.PrefixCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for _, text in ODD:
        text = (text or "")[:400]
        got = np.cumsum(counter.text(text)).tolist()
        assert got == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)], text


def test_token_budget(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = prefix_tokens.token_budget(odd, P.path("byte_bpe_50k.json"), P.PATTERN, 512).collect()
    text = dict(ODD)
    assert len(got) == len(ODD)
    for r in got:
        t = text[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
        assert len(library.encode(t[:r.fit_chars], add_special_tokens=False).ids) <= 512
        assert n > 512 or r.fit_chars == len(t)
    assert prefix_tokens.prefix_counts(odd.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def _library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 9), (64, 16), (50, 3)])
def test_chunked_encoding(spark, odd, chunk, overlap):
    library, ranks = _library(), P.path("byte_bpe_multi_50k.tiktoken")
    encoded = chunked_bpe.encode(odd, ranks, P.PATTERN, chunk=chunk, overlap=overlap)
    text = dict(ODD)
    rows = encoded.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text[r.doc_id] or ""), r.doc_id
    for r in chunked_bpe.decode(encoded, ranks, P.PATTERN).collect():
        assert bytes(r.raw).decode() == (text[r.doc_id] or "")
    for r in chunked_bpe.round_trip(encoded, ranks, P.PATTERN).collect():
        ids = library.encode_ordinary(text[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    assert chunked_bpe.encode(odd.limit(0), ranks, P.PATTERN).count() == 0
