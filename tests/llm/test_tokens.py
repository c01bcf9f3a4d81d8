"""Encoding against the public libraries; lengths against a plain count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest_data import frame_rows
from holdfast.llm import length_histogram, trie_encoding

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path(trie_encoding.TOKENIZER))


@pytest.fixture(scope="module")
def encoder():
    return trie_encoding.TrieEncoder(public.path(trie_encoding.TOKENIZER))


def test_queries_digest_what_the_library_gives(docs, texts, no_docs, library):
    found = trie_encoding.digests(trie_encoding.decode(trie_encoding.encode(docs)))
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(plain.encode()).hexdigest()))
    assert frame_rows(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=repr)
    both = trie_encoding.digests(trie_encoding.round_trip(docs))
    assert frame_rows(both, both.columns) == frame_rows(found, both.columns)
    assert trie_encoding.decode(trie_encoding.encode(no_docs)).count() == 0
    assert trie_encoding.round_trip(no_docs).count() == 0


def test_random_text_and_special_tokens(encoder, library):
    pick = random.Random(5)
    some = [" ", "\n", "'s", "<|endoftext|>", "aaaa", "0", "é", "日", "😀", "=-", " ", "　", "\x1c", "th"]
    batch = ["".join(pick.choice(some) if pick.random() < 0.4 else chr(pick.choice((pick.randrange(32, 0x250), pick.randrange(0x4E00, 0x4E50))))
                     for _ in range(400)) for _ in range(150)]
    batch += ["a" * 3000, "ab" * 2000, " " * 999, "<|endoftext|>" * 3, "<|endoftext|", "x <|endoftext|>  y"]
    for text, ids in zip(batch, encoder.encode(batch)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids.tolist()) == text


def test_shared_prefixes_do_not_change_encodings(encoder):
    words = [b"there", b"the", b"therefore", b"th", b"there's", b"zebra"]
    together = dict(encoder.encode_words(words))
    assert all(dict(encoder.encode_words([w]))[w] == together[w] for w in words)
    assert list(together) == sorted(words)


def test_histogram(docs, texts, no_docs, library):
    counts = length_histogram.histogram(docs)
    # A special token's name is ordinary text here, and no text holds one.
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    assert dict(tuple(r) for r in counts.collect()) == Counter(lengths)
    rows = {r["context_limit"]: r for r in length_histogram.context_limits(counts).collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r["docs_to"] == sum(n <= limit for n in lengths) and r["tokens_to"] == sum(n for n in lengths if n <= limit)
        assert r["docs_over"] == sum(n > limit for n in lengths) and r["tokens_over"] == sum(n for n in lengths if n > limit)
        assert r["kept_tokens"] == sum(min(n, limit) for n in lengths)
    at = length_histogram.at_limit(counts, 77).first()
    assert tuple(at) == (77, sum(n > 77 for n in lengths), sum(min(n, 77) for n in lengths), sum(max(n - 77, 0) for n in lengths))
    middle = {r["share"]: r["length"] for r in length_histogram.quantiles(counts, [0.25, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert middle == {s: ordered[-(-int(s * len(ordered) * 4) // 4) - 1] for s in (0.25, 0.5, 1.0)}
    empty = length_histogram.histogram(no_docs)
    assert length_histogram.context_limits(empty).count() == 0 and tuple(length_histogram.at_limit(empty, 5).first()) == (5, 0, 0, 0)


def test_lengths_beyond_one_block(spark):
    counts = spark.createDataFrame([(n, 1 + n % 3) for n in range(0, 5000, 7)], "length long, docs long")
    rows = length_histogram.running(counts).orderBy("length").collect()
    total = sum(r["docs"] for r in rows)
    assert all(r["docs_to"] + r["docs_over"] == total for r in rows)
    assert rows[-1]["tokens_to"] == sum(r["length"] * r["docs"] for r in rows) and rows[-1]["tokens_over"] == 0
    assert counts.agg(F.sum("docs")).first()[0] == total
