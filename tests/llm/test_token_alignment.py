from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest_data import frame_rows
from holdfast.llm import token_alignment

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["two  spaces", " leads", "trails ", "tab\tand\nnewline \n x", "▁ is no space", "a▁b c", "no break  space", "<s> </s> <unk> <0x41>",
       "<|endoftext|> is text", "x \x1c y", "nul \x00 here", "日本語 テキスト と 😀 🇩🇪", "é é ﬁ ½ Ａ", "　wide　 space", "don't I'll 've", " ", "\n",
       "﻿bom", "a" * 300, "zero​width ‍ joiner", "İstanbul ß", "\u0085next  line"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public.path(token_alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path(token_alignment.TOKENIZER_B))


def plain(rows, libraries) -> list[tuple]:
    """Whole texts encoded at once, byte by byte."""
    a, b = libraries
    symbols = {v: k for k, v in zip(range(256), tokenizers.pre_tokenizers.ByteLevel.alphabet())}
    decoder = tokenizers.decoders.ByteLevel()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
    assert len(byte_of) == len(symbols) and decoder is not None
    linked, held, out = [], Counter(), []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        whole = b" " + (text or "").encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            linked.append(None)
            continue
        owner_a = [k for k, r in enumerate(raw_a) for _ in r]
        owner_b = [k for k, r in enumerate(raw_b) for _ in r]
        links = list(dict.fromkeys(zip(owner_a, owner_b)))
        ends = sorted(set(np.cumsum(list(map(len, raw_a)))) & set(np.cumsum(list(map(len, raw_b)))))
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(ids_a[k]) for k in dict.fromkeys(owner_a[start:end])) + "|"
                          + ",".join(str(ids_b[k]) for k in dict.fromkeys(owner_b[start:end])))
            start = end
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        held.update(set(pairs))
        linked.append((len(ids_a), len(ids_b), groups, pairs))
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    for (doc, _), found in zip(rows, linked):
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = found
            out.append((doc, n_a, n_b, len(groups), len(pairs), sum(held[p] == highest[p[0]] for p in pairs),
                        sum(held[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(texts):
    dice = random.Random(3)
    mixed = [" ".join(dice.choice(ODD) for _ in range(5)) for _ in range(10)]
    strange = ["".join(chr(dice.choice([32, 32, 9, 10, 97, 98, 0x2581, 0xe9, 0x4e2d, 0x1f600, 39])) for _ in range(40)) for _ in range(25)]
    return [*texts, *((1000 + i, t) for i, t in enumerate([*ODD, *mixed, *strange])), (2 ** 53 + 1, "big id"), (None, "no id")]


def as_frame(spark, docs, rows):
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return spark.createDataFrame([(i, t, *("x" for _ in names)) for i, t in rows],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)).repartition(5)


def test_documents_equal_whole_texts_compared_byte_by_byte(spark, docs, rows, libraries):
    got = frame_rows(token_alignment.align_documents(as_frame(spark, docs, rows)), COLUMNS)
    assert got == plain(rows, libraries)
    assert {g[1] == 0 for g in got} == {True, False}


def test_portions_trees_and_flushes_change_nothing(spark, docs, rows, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "MOST_SENT", 700)
    monkeypatch.setattr(token_alignment, "MOST_HELD", 300)
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    monkeypatch.setattr(token_alignment, "BUCKETS", 4)
    some = rows[::3] + rows[:5]
    assert frame_rows(token_alignment.align_documents(as_frame(spark, docs, some)), COLUMNS) == plain(some, libraries)


def test_counts_and_groups_are_readable(spark, libraries):
    frame = spark.createDataFrame([(1, "some words"), (2, "some"), (3, None)], "doc_id long, text string")
    counts = {(r.id_a, r.id_b): (r.n_docs, r.best) for r in token_alignment.pair_counts(token_alignment.pair_table(frame)).collect()}
    a, b = libraries
    some = (a.encode(" some").ids[0], b.encode("some")[0])
    assert counts[some] == (2, True)
    assert [r.groups for r in token_alignment.groups(frame).orderBy("doc_id").collect()][1:] == [f"{some[0]}|{some[1]}", ""]


def test_no_documents(spark, no_docs):
    assert token_alignment.align_documents(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (1, ""), (2, "a▁")], "doc_id long, text string")
    assert frame_rows(token_alignment.align_documents(nothing), COLUMNS) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 1, 2)]


def test_the_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 35, 5000)) // (token_alignment.BUCKETS << 20) * (token_alignment.BUCKETS << 20)
    keys = np.unique(keys) + 17
    sizes, bits, ordered = token_alignment.minimal_hash(keys)
    table = token_alignment.PairTable([int(token_alignment.bucket_of(keys[:1])[0])], [sizes], [bits], [ordered])
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    assert (table.keys[table.slots(keys)] == keys).all()
    with pytest.raises(ValueError):
        table.slots(keys[:1] + 1)
