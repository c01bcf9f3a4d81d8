"""Byte-level BPE by depth-first traversal of a word trie.

The encoding of a string is fixed by its last token and the encoding of what precedes it: token ``t`` ends prefix
``q + t`` exactly when ``t`` encodes to itself and no merge crosses the border between the last token of ``q`` and
``t``. The distinct words of a batch, sorted as bytes, are the leaves of their trie in depth-first order: each word
keeps the states of the prefix it shares with the word before and only the rest is computed. No merge is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from holdfast.llm.scratch import once, small_batches

TOKENIZER = "byte_bpe_50k.json"
# How the file's pre-tokeniser cuts text into words (fixed value); white space is the Unicode property.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Encodings a task remembers, about 200 bytes each, and borders of token pairs, about 100 bytes each.
MOST_WORDS, MOST_PAIRS = 200_000, 500_000


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    """Encoder and decoder of a tokenizer file with byte-level BPE, whose merges only use tokens made before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols = _bytes_of_symbols()
        ids = model["model"]["vocab"]
        raw = {token: bytes(map(symbols.__getitem__, token)) for token in ids}
        self.bytes_of = {ids[token]: value for token, value in raw.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.cut = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                      if self.special else r"((?!))")
        # Rank of each merge, and the parts of each merged token.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            if any(p in self.parts and self.rank[self.parts[p]] > rank for p in pair):
                raise ValueError("a merge uses a token made later")
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(whole, pair)
        self.borders: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # Tokens by their bytes from the last to the first; entry 256 of a node is its token.
        self.backwards: dict = {}
        own = {i for i in self.bytes_of if i not in self.special.values() and self._encodes_to_itself(i)}
        for i in own:
            node = self.backwards
            for byte in reversed(self.bytes_of[i]):
                node = node.setdefault(byte, {})
            node[256] = i

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token while it is made, each with the rank of the merge that consumes it."""
        edge, until = [], float("inf")
        while True:
            edge.append((token, until))
            if token not in self.parts:
                return edge
            until = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def _first_crossing(self, left: int, right: int) -> float:
        """Rank of the first merge that takes place across the border of two tokens."""
        first = float("inf")
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                rank = self.rank.get((a, b), first)
                # Merges of one rank happen from left to right: one inside the left token comes first.
                if rank < first and rank < a_until and rank <= b_until:
                    first = rank
        return first

    def _encodes_to_itself(self, token: int) -> bool:
        if token not in self.parts:
            return len(self.bytes_of[token]) == 1
        left, right = self.parts[token]
        return (self._first_crossing(left, right) >= self.rank[left, right]
                and self._encodes_to_itself(left) and self._encodes_to_itself(right))

    def border(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        known = self.borders.get((left, right))
        if known is None:
            if len(self.borders) >= MOST_PAIRS:
                self.borders.clear()
            known = self.borders[left, right] = self._first_crossing(left, right) == float("inf")
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Each distinct word with its ids, in byte order; words must not be empty."""
        before, last = b"", [-1]  # last[n]: the last token of the first n bytes
        backwards, sizes, border = self.backwards, self.bytes_of, self.border
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del last[shared + 1:]
            for end in range(shared, len(word)):
                node, start = backwards, end
                while True:
                    node = node[word[start]]
                    token = node.get(256)
                    if token is not None and (start == 0 or border(last[start], token)):
                        break
                    start -= 1
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(sizes[last[end]])
            before = word
            yield word, tuple(reversed(ids))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; those of a batch share one trie. NULL is the empty text."""
        cut: list[list[str]] = []
        for text in texts:
            pieces: list[str] = []
            for at, part in enumerate(self.specials.split(text or "")):
                pieces += [part] if at % 2 else self.cut.findall(part)
            cut.append(pieces)
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        known = self.words
        new = {p.encode(): p for p in set().union(*cut) if p not in known and p not in self.special}
        known.update({p: (i,) for p, i in self.special.items()})
        for word, ids in self.encode_words(new):
            known[new[word]] = ids
        return [np.array([i for p in pieces for i in known[p]], dtype=np.int32) for pieces in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def token_ids(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Ids of a text column; ``tokenizer`` is a path every worker has, or a name among the public files."""
    def encode(texts: pd.Series) -> pd.Series:
        encoder = once(("trie", tokenizer), lambda: TrieEncoder(_path(tokenizer)))
        return pd.Series(encoder.encode(texts), dtype=object)

    # Spark would repeat a deterministic function inside each one that uses its result.
    return F.pandas_udf(encode, ArrayType(IntegerType())).asNondeterministic()(text)


def decoded_text(ids: Column, tokenizer: str = TOKENIZER) -> Column:
    """The text of an id column; NULL stays NULL."""
    def decode(lists: pd.Series) -> pd.Series:
        encoder = once(("trie", tokenizer), lambda: TrieEncoder(_path(tokenizer)))
        return pd.Series([None if i is None else encoder.decode(i.tolist()) for i in lists], dtype=object)

    return F.pandas_udf(decode, StringType())(ids)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, text`` per row, ``text`` decoded from the ids, in one step of one process.

    The same as ``decode(encode(docs))`` with half the encoders in memory.
    """
    small_batches(docs.sparkSession)

    def both(texts: pd.Series) -> pd.DataFrame:
        encoder = once(("trie", tokenizer), lambda: TrieEncoder(_path(tokenizer)))
        ids = encoder.encode(texts)
        return pd.DataFrame({"ids": ids, "text": [encoder.decode(i.tolist()) for i in ids]})

    kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("text", StringType())])
    found = F.pandas_udf(both, kind).asNondeterministic()(F.col("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.ids", "found.text")


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` per row; NULL and empty texts have no ids. Repeated rows are encoded alike; other columns are
    not read."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", token_ids(F.col("text"), tokenizer).alias("ids"))


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, text`` of rows with ids."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids", decoded_text(F.col("ids"), tokenizer).alias("text"))


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows with ids and text, and the columns in ``more``."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"), *more)
