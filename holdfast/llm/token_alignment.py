"""Cross-tokenizer alignment: how often two tokenizers' tokens cover the same bytes.

Tokenizer A is byte-level BPE, B sentencepiece BPE; both see a space before the text. Neither has a token over a space
that follows a letter, so a text falls into segments, each a space and what follows it, that are encoded and aligned once
per batch of texts. A link is a pair of tokens that share bytes.

1. The first pass writes, per task and bucket of A ids, the distinct pairs and how many of the task's documents hold them.
2. A minimal perfect hash per bucket (levels of bits, a key in the first level where it is alone; its slot is the rank of
   its bit) numbers the distinct pairs. A bucket has at most as many pairs as its A ids times the vocabulary of B.
3. Each group of lists becomes a dense vector of counts by slot, and the vectors of a bucket are summed in a tree.
4. The second pass aligns the documents again and looks up counts by slot; the key kept beside each count is compared, so
   a pair that was never counted can't take another's count. Buckets go to the tasks in portions of a fixed number of
   pairs, one pass over the documents for each portion.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import once, small_batches, stored

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# A pair is one number: A id times this plus B id.
IDS_B = 1 << 18
PAIR_BITS = 36
BUCKETS = 64
# Lists or vectors merged at once: the tree's fan-in.
FAN_IN = 16
# Pairs a task holds before it writes them, and pairs sent to the tasks at once: 25 bytes each.
MOST_HELD, MOST_SENT = 1_000_000, 4_000_000
# Segments a task remembers, about 500 bytes each, and their characters; one batch of texts may add to either.
MOST_SEGMENTS, MOST_CHARS = 200_000, 8_000_000
# Bits per key and level of the hash.
SPACE = 1.25
# Texts that the faster encoder may have: below U+0250 the classes of characters have long been settled.
COMMON = re.compile("[\x00-\u024f]*")
CUT = re.compile(r"(?<=\S) (?=\S)")


def _public(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers one after the other, and where each begins (one more at the end)."""
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=starts[1:])
    return np.fromiter(chain.from_iterable(parts), np.int64, int(starts[-1])), starts


def _gathered(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked lists of ``_flat`` one after the other, and the number of values of each."""
    sizes = starts[picks + 1] - starts[picks]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return values[np.repeat(starts[picks], sizes) + within], sizes


def _of_lists(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each list of ``_flat``."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _tallied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(first, append=len(values))


class Numbers(dict):
    """A number for every new key, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _ranks(path: str, bytes_a: list[bytes]) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same ids for texts below U+0250, whose letters and digits no library sees differently.

    None unless the file has plain byte-level BPE whose ids follow its merges.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    cutter, ids = model.get("pre_tokenizer") or {}, model["model"]["vocab"]
    in_order = all(ids.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))
    if model.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not in_order:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={bytes_a[i]: i for i in range(256 + len(merges))}).encode_ordinary


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignments of the segments met lately.

    Segment ``i`` has the counts ``sums[:, i]`` (tokens of A and of B, groups, links), the links ``links[starts[i]:
    starts[i + 1]]`` and, if ``texts`` are asked for, its groups as ``texts[i]``.
    """

    def __init__(self, path_a: str, path_b: str, with_texts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        # The stand-ins of bytes in the vocabulary file: itself if printable, else the next code point from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.ranked = _ranks(path_a, self.bytes_a)
        self.length_a, self.length_b = (np.array([len(x) for x in raw], dtype=np.int64) for raw in (self.bytes_a, self.bytes_b))
        # Texts may be cut before a space only if no piece holds a space after something else.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.with_texts = with_texts
        # Every id as it is written, first inside a group and then at the end of its side.
        ids_a, ids_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.written = [f"{i}{end}" for ids, ends in ((ids_a, ",|"), (ids_b, ",;")) for end in ends for i in ids] if with_texts else []
        self._forget()

    def _forget(self) -> None:
        self.index = Numbers()
        self.n_chars, self.texts = 0, []
        # Whether a segment's bytes are given back, and whether a space may stand before and after it in a text.
        self.good, self.inner = np.empty(0, bool), np.empty(0, bool)
        self.sums, self.links, self.starts = np.empty((4, 0), np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)

    def _given_back(self, new: list[str], a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a segment's tokens are the segment's, for both tokenizers."""
        raw = [b" " + t.encode() for t in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        good = (_of_lists(self.length_a[a], at_a) == sizes) & (_of_lists(self.length_b[b], at_b) == sizes)
        by_a, by_b = (list(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        whole = b"".join(raw)
        if good.all() and b"".join(by_a) == whole == b"".join(by_b):
            return good
        return np.array([b"".join(by_a[at_a[i]:at_a[i + 1]]) == r == b"".join(by_b[at_b[i]:at_b[i + 1]])
                         for i, r in enumerate(raw)], dtype=bool)

    def _encoded_a(self, new: list[str]) -> list[list[int]]:
        """Ids of A of segments."""
        ranked = self.ranked
        ids = [ranked(" " + t) if ranked and (t.isascii() or COMMON.fullmatch(t)) else None for t in new]
        others = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(others, self.a.encode_batch_fast([" " + new[i] for i in others], add_special_tokens=False)):
            ids[i] = e.ids
        return ids

    def _add(self, new: list[str]) -> None:
        """Align segments that are not known yet, all at once."""
        n = len(new)
        a, at_a = _flat(self._encoded_a(new))
        b, at_b = _flat(self.b.encode(new, num_threads=1))
        good = self._given_back(new, a, at_a, b, at_b)
        of_a, of_b = np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))
        a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        # Both cover the same bytes, so places in all segments, one after the other, can be compared.
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = _distinct(np.concatenate([ends_a, ends_b]))
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closes = (ends_a[i] == ends) & (ends_b[j] == ends)
        counts = [np.bincount(x, minlength=n) for x in (of_a, of_b, of_a[i[closes]], of_a[i])]
        self.sums = np.concatenate([self.sums, counts], axis=1)
        self.links = np.concatenate([self.links, a[i] * IDS_B + b[j]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[3])])
        self.good = np.concatenate([self.good, good])
        self.inner = np.concatenate([self.inner, good & np.fromiter((t == t.strip() != "" for t in new), bool, n)])
        if self.with_texts:
            closed = ends[closes]
            group_a, group_b = np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b)
            last_a, last_b = np.isin(ends_a, closed, assume_unique=True), np.isin(ends_b, closed, assume_unique=True)
            written = np.empty(len(a) + len(b), dtype=np.int64)
            written[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + last_a * len(self.bytes_a)
            written[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = (
                b + 2 * len(self.bytes_a) + last_b * len(self.bytes_b))
            tokens = list(map(self.written.__getitem__, written.tolist()))
            upto = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
            self.texts += ["".join(tokens[x:y])[:-1] for x, y in zip(upto, upto[1:])]

    def _numbers(self, parts: list[str]) -> list[int]:
        return list(map(self.index.__getitem__, parts))

    def _known(self) -> None:
        """Align the segments that were numbered since the last time."""
        if len(self.index) > len(self.good):
            new = list(islice(self.index, len(self.good), None))
            self.n_chars += sum(map(len, new))
            self._add(new)

    def align(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts as numbers of segments, in the form of ``_flat``: none for texts that are empty or not given back."""
        if len(self.index) > MOST_SEGMENTS or self.n_chars > MOST_CHARS:
            self._forget()
        texts = list(texts)
        # Cut at every space; then, where white space stands beside one, only at spaces between other characters; then
        # not at all.
        docs = [(self._numbers(t.split(" ") if self.cuts else [t])) if t else [] for t in texts]
        self._known()
        flat, starts = _flat(docs)
        odd = np.flatnonzero(_of_lists(~(self.inner if self.cuts else self.good)[flat], starts))
        if len(odd):
            for cut in ((CUT.split, lambda t: [t]) if self.cuts else (lambda t: [t],)):
                for i in odd:
                    docs[i] = self._numbers(cut(texts[i]))
                self._known()
                odd = [i for i in odd if not self.good[docs[i]].all()]
            for i in odd:
                docs[i] = []
            flat, starts = _flat(docs)
        return flat, starts


def pairs_held(aligner: Aligner, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the texts, sorted, and how many texts hold each."""
    segments, starts = aligner.align(texts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    once_each = _distinct(doc * len(aligner.good) + segments)
    pairs, sizes = _gathered(aligner.links, aligner.starts, once_each % max(len(aligner.good), 1))
    # A batch has fewer than 2 ** 27 texts, and a pair fewer than 36 bits.
    of_doc = _distinct((np.repeat(once_each // max(len(aligner.good), 1), sizes) << PAIR_BITS) | pairs)
    return _tallied(of_doc & ((1 << PAIR_BITS) - 1))


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, slot = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(slot.ravel(), np.concatenate(counts), len(distinct)).astype(np.int64)


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return pairs // IDS_B % BUCKETS


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of each key, others for each level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minimal_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits, and the distinct keys in the order of their slots."""
    sizes, bits, rest, ordered = [], [], keys, []
    while len(rest):
        size = int(len(rest) * SPACE) + 1
        place = (_mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        ordered.append(rest[mine][np.argsort(place[mine])])
        sizes.append(size)
        bits.append(alone)
        rest = rest[~mine]
    return (np.array(sizes, dtype=np.int64), np.concatenate([np.empty(0, bool), *bits]),
            np.concatenate([np.empty(0, np.int64), *ordered]))


class PairTable:
    """Slots of pairs of some buckets, with the keys to compare."""

    def __init__(self, buckets: list[int], sizes: list[np.ndarray], bits: list[np.ndarray], keys: list[np.ndarray]):
        levels = max(map(len, sizes), default=0)
        self.sizes = np.zeros((BUCKETS, levels), dtype=np.int64)
        for b, s in zip(buckets, sizes):
            self.sizes[b, :len(s)] = s
        self.starts = np.zeros((BUCKETS, levels), dtype=np.int64)
        at = 0
        for b, s in zip(buckets, sizes):
            self.starts[b, :len(s)] = at + np.cumsum(s) - s
            at += int(s.sum())
        self.bits = np.concatenate([np.empty(0, bool), *bits])
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.keys = np.concatenate([np.empty(0, np.int64), *keys])
        self.has = np.isin(np.arange(BUCKETS), buckets)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs of other buckets; an unknown pair is an error."""
        bucket, found = bucket_of(pairs), np.full(len(pairs), -1, dtype=np.int64)
        rest = np.flatnonzero(self.has[bucket])
        for level in range(self.sizes.shape[1]):
            size = self.sizes[bucket[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            place = self.starts[bucket[rest], level] + (_mixed(pairs[rest], level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[place]
            found[rest[hit]] = self.rank[place[hit]]
            rest = rest[~hit]
        mine = self.has[bucket]
        if (found[mine] < 0).any() or (self.keys[found[mine]] != pairs[mine]).any():
            raise ValueError("a pair of tokens was not counted: the documents changed between the passes")
        return found


def _tree(frame: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], parts: int, most: int) -> DataFrame:
    """Rows of a bucket merged ``FAN_IN`` parts at a time until at most ``most`` are left."""
    while parts > most:
        frame = frame.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("bucket", "part").applyInPandas(
            merge, frame.schema)
        parts = -(-parts // FAN_IN)
    return frame


def _union(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in rows.pairs]))
    return pd.DataFrame({"bucket": rows.bucket[:1], "part": rows.part[:1], "pairs": [keys.tobytes()]})


def _hashed(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in rows.pairs]))
    sizes, bits, ordered = minimal_hash(keys)
    return pd.DataFrame({"bucket": rows.bucket[:1], "n": [len(keys)], "sizes": [sizes.tobytes()],
                         "bits": [np.packbits(bits).tobytes()], "keys": [ordered.tobytes()]})


def _table_of(rows: pd.DataFrame) -> PairTable:
    sizes = [np.frombuffer(s, np.int64) for s in rows["sizes"]]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(s.sum())).astype(bool) for b, s in zip(rows.bits, sizes)]
    return PairTable(rows.bucket.tolist(), sizes, bits, [np.frombuffer(k, np.int64) for k in rows["keys"]])


def _counted(lists: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
    """A group's lists as one dense vector."""
    if not len(lists):
        return pd.DataFrame({"bucket": [], "part": [], "counts": []})
    table = _table_of(hashes)
    vector = np.zeros(len(table.keys), dtype=np.int64)
    for pairs, counts in zip(lists.pairs, lists.counts):
        vector[table.slots(np.frombuffer(pairs, np.int64))] += np.frombuffer(counts, np.int64)
    return pd.DataFrame({"bucket": lists.bucket[:1], "part": lists.part[:1], "counts": [vector.tobytes()]})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    vector = np.frombuffer(rows.counts.iloc[0], np.int64).copy()
    for more in rows.counts.iloc[1:]:
        vector += np.frombuffer(more, np.int64)
    return pd.DataFrame({"bucket": rows.bucket[:1], "part": rows.part[:1], "counts": [vector.tobytes()]})


def _aligner(path_a: str, path_b: str, with_texts: bool) -> Callable[[], Aligner]:
    return lambda: once(("aligner", path_a, path_b, with_texts), lambda: Aligner(_public(path_a), _public(path_b), with_texts))


def pair_table(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """One row per bucket of A ids: the minimal perfect hash of its pairs, the keys and the dense counts by slot.

    Columns ``bucket, n, sizes, bits, keys, counts``; ``counts`` says how many documents hold each pair linked. Repeated
    rows are documents of their own. No tokens give no rows.
    """
    spark, aligner = docs.sparkSession, _aligner(path_a, path_b, with_texts=False)
    small_batches(spark)

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def written() -> pd.DataFrame:
            pairs, counts = _added(*zip(*held))
            held.clear()
            bucket = bucket_of(pairs)
            present = np.unique(bucket)
            return pd.DataFrame({"bucket": present, "pairs": [pairs[bucket == b].tobytes() for b in present],
                                 "counts": [counts[bucket == b].tobytes() for b in present]})

        for frame in frames:
            held.append(pairs_held(aligner(), frame.text))
            if sum(len(p) for p, _ in held) > MOST_HELD:
                held[:] = [_added(*zip(*held))]
                if len(held[0][0]) > MOST_HELD // 2:
                    yield written()
        if held:
            yield written()

    made = stored(docs.select("text").mapInPandas(lists, "bucket long, pairs binary, counts binary")
                  .withColumn("part", F.spark_partition_id().cast("long")), "pair-lists")
    parts = (made.agg(F.max("part").alias("n")).first().n or 0) + 1
    unions = _tree(made.select("bucket", "part", "pairs"), _union, parts, most=FAN_IN)
    hashes = stored(unions.groupBy("bucket").applyInPandas(
        _hashed, "bucket long, n long, sizes binary, bits binary, keys binary"), "pair-hashes")
    first = F.floor(F.col("part") / FAN_IN).cast("long")
    groups = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((parts - 1) // FAN_IN)).cast("array<bigint>")))
    vectors = made.withColumn("part", first).groupBy("bucket", "part").cogroup(groups.groupBy("bucket", "part")).applyInPandas(
        _counted, "bucket long, part long, counts binary")
    summed = _tree(vectors, _summed, -(-parts // FAN_IN), most=1)
    return stored(hashes.join(summed.select("bucket", "counts"), "bucket"), "pair-counts")


def pair_counts(table: DataFrame) -> DataFrame:
    """``id_a, id_b, n_docs, best``: the counted pairs; best where no other pair of the A id has a higher count."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, counts in zip(frame["keys"], frame.counts):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                yield pd.DataFrame({"id_a": keys // IDS_B, "id_b": keys % IDS_B, "n_docs": counts, "best": _best(keys, counts)})

    return table.select("keys", "counts").mapInPandas(rows, "id_a long, id_b long, n_docs long, best boolean")


def _best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; all pairs of an A id are in one bucket."""
    highest = np.zeros(int(keys.max()) // IDS_B + 1 if len(keys) else 0, dtype=np.int64)
    np.maximum.at(highest, keys // IDS_B, counts)
    return counts == highest[keys // IDS_B]


def _portions(table: DataFrame) -> list[list[int]]:
    """Buckets in portions of at most ``MOST_SENT`` pairs; a larger bucket is one of its own."""
    portions, room = [], 0
    for row in table.select("bucket", "n").orderBy("bucket").collect():  # at most BUCKETS rows
        if not portions or row.n > room:
            portions.append([])
            room = MOST_SENT
        portions[-1].append(row.bucket)
        room -= row.n
    return portions or [[]]


def groups(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups``: each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    aligner = _aligner(path_a, path_b, with_texts=True)
    small_batches(docs.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id, **_described(aligner(), *aligner().align(frame.text))})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        rows, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def _described(aligner: Aligner, segments: np.ndarray, starts: np.ndarray) -> dict:
    """Counts and groups of texts."""
    texts = list(map(aligner.texts.__getitem__, segments.tolist()))
    upto = starts.tolist()
    return {**{name: _of_lists(aligner.sums[k][segments], starts) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups": [";".join(texts[x:y]) for x, y in zip(upto, upto[1:])]}


def align_documents(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    NULL and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and ''.
    Repeated rows count each and are returned each; a missing doc_id stays NULL. Special tokens' strings are plain text.
    An empty table gives no rows. Other columns are ignored. The sums over portions of the counts are added per distinct
    result, so rows need no number of their own.
    """
    spark, aligner = docs.sparkSession, _aligner(path_a, path_b, with_texts=True)
    small_batches(spark)
    table = pair_table(docs, path_a, path_b)
    # Ids travel as text: pandas has no missing integer.
    schema = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    every = None
    for k, buckets in enumerate(_portions(table)):
        sent = spark.sparkContext.broadcast([tuple(r) for r in table.where(F.col("bucket").isin(buckets or [-1])).select(
            "bucket", "sizes", "bits", "keys", "counts").collect()])  # at most MOST_SENT pairs, or one bucket

        def rows(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            def prepared() -> tuple[PairTable, np.ndarray, np.ndarray]:
                parts = pd.DataFrame(sent.value, columns=["bucket", "sizes", "bits", "keys", "counts"])
                counted = _table_of(parts)
                counts = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(c, np.int64) for c in parts.counts]])
                return counted, counts, _best(counted.keys, counts)

            counted, counts, best = prepared()
            for frame in frames:
                segments, starts = aligner().align(frame.text)
                # Segments that only texts without tokens have were not counted.
                used, again = np.unique(segments, return_inverse=True)
                links, sizes = _gathered(aligner().links, aligner().starts, used)
                slot = counted.slots(links)
                at = np.concatenate([[0], np.cumsum(sizes)])
                mine = slot >= 0
                n_best, count_sum = (_of_lists(np.where(mine, values[slot], 0), at)[again.ravel()] if len(values)
                                     else np.zeros(len(segments), np.int64) for values in (best, counts))
                described = _described(aligner(), segments, starts)
                texts = described.pop("groups")
                yield pd.DataFrame({
                    "doc_id": frame.doc_id, **described, "n_best": _of_lists(n_best, starts), "count_sum": _of_lists(count_sum, starts),
                    "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]})

        part = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, schema).withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    alike = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = every.groupBy(*alike).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"),
                                      F.sum((F.col("k") == 0).cast("long")).alias("n"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.expr("n_best DIV n").alias("n_best"),
        F.expr("count_sum DIV n").alias("count_sum"), "groups_sha256")
