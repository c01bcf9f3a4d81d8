"""Exact, near and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import holdfast.llm.components
from conftest import prose
from conftest_data import frame_rows
from holdfast.llm import ball_hashing, chunk_dedup, suffix_order
from holdfast.llm.components import components, similar_components, similar_links
from holdfast.llm.scratch import CLEANUP, stored


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    rows = []
    for i, t in texts:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        members = groups[plain]
        keep, size = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))
        rows.append((i, keep, len(members), i == keep and len(t or "") == size, sha(plain)))
    return rows


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_duplicates(docs, texts, no_docs):
    found = chunk_dedup.exact_duplicates(docs, min_chars=16, max_chars=64)
    assert frame_rows(found, COLUMNS) == sorted(exact(texts), key=repr)
    assert chunk_dedup.exact_duplicates(no_docs).count() == 0


def test_chunk_identifiers_are_verified(docs, texts):
    """With a hash of four values, nearly all chunks clash; the result is the same."""
    found = chunk_dedup.exact_duplicates(docs, min_chars=16, max_chars=64, hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(4)))
    assert frame_rows(found, COLUMNS) == sorted(exact(texts), key=repr)


def simhash(text: str | None) -> int:
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def linked(texts):
    prints = [simhash(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(texts[i][0])
    least = {r: min((m for m in ids if m is not None), default=None) for r, ids in groups.items()}
    return [(texts[i][0], f"{prints[i]:016x}", least[root(i)]) for i in range(len(texts))]


def test_near_duplicates(docs, texts, no_docs):
    found = ball_hashing.near_duplicates(docs).select("doc_id", ball_hashing.as_hex(F.col("fp")).alias("fp"), "component_id")
    assert frame_rows(found, ["doc_id", "fp", "component_id"]) == sorted(linked(texts), key=repr)
    assert ball_hashing.near_duplicates(no_docs).count() == 0


def test_one_of_each_group(docs, texts):
    kept = ball_hashing.one_of_each_group(docs)
    assert kept.columns == docs.columns
    classes = ball_hashing.near_duplicates(docs)
    assert kept.count() == classes.select("root").distinct().count()
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in linked(texts)}


def five_word_sets(texts):
    sets = []
    for t in texts:
        words = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
        sets.append(frozenset(" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 0))) or frozenset([" ".join(words)] * bool(words)))
    return sets


def similar_roots(texts):
    """Per text the number of the first text it is linked to by a Jaccard similarity of 0.8 or more."""
    sets, parent = five_word_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * shared >= 8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(seed: int, words: list[str], edits: int) -> str:
    pick, words = random.Random(seed), list(words)
    for at in pick.sample(range(len(words)), edits):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


def test_crowded_buckets_lose_no_link(spark):
    """Copies with many edits meet in crowded buckets and are mostly unlike each other; so are texts round a passage."""
    family, passage = prose(2100, 70).split(), prose(2200, 40)
    texts = [edited(300 + i, family, i % 7) for i in range(140)]
    texts += [f"{passage} {prose(2300 + i // 4, 12)} {prose(2400 + i, 1)}" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ball_hashing.similar_documents(docs).collect()}
    assert found == dict(enumerate(similar_roots(texts)))
    assert 40 < len(set(found.values())) < 160


def test_sets_that_share_rare_elements(spark):
    """Every pair of similar sets shares a bucket of rarest elements near enough to the start of both."""
    pick = random.Random(5)
    sets = [sorted(pick.sample(range(60), pick.randint(1, 12))) for _ in range(60)]
    sets += [sorted(set(s[:-1]) | {200 + i}) for i, s in enumerate(sets)] + [s + [300] for s in sets]
    frame = spark.createDataFrame(list(enumerate(sets)), "node long, elements array<long>")
    one_bucket = frame.select("node", F.lit(0).alias("bucket"), F.size("elements").alias("n"))
    found = {r["node"]: r["root"] for r in similar_components(one_bucket, frame, 0.8).collect()}
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(set(a) & set(b)) >= 8 * len(set(a) | set(b)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [found.get(i, i) for i in range(len(sets))] == root


@pytest.mark.parametrize("size", [60, 120])
def test_sets_that_meet_many_ends_are_compared_with_few(spark, monkeypatch, size):
    """Compared pairs grow with the sets of a large group that meets in many buckets, not with its square."""
    pick = random.Random(7)
    sets = [(i, [*range(2 * i % 50), *range(2 * i % 50 + 2, 100), 1000 + i]) for i in range(size)]
    members = [(i, bucket, len(sets[i][1])) for bucket in range(8 * size) for i in pick.sample(range(size), 5)]
    compared = []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar_links(pairs, *rest)

    monkeypatch.setattr(holdfast.llm.components, "similar_links", counted)
    found = similar_components(spark.createDataFrame(members, "node long, bucket long, n int"),
                               spark.createDataFrame(sets, "node long, elements array<long>"), 0.8)
    assert {r["root"] for r in found.collect()} == {0} and found.count() == size - 1
    assert sum(compared) <= 5 * size


def test_sets_that_met_by_chance_are_not_read(spark):
    """Of small buckets only the sets of likely pairs are fetched, whatever the number of buckets that chance has made."""
    own = {i: list(range(100 * i, 100 * i + 20)) for i in range(40)}
    own |= {100 + i: [*own[i][:-1], 7000 + i] for i in range(3)}
    chance = [(node, bucket, 20) for bucket in range(39) for node in (bucket, bucket + 1)]
    triples = [(node, 100 + i, 20) for i in range(3) for node in (i, 100 + i, 20 + i)]
    read = []

    def sets(wanted):
        read.extend(r["node"] for r in wanted.collect())
        return stored(wanted.join(spark.createDataFrame(list(own.items()), "node long, elements array<long>"), "node"), "sets")

    found = similar_components(spark.createDataFrame(chance + triples, "node long, bucket long, n int"), sets, 0.8,
                               lambda pairs: pairs.where("a < 3 and b >= 100"))
    assert {r["node"]: r["root"] for r in found.collect()} == {100 + i: i for i in range(3)}
    assert set(read) == {0, 1, 2, 100, 101, 102}


def test_crowded_values_are_the_same_in_any_number_of_rounds(spark, monkeypatch):
    pick = random.Random(12)
    each = [np.array([pick.getrandbits(64) for _ in range(30)], dtype=np.uint64) for _ in range(40)]
    each += [np.append(s[1:], np.uint64(pick.getrandbits(64))) for s in each]
    found = [ball_hashing.narrow_fingerprints(s) for s in each]
    rows = [(i, p.tolist(), u.tolist()) for i, (p, u) in enumerate(found)] + [(-1, [], [])]
    nodes = spark.createDataFrame(rows, "fp long, prints array<long>, unsure array<long>")
    times = Counter(v for _, p, u in rows for v in plain_ball(p, u))
    wanted = sorted((i, v) for i, p, u in rows for v in plain_ball(p, u) if times[v] > 1)
    assert len(wanted) > 100
    for at_once in (1, 5 * len(rows) * ball_hashing.BALL, 1 << 30):
        monkeypatch.setattr(ball_hashing, "VALUES_AT_ONCE", at_once)
        assert sorted(tuple(r) for r in ball_hashing.crowded_values(nodes).collect()) == wanted


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """Shuffle files behind a written table go with the statement, whenever the driver collects its garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles().iterator()
        found = set()
        while files.hasNext():
            found.add(files.next().getName())
        return {f for f in found if f.startswith("shuffle_")}

    before = shuffled()
    setting = spark.conf.get(CLEANUP)
    table = stored(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 5000 and spark.conf.get(CLEANUP) == setting


def test_near_duplicates_stage_reaches_its_similarity(spark):
    """Copies with scattered edits differ by more than two bits; chains of copies and a large family are one group each."""
    own = [prose(1000 + i, 300).split() for i in range(30)]
    texts = [" ".join(w) for w in own] + [edited(i, w, 2 + i % 6) for i, w in enumerate(own)]
    family = prose(2000, 300).split()
    texts += [edited(100 + i, family, 3) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(similar_roots(texts))
    assert len(kept) < 40


def test_similar_documents(docs, texts, no_docs):
    found = ball_hashing.similar_documents(docs)
    roots = similar_roots([t for _, t in texts])
    ids = defaultdict(list)
    for (i, _), r in zip(texts, roots):
        ids[r].append(i)
    least = {r: min((m for m in own if m is not None), default=None) for r, own in ids.items()}
    assert frame_rows(found, ["doc_id", "component_id"]) == sorted(((i, least[r]) for (i, _), r in zip(texts, roots)), key=repr)
    assert ball_hashing.similar_documents(no_docs).count() == 0


def plain_ball(prints, unsure):
    each = len(unsure) // max(len(prints), 1)
    found = set()
    for i, fp in enumerate(prints):
        bits = unsure[i * each:(i + 1) * each]
        flips = [0, *bits, *(a | b for k, a in enumerate(bits) for b in bits[:k])]
        found |= {i << ball_hashing.PRINT_BITS | (fp ^ flip) for flip in flips}
    return found


def test_similar_sets_meet_in_balls_round_their_fingerprints(spark):
    """Ball values are those of a plain version; sets at 0.8 meet at one in 95 % of cases, whatever their size."""
    pick, rows, met = random.Random(11), [], []
    for k in range(160):
        shared, own = ((8, 1), (40, 5), (320, 40))[k % 3]
        common = [pick.getrandbits(64) for _ in range(shared)]
        pair = [ball_hashing.narrow_fingerprints(np.array(common + [pick.getrandbits(64) for _ in range(own)], dtype=np.uint64))
                for _ in "ab"]
        pair = [(prints.tolist(), unsure.tolist()) for prints, unsure in pair]
        rows += [(2 * k + i, *found) for i, found in enumerate(pair)]
        met.append(bool(plain_ball(*pair[0]) & plain_ball(*pair[1])))
    assert sum(met) >= 0.95 * len(met)
    nodes = spark.createDataFrame([*rows, (-1, [], [])], "fp long, prints array<long>, unsure array<long>")
    values = defaultdict(list)
    for node, value in ball_hashing.ball_values(nodes).collect():
        values[node].append(value)
    assert {n: sorted(v) for n, v in values.items()} == {n: sorted(plain_ball(p, u)) for n, p, u in rows}


def test_links_at_one_and_two_bits(spark):
    prints = [0, 1, 3, 7, 1 << 63, (1 << 63) | (1 << 62), 0b11111 << 20]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(tuple(r) for r in components(ball_hashing.links(nodes)).collect())
    least = min(signed)
    assert [roots.get(p, p) for p in signed] == [least] * 6 + [signed[6]]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (70, 71), (71, 70), (None, 3)], "a long, b long")
    found = dict(tuple(r) for r in components(edges).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, 71: 70}


def without_repeats(texts, length):
    seen, rows = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            piece = data[at:at + length]
            if piece in seen:
                gone[at:at + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        rows.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def test_anchors_are_few_and_of_equal_strings_equal():
    """A string has an anchor at a thirty-fifth of its places or so, and the same one wherever it stands."""
    passage = prose(40, 200).encode()
    one, two = prose(41, 3000).encode() + passage, passage + prose(42, 3000).encode()
    found = [suffix_order.anchors(data) for data in (one, two)]
    for data, (grams, begins, counts) in zip((one, two), found):
        assert (np.sort(np.concatenate([np.arange(b, b + n) for b, n in zip(begins, counts)])) == np.arange(len(data) - 99)).all()
        assert 20 * len(grams) < len(data)
    shared = set(found[0][0].tolist()) & set(found[1][0].tolist())
    assert 10 < len(shared) < 0.2 * len(found[0][0])


@pytest.mark.parametrize("bucket", [6_000, 3])
def test_passages_in_many_texts(spark, monkeypatch, bucket):
    """Repeats within and between texts, with anchors of more different contexts than a bucket takes; bytes may be any."""
    monkeypatch.setattr(suffix_order, "BUCKET", bucket)
    passages = [prose(60 + i, 9 + 4 * i) for i in range(5)]
    texts = [(None if i == 7 else i, " ".join(f"{prose(600 + 9 * i + k, 3)} {p}" for k, p in enumerate(passages) if (i + k) % 3))
             for i in range(24)] + [(50, "\0\0" * 90 + "é" * 70), (51, "é" * 70 + "\0" * 130), (52, None), (53, "x" * 400)]
    found = suffix_order.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), length=40)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert frame_rows(found, columns) == without_repeats(texts, 40)


def test_substring_repeats(docs, texts):
    # Repeated ids are left out here: between them the order is that of the table.
    once = [(i, t) for i, t in texts if i is not None and i not in (210, 220)]
    frame = docs.where("doc_id is not null and doc_id not in (210, 220)")
    found = suffix_order.remove_repeats(frame, length=40, symbol=6)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert frame_rows(found, columns) == without_repeats(once, 40)


def test_substring_repeats_of_repeated_rows(docs, no_docs):
    rows = suffix_order.remove_repeats(docs.where("doc_id = 220 or doc_id is null or text is null")).collect()
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] == 220)[0] == 0 < max(r["n_removed"] for r in rows if r["doc_id"] == 220)
    assert all(r["n_bytes"] == 0 for r in rows if r["doc_id"] in (200, 201)) and len(rows) == 6
    assert suffix_order.remove_repeats(no_docs).count() == 0
