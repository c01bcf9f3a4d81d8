from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from conftest_data import frame_rows
from holdfast.llm import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node long, depth int, id string"


def plain(rows) -> list[tuple]:
    """The trie by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, convs in members.items():
        if p:
            children[p[:-1]] += 1
        longest = max(len(built[c]) for c in convs)
        for d in range(len(p) + 1):
            leaves[p[:d]] += longest == len(p)
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(built[c]) == len(p)).encode()).hexdigest())
                   for p, convs in members.items()), key=repr)


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 9, "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def talks():
    dice, rows = random.Random(5), []
    lines = [f"é line {i} " * (i % 3) for i in range(6)]
    for c in [*range(-7, 60), 2 ** 53 + 1, 2 ** 53 + 2]:
        for t in range(dice.randint(1, 12)):
            rows.append((c, t if dice.random() < 0.9 else None, dice.choice(["user", "assistant", None]), dice.choice([*lines, None])))
    rows += [(200 + c, t, "user", "same") for c in range(30) for t in range(10)]  # a hot conversation
    rows += [(300 + c, t, "user", f"turn {t}" if t < 60 else f"turn {t} of {c}") for c in (0, 1) for t in range(90)]  # long ones
    rows += [(c, 0, "user", "only") for c in (401, 402, 403, 404, 406, 407)]  # first of the family absent: some keep no turn
    rows += [(500, 1, "user", "twice")] * 3 + [(501, 1, "a", "tie"), (501, 1, "b", "tie"), (501, 1, "a", "other")]
    rows += [(None, 0, "user", "nobody's"), (600, 0, "", ""), (605, 0, None, None), (610, 0, "user", "x" * 50_000)]
    return rows


def test_prefixes_equal_a_plain_trie(spark, talks, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS_IN_PIECE", 4)
    got = frame_rows(conversation_trie.prefix_nodes(as_frame(spark, talks)), COLUMNS)
    assert got == plain(talks)
    assert max(r[1] for r in got) > conversation_trie.FIRST_BLOCK + conversation_trie.NEXT_BLOCKS


def test_turnless_conversations_end_in_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 5)]
    got = frame_rows(conversation_trie.prefix_nodes(as_frame(spark, rows)), COLUMNS)
    assert got == plain(rows)
    assert all(r[3] == 4 for r in got if r[1] == 0)


def test_empty_table_has_no_node(spark):
    assert conversation_trie.prefix_nodes(as_frame(spark, []).limit(0)).count() == 0
    assert conversation_trie.prefix_nodes(as_frame(spark, [(None, 0, "user", "nobody's")])).count() == 0
