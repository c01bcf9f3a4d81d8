"""Decontamination, line templates and quality against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import prose
from conftest_data import frame_rows
from holdfast.llm import line_templates, positional_index, weak_labels

FOLDER = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(text, size):
    ws = words(text)
    return {tuple(ws[i:i + size]) for i in range(max(len(ws) - size, 0) + 1)} if ws else set()


def contaminated(texts, items, size):
    rows = []
    for i, t in texts:
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            for w in windows(text, size):
                for at in range(len(ws) - len(w) + 1):
                    if tuple(ws[at:at + len(w)]) == w:
                        hit |= set(range(at, at + len(w)))
                        found |= {str(item)} if item is not None else set()
        rows.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return rows


@pytest.fixture(scope="module")
def items(texts):
    by_id = dict((i, t) for i, t in texts if i is not None)
    long = by_id[15].split()
    return [(1, " ".join(long[3:20])), (2, " ".join(long[10:24]).upper()), (10, "all rights"), (3, None), (4, ""), (5, "and and"),
            (6, " ".join(by_id[7].split()[:10])), (6, "nowhere to be found in any text of this kind at all"), (None, by_id[210]), (7, "AND")]


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(c) for c in ("row", "phrase", "term", "words")})


def test_decontaminate(docs, texts, items, benchmark, no_docs):
    found = positional_index.decontaminate(docs, benchmark)
    assert frame_rows(found, COLUMNS) == sorted(contaminated(texts, items, 10), key=repr)
    assert positional_index.decontaminate(no_docs, benchmark).count() == 0


def test_nothing_to_look_for(docs, texts, benchmark):
    none = positional_index.decontaminate(docs, benchmark.limit(0))
    assert frame_rows(none, COLUMNS) == sorted(contaminated(texts, [], 10), key=repr)


def test_clean_documents(docs, texts, items, benchmark):
    kept = positional_index.clean_documents(docs, benchmark)
    want = Counter((i, t) for (i, t), r in zip(texts, contaminated(texts, items, 10)) if not r[5])
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_whole_index_and_proximity(spark, docs, texts):
    index = positional_index.build_index(docs.select("doc_id", "text"))
    all_words = Counter(w for _, t in texts for w in words(t))
    assert {r["word"]: r["n"] for r in index.terms.collect()} == all_words
    phrases = spark.createDataFrame([(1, ["all", "reserved"]), (2, ["page", "rights"]), (3, ["and"]), (4, ["page", "nowhere"])],
                                    "phrase long, words array<string>")
    near = Counter(r["phrase"] for r in positional_index.near_phrases(index, phrases, 2).collect())
    assert near == {1: 14, 3: all_words["and"]}
    assert Counter(r["phrase"] for r in positional_index.near_phrases(index, phrases, 5).collect())[2] == 14


def copies(texts):
    """The class of every text: links are texts that share half of their runs of two words, cyclic."""
    sets, root = {}, {t: t for t in texts}
    for t in texts:
        own = ["<*>" if re.search(r"\d", w) else w for w in t.split()]
        sets[t] = set(zip(own[-1:] + own, own))
    for a in texts:
        for b in texts:
            if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {t: new if r == old else r for t, r in root.items()}
    return root


def dropped_lines(texts, least, share, most_variable):
    lines = []  # (key of the text, document, line number, masked, path)
    for k, (i, t) in enumerate(texts):
        own = []
        for n, line in enumerate((t or "").split("\n")):
            tokens = ["<*>" if re.search(r"\d", w) else w for w in line.split()]
            if tokens:
                own.append((n, tokens, (len(tokens), *tokens[:3])))
        for p, (n, tokens, path) in enumerate(own):
            before, after = (own[q][2] if 0 <= q < len(own) else 0 for q in (p - 1, p + 1))
            lines.append((t or "", k, n, tuple(tokens), path, (before, after)))
    leaves, support, per_form = defaultdict(set), Counter(), defaultdict(set)
    for text, _, _, tokens, path, _ in lines:
        leaves[path].add(text)
        per_form[path, tokens].add(text)
    for (path, tokens), own in per_form.items():
        for at, token in enumerate(tokens):
            support[path, at, token] += len(own)
    seen, sides, of_line = defaultdict(set), defaultdict(set), {}
    for text, k, n, tokens, path, beside in lines:
        if len(leaves[path]) < least:
            continue
        constant = [support[path, at, w] >= least for at, w in enumerate(tokens)]
        variable = sum(not c and w != "<*>" for c, w in zip(constant, tokens))
        constants = sum(c and w != "<*>" for c, w in zip(constant, tokens))
        general = variable <= len(tokens) * most_variable or variable == 1 and constants >= 4
        template = (path, tuple(w if c else "<*>" for c, w in zip(constant, tokens)) if general else ("own", tokens))
        seen[template].add(text)
        sides[template].add(beside)
        of_line[k, n] = template
    seen = {t: own for t, own in seen.items() if len(own) >= least}
    bad = {t for t in seen if len(sides[t]) >= max(least, share * len(seen[t]))}
    classes = copies({x for t, own in seen.items() if t not in bad for x in own})
    bad |= {t for t in seen if t not in bad and len({classes[x] for x in seen[t]}) >= least}
    return {key for key, t in of_line.items() if t in bad}


@pytest.mark.parametrize("least", [3, 10])
def test_recurring_lines(docs, texts, least, no_docs):
    gone = dropped_lines(texts, least, 0.25, 0.1)
    assert len(gone) == 14
    want = []
    for k, (i, t) in enumerate(texts):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)
        want.append((i, kept, 0 if t is None else len(t.split("\n")), sum(key[0] == k for key in gone)))
    found = line_templates.drop_recurring_lines(docs, least_texts=least)
    # A column named like a result, in any case, is replaced.
    assert set(docs.columns) - {"N_LINES"} <= set(found.columns)
    assert frame_rows(found, ["doc_id", "text", "n_lines", "n_dropped"]) == sorted(want, key=repr)
    assert line_templates.drop_recurring_lines(no_docs).count() == 0


def test_words_that_vary_share_a_template(spark):
    rows = [(i, f"first {i * 7919 % 1000:03d}x\nplease read all of the rules before you write to user {'abcdefghijklmnop'[i]} in "
                f"here today\nthe end of it") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_templates.drop_recurring_lines(docs).collect()
    assert {r["n_dropped"] for r in found} == {0}  # the neighbours have one template each
    moved = spark.createDataFrame([(i, t.replace("first", "alpha " * (i + 1))) for i, t in rows], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_templates.drop_recurring_lines(moved).collect()} == {1}


def own_prose(seed: int) -> str:
    return prose(seed, 25) + "\n" + prose(seed + 5000, 25)


def test_whole_block_of_boilerplate_goes(spark):
    """Inner lines of a block have one pair of neighbours, the last line ends the text."""
    block = [f"{prose(77 + i, 6)} clause" for i in range(6)]
    texts = ["\n".join([own_prose(3000 + i), *block]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_templates.drop_recurring_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {i: own_prose(3000 + i) for i in range(40)}


def test_family_of_copies_counts_once(spark):
    """A line of 15 unrelated texts and 120 edited copies goes everywhere; the other lines of the copies stay."""
    line = "please subscribe to our letter here"
    family = [prose(4000 + i, 12) for i in range(12)]
    texts = ["\n".join([prose(4100 + i, 40), line, prose(4200 + i, 40)]) for i in range(15)]
    texts += ["\n".join([*family[:6], line, *family[6:], f"written down here as {prose(4300 + i, 1)}{'x' * (i % 7)}"]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs).collect()}
    assert found == {i: t.replace(line + "\n", "") for i, t in enumerate(texts)}


def test_copy_classes_join_no_unrelated_texts(spark):
    """Texts round a common block that is under half of their words stay apart, whatever keys they share."""
    block = prose(4700, 60)
    texts = [f"{prose(4710 + i, 50)} {block}" for i in range(150)]
    texts += [f"{prose(4900 + i // 3, 90)} {prose(4990 + i, 2)}" for i in range(30)]  # families of three
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    classes = line_templates.copy_classes(docs, hashes.select("text_hash"))
    found = hashes.join(classes, "text_hash", "left").select("doc_id", F.coalesce("class", "text_hash").alias("class")).collect()
    plain = copies(set(texts))
    assert len({(plain[texts[r["doc_id"]]], r["class"]) for r in found}) == len({r["class"] for r in found}) == 160


def test_short_line_with_a_name_shares_a_template(spark):
    names = ["anna", "bert", "cleo", "dora", "emil", "fritz", "gina", "hugo", "ida", "jan", "karl", "lena", "max", "nora"]
    texts = [f"{prose(4400 + i, 30)}\nshare this on {name} now\n{prose(4500 + i, 30)}" for i, name in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_templates.drop_recurring_lines(docs).collect()
    assert [r["n_dropped"] for r in found] == [1] * len(names) and not any("share this" in r["text"] for r in found)
    few = [t.replace("share this on ", "share this ") for t in texts]
    docs = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")
    assert {r["n_dropped"] for r in line_templates.drop_recurring_lines(docs).collect()} == {0}


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not here")
def test_quality_agrees_with_labels(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_labels.score_quality(table).join(labels, "doc_id").select("quality", "kept").collect()
    right = [(r["quality"] == 1) == r["kept"] for r in rows]
    assert len(right) > 300 and np.mean(right) >= 0.97
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) >= 0.98


def test_quality_of_odd_texts(docs, texts, no_docs):
    rows = weak_labels.score_quality(docs).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert len({(r["posterior"], r["score"]) for r in rows if r["doc_id"] in (200, 201, 202)}) == 1
    assert weak_labels.score_quality(no_docs).count() == 0


def test_runs_of_a_word_of_any_length(spark):
    """A run of 30,000 equal words takes no stack; the shares of text in runs are those of a plain version."""
    texts = ["spam " * 30_000, "so " * 2000 + prose(80, 3000), "a  a\n a b b ab a", "to to be aa a", "", None] + [
        " ".join(random.Random(i).choice(["a", "aa", "é", "\n"]) for _ in range(30)) for i in range(40)]

    def share(text):
        spans = [(m.group(), *m.span()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
        covered = sum(next_end - (start if first else end) for (first, start, end, next_end) in (
            (i == 0 or spans[i - 1][0] != spans[i][0], spans[i][1], spans[i][2], spans[i + 1][2])
            for i in range(len(spans) - 1) if spans[i][0] == spans[i + 1][0]))
        return covered / len(text) if text else 1  # nothing is left of an empty text either

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = list(weak_labels.labellers(F.lit(""))).index("runs")
    found = {r["doc_id"]: r["votes"][at] for r in weak_labels.voted(docs).collect()}
    assert found == {i: -1 if share(t) >= 0.2 else 0 for i, t in enumerate(texts)}
    assert {-1, 0} == set(found.values())


def test_long_words_are_not_remembered():
    buckets, values = weak_labels.features("x" * 5000 + " short")
    known = weak_labels.once(("word buckets",), dict)
    assert "short" in known and max(map(len, known)) <= weak_labels.LONGEST_WORD
    assert len(buckets) == 3 and np.isclose((values ** 2).sum(), 1)


def test_em_finds_accuracies():
    pick = np.random.default_rng(1)
    good = pick.random(20_000) < 0.7
    accuracy = [0.95, 0.85, 0.75, 0.9]
    votes = np.stack([np.where(pick.random(len(good)) < 0.3, 0, np.where(pick.random(len(good)) < a, 1, -1) * np.where(good, 1, -1))
                      for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.estimate(tuple("abcd"), patterns, counts.astype(float))
    assert np.allclose(list(model.accuracies().values()), accuracy, atol=0.03) and abs(model.good - 0.7) < 0.03


def test_lines_outside_recurring_leaves_are_not_written(spark, monkeypatch):
    """Of all lines only those in leaves of enough texts are stored; odd white space and digits change no leaf."""
    written, stored = {}, line_templates.stored

    def watched(frame, purpose):
        table = stored(frame, purpose)
        written[purpose] = max(written.get(purpose, 0), table.count())
        return table

    monkeypatch.setattr(line_templates, "stored", watched)
    gaps = [" ", "\t", " \t ", "\x0b", "  "]
    texts = ["\n".join([prose(5000 + i, 30), f" Page{gaps[i % 5]}{i} of 90, all rights reserved\r", "\t", prose(6000 + i, 20)]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_templates.template_lines(docs).select("doc_id", "line_no").collect()
    assert sorted(tuple(r) for r in found) == [(i, 1) for i in range(20)]
    assert max(written.values()) <= 20
