from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = ["an", "er", "th", "on", "in", "ed", "re", "at", "en", "ou", "ti", "ea"]


def prose(seed: int, n: int) -> str:
    words = random.Random(seed)
    return " ".join("".join(words.choice(SYLLABLES) for _ in range(words.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts with NULLs, empty and very long texts, ties, copies, near copies and repeated rows."""
    rows: list[tuple[int | None, str | None]] = [(i, prose(i, 5 + 12 * i)) for i in range(20)]
    copied = prose(7, 5 + 12 * 7)
    rows += [(100 + i, copied) for i in range(12)]  # exact copies
    rows += [(130, copied.replace(" ", "\n\t", 3)), (131, "  " + copied), (132, " " + copied + " ")]  # but for white space
    rows += [(140 + i, copied + f" {prose(900 + i, 1)}") for i in range(4)]  # near copies
    rows += [(200, None), (201, None), (202, ""), (203, " \n\t "), (204, "Éé ß İ 日本語 😀 don't I'LL 12,5"), (205, "...")]
    rows += [(210, prose(50, 4)), (210, prose(51, 4)), (None, prose(52, 40)), (None, copied)]  # repeated and missing ids
    rows += [(220, prose(3, 41)), (220, prose(3, 41))]  # repeated rows
    rows += [(230, "ab" * 3000 + " " + "x" * 5000), (231, prose(60, 4000)), (232, "and " * 700)]  # long
    rows += [(240 + i, f"{prose(70 + i, 30)}\nPage {i} of 90, all rights reserved.\n{prose(90 + i, 25)}") for i in range(14)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as ``documents``, with columns whose names the operators use inside."""
    frame = spark.createDataFrame(
        [(i, t, ("en", "de", None)[k % 3], "src0", len(t or "")) for k, (i, t) in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["row", "words", "term", "fp", "n", "part", "rank", "recipe", "chunk", "text_hash", "line_nos", "judged", "score",
               "_hot", "position", "payload", "data", "votes"]
    return frame.repartition(3).withColumns({c: F.lit(c) for c in [*clashes, "a.dotted name", "N_LINES", "Fingerprint"]})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
