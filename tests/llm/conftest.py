from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; further input columns may clash with them.
CLASHING = "rid long, kept boolean, n_words string, digest int, body string, size long, label double, h long, __size int"


def prose(draw: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(draw.choices(letters, k=draw.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty and long texts, ties, exact and near copies, repeats of a row and of an id."""
    draw = random.Random(3)
    texts = [prose(draw, draw.choice((3, 40, 120, 300))) for _ in range(40)]
    long = prose(draw, 9000)
    passage = prose(draw, 60)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper(), "en", "s1", None) for i, t in enumerate(texts[:5])]
    for i in range(12):
        own = texts[7 + i % 3].split()
        for _ in range(max(1, len(own) // 60)):
            own[draw.randrange(len(own))] = "edited"
        rows.append((200 + i, " ".join(own), "de", "s2", 1))
    rows += [(300 + i, prose(draw, 30) + "\n" + passage + "\n" + prose(draw, 20), "fr", None, 2) for i in range(4)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, " \n\t ", "en", "s0", 4)]
    rows += [(403, long, "en", "big", 1), (404, "word", "en", "s3", 4), (405, "Word", "en", "s3", 4)]
    rows += [(406, "same " * 200, "en", "s3", 4), (407, "é ü — 漢字 ｘ " * 30, "zz", "s3", 4)]
    rows += [(408, "a\x0bb\x0cc\rd " * 40 + "\n| | # $\n| | # $\n", "en", "s3", 4)]
    rows += [(0, texts[0], None, "s0", 9), (0, texts[1], "en", "s1", 9), (None, texts[2], "en", "s2", 9)]
    rows += [(None, None, "en", "s2", 9), (None, None, "en", "s2", 9), (500, texts[30], "en", "s1", 9)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of rows, with further columns that clash."""
    from opslens.llm.store import prepared

    def make(rows, schema=SCHEMA, clash=True):
        prepared(spark)
        extra = [p.rsplit(" ", 1) for p in CLASHING.split(", ")] if clash else []
        full = schema + "".join(f", {n} {t}" for n, t in extra)
        return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], full).repartition(3)

    return make


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
