"""Spelling variants against a plain search, and the bit-sliced index on its own."""

from __future__ import annotations

import random

import pytest
from brute import spelling_forms

from opslens.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(draw: random.Random, n: int, alphabet: str = "abÿ") -> list[str]:
    return sorted({"".join(draw.choices(alphabet, k=draw.randint(5, 8))) for _ in range(n)})


def test_index_finds_each_pair_once():
    words = words_of(random.Random(1), 400)
    found = []
    for m in range(4, 9):
        group = [w for w in words if len(w) in (m, m + 1)]
        for start, stop in ((0, m // 2), (m // 2, m)):
            for one, other in spelling.one_edit_pairs(group, m, start, stop) if group else ():
                found += [(group[i], group[j]) for i, j in zip(one, other, strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if near(a, b)}


@pytest.mark.parametrize("limit", [4, 50, 8192])
def test_buckets_of_any_size(spark, limit):
    words = words_of(random.Random(2), 300)
    table = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.near, r.best, r.best_n) for r in spelling.near_words(table, bucket=limit, shard=40).collect()}
    counts = {w: 3 + i for i, w in enumerate(words)}
    want = {}
    for a in words:
        others = [b for b in words if near(a, b)]
        if others:
            best = min(others, key=lambda w: (-counts[w], w))
            want[a] = (len(others), best, counts[best])
    assert got == want


def test_large_buckets_are_halved(spark):
    words = words_of(random.Random(3), 300)
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    members = spelling.bucketed(table, limit=5)
    sizes = members.where("stop - start > 1").groupBy(*spelling.SHAPE, "rest").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 5
    assert members.where("stop - start = 1").count() > 0


def test_messy_table(frame, messy):
    got = [tuple(r) for r in spelling.spelling_variants(frame(messy)).collect()]
    want = spelling_forms([(r[0], r[1]) for r in messy])
    assert len(got) == len(want) and set(got) == want


def test_chains_ties_long_runs_and_letters(frame):
    texts = ["abcdef " * 4, "abcdefg " * 12, "abcdefgh " * 30 + "abcdefgx " * 30, "ÀÉÿ÷×é " * 5, "ÀÉÿ÷×e " * 12]
    texts += ["q" * 70 + " " + "q" * 71, ("q" * 70 + " ") * 8 + ("q" * 71 + " ") * 3, "ABCDEF1ABCDEF", None, ""]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {tuple(r) for r in spelling.spelling_variants(frame(rows)).collect()}
    assert got == spelling_forms([(r[0], r[1]) for r in rows])
    roots = {r[0]: r[2] for r in got}
    assert roots["abcdef"] == roots["abcdefg"] == "abcdefgh"


def test_empty_table(empty):
    assert spelling.spelling_variants(empty).collect() == []
