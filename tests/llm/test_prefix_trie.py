"""The prefix trie against a plain rebuild, with component cuts in Spark and inside tasks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import trie_nodes

from opslens.llm import prefix_trie
from opslens.llm.store import prepared

SCHEMA = "conv_id long, turn long, role string, text string, node string, weight int, top int"


@pytest.fixture(scope="module")
def talk(spark):
    """Shared, absent and short first conversations; ties, nulls, repeated rows, copies, one long chain."""
    draw = random.Random(5)
    rows = []
    for i in [*range(100, 160), *range(300, 340), 205, 206, 207, -3, -104, 10**12 + 1, 10**12 + 2]:
        for t in range(draw.randint(1, 7)):
            rows.append((i, t, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "long é text"])))
    rows += [(400, t, "user", f"turn {t}") for t in range(150)]
    rows += [(i, t, "user", f"same {t}") for i in range(500, 540) for t in range(3)]
    rows += [(120, None, None, None), (120, None, "user", ""), (121, 0, "user", "tie"), (121, 0, "user", "tie")]
    rows += [(None, 0, "user", "no conversation"), (299, 0, "user", "alone")]
    draw.shuffle(rows)
    prepared(spark)
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("small", [1, 60, 1 << 16])
def test_trie(talk, small):
    rows, df = talk
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, small).collect()]
    want = trie_nodes(rows)
    assert len(got) == len(want) and set(got) == set(want)


def test_lists_in_pieces(talk, monkeypatch):
    rows, df = talk
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    got = {tuple(r) for r in prefix_trie.prefix_trie(df).collect()}
    assert got == set(trie_nodes(rows))


def test_empty_table(spark):
    prepared(spark)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("reach", [1, 3, 40])
def test_sums_of_random_forests(reach):
    draw = np.random.default_rng(reach)
    n = 500
    parent = np.array([-1, *(max(0, i - 1 - draw.integers(reach)) for i in range(1, n))])
    parent[[100, 300]] = -1
    depth = np.zeros(n, int)
    own = draw.integers(1, 5, n)
    values = draw.integers(0, 100, (2, n))
    weight, want = own.copy(), values.copy()
    for i in range(1, n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    for i in reversed(range(n)):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            want[:, parent[i]] += want[:, i]
    assert (prefix_trie.subtree_sums(parent, depth, weight, values) == want).all()
