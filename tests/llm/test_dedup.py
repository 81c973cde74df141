"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import component_ids, sha, shingles, without_repeats, words
from conftest import prose

from opslens.llm import exact_dedup, fm_index, near_dedup, substring_dedup
from opslens.llm.text import chunks, grams


def test_words_and_hashes_follow_the_bytes():
    texts = ["a b", None, "", " x\x0by\x1cz w ", "B b", "end"]
    found = []
    for part in chunks(pa.array(texts), lower=True):
        raw = part.data.tobytes()
        for i in range(len(part)):
            span = slice(part.bounds[i], part.bounds[i + 1])
            found.append([raw[s:e] for s, e in zip(part.starts[span], part.ends[span], strict=True)])
    assert found == [words(t, lower=True) for t in texts]
    (part,) = chunks(pa.array(["ab cd ab", "cd", "ba"]), lower=False)
    h = part.hashes
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert grams(h, 2)[0] != grams(h, 2)[1]


def test_chunks_cover_a_sliced_column_and_very_long_texts():
    column = pa.array(["skip", "x " * 900_000, "y", None])[1:]
    assert [n for part in chunks(column, lower=False) for n in part.sizes()] == [900_000, 1, 0]


def test_fuse_filter_has_no_false_negatives_and_few_false_positives():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        made = exact_dedup.BinaryFuse(keys)
        assert made.has(keys).all()
        assert made.has(draw.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001


def test_exact_duplicates(frame, messy, empty):
    found = exact_dedup.exact_duplicates(frame(messy)).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in messy:
        groups[(text or "").encode().lower()].append(doc_id)
    assert len(found) == len(messy)
    expected, kept = Counter(), {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept[sha(text)] = keep
        expected.update((i, keep, len(ids), sha(text)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in found) == expected
    stay = Counter((bytes(r.digest).hex(), r.doc_id) for r in found if r.kept)
    assert stay == Counter(kept.items())
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_do_not_depend_on_the_snapshot(frame, messy):
    from pyspark.sql import functions as F

    docs = frame(messy)
    columns = ("doc_id", "keep_id", "group_size", "kept")
    results = [
        Counter(exact_dedup.exact_duplicates(docs, incoming).select(*columns).collect())
        for incoming in (F.lit(True), F.lit(False), F.col("doc_id") % 3 == 0)
    ]
    assert results[0] == results[1] == results[2]


def test_dropping_exact_duplicates_keeps_columns_and_one_row(frame, messy):
    docs = frame(messy)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = [(r.text or "").encode().lower() for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").encode().lower() for _, t, *_ in messy})


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(frame, messy, empty, width):
    rows = [r for r in messy if r[0] is not None]
    found = near_dedup.near_duplicates(frame(rows), width).collect()
    pairs = [(r[0], r[1]) for r in rows]
    expected = Counter(
        (i, len(shingles(t, width)), c)
        for (i, t), c in zip(pairs, component_ids(pairs, width), strict=True)
    )
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert near_dedup.near_duplicates(empty, width).count() == 0
    one = Counter(r.component_id for r in found if r.kept and r.n_shingles)
    assert {n for i, n in one.items() if i} == {1}  # id 0 is the smallest of several components


def test_near_copies_chained_in_one_hot_group(frame):
    """Hundreds of near copies, each close to its neighbours only: nothing is lost, nothing else joins."""
    draw = random.Random(8)
    own = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        for _ in range(5):
            own[draw.randrange(len(own))] = f"n{draw.random()}"
        rows.append((1000 - i, " ".join(own), "en", "s", 1))
    rows += [(2000 + i, prose(draw, 80), "en", "s", 1) for i in range(30)]
    found = near_dedup.near_duplicates(frame(rows, clash=False), 2).collect()
    pairs = [(r[0], r[1]) for r in rows]
    assert {r.doc_id: r.component_id for r in found} == dict(
        zip((i for i, _ in pairs), component_ids(pairs, 2), strict=True)
    )


def test_unrelated_members_of_buckets_are_all_compared(frame):
    """Outliers that the heads of their buckets don't match are compared with everything else there."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(draw.randint(4, 14)):
            own[draw.randrange(len(own))] = f"n{draw.random()}"
        rows.append((i, " ".join(own), "", "", 1))
    found = near_dedup.near_duplicates(frame(rows, clash=False), 2).collect()
    pairs = [(r[0], r[1]) for r in rows]
    expected = component_ids(pairs, 2)
    assert len(set(expected)) > 5
    assert {r.doc_id: r.component_id for r in found} == dict(zip((i for i, _ in pairs), expected, strict=True))


def test_blocks_emit_each_pair_once():
    draw = np.random.default_rng(3)
    n, m = 6, near_dedup.SHARPER * near_dedup._MINIMA // 2
    one = draw.integers(0, 256, m, dtype=np.uint8)
    bands = draw.integers(1, 9, (n, near_dedup.BANDS))
    bands[:, 0], bands[:, 3] = np.arange(n) + 100, 7
    side = {
        "rid": np.arange(n) * 10, "part": np.array([0, 1, 2, 3, 3, 3]), "waiting": np.arange(n) < 3,
        "sharp": np.tile(one, (n, 1)), "bands": bands,
    }
    leads = {k: v[:3] for k, v in side.items()}
    seen = Counter()
    for key in np.unique(bands[:, 1:]):
        held = {k: v[(bands == key).any(axis=1)] for k, v in side.items()}
        ahead = {k: v[(bands[:3] == key).any(axis=1)] for k, v in leads.items()}
        if key == 7 or len(ahead["rid"]):
            a, b = near_dedup.compare_blocks(int(key), ahead, held, {m: 0.5})
            seen.update(zip(a.tolist(), b.tolist(), strict=True))
    assert not seen or set(seen.values()) == {1}


def test_signature_estimate_is_corrected_for_chance():
    draw = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 1.0):
        a = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = int(2 * 4000 * share / (1 + share))
        b = np.concatenate([a[:n], draw.integers(0, 1 << 63, 4000 - n, dtype=np.uint64)])
        packed = near_dedup.pack(near_dedup.minima([a, b]))
        assert abs(near_dedup.estimate(packed[:1], packed[1:])[0] - share) < 0.15


def test_fm_index_counts_patterns():
    draw = np.random.default_rng(0)
    texts = [draw.integers(1, 5, n) for n in (60, 1, 35, 80, 200)]
    weights = np.array([1, 2, 3, 1, 1])
    index = fm_index.FMIndex(texts, weights, 5, 8)
    for length in (1, 2, 3, 5, 8):
        for _ in range(40):
            pattern = draw.integers(1, 5, length)
            low, high = index.whole(1)
            for symbol in pattern[::-1]:
                low, high = index.step(np.array([symbol]), low, high)
            count = sum(
                w * sum(np.array_equal(t[i : i + length], pattern) for i in range(len(t) - length + 1))
                for t, w in zip(texts, weights, strict=True)
            )
            assert index.weight(low, high)[0] == count


def test_repeated_windows_of_many_texts():
    draw = np.random.default_rng(6)
    shared = draw.integers(1, 40, 50)
    texts = [
        np.concatenate([draw.integers(1, 40, draw.integers(0, 12)), shared[a:b], draw.integers(1, 40, draw.integers(1, 12))])
        for a, b in draw.integers(0, 51, (60, 2))
    ]
    texts = [t if len(t) >= 10 else draw.integers(1, 40, 12) for t in texts]
    index = fm_index.FMIndex(texts, np.ones(len(texts), np.int64), 40, 10)
    seen = Counter(tuple(t[i : i + 10]) for t in texts for i in range(len(t) - 9))
    for t, found in zip(texts, fm_index.repeated_windows(index, texts, 10, 2), strict=True):
        assert found.tolist() == [i for i in range(len(t) - 9) if seen[tuple(t[i : i + 10])] > 1]


@pytest.mark.parametrize("hot", [substring_dedup.HOT_SEGMENTS, 0])
def test_substring_dedup(frame, messy, empty, hot):
    draw = random.Random(1)
    passage = prose(draw, 80).split()
    rows = list(messy)
    for i in range(30):
        a = draw.randint(0, 40)
        part = passage[a : a + draw.randint(30, 40)]
        rows.append((600 + i, " ".join([prose(draw, 5), *part, prose(draw, 5)]), "en", "s", 1))
    found = substring_dedup.remove_repeats(frame(rows), hot_segments=hot).collect()
    expected = Counter(
        (r[0], n, gone, sha(kept), kept.decode())
        for r, (n, gone, kept) in zip(rows, without_repeats([r[1] for r in rows]), strict=True)
    )
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found) == expected
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_covered_words_of_several_texts():
    marks = [
        [{"first": 0, "mask": 0b101}, {"first": 40, "mask": 1 << 27}],
        None,
        [],
        [{"first": 5, "mask": 1}, {"first": 5, "mask": 0b11}],
    ]
    sizes = np.array([110, 50, 0, 41])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("mask", pa.int64())]))
    got = substring_dedup.covered_words(sizes, pa.array([None, *marks], kind).slice(1))
    want = []
    for n, own in zip(sizes, marks, strict=True):
        gone = [False] * n
        for m in own or ():
            for j in range(28):
                if m["mask"] >> j & 1:
                    at = m["first"] + j
                    gone[at : at + 35] = [True] * 35
        want += gone
    assert got.tolist() == want
