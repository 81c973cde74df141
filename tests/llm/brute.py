"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def base_scores(rows):
    """``n_tokens, n_known, base`` by row, and the number of training tokens."""
    known = Counter()
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            known.update([*words(text, lower=True), "end"])
    n, v = sum(known.values()), len(known)
    found = []
    for (_, text), out in zip(rows, held, strict=True):
        own = [*words(text, lower=True), "end"]
        base = sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        found.append((out, len(own), sum(known[w] > 0 for w in own), base))
    return found, n


def without_repeats(texts, length=35):
    """``n_words, n_removed, kept`` of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def measures(text):
    own = words(text)
    chars = sum(len(w.decode()) for w in own)
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = set()
    for i in range(len(own) - 2):
        if windows[tuple(own[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(own), chars, symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text, width):
    own = words(text, lower=True)
    if len(own) < width:
        return frozenset([tuple(own)]) if own else frozenset()
    return frozenset(tuple(own[i : i + width]) for i in range(len(own) - width + 1))


def component_ids(rows, width, percent=80):
    """Smallest id reachable from each row; rows are ``(doc_id, text)`` with ids."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)].append(doc_id)
    return [min(groups[root(i)]) for i in range(len(rows))]


def secret_spans(text):
    text = text or ""
    assign = re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.IGNORECASE | re.ASCII,
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))


def water_fill(sizes, epochs=3):
    """Targets of ``{source: size}``, by repeated redistribution."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > epochs * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        free -= full
    return target


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def spelling_forms(rows, least=5, often=3):
    """``word, form, root, n, n_near, form_n`` of (doc_id, text) rows."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= often}
    gaps = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (head, tail), group in gaps.items():
        for w in group:
            near[w] |= group - {w}
            if head + tail in n:
                near[w].add(head + tail)
                near[head + tail].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def trie_nodes(rows):
    """Nodes of the prefix trie of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role)}:{role}{text}".encode())
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends, texts = defaultdict(list), defaultdict(list), {(): ""}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        tokens = (len(convs) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += tokens
    return [
        (
            convs[0],
            len(p),
            members[p[:-1]][0] if p else None,
            len(convs),
            children[p],
            leaves[p],
            saved[p],
            sha(",".join(map(str, ends[p])).encode()),
        )
        for p, convs in members.items()
    ]
