"""The prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Nodes.  A node stands for the conversations that share their first turns.  The id of a prefix is the sum
of 92-bit hashes of its turns, each taken with its place; so running totals over sorted ranges give
all ids, however long one conversation is, and the id less the last hash is the parent's.

Rollup.  Sums over subtrees must not walk each path to the root: a chain would cost the square of its length.
Instead each component of the forest is cut at its centroid, a node whose subtree holds at least half
of the component's weight while that of no child does.  What lies at and under the centroid is totalled
and added to the nodes from the centroid up to the component's top; the parts then are components of their own,
with at most half the weight, so the number of rounds is logarithmic.  The weight of a node is the
number of conversations through it: its subtree's weight, the number of turns at or behind it, comes from
one grouping.  The nodes above the centroid are the earlier steps of any conversation through it, found by
one join.  Components of at most ``SMALL`` turns are finished by the same cuts inside a task, many at a time.

Rows without a conv_id belong to no conversation; turns with equal ``turn`` go by a hash of role and
text; repeated rows are turns of their own; null role or text is empty; further columns are not looked at; an empty
table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import batch, saved
from opslens.operators.ranking import numbered, running_sum

#: Turns at or behind the nodes of a component that one task finishes; it has no more nodes than that.
SMALL = 1 << 16
#: Ids in one piece of a member list.
PIECE = 4096

BLOCK, MOST_SHARED = 100, 6

SUMS = pa.schema([("node", pa.string()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
PIECES = pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with its members and subtree totals."""
    steps = prefixes(rebuilt(conversations))
    grouped = saved(
        steps.groupBy("node").agg(
            F.min("parent").alias("parent"),
            F.min("depth").alias("depth"),
            F.min("chars").alias("chars"),
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        ),
        "nodes",
    )
    children = grouped.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    above = grouped.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = grouped.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = saved(nodes, "nodes")
    leaves = (F.col("n_children") == 0).cast("long").alias("leaves")
    tokens = ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens")
    sums = subtree_totals(nodes.select("node", "conv_id", "depth", "parent", "weight", leaves, tokens), steps, small)
    ends = members_at_end(steps.where(F.col("depth") == F.col("length")).select("node", "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    full = nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
    return full.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, chars``: turns from 1; a conversation without turns has one row of depth 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).alias("chars"),
    )
    placed = numbered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place").drop("turn")
    placed = saved(placed, "turns")
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    convs = placed.select("conv_id").distinct()
    heads = placed.where(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    taken = convs.withColumn("base", base).join(heads, "base")
    taken = taken.where(F.col("place") <= shared_turns(F.col("conv_id"))).select(
        "conv_id", F.col("place").alias("depth"), "digest", "chars"
    )
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    shared = shared_turns(F.col("conv_id"))
    own = placed.where(F.col("place") > shared).withColumn("base", base).join(sizes, "base", "left")
    own = own.select(
        "conv_id",
        (F.col("place") - shared + F.least(shared, F.coalesce("there", F.lit(0)))).alias("depth"),
        "digest",
        "chars",
    )
    nothing = {"depth": F.lit(0).cast("long"), "digest": F.lit(None).cast("string"), "chars": F.lit(0)}
    root = convs.select("conv_id", *[value.alias(name) for name, value in nothing.items()])
    return taken.unionByName(own).unionByName(root)


def prefixes(turns: DataFrame) -> DataFrame:
    """Each step of each conversation with the ids of its prefix and of the one before."""
    place = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    high = F.conv(F.substring(place, 1, 11), 16, 10).cast("decimal(14,0)")
    low = F.conv(F.substring(place, 12, 12), 16, 10).cast("decimal(15,0)")
    hashed = (high * F.lit(1 << 48).cast("decimal(15,0)") + low).cast("decimal(28,0)")
    own = F.when(F.col("depth") > 0, hashed).otherwise(F.lit(0)).cast("decimal(28,0)")
    valued = turns.select("conv_id", "depth", "chars", own.alias("own"))
    steps = saved(running_sum(valued, ["conv_id"], [F.col("depth")], "own", "total"), "steps")
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("length"))
    return saved(
        steps.join(lengths, "conv_id").select(
            "conv_id",
            "depth",
            "length",
            "chars",
            F.col("total").cast("string").alias("node"),
            F.when(F.col("depth") > 0, (F.col("total") - F.col("own")).cast("string")).alias("parent"),
        ),
        "steps",
    )


def subtree_totals(nodes: DataFrame, steps: DataFrame, small: int = SMALL) -> DataFrame:
    """``node, n_leaves, saved_tokens``: ``leaves`` and ``tokens`` summed over each node's subtree.

    ``nodes`` has one conversation through each node in ``conv_id`` and its subtree's weight in ``weight``.
    """
    root = nodes.where("parent is null").select("node", "weight").first()
    if root is None:
        return nodes.select("node", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    whole = [F.lit(root.node).alias("top"), F.lit(root.weight).alias("total")]
    state = nodes.select("*", *whole, zero.alias("n_leaves"), zero.alias("saved_tokens"))
    ready = done = None
    while True:
        state = saved(state, "trie")
        rest = state.where(F.col("total") <= small)
        ready = rest if ready is None else ready.unionByName(rest)
        state = state.where(F.col("total") > small)
        if state.isEmpty():
            break
        state, centroids = _cut(state, steps)
        done = centroids if done is None else done.unionByName(centroids)
    inside = _finished(ready)
    return inside if done is None else inside.unionByName(done)


def _cut(state: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut each component at its centroid: what is left of them, and the centroids with their totals."""
    heavy = state.where(2 * F.col("weight") >= F.col("total")).groupBy("top")
    centroids = heavy.agg(
        F.max(F.struct("depth", "node", "conv_id", "weight")).alias("c"), F.min("depth").alias("top_depth")
    )
    # The step just behind the centroid's depth tells whether a node lies under it, and in which part.
    names = {"conv_id": "__conv", "depth": "__depth", "node": "__part", "parent": "__up"}
    behind = steps.select(*[F.col(c).alias(n) for c, n in names.items()])
    placed = state.join(centroids, "top").join(
        behind, (F.col("conv_id") == F.col("__conv")) & (F.col("c.depth") + 1 == F.col("__depth")), "left"
    )
    is_centroid = F.col("node") == F.col("c.node")
    under = ~is_centroid & (F.col("depth") > F.col("c.depth")) & F.coalesce(F.col("__up") == F.col("c.node"), F.lit(False))
    placed = saved(
        placed.withColumns({"is_centroid": is_centroid, "under": under, "part": F.when(under, F.col("__part"))}).drop(
            "__conv", "__depth", "__part", "__up"
        ),
        "placed",
    )
    totals = saved(
        placed.where("under or is_centroid").groupBy("top").agg(
            F.sum("leaves").alias("add_leaves"), F.sum("tokens").alias("add_tokens")
        ),
        "totals",
    )
    centroids = centroids.join(totals, "top")
    done = placed.where("is_centroid").join(totals, "top").select(
        "node",
        (F.col("n_leaves") + F.col("add_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("add_tokens")).alias("saved_tokens"),
    )
    of_centroid = {"conv_id": "conv_id", "depth": "until", "weight": "lost"}
    path = centroids.select(*[F.col(f"c.{c}").alias(n) for c, n in of_centroid.items()], "top_depth", "add_leaves", "add_tokens")
    path = path.join(steps.select("conv_id", "depth", "node"), "conv_id").where(
        (F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("until"))
    )
    parts = placed.where("under").groupBy("part").agg(F.max("weight").alias("part_total"))
    added = placed.where("not is_centroid").join(path.select("node", "lost", "add_leaves", "add_tokens"), "node", "left")
    added = added.join(parts, "part", "left")
    none = F.lit(0).cast("long")
    columns = ["node", "conv_id", "depth", "parent", "leaves", "tokens"]
    rest = added.select(
        *columns,
        (F.col("weight") - F.coalesce("lost", none)).alias("weight"),
        F.coalesce("part", "top").alias("top"),
        F.when(F.col("under"), F.col("part_total")).otherwise(F.col("total") - F.col("c.weight")).alias("total"),
        (F.col("n_leaves") + F.coalesce("add_leaves", none)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("add_tokens", none)).alias("saved_tokens"),
    )
    return rest, done


def _finished(ready: DataFrame) -> DataFrame:
    """Totals of the nodes of small components, each component inside one task."""

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for rows in batches:
            table = pa.Table.from_batches([rows])
            table = table if left is None else pa.concat_tables([left, table])
            tops = np.array(table.column("top").to_pylist(), object)
            last = int(np.flatnonzero(tops == tops[-1])[0]) if len(tops) else 0  # the last component may go on
            if last:
                yield _sums(table.slice(0, last))
            left = table.slice(last)
        if left is not None and len(left):
            yield _sums(left)

    needed = ["top", "node", "parent", "depth", "weight", "leaves", "tokens", "n_leaves", "saved_tokens"]
    dealt = ready.select(*needed).repartition("top").sortWithinPartitions("top")
    return dealt.mapInArrow(finish, "node string, n_leaves long, saved_tokens long")


def _sums(table: pa.Table) -> pa.RecordBatch:
    column = {c: table.column(c).to_pylist() for c in ("node", "parent", "top")}
    numbers = {c: table.column(c).to_numpy() for c in ("depth", "weight", "leaves", "tokens", "n_leaves", "saved_tokens")}
    at = {node: i for i, node in enumerate(column["node"])}
    parent = np.array(
        [-1 if n == t else at[p] for n, p, t in zip(column["node"], column["parent"], column["top"], strict=True)]
    )
    inside = subtree_sums(parent, numbers["depth"], numbers["weight"], np.array([numbers["leaves"], numbers["tokens"]]))
    return batch(
        {
            "node": column["node"],
            "n_leaves": inside[0] + numbers["n_leaves"],
            "saved_tokens": inside[1] + numbers["saved_tokens"],
        },
        SUMS,
    )


def subtree_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over subtrees of a forest, by cutting all its components at once, again and again.

    ``parent`` is -1 at the tops; ``weight`` is that of each subtree, and larger than that of any below it.
    """
    n = len(parent)
    parent, weight = parent.copy(), weight.copy()
    sums = np.zeros_like(values)
    alive = np.ones(n, bool)
    while alive.any():
        top = _tops(parent)
        heavy = np.flatnonzero(alive & (2 * weight >= weight[top]))
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        deepest = np.append(top[heavy][1:] != top[heavy][:-1], True)
        center = heavy[deepest]
        alive[center] = False
        at, lost = parent[center], weight[center]
        parent[center] = -1
        below = np.flatnonzero((parent >= 0) & ~alive[parent])
        owner = parent[below]
        parent[below] = -1
        top = _tops(parent)
        for value, total in zip(values, sums, strict=True):
            parts = np.zeros(n, values.dtype)
            np.add.at(parts, top[alive], value[alive])
            gathered = np.where(alive, 0, value)
            np.add.at(gathered, owner, parts[below])
            add, up = gathered[center], at
            total[center] += add
            while len(up := up[(inner := up >= 0)]):
                add = add[inner]
                total[up] += add
                up = parent[up]
        while len(at := at[(inner := at >= 0)]):
            lost = lost[inner]
            weight[at] -= lost
            at = parent[at]
    return sums


def _tops(parent: np.ndarray) -> np.ndarray:
    """The top of each node's component."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


def members_at_end(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the comma-joined ids of each node, ascending.

    The ids are sorted by range over all tasks and joined into pieces there; so the task that hashes the
    list of a popular node reads few rows, and holds one piece at a time.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, i) for b in batches for n, i in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple[str, int, str]] = []
        for node, group in itertools.groupby(rows, lambda r: r[0]):
            ids = (i for _, i in group)
            while piece := list(itertools.islice(ids, PIECE)):
                out.append((node, piece[0], ",".join(map(str, piece))))
                if len(out) >= PIECE or len(piece) == PIECE:
                    yield _table(out, PIECES)
                    out = []
        if out:
            yield _table(out, PIECES)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((b.column("node").to_pylist(), b.column("ids").to_pylist()) for b in batches)
        rows = (pair for nodes, ids in columns for pair in zip(nodes, ids, strict=True))
        out: list[tuple[str, str]] = []
        for node, group in itertools.groupby(rows, lambda r: r[0]):
            total = hashlib.sha256()
            for k, (_, piece) in enumerate(group):
                total.update(("," * (k > 0) + piece).encode())
            out.append((node, total.hexdigest()))
            if len(out) >= PIECE:
                yield _table(out, ENDS)
                out = []
        if out:
            yield _table(out, ENDS)

    ordered = ends.select("node", "conv_id").orderBy("node", "conv_id")
    pieces = ordered.mapInArrow(join, "node string, first long, ids string")
    dealt = pieces.repartition("node").sortWithinPartitions("node", "first")
    return dealt.mapInArrow(digest, "node string, ends_sha256 string")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return batch({f: [r[i] for r in rows] for i, f in enumerate(schema.names)}, schema)
