"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. A prefix is known by 128 bits: sums over its turns of hashes of (digest of role and text, position), so they are prefix sums, taken
inside blocks of BLOCK turns and over the blocks' totals. A node's weight R, the number of turns its members have from there on, is one grouping away and makes the tree ready to be split.

Subtree sums come from a centroid decomposition of the parent-edge forest. In a component with the total weight W the nodes that have half of it or more below them are a path from the top, and the last one is the centroid. What lies
in the centroid's subtree is added to every node of that path; then the component falls apart into the subtrees of the centroid's children and the part above it, whose path nodes weigh less by the centroid's subtree. A node and a node below it
are thus added once: in the component in which a centroid lies between them. Weights halve, so there are at most log2 of all turns rounds. Components above LOCAL turns are split by joins and groupings over all of them
at once, each round written down; smaller ones, which fit a task, are finished in arrays, the components of a batch together.

Rules for odd rows: turns are ordered by turn (null first), then role, then text, null roles and texts being empty; repeated rows are turns of their own; rows without a conv_id are left out;
conv_id % REBASE has the sign of conv_id, as in SQL; a conversation of any length is split over tasks; a table without conversations has no nodes; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import BROADCAST_ROWS, whole_runs, written

REBASE, HEADS = 20, 4
BLOCK, LOCAL = 4096, 200_000
#: Bytes of conv_ids that a piece of a node's list has at most, and rows of an Arrow batch besides.
_PIECE = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast when its measured count is at most BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of conversations (conv_id, turn, role, text): positions from 1.

    Rows are sorted by ranges, so a conversation may lie in several partitions; each counts its own rows, and the counts of the partitions before are added.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    # Ranges are cut by a beginning of the texts only: what is sampled stays small, and equal beginnings stay together.
    t = t.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    t = written(t.select("conv_id", "role", "text").mapInArrow(_numbered, "conv_id long, role string, text string, inside long, part int"), "ordered")
    parts = t.groupBy("conv_id", "part").agg(F.max("inside").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("before")).filter("before > 0")  # at most one conversation for each partition
    later = _small(written(later, "later_parts"))
    t = t.join(later, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return t.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their number inside the conversation and partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        begin = np.nonzero(np.r_[True, conv[1:] != conv[:-1]])[0]
        number = np.arange(len(conv)) - np.repeat(begin, np.diff(np.r_[begin, len(conv)])) + 1
        if conv[0] == last:
            number[: begin[1] if len(begin) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number), pa.array(np.full(len(conv), part, np.int32))], names=["conv_id", "role", "text", "inside", "part"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations of `ordered_turns`: their turns (conv_id, pos, digest, tokens), and (conv_id, n) of all.

    A conversation begins with the first h turns of conversation conv_id - conv_id % REBASE and goes on with its own after its first h; h = crc32(conv_id) % HEADS.
    """
    turns = turns.select(
        "conv_id", "pos", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"),
        F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("tokens"),
    )
    turns = written(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % REBASE)
    heads = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % REBASE == 0)).groupBy(F.col("conv_id").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "tokens"))).alias("heads"))
    convs = convs.join(heads, F.col("base") == F.col("b"), "left")
    convs = convs.withColumn("heads", F.coalesce(F.filter("heads", lambda x: x["pos"] <= F.col("h")), F.array().cast("array<struct<pos:long,digest:string,tokens:long>>")))
    convs = convs.withColumn("lead", F.size("heads").cast("long")).withColumn("n", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "h", "heads", "lead", "n"), "conversations")
    front = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", "t.*")
    own = turns.join(convs.select(F.col("conv_id").alias("c"), "h", "lead"), F.col("conv_id") == F.col("c")).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "tokens")
    return front.unionByName(own), convs.select("conv_id", "n")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each turn of `rebuilt`: (conv_id, depth, k1, k2, p1, p2, t1, t2, tokens, rest, last): hash of the prefix that ends here, of the one before, and of the first turn's; turns from here on."""
    sums = ["h1", "h2", "h3", "h4"]
    one, two = F.xxhash64("digest", "pos"), F.xxhash64("pos", "digest")
    low = F.lit(0xFFFFFFFF).cast("long")
    t = turns.withColumns({"h1": F.shiftright(one, 32), "h2": one.bitwiseAND(low), "h3": F.shiftright(two, 32), "h4": two.bitwiseAND(low), "block": F.floor((F.col("pos") - 1) / BLOCK)}).drop("digest")
    t = t.withColumns({f"u{s}": F.col(s) for s in sums})
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = written(t.withColumns({s: F.sum(s).over(inside) for s in sums}), "block_sums")
    totals = t.groupBy("conv_id", "block").agg(*[F.max_by(s, "pos").alias(s) for s in sums])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b_block"), *[F.sum(s).over(earlier).alias(f"e{s}") for s in sums]).filter("eh1 is not null")
    totals = _small(written(totals, "block_totals"))  # only conversations of more than one block
    t = t.join(totals, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b_block")), "left")
    t = t.withColumns({s: F.col(s) + F.coalesce(f"e{s}", F.lit(0)) for s in sums})
    t = t.join(convs.select(F.col("conv_id").alias("n_conv"), "n"), F.col("conv_id") == F.col("n_conv"))
    before = {s: F.col(s) - F.col(f"u{s}") for s in sums}
    key = lambda of, depth: [F.xxhash64(of["h1"], of["h2"], depth), F.xxhash64(of["h3"], of["h4"], depth)]
    k, p = key({s: F.col(s) for s in sums}, F.col("pos")), key(before, F.col("pos") - 1)
    t = t.select("conv_id", F.col("pos").alias("depth"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), "tokens", (F.col("n") - F.col("pos") + 1).alias("rest"), (F.col("n") == F.col("pos")).alias("last"))
    t = written(t, "prefixes")
    tops = t.filter("depth = 1").select(F.col("conv_id").alias("c"), F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    return t.join(tops, F.col("conv_id") == F.col("c")).drop("c")


def tree_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of `prefixes` but the root: (k1, k2, conv_id, depth, p1, p2, t1, t2, n_convs, rest, saved): the smallest member, the number of members, their turns from here on."""
    n = paths.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("rest").alias("rest"), *[F.any_value(c).alias(c) for c in ("depth", "p1", "p2", "t1", "t2", "tokens")]
    )
    return n.withColumn("saved", (F.col("n_convs") - 1) * F.col("tokens")).drop("tokens")


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """(k1, k2, values): for each of `tree_nodes` the sums of `values` over its subtree, by centroid decomposition."""
    columns = ["k1", "k2", "p1", "p2", "conv_id", "depth", "rest", "c1", "c2", *values]
    big = nodes.withColumnsRenamed({"t1": "c1", "t2": "c2"}).select(*columns)
    small, gains = None, None
    add = lambda all_, more: more if all_ is None else all_.unionByName(more)
    while True:
        sizes = big.groupBy(F.col("c1").alias("s1"), F.col("c2").alias("s2")).agg(F.max("rest").alias("total")).filter(F.col("total") > local)
        sizes = _small(written(sizes, "large_components"))
        big = big.join(sizes, (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")), "left").drop("s1", "s2")
        big = written(big, "components")
        small = add(small, big.filter("total is null").drop("total"))
        big = big.filter("total is not null")
        if sizes.isEmpty():
            break
        path = big.filter(2 * F.col("rest") >= F.col("total"))
        centroids = path.groupBy(F.col("c1").alias("s1"), F.col("c2").alias("s2")).agg(F.min_by(F.struct("k1", "k2", "depth", "rest"), "rest").alias("x"))
        centroids = _small(written(centroids, "centroids"))
        big = big.join(centroids, (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2"))).drop("s1", "s2")
        # Where the conversation of a node deeper than the centroid goes on after the centroid's depth, if it passes the centroid at all.
        steps = paths.select(F.col("conv_id").alias("w_conv"), F.col("depth").alias("w_depth"), F.struct("k1", "k2", "p1", "p2").alias("w"))
        big = big.join(steps, (F.col("conv_id") == F.col("w_conv")) & (F.col("depth") > F.col("x.depth")) & (F.col("w_depth") == F.col("x.depth") + 1), "left").drop("w_conv", "w_depth")
        at = (F.col("k1") == F.col("x.k1")) & (F.col("k2") == F.col("x.k2"))
        under = F.coalesce((F.col("w.p1") == F.col("x.k1")) & (F.col("w.p2") == F.col("x.k2")), F.lit(False))
        big = written(big.withColumns({"at": at, "under": under, "on_path": 2 * F.col("rest") >= F.col("total")}), "split")
        below = big.filter("at or under").groupBy(F.col("c1").alias("s1"), F.col("c2").alias("s2")).agg(*[F.sum(v).alias(f"b_{v}") for v in values])
        got = big.filter("on_path").join(_small(written(below, "below")), (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")))
        gains = add(gains, written(got.select("k1", "k2", *[F.col(f"b_{v}").alias(v) for v in values]), "gains"))
        rest = F.when(F.col("on_path"), F.col("rest") - F.col("x.rest")).otherwise(F.col("rest"))
        big = big.filter("not at").withColumns({"rest": rest, "c1": F.when(F.col("under"), F.col("w.k1")).otherwise(F.col("c1")), "c2": F.when(F.col("under"), F.col("w.k2")).otherwise(F.col("c2"))}).select(*columns)
    dealt = small.select("c1", "c2", "k1", "k2", "p1", "p2", "depth", "rest", *values).repartition("c1", "c2").sortWithinPartitions("c1", "c2", "depth")
    done = dealt.mapInArrow(_finished(len(values)), "k1 long, k2 long, " + ", ".join(f"{v} long" for v in values))
    return add(gains, done).groupBy("k1", "k2").agg(*[F.sum(v).alias(v) for v in values])


def _finished(n_values: int):
    """Rows (c1, c2, k1, k2, p1, p2, depth, rest, values), sorted by component and depth, to (k1, k2, subtree sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 2):
            c1, c2, k1, k2, p1, p2, depth, rest = (table.column(i).to_numpy() for i in range(8))
            values = np.stack([table.column(8 + i).to_numpy() for i in range(n_values)])
            component = np.cumsum(np.r_[True, (np.diff(c1) != 0) | (np.diff(c2) != 0)]) - 1
            sums = centroid_sums(component, parents(k1, k2, p1, p2, component), rest.astype(np.int64), values)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, *sums)], names=["k1", "k2", *[f"v{i}" for i in range(n_values)]])

    return run


def parents(k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Each node's parent among the nodes of its component, or -1."""
    both = np.unique(np.stack([np.r_[k1, p1], np.r_[k2, p2]]), axis=1, return_inverse=True)[1].reshape(-1)
    number, wanted = both[: len(k1)], both[len(k1) :]
    at = np.full(int(both.max(initial=-1)) + 1, -1)
    at[number] = np.arange(len(k1))
    up = at[wanted]
    return np.where((up >= 0) & (component[up] == component), up, -1)


def centroid_sums(component: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (one row per kind) over the subtrees of components whose nodes come after their parents. weight: the total of positive node weights over each subtree."""
    n = len(component)
    size, first, order = np.ones(n, np.int64), np.zeros(n, np.int64), parent.tolist()
    for v in range(n - 1, -1, -1):
        if order[v] >= 0:
            size[order[v]] += size[v]
    # Places in depth-first order: a subtree is an interval of them.
    free, at = np.zeros(n, np.int64), 0
    for v in range(n):
        if order[v] < 0:
            first[v], at = at, at + size[v]
        else:
            first[v] = free[order[v]]
            free[order[v]] += size[v]
        free[v] = first[v] + 1
    by_place = np.argsort(first)
    component, weight, values, size = component[by_place].copy(), weight[by_place].copy(), values[:, by_place], size[by_place]
    up = np.where(parent[by_place] >= 0, first[parent[by_place]], -1)
    place, sums = np.arange(n), np.zeros_like(values)
    live = place
    while len(live):
        # Nodes of one component in a row, in depth-first order.
        live = live[np.argsort(component[live], kind="stable")]
        of = component[live]
        begin = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
        number = np.cumsum(np.r_[True, of[1:] != of[:-1]]) - 1
        total = np.maximum.reduceat(weight[live], begin)[number]
        path = 2 * weight[live] >= total
        # The last of a path is its centroid: nodes come after their parents.
        centroid = np.zeros(len(begin), np.int64)
        centroid[number[path]] = live[path]
        x = centroid[number]
        under = (live >= x) & (live < x + size[x])
        below = np.zeros((len(values), len(begin)), values.dtype)
        for row, v in zip(below, values):
            np.add.at(row, number[under], v[live[under]])
        sums[:, live[path]] += below[:, number[path]]
        taken = weight[x]
        weight[live[path]] -= taken[path]
        # The children of centroids are tops of new components; a node under a centroid belongs to the last of its component's new tops before it.
        tops = live[under & (up[live] == x)]
        in_order = live[under & (live != x)]
        if len(in_order):
            old = component.copy()
            key = lambda v: old[v] * np.int64(n + 1) + v
            tops = tops[np.argsort(key(tops))]
            component[in_order] = n + tops[np.searchsorted(key(tops), key(in_order), side="right") - 1]
        live = live[live != x]
        component[live] = np.unique(component[live], return_inverse=True)[1].reshape(-1) if len(live) else component[live]
    out = np.zeros_like(sums)
    out[:, by_place] = sums
    return out


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, conv_id), sorted, to pieces (k1, k2, first, ids) of comma-joined ids."""
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, conv = (b.column(i).to_numpy() for i in range(3))
        cut = np.nonzero((np.diff(k1) != 0) | (np.diff(k2) != 0))[0] + 1
        low, high = np.r_[0, cut], np.r_[cut, len(k1)]
        ids = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[low]), pa.array(k2[low]), pa.array(conv[low]), pa.array(ids)], names=["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (k1, k2, first, ids) to (k1, k2, digest); a node's pieces are hashed as they come."""
    held, digest = None, None
    emit = lambda: pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in held], pa.array([digest.hexdigest()])], names=["k1", "k2", "digest"])
    for b in batches:
        for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            if held == (k1, k2):
                digest.update(b",")
            else:
                if held:
                    yield emit()
                held, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
    if held:
        yield emit()


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the ascending comma-joined conv_ids of each key. Ids are joined where the ranges of the sort put them; a digest then reads its few pieces in order."""
    pieces = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_joined_ids, "k1 long, k2 long, first long, ids string")
    return written(pieces, "pieces").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def _root(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The root's row, of one-row tables; none without conversations."""
    empty = convs.filter("n = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    digest = end_digests(empty).select("ends_sha256")
    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    below = nodes.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    row = members.crossJoin(below).join(digest, F.lit(True), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return row.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero("n_children").alias("n_children"), F.greatest(zero("leaves"), F.lit(1)).alias("n_leaves"), zero("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the rebuilt conversations (conv_id, turn, role, text); local: turns of a component that a task finishes."""
    turns, convs = rebuilt(ordered_turns(rows))
    paths = written(prefixes(turns, convs), "paths")
    nodes = written(tree_nodes(paths), "nodes")
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    keyed = lambda df, **columns: df.select("k1", "k2", *[(columns[c] if c in columns else F.lit(None).cast(t)).alias(c) for c, t in _PARTS.items()])
    # One grouping brings together what is known of a node.
    together = lambda parts: parts.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in _PARTS])
    column = lambda *names: {n: F.col(n) for n in names}
    own = keyed(nodes, **column("conv_id", "depth", "p1", "p2", "t1", "t2", "n_convs", "rest", "saved")).unionByName(keyed(children, n_children=F.col("n_children")))
    nodes = written(together(own).filter("conv_id is not null").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "whole_nodes")
    sums = subtree_sums(nodes, paths, ["leaf", "saved"], local).withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"})
    ends = end_digests(paths.filter("last"))
    parts = keyed(nodes, **column("conv_id", "depth", "p1", "p2", "n_convs", "n_children"))
    parts = parts.unionByName(keyed(sums, **column("n_leaves", "saved_tokens"))).unionByName(keyed(ends, **column("ends_sha256")))
    whole = together(parts)
    # A parent of very many nodes is one row beside two written tables, so adaptive execution can split their partition.
    up = written(nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id")), "parents")
    whole = written(whole, "rolled_up").join(up, (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left")
    smallest = convs.agg(F.min("conv_id").alias("root_conv"))  # one row
    whole = whole.crossJoin(smallest).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.col("parent_conv_id")))
    out = whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    return _root(convs, nodes).unionByName(out)


_PARTS = {
    "conv_id": "long", "depth": "long", "p1": "long", "p2": "long", "t1": "long", "t2": "long", "n_convs": "long", "rest": "long", "saved": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string",
}


def query(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def sql() -> str:
    return f"""
    WITH RECURSIVE t AS (
      SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    crc AS (
      SELECT DISTINCT c, CAST(c AS VARCHAR) AS s, CAST(0 AS BIGINT) AS step, CAST(4294967295 AS BIGINT) AS r FROM t
      UNION ALL
      SELECT c, s, step + 1, CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END
      FROM (SELECT c, s, step, CASE WHEN step % 8 = 0 THEN xor(r, CAST(ascii(s[step // 8 + 1]) AS BIGINT)) ELSE r END AS z FROM crc WHERE step < 8 * length(s))
    ),
    h AS (SELECT c, xor(r, 4294967295) % {HEADS} AS h, c - c % {REBASE} AS base FROM crc WHERE step = 8 * length(s)),
    front AS (SELECT h.c, b.pos, b.role, b.text FROM h JOIN t b ON b.c = h.base AND b.pos <= h.h),
    lead AS (SELECT h.c, h.h, count(f.c) AS n FROM h LEFT JOIN front f ON f.c = h.c GROUP BY h.c, h.h),
    turns AS (SELECT * FROM front UNION ALL SELECT t.c, t.pos - l.h + l.n AS pos, role, text FROM t JOIN lead l ON l.c = t.c AND t.pos > l.h),
    whole AS (SELECT lead.c, list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL) AS w FROM lead LEFT JOIN turns ON turns.c = lead.c GROUP BY lead.c),
    rows AS (SELECT c, d, sha256(CAST(to_json(w[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(to_json(w[1:d - 1]) AS VARCHAR)) END AS p,
        CASE WHEN d > 0 THEN len(regexp_extract_all(w[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words, d = n AS last
      FROM (SELECT c, coalesce(w, []) AS w, coalesce(len(w), 0) AS n, unnest(range(0, coalesce(len(w), 0) + 1)) AS d FROM whole)),
    nodes AS (SELECT k, d, any_value(p) AS p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM rows GROUP BY k, d),
    children AS (SELECT p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY p, d),
    own AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.k AND c.d = n.d),
    sums AS (SELECT a.k, a.d, sum(CAST(b.n_children = 0 AS INTEGER)) AS leaves, sum(b.saved) AS saved
      FROM own b JOIN rows r ON r.c = b.conv_id AND r.d <= b.d JOIN own a ON a.k = r.k AND a.d = r.d GROUP BY a.k, a.d)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
      CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
    FROM own n JOIN sums s ON s.k = n.k AND s.d = n.d LEFT JOIN own u ON u.k = n.p AND u.d = n.d - 1
    """
