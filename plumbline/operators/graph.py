"""Reachability in the lineage graph by frontiers: each round joins the last round's nodes with the edges, and a node is kept once.

The cost is edges times rounds whatever the number of paths, cycles end by themselves, and a round's result is written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranking import global_position
from plumbline.session import cut

#: Rounds after which what was seen is brought together in one table.
FOLD = 6
#: Edges up to which the layer of one root, which has no more rows, is ranked in one task.
LAYER_ROWS = 2_000_000
#: Edges of a graph that tasks hold as numbers, 8 bytes an edge, to walk from many roots; a larger graph is walked by joins.
PACKED_EDGES = 20_000_000
#: Names that are broadcast to be put on pairs of numbers.
NAMES = 500_000


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """edges(src, dst), seeds(root) -> (root, node, depth): all nodes downstream of each root with their least depth, the root itself left out.

    64 roots walk together as the bits of a long: a round joins (block of roots, node) with the edges and ors the bits, so its cost is that
    of one walk per block and not per root.
    """
    edges = cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())  # read once per round
    numbered = global_position(seeds.select("root").where("root is not null").distinct(), F.col("root"), name="n")
    roots = cut(numbered.select("root", F.floor((F.col("n") - 1) / 64).cast("int").alias("block"), ((F.col("n") - 1) % 64).cast("int").alias("bit")))
    layers = [cut(roots.groupBy("block", F.col("root").alias("node")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))]
    done, recent = None, [layers[0]]  # what was seen: up to the last fold, and the layers since then
    while depth is None or len(layers) <= depth:
        step = layers[-1].join(edges, layers[-1]["node"] == edges["src"]).groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"))
        seen = reduce(DataFrame.unionByName, recent if done is None else [done, *recent])
        seen = seen.groupBy("block", "node").agg(F.bit_or("mask").alias("_seen"))
        fresh = step.join(seen, ["block", "node"], "left").select("block", "node", F.expr("mask & ~coalesce(_seen, 0L)").alias("mask")).where("mask <> 0")
        layers.append(cut(fresh))
        if layers[-1].isEmpty():
            layers.pop()
            break
        recent.append(layers[-1])
        if len(recent) == FOLD:
            folded = reduce(DataFrame.unionByName, recent if done is None else [done, *recent])
            done, recent = cut(folded.groupBy("block", "node").agg(F.bit_or("mask").alias("mask"))), []
    out = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).where("false")
    for level, x in enumerate(layers[1:], 1):
        bits = x.select("block", "node", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(mask, b) & 1L) = 1)")).alias("bit"))
        out = out.unionByName(bits.join(roots, ["block", "bit"]).select("root", "node", F.lit(level).alias("depth")))
    return out


@dataclass
class Packed:
    """A graph whose nodes are numbers from 0, small enough for a task: its edges by target, so that a step of 64 roots is one reduction over them."""

    names: DataFrame  # (id, name)
    n: int
    roots: np.ndarray
    src: np.ndarray
    dst: np.ndarray  # the different targets, and where the edges of each start
    starts: np.ndarray

    def mask(self, nodes: DataFrame) -> np.ndarray:
        """nodes(node) -> whether each number is one of them."""
        out = np.zeros(self.n, bool)
        out[self.names.join(nodes.select(F.col("node").alias("name")), "name", "left_semi").select("id").toArrow()["id"].to_numpy()] = True
        return out

    def levels(self, roots: np.ndarray, depth: int | None, rim: np.ndarray | None, hops: int) -> Iterator[tuple[int, np.ndarray]]:
        """(level, masks) with a bit per root at each node that it reaches there first; from nodes of the ``rim`` reached less than ``hops`` before the end, ``hops`` steps more."""

        def step(f: np.ndarray) -> np.ndarray:
            out = np.zeros(self.n, np.uint64)
            if len(self.src):
                out[self.dst] = np.bitwise_or.reduceat(f[self.src], self.starts)
            return out

        f = np.zeros(self.n, np.uint64)
        f[roots] = np.left_shift(np.uint64(1), np.arange(len(roots), dtype=np.uint64))
        seen, level, beyond = f.copy(), 0, {}
        while depth is None or level < depth:
            f, level = step(f) & ~seen, level + 1
            if not f.any():
                break
            seen |= f
            yield level, f
            if rim is not None and level > depth - hops:
                far = np.where(rim, f, np.uint64(0))
                for k in range(1, hops + 1):
                    far = step(far)
                    if level + k > depth:
                        beyond[level + k] = beyond.get(level + k, 0) | far
        for level in sorted(beyond):
            f = beyond[level] & ~seen
            seen |= f
            yield level, f


def packed(edges: DataFrame, seeds: DataFrame) -> Packed | None:
    """edges(src, dst) and seeds(root) as numbers; None if there are too many edges."""
    edges = cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    if edges.count() > PACKED_EDGES:
        return None
    seeds = seeds.select("root").where("root is not null").distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("name")).union(seeds).distinct()
    names = cut(global_position(nodes, F.col("name"), name="id").select((F.col("id") - 1).cast("int").alias("id"), "name"))
    at = lambda c: names.select(F.col("id").alias(f"_{c}"), F.col("name").alias(c))
    e = edges.join(at("src"), "src").join(at("dst"), "dst").select("_src", "_dst").toArrow()
    src, dst = e["_src"].to_numpy(), e["_dst"].to_numpy()
    by = np.argsort(dst, kind="stable")
    targets, starts = np.unique(dst[by], return_index=True)
    roots = np.sort(seeds.join(at("root"), "root").select("_root").toArrow()["_root"].to_numpy())
    return Packed(names, names.count(), roots, src[by], targets, starts)


def _by_blocks(g: Packed, work, schema: str) -> DataFrame:
    """work(block of 64 roots) -> batches, over all blocks."""
    blocks = -(-len(g.roots) // 64)
    return g.names.sparkSession.range(0, blocks, 1, max(1, min(blocks, 1000))).mapInArrow(lambda batches: (out for b in batches for i in b.column(0).to_pylist() for out in work(i)), schema)


def _bits(masks: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(masks).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sent(g: Packed, more: tuple) -> Broadcast:
    return g.names.sparkSession.sparkContext.broadcast((Packed(None, g.n, g.roots, g.src, g.dst, g.starts), *more))


def packed_pairs(g: Packed, depth: int | None = None, wanted: np.ndarray | None = None, rim: np.ndarray | None = None, hops: int = 0) -> DataFrame:
    """(root, node, depth) as ``reach`` gives it, or only of wanted nodes, and what follows from the rim. Pairs are numbers until they are written."""
    sent = _sent(g, (wanted, rim))

    def work(i: int) -> Iterator[pa.RecordBatch]:
        g, wanted, rim = sent.value
        roots = g.roots[64 * i : 64 * i + 64]
        for level, f in g.levels(roots, depth, rim, hops):
            at = np.flatnonzero(f if wanted is None else np.where(wanted, f, np.uint64(0)))
            for k in range(0, len(at), 4096):
                node, bit = np.nonzero(_bits(f[at[k : k + 4096]]))
                yield pa.record_batch([pa.array(roots[bit]), pa.array(at[k : k + 4096][node].astype(np.int32)), pa.array(np.full(len(bit), level, np.int32))], ["_root", "_node", "depth"])

    pairs = _by_blocks(g, work, "_root int, _node int, depth int")
    name = F.broadcast if g.n <= NAMES else lambda df: df
    for c in ("root", "node"):
        pairs = pairs.join(name(g.names.select(F.col("id").alias(f"_{c}"), F.col("name").alias(c))), f"_{c}")
    return pairs.select("root", "node", "depth")


def packed_counts(g: Packed, classes: DataFrame, depth: int | None = None, rim: np.ndarray | None = None, hops: int = 0) -> DataFrame:
    """classes(node, class long) of all nodes -> (root, class, n): how many nodes of each class a root reaches, without a row per pair."""
    c = g.names.join(classes.withColumnRenamed("node", "name"), "name").select("id", "class").toArrow()
    values, of = np.unique(c["class"].to_numpy(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    sent = _sent(g, (values, c["id"].to_numpy()[order], np.unique(of[order], return_index=True)[1], rim))

    def work(i: int) -> Iterator[pa.RecordBatch]:
        g, values, order, starts, rim = sent.value
        roots, hit = g.roots[64 * i : 64 * i + 64], np.zeros(g.n, np.uint64)
        for _, f in g.levels(roots, depth, rim, hops):
            hit |= f
        if len(order):
            for b in range(0, len(roots), 8):
                bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8)[order, b // 8].reshape(-1, 1), axis=1, bitorder="little")
                n = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                cls, bit = np.nonzero(n)
                yield pa.record_batch([pa.array(roots[b + bit]), pa.array(values[cls]), pa.array(n[cls, bit])], ["_root", "class", "n"])

    return _by_blocks(g, work, "_root int, class long, n long").join(g.names.select(F.col("id").alias("_root"), F.col("name").alias("root")), "_root").select("root", "class", "n")


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(root, node, path): to each node within ``depth`` steps (None: however far), or only to targets(node), the least path in node order among the shortest
    ones, as an array from root to node.

    Rounds carry no paths. A path is the least if its predecessor's is, so within a layer it is known by its rank, a number; the paths
    themselves are put together at the end, layer by layer backwards, for the targets only.
    """
    edges = cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())  # read once per round
    layers = [cut(seeds.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("before")).distinct())]
    total, large = layers[0], edges.count() > LAYER_ROWS
    while depth is None or len(layers) <= depth:
        x = layers[-1]
        step = x.join(edges, x["node"] == edges["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.min("rank").alias("before"))
        new = step.join(total.select("root", "node"), ["root", "node"], "left_anti")
        if large:  # ranks only have to grow with (before, node) within a root: the numbers of sorted ranges do, and no root's layer is one task
            new, rank = new.repartitionByRange("root", "before", "node").sortWithinPartitions("root", "before", "node"), F.monotonically_increasing_id()
        else:
            rank = F.row_number().over(Window.partitionBy("root").orderBy("before", "node")).cast("long")
        fresh = cut(new.select("root", "node", rank.alias("rank"), "before"))
        if fresh.isEmpty():
            break
        layers.append(fresh)
        total = total.unionByName(fresh)
        if len(layers) % FOLD == 0:
            total = cut(total)
    wanted = None if targets is None else targets.select("node").distinct()
    back = None
    for level in range(len(layers) - 1, -1, -1):
        x = layers[level]
        if back is not None:
            up = x.select("root", F.col("rank").alias("_b"), F.col("node").alias("_n"), F.col("before").alias("_next"))
            back = back.withColumnRenamed("before", "_b").join(up, ["root", "_b"]).select("root", "node", F.col("_next").alias("before"), F.array_prepend("path", F.col("_n")).alias("path"))
        if level:
            ends = (x if wanted is None else x.join(wanted, "node", "left_semi")).select("root", "node", "before", F.array("node").alias("path"))
            back = ends if back is None else back.unionByName(ends)
    if back is None:
        return layers[0].select("root", "node", F.array("node").alias("path")).where("false")
    return back.select("root", "node", "path")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(node) -> (node): everything that can be reached from any of them, the seeds too."""
    edges, total = cut(edges.select("src", "dst").distinct()), cut(seeds.select("node").distinct())
    frontier = total
    while True:
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(total, "node", "left_anti"))
        if frontier.isEmpty():
            return total
        total = total.unionByName(frontier)


def witnesses(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(node) -> (node, seed): up to two different seeds that each node leads to, the seeds themselves included. One says that a node leads
    to a seed, two that it leads to another than itself; a node with two needs no more, so no node is kept more than twice.
    """
    edges, total = cut(edges.select("src", "dst").distinct()), cut(seeds.select("node", F.col("node").alias("seed")).distinct())
    frontier, rounds = total, 0
    while True:
        step = frontier.join(edges, frontier["node"] == edges["dst"]).select(F.col("src").alias("node"), "seed").distinct()
        new = step.join(total, ["node", "seed"], "left_anti").groupBy("node").agg(F.min("seed").alias("_a"), F.max("seed").alias("_b"))
        had = total.groupBy("node").agg(F.count("*").alias("_n"))
        gained = F.when(F.col("_n").isNull(), F.array_distinct(F.array("_a", "_b"))).when(F.col("_n") < 2, F.array("_a"))
        frontier, rounds = cut(new.join(had, "node", "left").select("node", F.explode(gained).alias("seed"))), rounds + 1
        if frontier.isEmpty():
            return total
        total = total.unionByName(frontier)
        if rounds % FOLD == 0:
            total = cut(total)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour) over one hop in either direction."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(e.select("dst", "src")).distinct()


def ego_net(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """centre(node) -> the edges that touch one of them."""
    c = centre.select("node").distinct()
    return edges.join(c.withColumnRenamed("node", "src"), "src", "left_semi").union(edges.join(c.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """pairs(root, node) -> the least shortest path of each pair that has one."""
    return shortest_paths(edges, pairs.select("root").distinct(), depth, pairs.select("node")).join(pairs.distinct(), ["root", "node"], "left_semi")
