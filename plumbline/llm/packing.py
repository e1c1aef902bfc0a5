"""Filling containers of fixed capacity with items of varying length.

A text longer than the capacity is cut into pieces of exactly the capacity and a rest; all else stays whole. The pieces are spread by hash
over blocks of a bounded number of items, and each block is packed by best-two-fit: a pack is filled greedily with the longest item that
still fits; then its shortest item is taken out again if two unpacked items fill the wider gap better. Lengths are small numbers, so a
block is packed over counts per length, and items of one length are interchangeable.

Defined cases: items without tokens (null and empty texts) take no room and are in no pack (``pack_id`` null); null ids take no part;
repeated document ids are separate items; a capacity below 1 or null, or without a name, is ignored; empty tables give no packs.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.encoding import token_counts
from plumbline.session import cut, table

#: Items that are packed together; the packs left part empty are about one per block.
BLOCK_ITEMS = 20_000


class _Stock:
    """Counts of unpacked items per length."""

    def __init__(self, lengths: list[int]) -> None:
        self.n: dict[int, int] = {}
        for x in lengths:
            self.n[x] = self.n.get(x, 0) + 1
        self.order = sorted(self.n)

    def take(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            del self.n[x]
            self.order.pop(bisect_right(self.order, x) - 1)

    def give(self, x: int) -> None:
        if x in self.n:
            self.n[x] += 1
        else:
            self.n[x] = 1
            insort(self.order, x)

    def best(self, room: int) -> int | None:
        """The greatest length that fits."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two items that fill ``room`` best, and better than ``above``: one pointer runs down, the other up."""
        order, i, j, found = self.order, 0, bisect_right(self.order, room) - 1, None
        while i <= j:
            total = order[i] + order[j]
            if total > room or (i == j and self.n[order[i]] < 2):
                j -= 1
                continue
            if total > above:
                above, found = total, (order[i], order[j])
                if total == room:
                    break
            i += 1
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Packs as lists of lengths."""
    packs = [[x] for x in lengths if x == capacity]
    stock = _Stock([x for x in lengths if 0 < x < capacity])
    while stock.order:
        pack, room = [], capacity
        while (x := stock.best(room)) is not None:
            stock.take(x)
            pack.append(x)
            room -= x
        if room and stock.order:
            least = pack[-1]  # the last one is the shortest
            two = stock.best_two(room + least, least)
            if two:
                pack.pop()
                for x in two:
                    stock.take(x)
                    pack.append(x)
                stock.give(least)
        packs.append(pack)
    return packs


def _pack_block(items: pd.DataFrame) -> pd.DataFrame:
    capacity = int(items["capacity"].iloc[0])
    items = items.sort_values(["n_tokens", "doc_id", "piece"], ignore_index=True)
    rows: dict[int, list[int]] = {}
    for i, n in enumerate(items["n_tokens"].tolist()):
        rows.setdefault(n, []).append(i)
    number = [0] * len(items)
    for k, pack in enumerate(best_two_fit(items["n_tokens"].tolist(), capacity)):
        for n in pack:
            number[rows[n].pop()] = k
    prefix = items["pack_name"].iloc[0] + "-" + str(items["block"].iloc[0]) + "-"
    return items.assign(pack_id=[prefix + str(k) for k in number]).drop(columns="block")


_SCHEMA = "pack_name string, capacity long, doc_id long, piece int, n_pieces int, start_token long, n_tokens long, pack_id string"


def pieces(counts: DataFrame, capacities: DataFrame) -> DataFrame:
    """counts(doc_id, n_tokens) x capacities(pack_name, capacity; a few rows) -> the items of every capacity."""
    caps = sorted({(r["pack_name"], r["capacity"]) for r in capacities.where("capacity >= 1 and pack_name is not null").select("pack_name", "capacity").collect()})  # a few rows by definition
    each_cap = F.array(*(F.struct(F.lit(k).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for k, c in caps))
    each = counts.where(F.col("doc_id").isNotNull() if caps else F.lit(False)).select("doc_id", "n_tokens", F.explode(each_cap if caps else F.array(F.struct(F.lit("").alias("pack_name"), F.lit(1).cast("long").alias("capacity")))).alias("_c"))
    each = each.select("doc_id", "n_tokens", "_c.pack_name", "_c.capacity")
    each = each.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int"))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece") * F.col("capacity")
    return each.select("pack_name", "capacity", "doc_id", "piece", "n_pieces", start.alias("start_token"), F.least("capacity", F.col("n_tokens") - start).alias("n_tokens"))


def pack_documents(counts: DataFrame, capacities: DataFrame) -> DataFrame:
    """Every item with the pack it is in."""
    items = pieces(counts, capacities)
    blocks = {r["pack_name"]: -(-r["n"] // BLOCK_ITEMS) for r in items.groupBy("pack_name").agg(F.count("*").alias("n")).collect()}  # a row per capacity
    of = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv)) if blocks else F.create_map(F.lit(""), F.lit(1))
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(of, F.col("pack_name")).cast("long"))
    full = items.where("n_tokens > 0").withColumn("block", block)
    packed = full.groupBy("pack_name", "block").applyInPandas(_pack_block, _SCHEMA)
    return packed.unionByName(items.where("n_tokens <= 0").withColumn("pack_id", F.lit(None).cast("string")))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return cut(token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """The pack of every item for every capacity."""
    return pack_documents(_counts(spark, d), table(spark, d, "pack_capacity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that must be cut for the pack 'wide'."""
    packed = pack_documents(_counts(spark, d), table(spark, d, "pack_capacity").where("pack_name = 'wide'"))
    return packed.where("n_pieces > 1").select("doc_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Packs and unused space per capacity."""
    packs = p8_packs(spark, d).where("pack_id is not null").groupBy("pack_name", "capacity", "pack_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return packs.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_packs"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.sum(F.col("capacity") - F.col("used")).alias("n_free"))


QUERIES = {"p8_found": p8_found, "p8_packs": p8_packs, "p8_report": p8_report}
ORACLE = {}
