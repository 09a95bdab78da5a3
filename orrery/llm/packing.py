"""Packing documents into fixed-length token sequences by a grouping genetic algorithm on islands.

Documents become token ids and an end id; only those longer than a sequence are cut. Full pieces are sequences of their
own. The others are dealt into blocks of bounded size, and every block is packed by several islands. An island starts
from best-fit decreasing. Where that needs more bins than the block's lower bound, and the free space of the ``OPEN``
emptiest bins would make up a whole bin, the items of these are evolved: crossover injects whole well-filled bins of one
parent into another, removes the bins that hold the same items twice, and best-fits the displaced items; mutation opens
some bins and best-fits their items in another order. Between epochs the best solution of every island migrates to the
next one (a Spark shuffle). A block that reaches its bound stops. Bins that stay short by more than ``SLACK`` are opened,
and their items are dealt anew and packed across blocks, as long as fewer than half as many items are left each time (at
most 120 times, which bounds the numbers of sequences).

Defined results: null text is empty (one piece, the end id); repeated rows are documents of their own; an empty table
gives an empty result; further columns of ``docs`` do not matter. A rerun on the same table packs alike.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize, table
from orrery.llm.token_counts import chunks
from orrery.llm.tokens import encoder

CAPACITY = 2048
#: Items of a block on average: bounds an island's memory (some tens of MB) whatever the input. Where a block's small items are
#: used up, bins stay a few tokens short; that costs about the same in a block of any size, so large blocks waste less.
BLOCK_ITEMS = 40_000
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4, 3, 24, 60
#: Generations without progress after which an island rests, share of children by mutation, bins that an island works on.
STALL, MUTATION, OPEN = 15, 0.3, 96
#: Bins with at most this share of the capacity free stay as they are.
SLACK = 0.01


def pieces(docs: DataFrame, tokenizer_path: str, kind: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for) of every row of ``docs``."""
    key = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path, kind)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for b in chunks(whole, 1):
                ids, offsets = memo.batch(b.column(1))
                rows, out = [], []
                for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    data = ids[x:y].tobytes() + end
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append(i)
                        out.append((n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                if rows:
                    n, start, length, crc, own = zip(*out, strict=True)
                    cols = [b.column(0).take(pa.array(rows)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.list_(pa.int32()))] if with_ids else cols, [*names, "ids"] if with_ids else names)

    ddl = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, ddl)


class Bins:
    """Bins of one solution, with best fit in constant time: bins by free space, and a bit for each space that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.by_free, self.spaces = capacity, [], [], {}, 0

    def add(self, items: list[int], free: int) -> None:
        self._at(len(self.items), free)
        self.items.append(items)
        self.free.append(free)

    def _at(self, number: int, free: int) -> None:
        held = self.by_free.get(free)
        if held:
            held.append(number)
        else:
            self.by_free[free] = [number]
            self.spaces |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        room = self.spaces >> size
        if not room:
            self.add([item], self.capacity - size)
            return
        free = size + (room & -room).bit_length() - 1
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.spaces &= ~(1 << free)
        self.items[number].append(item)
        self.free[number] = free - size
        self._at(number, free - size)

    def value(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill); smaller is better."""
        return len(self.items), -sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free) / max(1, len(self.items))


def decreasing(sizes: list[int], capacity: int, order: list[int]) -> Bins:
    out = Bins(capacity)
    for i in order:
        out.best_fit(i, sizes[i])
    return out


def crossover(a: Bins, b: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` with an item twice dissolve; the rest is best-fitted."""
    ranked = sorted(range(len(b.items)), key=lambda n: b.free[n] + rng.random() * 8)
    injected = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]
    child, taken = Bins(a.capacity), set()
    for n in injected:
        child.add(list(b.items[n]), b.free[n])
        taken.update(b.items[n])
    displaced = []
    # the emptiest bin of the first parent dissolves too, so that bins can be saved
    worst = max(range(len(a.items)), key=a.free.__getitem__)
    for n, own in enumerate(a.items):
        if n != worst and taken.isdisjoint(own):
            child.add(list(own), a.free[n])
        else:
            displaced += [i for i in own if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    for i in displaced:
        child.best_fit(i, sizes[i])
    return child


def lower_bound(sizes: list[int], capacity: int) -> int:
    """At least the total over the capacity, and at least one bin for each item over half of it."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def mutation(a: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """Some bins of ``a`` are opened, and their items best-fitted from large to small, roughly."""
    count = len(a.items)
    opened = set(rng.sample(range(count), min(count, 2 + count // 20)))
    child, loose = Bins(a.capacity), []
    for n, own in enumerate(a.items):
        if n in opened:
            loose += own
        else:
            child.add(list(own), a.free[n])
    for i in sorted(loose, key=lambda i: sizes[i] * rng.uniform(0.8, 1.2), reverse=True):
        child.best_fit(i, sizes[i])
    return child


def with_bins(bins: list[list[int]], sizes: list[int], capacity: int) -> Bins:
    """A solution that has ``bins``, with all other items best-fitted from large to small."""
    out, placed = Bins(capacity), set()
    for b in bins:
        out.add(list(b), capacity - sum(sizes[i] for i in b))
        placed.update(b)
    for i in sorted((i for i in range(len(sizes)) if i not in placed), key=sizes.__getitem__, reverse=True):
        out.best_fit(i, sizes[i])
    return out


def emptiest(bins: Bins, rng: random.Random, most: int) -> list[int]:
    """The emptiest bins, roughly: as many as needed to make up a bin and a quarter, but ``most`` at most; none if that makes up less than one."""
    order = sorted(range(len(bins.items)), key=lambda n: bins.free[n] * rng.uniform(0.7, 1.3), reverse=True)[:most]
    return order if sum(bins.free[n] for n in order) >= bins.capacity else []


def evolve(sizes: list[int], capacity: int, start: list[list[list[int]]], seed: int, population: int = POPULATION, generations: int = GENERATIONS, most: int = OPEN) -> tuple[Bins, int]:
    """The best solution of one island after some generations, and the number of crossovers.

    ``start``: solutions that it has, as lists of bins of item numbers, the own one first.
    """
    rng, bound = random.Random(seed), lower_bound(sizes, capacity)
    solutions = [with_bins(bins, sizes, capacity) for bins in start] or [with_bins([], sizes, capacity)]
    base = min(solutions, key=Bins.value)
    opened = emptiest(base, rng, most) if base.value()[0] > bound else []
    if not opened:
        return base, 0
    fixed = set(range(len(base.items))) - set(opened)
    items = [i for n in opened for i in base.items[n]]
    own, place = [sizes[i] for i in items], {i: p for p, i in enumerate(items)}
    people = [with_bins([[place[i] for i in base.items[n]] for n in opened], own, capacity), with_bins([], own, capacity)]
    # what the migrants have of these items in whole bins
    people += [with_bins([[place[i] for i in b] for b in s.items if all(i in place for i in b)], own, capacity) for s in solutions if s is not base]
    while len(people) < population:
        shaken = sorted(range(len(own)), key=lambda i: own[i] * rng.uniform(0.8, 1.2), reverse=True)
        people.append(decreasing(own, capacity, shaken))
    people.sort(key=Bins.value)
    goal, best, still, crossed = lower_bound(own, capacity), people[0].value(), 0, 0
    for _ in range(generations):
        if best[0] <= goal or still >= STALL or len(people) < 2:
            break
        children = []
        for _ in range(population):
            if rng.random() < MUTATION:
                children.append(mutation(rng.choice(people), own, rng))
            else:
                children.append(crossover(*rng.sample(people, 2), own, rng))
                crossed += 1
        # equal values are most often equal solutions; one of each keeps the population apart
        people = list({p.value(): p for p in sorted(people + children, key=Bins.value)}.values())[:population]
        still = still + 1 if people[0].value() >= best else 0
        best = people[0].value()
    out = Bins(capacity)
    for n in sorted(fixed):
        out.add(base.items[n], base.free[n])
    for n, b in enumerate(people[0].items):
        out.add([items[i] for i in b], people[0].free[n])
    return min(base, out, key=Bins.value), crossed


ISLAND = "block long, island int, uid long, length long, bin int, bins int, fill double, bound int"


def _epoch(capacity: int, seed: int, population: int, generations: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["migrant", "uid"], kind="stable")
        own = rows[rows["migrant"] == rows["migrant"].iloc[0]]
        uids, sizes = own["uid"].to_numpy(), own["length"].tolist()
        start = []
        for _, solution in rows[rows["bin"] >= 0].groupby("migrant"):
            bins: dict[int, list[int]] = {}
            for i, n in enumerate(solution["bin"].tolist()):
                bins.setdefault(n, []).append(i)
            start.append(list(bins.values()))
        best, _ = evolve(sizes, capacity, start, hash((seed, *map(int, key))), population, generations)
        number = np.empty(len(sizes), np.int32)
        for n, items in enumerate(best.items):
            number[items] = n
        count, fill = best.value()
        return pd.DataFrame({"block": int(key[0]), "island": int(key[1]), "uid": uids, "length": sizes, "bin": number, "bins": count, "fill": -fill, "bound": lower_bound(sizes, capacity)})

    return run


def pack_items(items: DataFrame, capacity: int, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS, seed: int = 1) -> DataFrame:
    """(uid, length, sequence_id) for items (uid, length) none of which fills a sequence alone."""
    left, done, level, before = items, None, 0, None
    while True:
        count = left.count()
        if not count:
            break
        blocks = -(-count // block_items)
        dealt = left.select(F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(blocks)).alias("block"), "uid", "length")
        state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select("block", "island", "uid", "length", F.lit(-1).alias("bin"), F.lit(0).alias("migrant"))
        solved = []
        for epoch in range(epochs):
            after = materialize(state.groupBy("block", "island").applyInPandas(_epoch(capacity, seed + epoch, population, generations), ISLAND), "islands")
            best = after.groupBy("block").agg(F.min(F.struct("bins", -F.col("fill"), "island")).alias("b"), F.min("bound").alias("least")).select("block", F.col("b.island").alias("island"), (F.col("b.bins") > F.col("least")).alias("open"))
            best = materialize(best, "best")
            last = epoch == epochs - 1
            solved.append(after.join(best.where("not open") if not last else best, ["block", "island"]))
            rest = best.where("open").select("block")
            if last or rest.isEmpty():
                break
            # only blocks above their bound go on
            after = after.join(rest, "block")
            own = after.select("block", "island", "uid", "length", "bin", F.lit(0).alias("migrant"))
            moved = after.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "uid", "length", "bin", F.lit(1).alias("migrant"))
            state = own.unionByName(moved)
        chosen = reduce(DataFrame.unionByName, solved)
        packed = chosen.select("uid", "length", (F.lit(level).cast("long") * (1 << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"))
        if blocks == 1:
            done = packed if done is None else done.unionByName(packed)
            break
        short = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity * (1 - SLACK)).select("sequence_id")
        marked = materialize(packed.join(short.withColumn("short", F.lit(True)), "sequence_id", "left"), "packed")
        again = marked.where("short").select("uid", "length")
        if before is not None and again.count() > before / 2 or level == 120:
            done = marked.drop("short") if done is None else done.unionByName(marked.drop("short"))
            break
        before = count
        settled = marked.where("short is null").drop("short")
        done = settled if done is None else done.unionByName(settled)
        left, level = again, level + 1
    return done if done is not None else items.select("uid", "length", F.lit(0).cast("long").alias("sequence_id"))


def pack(docs: DataFrame, tokenizer_path: str, kind: str = "word", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of ``docs`` with sequence_id and offset (the place in the sequence, gapless from 0)."""
    cut = materialize(pieces(docs, tokenizer_path, kind, capacity, with_ids=with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    packed = materialize(pack_items(cut.where(F.col("length") < capacity).select("uid", "length"), capacity), "sequences")
    places = packed.select("uid", "sequence_id", (F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"))
    placed = cut.join(places, "uid", "left")
    return placed.withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("uid"))).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).drop("uid")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
