"""Near-duplicate embeddings by PCA-ordered tiled comparison.

1. Equal vectors are one class with a count, so copies cost nothing however many there are.
2. The second moments of all unit vectors, summed in the tasks and then by matrix row, give the principal directions of each
   vector length. Vectors are ordered by the cells of their leading coordinates and packed into tiles of bounded bytes.
3. Tiles meet in pairs. Two unit vectors with cosine t are sqrt(2 - 2t) apart, so tiles whose boxes in the leading coordinates are
   farther apart never meet; they find each other by an equal join on intervals of the first coordinate.
4. Inside a pair of tiles, products of the leading coordinates are accumulated block by block. What the other coordinates can
   add is at most the product of the suffix norms; rows and columns of which no pair can still reach the threshold leave.
   What is left is compared in double precision on the stored values.
5. A pair of tiles gives one row for each vector with links: how many (copies counted) and a representative that it is
   connected to. Pairs are never listed; representatives are the edges from which components are found.

The comparison is quadratic in tiles that stay near each other (all of them where directions carry equal variance); rows that
leave a task are at most the vectors of its tiles.

Defined results: vectors that are null, empty, all zero or hold null or non-finite values are linked with nothing; nor are
vectors of different lengths; a row with null vec_id is linked with nothing and has null component and verdict; repeated rows
are vectors of their own, linked with each other; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, settings, small, table
from orrery.llm.components import components

#: Bytes of values in a tile at most, fewest tiles, and rows and columns that are compared at a time.
TILE_BYTES, MIN_TILES, BLOCK = 8_000_000, 8, 1024
#: Ends of the runs of leading coordinates that are accumulated before the stored values are compared.
STAGES = (8, 16, 32)
#: Leading coordinates that order the vectors, and those that bound a tile.
CELLS, BOX = 4, 8
#: Slack of bounds that are computed in single precision.
SLACK = 1e-4


def comparable(v: Column) -> Column:
    """Whether all values are there and finite, and one is not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def units(values: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; values are first scaled by a power of two, so that squares stay in range."""
    scaled = rescaled(values)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def rescaled(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, initial=0))[1][:, None])


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length in an Arrow list array."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, pc.list_flatten(column.take(pa.array(rows))).to_numpy().reshape(len(rows), d)


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal directions of the unit vectors of each length, as columns by falling variance.

    Only of lengths that have at least as many vectors as coordinates: so what reaches the driver, a square matrix for each
    length, is never more than the vectors themselves. Others keep their own coordinates.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, values in by_length(b.column(0)):
                u = units(values)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["d", "i", "m"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [key[0]], "i": [key[1]], "m": [np.sum(np.stack(rows["m"].to_list()), axis=0)]})

    enough = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("n >= d").select("d")
    schema = "d int, i int, m array<double>"
    rows = classes.join(F.broadcast(enough), F.size(classes["embedding"]) == enough["d"], "left_semi").select("embedding").mapInArrow(moments, schema).groupBy("d", "i").applyInPandas(added, schema).collect()
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r.d, np.zeros((r.d, r.d)))[r.i] = r.m
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in found.items()}


def leading(values: np.ndarray, turn: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first n principal coordinates of each row's unit vector."""
    d = values.shape[1]
    u = units(values)
    return u @ turn[d][:, :n] if d in turn else u[:, :n]


def tiles(classes: DataFrame, turn: dict[int, np.ndarray], reach: float) -> DataFrame:
    """(tile, d, lo, hi, nodes, sizes, data): the classes in order of their leading cells, in tiles of at most TILE_BYTES."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(turn)
    kind = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, lengths = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for d, rows, values in by_length(b.column(2)):
                y = leading(values, shared.value, CELLS)
                steps = np.floor((np.clip(y, -1, 1) + 1) / reach).astype(np.int64)
                cell = np.zeros(len(rows), np.int64)
                for k in range(y.shape[1]):
                    cell = cell * math.ceil(2 / reach + 1) + steps[:, k]
                # vectors with equal places are told apart by their numbers
                node = b.column(0).to_numpy()[rows]
                place[rows] = cell + (y[:, 0] + 1) * 0.49 + (node * 2654435761 % 2**32) * 1e-14
                lengths[rows] = d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths), pa.array(place)], ["node", "size", "embedding", "d", "place"])

    schema = f"node long, size long, embedding {classes.schema['embedding'].dataType.simpleString()}, d int, place double"
    placed = materialize(classes.select("node", "size", "embedding").mapInArrow(ordered, schema), "placed")
    counts = {r.d: r.n for r in placed.groupBy("d").agg(F.count("*").alias("n")).collect()}
    most = {d: max(1, TILE_BYTES // (d * kind().nbytes)) for d in counts}
    cuts = {}
    for d, n in counts.items():
        k = max(min(MIN_TILES, -(-n // 64)), -(-n // most[d]))
        cuts[d] = np.array(placed.where(F.col("d") == d).approxQuantile("place", [i / k for i in range(1, k)], 0.2 / k) if k > 1 else [])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, place, part = b.column(3).to_numpy(), b.column(4).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(lengths):
                own = lengths == d
                part[own] = np.searchsorted(cuts[d], place[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending")])
        d, part = table["d"][0].as_py(), table["part"][0].as_py()
        out = []
        for at in range(0, table.num_rows, most[d]):
            own = table.slice(at, most[d])
            values = pc.list_flatten(own["embedding"].combine_chunks()).to_numpy().reshape(own.num_rows, d)
            y = leading(values, shared.value, BOX)
            out.append({"tile": (d << 40) + (part << 16) + at // most[d], "d": d, "lo": y.min(axis=0), "hi": y.max(axis=0), "nodes": own["node"].to_numpy().tobytes(), "sizes": own["size"].to_numpy().tobytes(), "data": values.astype(kind).tobytes()})
        return pa.Table.from_pylist(out, packed_schema)

    floats = pa.list_(pa.float64())
    packed_schema = pa.schema([("tile", pa.int64()), ("d", pa.int32()), ("lo", floats), ("hi", floats), ("nodes", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
    made = materialize(placed.mapInArrow(dealt, f"{schema}, part long").groupBy("d", "part").applyInArrow(packed, "tile long, d int, lo array<double>, hi array<double>, nodes binary, sizes binary, data binary"), "tiles")
    discard(placed)
    return made


def meetings(made: DataFrame, reach: float) -> DataFrame:
    """(a, b), a <= b: the tiles of equal length whose boxes are at most ``reach`` apart."""
    boxes = made.select("tile", "d", "lo", "hi")
    at = lambda x: F.floor(x / F.lit(reach))
    lo, hi = F.col("lo")[0], F.col("hi")[0]
    a = boxes.select(F.col("tile").alias("a"), "d", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(at(lo), at(hi))).alias("step"))
    b = boxes.select(F.col("tile").alias("b"), "d", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(at(lo - reach), at(hi + reach))).alias("step"))
    gaps = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["d", "step"]).where((F.col("a") <= F.col("b")) & (apart <= reach * reach + SLACK)).select("a", "b").distinct()


class Side:
    """A tile with its leading coordinates and, for each stage, the norm of what is left."""

    def __init__(self, nodes: bytes, sizes: bytes, data: bytes, d: int, turn: dict[int, np.ndarray], kind: type) -> None:
        self.nodes, self.sizes = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64)
        self.values = np.frombuffer(data, kind).reshape(len(self.nodes), d)
        y = leading(self.values, turn, min(d, STAGES[-1]))
        self.ends = [min(d, s) for s in STAGES if s < d] + ([d] if d <= STAGES[-1] else [])
        self.rest = [np.sqrt(np.maximum(0, 1 - (y[:, :e] ** 2).sum(axis=1))).astype(np.float32) for e in self.ends]
        self.lead = y.astype(np.float32)
        self.first = np.column_stack([self.lead[:, : self.ends[0]], self.rest[0]])


def open_block(x: Side, y: Side, rows: np.ndarray, cols: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a block that hold a pair which can still reach the threshold after all leading coordinates."""
    least = np.float32(threshold - SLACK)
    bound = x.first[rows] @ y.first[cols].T
    mask = bound >= least
    products = None
    for k, end in enumerate(x.ends):
        if k:
            products = products + x.lead[rows, x.ends[k - 1] : end] @ y.lead[cols, y.ends[k - 1] : end].T
            mask = products + x.rest[k][rows, None] * y.rest[k][None, cols] >= least
        r, c = mask.any(axis=1), mask.any(axis=0)
        rows, cols = rows[r], cols[c]
        if not len(rows):
            break
        products = x.lead[rows, :end] @ y.lead[cols, :end].T if k == 0 else products[np.ix_(r, c)]
    return rows, cols


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have at least this cosine, in double precision; what rounding could decide is summed exactly."""
    p, q = rescaled(x), rescaled(y)
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    cosine = (p @ q.T) / np.sqrt(pp[:, None] * qq[None, :])
    close = np.abs(cosine - threshold) < 1e-12
    out = cosine >= threshold
    for i, j in zip(*np.nonzero(close), strict=True):
        dot, a, b = (math.fsum(u * v) for u, v in ((p[i], q[j]), (p[i], p[i]), (q[j], q[j])))
        out[i, j] = dot / math.sqrt(a * b) >= threshold
    return out


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the least number of its component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def tile_links(x: Side, y: Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, representatives, links) of the vectors of two tiles, or of one with itself, that are linked."""
    n, m = len(x.nodes), len(y.nodes)
    shift = 0 if same else n
    labels, links = np.arange(shift + m), np.zeros(shift + m, np.int64)
    sizes = y.sizes if same else np.concatenate([x.sizes, y.sizes])
    for i in range(0, n, BLOCK):
        for j in range(i if same else 0, m, BLOCK):
            rows, cols = open_block(x, y, np.arange(i, min(n, i + BLOCK)), np.arange(j, min(m, j + BLOCK)), threshold)
            if not len(rows):
                continue
            mask = linked(x.values[rows], y.values[cols], threshold)
            if same and i == j:
                mask &= rows[:, None] < cols[None, :]
            links[rows] += mask @ sizes[cols + shift]
            links[cols + shift] += mask.T @ sizes[rows]
            r, c = np.nonzero(mask)
            labels = joined(labels, rows[r], cols[c] + shift)
    found = np.flatnonzero(links)
    nodes = y.nodes if same else np.concatenate([x.nodes, y.nodes])
    return nodes[found], nodes[labels[found]], links[found]


def compare(made: DataFrame, pairs: DataFrame, turn: dict[int, np.ndarray], threshold: float, kind: type) -> DataFrame:
    """(node, representative, links) of every linked vector in every pair of tiles, written out."""
    spark = made.sparkSession
    shared = spark.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y = (Side(r[f"nodes_{s}"], r[f"sizes_{s}"], r[f"data_{s}"], r["d"], shared.value, kind) for s in "ab")
                out = tile_links(x, y, r["a"] == r["b"], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["node", "representative", "links"])

    one = made.select(F.col("tile").alias("a"), "d", *(F.col(c).alias(f"{c}_a") for c in ("nodes", "sizes", "data")))
    other = made.select(F.col("tile").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("nodes", "sizes", "data")))
    # work follows the square of a tile, not its bytes: a task takes few pairs
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        return materialize(pairs.join(one, "a").join(other, "b").mapInArrow(run, "node long, representative long, links long"), "links", rows_per_batch=1)


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    v = vectors["embedding"]
    usable = comparable(v) & vectors["vec_id"].isNotNull()
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    keys = [F.when(usable, F.xxhash64(*x)).alias(n) for n, x in (("k1", [v]), ("k2", [F.lit(1), v]))]
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), *keys)
    kept = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), *keys, v.alias("embedding")).where("k1 is not null")
    grouped = kept.groupBy("k1", "k2", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    reach = max(1e-3, math.sqrt(max(0.0, 2 - 2 * threshold)))
    turn = directions(classes)
    made = tiles(classes, turn, reach)
    found = compare(made, meetings(made, reach), turn, threshold, kind)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("representative").alias("b")))
    named = classes.select("k1", "k2", "id", "size", "node").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = materialize(named.join(least, "component").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "components")
    discard(classes, made, found)
    out = rows.join(small(named), ["k1", "k2"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m AS component_id, e.vec_id = m AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
SQL = {"op12_embedding_dedup": _SQL}
