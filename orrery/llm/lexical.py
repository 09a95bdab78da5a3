"""Ranked lexical search over hashed max-sketches.

``build`` reads every text once. Each document's terms are hashed to coordinates, and its impacts fold into the maximum of each
coordinate. An impact is the score's factor of a term's frequency; within a document it grows with the frequency, so the
sketch holds greatest frequencies, and impacts follow at lookup, when the totals of the corpus are known. ``search`` takes the
queries in blocks. A lookup adds up weight times impact over the coordinates of a query's terms: an upper bound of the score,
since other terms that share a coordinate can only raise its maximum.

1. Each task gives the documents with the highest bounds of every query; the best of these are scored exactly, on their
   texts. The last of the highest scores is the query's threshold.
2. A second lookup lists what has a bound that reaches the threshold. It is scored in descending levels of bounds, in batches
   that grow; after each one thresholds rise and everything below them leaves. A query is done when no bound reaches its
   threshold.

Document frequencies of query terms are added up from counts that are stored beside the sketches (by 64-bit hash); weights and
scores are integers as the formula has them, and exact scores compare whole terms.

Defined results: null text has no terms; a row with null doc_id counts in the statistics and is never ranked; repeated rows and
rows with one doc_id are documents of their own, each with a rank; an item_id with several texts is ranked for each of them
(equal rows count once), null item_id is left out; items without terms, no documents and no items give no rows; equal scores
stand by ascending doc_id; further columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, small, table
from orrery.llm.token_counts import chunks

#: Coordinates of a sketch; two bytes name one.
COORDINATES = 1 << 16
#: Items and characters of items that are looked up together.
BLOCK_ITEMS, BLOCK_CHARS = 1_000, 4_000_000
#: Pairs of a query that the first batch of the second lookup scores, and growth from one batch to the next.
FIRST_BATCH, GROWTH = 50, 8
#: Levels of bounds in a doubling.
LEVELS = 16

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SKETCH = "doc_id long, row long, n long, coordinates binary, frequencies binary, terms array<long>, df array<long>"
BOUNDS = "q int, doc_id long, row long, bound double"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term)


def listed_terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms one after another, encoded, and the terms of each text as offsets (n + 1)."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)).dictionary_encode(), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]


def build(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, coordinates, frequencies, terms, df): the sketch of each document.

    ``row`` is a hash of the text, ``n`` its number of terms. ``terms`` and ``df`` are the document frequencies within a chunk of
    documents, on the chunk's first row; on other rows they are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in chunks(whole, 2)):
            encoded, offsets = listed_terms(b.column(2))
            pool = np.fromiter(map(term_hash, encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
            n = np.diff(offsets)
            doc = np.repeat(np.arange(b.num_rows), n)
            pair, tf = np.unique(doc * max(1, len(pool)) + encoded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(pair, max(1, len(pool)))
            df = np.bincount(term, minlength=len(pool))
            place = doc * COORDINATES + (pool[term] % np.uint64(COORDINATES)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, tf = place[order], tf[order]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            most = np.maximum.reduceat(tf, first) if len(first) else tf
            place = place[first]
            ends = np.searchsorted(place, np.arange(b.num_rows + 1) * COORDINATES)
            coordinates, most = (place % COORDINATES).astype(np.uint16), most.astype(np.uint32)
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            once = lambda x: pa.array([x, *[[]] * (b.num_rows - 1)], pa.list_(pa.int64()))
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), cut(coordinates), cut(most), once(pool.view(np.int64)), once(df)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n", "coordinates", "frequencies", "terms", "df"])

    text = docs["text"]
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return narrow.mapInArrow(run, SKETCH)


@dataclass(frozen=True)
class Corpus:
    """Documents that have terms, and all their terms."""

    documents: int
    terms: int

    def length_parts(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms; beyond 64 bits by Python's integers."""
        if 75 * int(n.max(initial=0)) * self.documents < 2**63:
            return 25 + 75 * n * self.documents // self.terms
        return np.array([25 + 75 * int(x) * self.documents // self.terms for x in n])

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Block:
    """Queries of one block: (item_id, {term: weight times repeats}), and their weights by coordinate as runs of (query, weight)."""

    items: list[tuple[int, dict[str, int]]]
    column: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, dict[str, int]]]) -> Block:
        by: dict[int, Counter] = {}
        for q, (_, weights) in enumerate(items):
            for t, w in weights.items():
                by.setdefault(term_hash(t) % COORDINATES, Counter())[q] += w
        column = np.full(COORDINATES, -1, np.int32)
        column[list(by)] = np.arange(len(by))
        starts = np.concatenate([[0], np.cumsum([len(c) for c in by.values()])]).astype(np.int64)
        runs = [(q, w) for c in by.values() for q, w in c.items()]
        return Block(items, column, starts, np.array([q for q, _ in runs], np.int64), np.array([w for _, w in runs], float))

    def bounds(self, n: np.ndarray, coordinates: list[bytes], frequencies: list[bytes], corpus: Corpus) -> np.ndarray:
        """Upper bounds of the scores, documents by queries."""
        sizes = np.array([len(c) // 2 for c in coordinates])
        column = self.column[np.frombuffer(b"".join(coordinates), np.uint16)]
        known = column >= 0
        column, doc = column[known], np.repeat(np.arange(len(n)), sizes)[known]
        tf = np.frombuffer(b"".join(frequencies), np.uint32)[known].astype(np.int64)
        g = impact(tf, corpus.length_parts(n)[doc])
        runs = self.starts[column + 1] - self.starts[column]
        at = np.repeat(self.starts[column] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        place = np.repeat(doc, runs) * len(self.items) + self.query[at]
        sums = np.bincount(place, self.weight[at] * np.repeat(g, runs), len(n) * len(self.items))
        return sums.reshape(len(n), len(self.items)) * (1 + 1e-12)


def lookup(sketches: DataFrame, block: Block, corpus: Corpus, best: int | None = None, least: list[int] | None = None) -> DataFrame:
    """(q, doc_id, row, bound): the ``best`` bounds of each query in each task, or all bounds that reach ``least`` of their query."""
    shared = sketches.sparkSession.sparkContext.broadcast(block)

    def batch_of(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(bounds, pa.float64())], ["q", "doc_id", "row", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        count = len(block.items)
        top, refs = np.zeros((0, count)), np.zeros((0, 2, count), np.int64)
        limit = None if least is None else np.maximum(np.array(least, float), 1)
        for b in batches:
            ids, rows, n = (b.column(i).to_numpy() for i in range(3))
            bounds = block.bounds(n, b.column(3).to_pylist(), b.column(4).to_pylist(), corpus)
            if limit is not None:
                d, q = np.nonzero(bounds >= limit)
                yield batch_of(q, ids[d], rows[d], bounds[d, q])
                continue
            top = np.concatenate([top, bounds])
            refs = np.concatenate([refs, np.broadcast_to(np.stack([ids, rows], axis=1)[:, :, None], (len(ids), 2, count))])
            if len(top) > best:
                first = np.argpartition(-top, best - 1, axis=0)[:best]
                top, refs = np.take_along_axis(top, first, 0), np.take_along_axis(refs, first[:, None, :], 0)
        if limit is None:
            k, q = np.nonzero(top > 0)
            yield batch_of(q, refs[k, 0, q], refs[k, 1, q], top[k, q])

    ranked = sketches.where("n > 0 and doc_id is not null").select("doc_id", "row", "n", "coordinates", "frequencies")
    return ranked.mapInArrow(run, BOUNDS)


def scores(docs: DataFrame, wanted: DataFrame, block: Block, corpus: Corpus) -> DataFrame:
    """(q, doc_id, score) of the documents in ``wanted`` (q, doc_id, row), from their whole texts; scores of 0 are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value.items
        for b in batches:
            out = []
            for doc_id, text, queries in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tf = Counter(terms_of(text))
                m = 25 + 75 * tf.total() * corpus.documents // corpus.terms
                for q in queries:
                    score = sum(w * impact(tf[t], m) for t, w in items[q][1].items() if t in tf)
                    if score > 0:
                        out.append((q, doc_id, score))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    chosen = small(materialize(wanted.groupBy(F.col("doc_id").alias("id"), "row").agg(F.collect_set("q").alias("qs")), "wanted"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    both = texts.join(chosen, (texts["doc_id"] == chosen["id"]) & (F.xxhash64(texts["text"]) == chosen["row"]))
    return both.select("doc_id", "text", "qs").mapInArrow(run, "q int, doc_id long, score long")


def highest(scored: DataFrame, k: int) -> DataFrame:
    """The k first rows of each query by score and doc_id, with their rank."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def thresholds(top: DataFrame, k: int, queries: int) -> list[int]:
    """Score that a document must reach to change a query's first k; 0 where fewer are known."""
    found = {r.q: r.s for r in top.where(F.col("rank") == k).select("q", F.col("score").alias("s")).collect()}
    return [found.get(q, 0) for q in range(queries)]


def next_batch(open_pairs: DataFrame, limit: int) -> dict[int, int]:
    """For each query the lowest level of its next batch: the highest levels that hold at most ``limit`` pairs, one at least."""
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in open_pairs.groupBy("q", "level").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.q, []).append((r.level, r.n))
    out = {}
    for q, levels in counts.items():
        total = 0
        for level, n in sorted(levels, reverse=True):
            if total and total + n > limit:
                break
            total += n
            out[q] = level
    return out


def search_block(docs: DataFrame, sketches: DataFrame, block: Block, corpus: Corpus, k: int) -> DataFrame:
    """(q, doc_id, score, rank) of the k highest scores of each query of a block."""
    spark, queries = docs.sparkSession, len(block.items)
    ahead = Window.partitionBy("q").orderBy(F.col("bound").desc(), "doc_id", "row")
    first = materialize(lookup(sketches, block, corpus, best=k).withColumn("_n", F.row_number().over(ahead)).where(F.col("_n") <= k).drop("_n"), "bounds")
    top = materialize(highest(scores(docs, first, block, corpus), k), "top")
    least = thresholds(top, k, queries)
    reach = lookup(sketches, block, corpus, least=least).join(small(first.select("q", "doc_id", "row").distinct()), ["q", "doc_id", "row"], "left_anti")
    waiting = materialize(reach.withColumn("level", F.floor(F.log2("bound") * LEVELS).cast("int")), "open")
    discard(first)
    limit, done = FIRST_BATCH, {}
    while batch := next_batch(_open(spark, waiting, least, done), limit):
        cut = spark.createDataFrame(list(batch.items()), "q int, cut int")
        now = _open(spark, waiting, least, done).join(F.broadcast(cut), "q").where("level >= cut")
        better = materialize(highest(top.drop("rank").unionByName(scores(docs, now, block, corpus)), k), "top")
        discard(top)
        top, least = better, thresholds(better, k, queries)
        done |= batch
        limit *= GROWTH
    discard(waiting)
    return top


def _open(spark: SparkSession, waiting: DataFrame, least: list[int], done: dict[int, int]) -> DataFrame:
    """Pairs below the levels that are done whose bounds reach the threshold of their query."""
    limits = spark.createDataFrame([(q, float(x), done.get(q)) for q, x in enumerate(least)], "q int, least double, done int")
    return waiting.join(F.broadcast(limits), "q").where("bound >= least and (done is null or level < done)").drop("least", "done")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    sketches = materialize(build(docs), "sketches")
    totals = sketches.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    corpus = Corpus(totals.n, totals.terms or 1)
    asked = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text")).where("item_id is not null").distinct()
    amount = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-amount.n // BLOCK_ITEMS), -(-amount.chars // BLOCK_CHARS))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(blocks if corpus.documents else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == part).collect()
        repeats = [(r.item_id, Counter(terms_of(r.text))) for r in rows]
        vocabulary = {t: int(np.uint64(term_hash(t)).astype(np.int64)) for _, c in repeats for t in c}
        if not vocabulary:
            continue
        wanted = small(spark.createDataFrame([(h,) for h in set(vocabulary.values())], "term long"))
        counted = sketches.where(F.size("terms") > 0).select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
        df = {r.term: r.df for r in counted.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = {t: corpus.weight(df.get(h, 0)) for t, h in vocabulary.items()}
        block = Block.of([(i, {t: c * weights[t] for t, c in own.items() if weights[t] > 0}) for i, own in repeats])
        top = search_block(docs, sketches, block, corpus, k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block.items)], "q int, item_id long")
        found = found.unionByName(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    discard(sketches)
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i) GROUP BY 1, 2),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total)::BIGINT AS m FROM n, s),
p AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
SQL = {"op11_lexical_search": _SQL}
