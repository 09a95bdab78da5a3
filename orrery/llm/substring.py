"""Exact substring dedup by compacting a de Bruijn graph of word windows.

A window of ``width`` consecutive words is an edge of the graph, from the node of its first to that of its last
``width - 1`` words. Edges that start in documents with different ids are the repeated ones; the source of an edge is its
occurrence with the least (doc_id, position).

1. Each window has a minimizer: of its ``SEED``-word parts the one with the least hash. Equal windows have equal
   minimizers, so only windows under a minimizer that two documents have can be repeated (one aggregation of narrow rows).
2. Windows in a row under one place of such a minimizer are a run, kept as the hashes of its nodes. Equal runs are
   aggregated first, so copies of a passage cost one row each task; the windows of distinct runs are the edges.
3. Nodes with more than one repeated edge in or out branch. Edges whose sources follow on each other over other nodes are
   one piece, and pieces that meet in such a node are joined, by hooking and pointer doubling, to paths: the maximal
   non-branching ones, also where their parts have different sources.
4. Stretches of a document on one path are spans, with the coordinates of their source. The words at these coordinates are
   read again, and only spans with the same words (by a hash of other word hashes than those of the graph) are cut.

Edges are known by the 64-bit hashes of both their nodes. Edges that collide all the same make a span that the words at
its source do not confirm; such a span stays.

Defined results: null text has no words; words of a text with fewer than ``width`` words stay; windows repeated inside one
document only stay; rows with one doc_id are one document to each other; a row with a null doc_id is neither a source nor
cut; an empty table gives an empty result; the columns of ``docs`` are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, small, stacked, table
from orrery.llm.components import components
from orrery.llm.shingles import rolling, word_bounds, word_hashes
from orrery.llm.token_counts import chunks

WIDTH, SEED = 13, 6


def hashed_words(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one after another, and the word offsets of each text (n + 1)."""
    data, first, last, offsets, _ = word_bounds(texts)
    return word_hashes(data, first, last, seed), offsets


def _windows(words: np.ndarray, offsets: np.ndarray, width: int, seed: int):
    """For a batch: text of each word, window starts, hashes of the ``seed``-word parts and the place of each window's minimizer."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = max(0, len(words) - width + 1)
    starts = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n])
    if not len(starts):
        return None
    parts = rolling(words, seed, 7)
    # the first place of the least hash; equal windows choose alike
    view = np.lib.stride_tricks.sliding_window_view(parts, width - seed + 1)
    place = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 18):
        own = starts[lo : lo + (1 << 18)]
        place[lo : lo + (1 << 18)] = own + view[own].argmin(axis=1)
    return doc, starts, parts, place


def seeds(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, m): the minimizers of each document's windows. One that a document has several times may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                words, offsets = hashed_words(b.column(1))
                w = _windows(words, offsets, width, seed)
                if w is None:
                    continue
                doc, starts, parts, place = w
                new = np.r_[True, (place[1:] != place[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[starts[new]])), pa.array(parts[place[new]].view(np.int64))], ["doc_id", "m"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, m long")


def repeated_seeds(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, seeds): the minimizers of each document that other documents have as well, written out."""
    rows = materialize(seeds(docs, width, seed), "seeds")
    # written out, so that the join below has plain exchanges on both sides and a hot minimizer can be split
    repeated = materialize(rows.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"), "repeated")
    found = materialize(rows.join(repeated.hint("shuffle_hash"), "m").groupBy("doc_id").agg(F.collect_set("m").alias("seeds")), "own-seeds")
    discard(rows, repeated)
    return found


def runs(docs: DataFrame, repeated: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, place, nodes): maximal runs of consecutive windows under one place of a repeated minimizer.

    ``nodes``: hashes of the ``width - 1`` words before, between and after the windows (one more than windows). ``place``:
    where the first window starts, with the number of the text above bit 32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                words, offsets = hashed_words(b.column(1))
                w = _windows(words, offsets, width, seed)
                if w is None:
                    continue
                doc, starts, parts, place = w
                m = parts[place]
                # repeated minimizers of the batch; one that another text has brought in is repeated here, too
                known = np.unique(pc.list_flatten(b.column(2)).to_numpy().view(np.uint64))
                if not len(known):
                    continue
                at = np.searchsorted(known, m)
                at[at == len(known)] = 0
                keep = np.flatnonzero(known[at] == m)
                if not len(keep):
                    continue
                first, hold = starts[keep], place[keep]
                heads = np.flatnonzero(np.r_[True, (hold[1:] != hold[:-1]) | (first[1:] != first[:-1] + 1)])
                cuts = np.r_[heads, len(first)]
                nodes = rolling(words, width - 1, 5)[np.insert(first, cuts[1:], first[cuts[1:] - 1] + 1)]
                ends = pa.array((cuts + np.arange(len(cuts))).astype(np.int32))
                own = doc[first[heads]]
                where = (b.column(3).to_numpy()[own] << 32) + first[heads] - offsets[own]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(where), pa.ListArray.from_arrays(ends, pa.array(nodes.view(np.int64)))], ["doc_id", "place", "nodes"])

    chosen = docs.join(repeated, "doc_id").select("doc_id", "text", "seeds", "row")
    return chosen.mapInArrow(run, "doc_id long, place long, nodes array<long>")


#: What tells runs apart: first and last node hold all words of a run, which has fewer windows than a node has words.
RUN = {"a": "nodes[0]", "z": "element_at(nodes, -1)", "k": "size(nodes)"}


def distinct_runs(found: DataFrame) -> DataFrame:
    """One row of each distinct run: a number, its first occurrence, the greatest doc_id that has it, and its nodes."""
    keyed = found.select("doc_id", "place", "nodes", *(F.expr(e).alias(c) for c, e in RUN.items()))
    grouped = keyed.groupBy(*RUN).agg(F.min(F.struct("doc_id", "place")).alias("s"), F.max("doc_id").alias("last"), F.first("nodes").alias("nodes"))
    return grouped.select(F.monotonically_increasing_id().alias("id"), "s.*", "last", "nodes")


def _edges(nodes: str = "nodes"):
    """One row (u, v) for each window of a run."""
    n = F.size(nodes) - 1
    return F.posexplode(F.arrays_zip(F.slice(nodes, F.lit(1), n).alias("u"), F.slice(nodes, F.lit(2), n).alias("v")))


def repeated_edges(distinct: DataFrame) -> DataFrame:
    """(u, v, source, place): windows that start in documents with different ids, and the sources."""
    rows = distinct.select("doc_id", "place", "last", _edges().alias("j", "e"))
    rows = rows.select("e.*", F.struct("doc_id", (F.col("place") + F.col("j")).alias("place")).alias("s"), "last")
    edges = rows.groupBy("u", "v").agg(F.min("s").alias("s"), F.max("last").alias("last"))
    return edges.where("s.doc_id < last").select("u", "v", F.col("s.doc_id").alias("source"), F.col("s.place").alias("place"))


def branching_nodes(edges: DataFrame) -> DataFrame:
    """(node): the nodes with several repeated edges in or several out."""
    many = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    return many("u").unionAll(many("v")).distinct()


def in_pieces(edges: DataFrame, branching: DataFrame) -> DataFrame:
    """``edges`` and piece: the place of the first edge of their piece. A sort holds the edges of one source document."""
    marked = edges.join(small(branching.select(F.col("node").alias("u"), F.lit(True).alias("branches"))), "u", "left")
    order = Window.partitionBy("source", F.shiftright("place", 32)).orderBy("place")
    goes_on = F.coalesce(F.lag("place").over(order) == F.col("place") - 1, F.lit(False)) & F.col("branches").isNull()
    head = F.when(~goes_on, F.col("place"))
    return marked.select(*edges.columns, F.max(head).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))


def path_pieces(edges: DataFrame, branching: DataFrame) -> DataFrame:
    """(source, piece, path) from the edges in pieces: pieces that meet in a node that does not branch have one path."""
    ends = edges.groupBy("source", "piece").agg(F.min(F.struct("place", "u")).alias("a"), F.max(F.struct("place", "v")).alias("z"))
    pieces = materialize(ends.select("source", "piece", F.col("a.u").alias("u"), F.col("z.v").alias("v"), F.monotonically_increasing_id().alias("id")), "pieces")
    # such a node has one edge in and one out, so each piece is followed by one other at most
    open_ = pieces.select(F.col("id").alias("a"), F.col("v").alias("node")).join(small(branching), "node", "left_anti")
    joined = components(open_.join(pieces.select(F.col("id").alias("b"), F.col("u").alias("node")), "node").select("a", "b"))
    paths = materialize(pieces.join(joined, F.col("id") == F.col("node"), "left").select("source", "piece", F.coalesce("component", "id").alias("path")), "paths")
    discard(pieces)
    return paths


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (distance to the source, place of a run, bits of its windows) of one document and piece, as stretches in a row.

    Stretches with one source and length are one row with all their places: words that go round in a circle have their source
    in the same few windows again and again.
    """
    for b in batches:
        lists = b.column("parts")
        flat, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        ahead, places, bits = (flat.field(c).to_numpy() for c in ("ahead", "place", "bits"))
        here = [np.flatnonzero(bits >> j & 1) for j in range(int(bits.max(initial=0)).bit_length())]
        part = np.concatenate(here or [np.zeros(0, np.int64)])
        row, far = of[part], ahead[part]
        at = np.concatenate([places[x] + j for j, x in enumerate(here)] or [places[:0]])
        order = np.lexsort((at, far, row))
        row, far, at = row[order], far[order], at[order]
        heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (far[1:] != far[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)])
        n = np.diff(np.r_[heads, len(at)]).astype(np.int32)
        row, at, source = row[heads], at[heads], at[heads] + far[heads]
        text = at >> 32
        order = np.lexsort((at, n, source, text, row))
        row, text, at, source, n = row[order], text[order], at[order], source[order], n[order]
        firsts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (text[1:] != text[:-1]) | (source[1:] != source[:-1]) | (n[1:] != n[:-1])][: len(at)])
        starts = pa.ListArray.from_arrays(pa.array(np.r_[firsts, len(at)].astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)))
        own = b.take(pa.array(row[firsts]))
        cols = [own.column("doc_id"), pa.array(text[firsts]), starts, pa.array(n[firsts]), own.column("source"), pa.array(source[firsts]), own.column("piece")]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "starts", "n", "source", "source_place", "piece"])


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, row, start, n, source, source_row, source_start, path): stretches of windows that also start in a document
    with a smaller id, each on one path and in a row at its source.

    ``row`` is a hash of the text, since rows may share a doc_id. ``start`` counts words from 0, ``n`` windows: the words
    covered are start .. start + n + width - 2.
    """
    spans = grouped_spans(docs, width, seed)
    return spans.select("doc_id", "row", F.explode("starts").alias("start"), *SPAN[2:], "path")


#: What the stretches in one row of ``grouped_spans`` share.
SPAN = ["doc_id", "row", "n", "source", "source_row", "source_start"]


def grouped_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``repeated_spans`` with one row for all stretches of a text that have one source and length: their places are ``starts``."""
    own = _own(docs)
    repeated = repeated_seeds(own, width, seed)
    found = materialize(runs(own, repeated, width, seed), "runs")
    discard(repeated)
    distinct = materialize(distinct_runs(found), "distinct")
    edges = materialize(repeated_edges(distinct), "edges")
    branching = materialize(branching_nodes(edges), "branching")
    pieced = materialize(in_pieces(edges, branching), "pieced")
    discard(edges)
    paths = path_pieces(pieced, branching)
    # where each distinct run lies at its sources: the bits of its windows by piece and distance
    windows = distinct.select("id", _edges().alias("j", "e")).select("id", "j", "e.*")
    placed = windows.join(pieced, ["u", "v"]).withColumn("ahead", F.col("place") - F.col("j"))
    sources = materialize(placed.groupBy("id", "source", "piece", "ahead").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("bits")), "sources")
    discard(pieced, branching)
    keys = [F.expr(e).alias(c) for c, e in RUN.items()]
    sources = materialize(sources.join(distinct.select("id", *keys), "id").drop("id"), "keyed")
    discard(distinct)
    parts = found.select("doc_id", "place", *keys).join(sources, list(RUN)).where("source < doc_id").select("doc_id", "place", "source", "piece", (F.col("ahead") - F.col("place")).alias("ahead"), "bits")
    lists = parts.groupBy("doc_id", "source", "piece").agg(F.collect_list(F.struct("ahead", "place", "bits")).alias("parts"))
    stretches = lists.mapInArrow(_stretches, "doc_id long, row long, starts array<int>, n int, source long, source_place long, piece long")
    spans = stretches.join(paths, ["source", "piece"]).select("doc_id", "row", "starts", "n", "source", F.shiftright("source_place", 32).alias("source_row"), F.expr("cast(source_place & 4294967295 as int)").alias("source_start"), "path")
    spans = materialize(spans, "spans")
    discard(found, paths, sources)
    return spans


def _own(docs: DataFrame) -> DataFrame:
    return docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_number(docs["text"]).alias("row"))


def text_number(text: Column) -> Column:
    """A 31-bit hash, which tells texts with one doc_id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of ``count`` words from ``first`` on, for many spans of one array of word hashes."""
    powers = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), base, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(words * powers(BASE)[:-1])]
    return (sums[first + count] - sums[first]) * powers(INVERSE)[first]


def source_hashes(docs: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """(source, source_row, source_start, n, hash): what stands at the sources of ``spans``, read from the texts."""
    places = spans.select("source", "source_row", "source_start", "n").distinct()
    asked = materialize(places.groupBy("source", "source_row").agg(F.collect_list(F.struct("source_start", "n")).alias("at")), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 0):
                words, offsets = hashed_words(b.column(0), seed=1)
                at, of = pc.list_flatten(b.column(3)), pc.list_parent_indices(b.column(3))
                start, n = at.field("source_start"), at.field("n")
                hashes = span_hashes(words, offsets[of.to_numpy()] + start.to_numpy(), n.to_numpy() + width - 1)
                yield pa.RecordBatch.from_arrays([b.column(1).take(of), b.column(2).take(of), start, n, pa.array(hashes.view(np.int64))], ["source", "source_row", "source_start", "n", "hash"])

    own = _own(docs).select(F.col("doc_id").alias("source"), F.col("row").alias("source_row"), "text")
    # only texts that are a source go through the shuffle, if their ids are few
    chosen = own.join(small(asked.select("source").distinct()), "source", "left_semi").join(asked, ["source", "source_row"])
    return chosen.select("text", "source", "source_row", "at").mapInArrow(run, "source long, source_row long, source_start int, n int, hash long").distinct()


def cut_spans(docs: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` and _cut_n_words, _cut_n_removed and _cut_text (the words that no confirmed span covers, joined by one space).

    ``spans`` are those of ``repeated_spans`` or ``grouped_spans``. Where ``docs`` has columns of these names, the new ones get
    further underscores in front.
    """
    names = list(docs.columns)
    if "starts" not in spans.columns:
        spans = spans.groupBy(*SPAN).agg(F.collect_list("start").alias("starts"))
    hashes = materialize(source_hashes(docs, spans, width), "hashes")
    known = spans.join(hashes, ["source", "source_row", "source_start", "n"])
    per_doc = known.groupBy("doc_id", "row").agg(F.collect_list(F.struct("starts", "n", "hash")).alias("spans")).select(F.col("doc_id").alias("span_doc"), F.col("row").alias("span_row"), "spans")
    at = names.index("text")
    plain = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, at):
                data, begins, ends, offsets, borders = word_bounds(b.column(at))
                words = word_hashes(data, begins, ends, seed=1)
                own, of = pc.list_flatten(b.column(len(names))), pc.list_parent_indices(b.column(len(names))).to_numpy()
                places = own.field("starts")
                span = pc.list_parent_indices(places).to_numpy()
                first = offsets[of[span]] + pc.list_flatten(places).to_numpy()
                count = own.field("n").to_numpy().astype(np.int64)[span] + width - 1
                same = span_hashes(words, first, count) == own.field("hash").to_numpy().view(np.uint64)[span]
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, first[same], 1)
                np.add.at(covered, (first + count)[same], -1)
                keep = np.cumsum(covered[:-1]) <= 0
                n_words, n_removed = np.diff(offsets), np.diff(np.concatenate([[0], np.cumsum(~keep)])[offsets])
                kept = _joined(data, begins[keep], ends[keep], borders)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n_words), pa.array(n_removed), kept], [*plain, "n_words", "n_removed", "kept"])

    ddl = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, docs.schema, strict=True)), "n_words long, n_removed long, kept string"])
    rows = docs.toDF(*plain)
    doc, text = rows[plain[names.index("doc_id")]].cast("long"), rows[plain[at]]
    joined = rows.join(per_doc, (doc == per_doc["span_doc"]) & (text_number(text) == per_doc["span_row"]), "left").select(*plain, "spans")
    return joined.mapInArrow(run, ddl).toDF(*names, *stacked(CUT, names))


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The words at these places, of each text joined by one space; ``borders``: byte offsets of the texts."""
    own = np.searchsorted(borders, first, "right")
    # between two words of one text stands white space: its first byte is the space that joins them
    more = np.r_[own[1:] == own[:-1], np.zeros(min(1, len(own)), bool)]
    data = data.copy()
    data[last[more]] = 32
    marks = np.zeros(len(data) + 1, np.int8)
    marks[first] += 1
    np.subtract.at(marks, last + more, 1)
    keep = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    sizes = np.concatenate([[0], np.cumsum(keep)])[borders]
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(data[keep]))


CUT = ["_cut_n_words", "_cut_n_removed", "_cut_text"]


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the kept text in place of ``text`` (and its length in place of ``n_chars``, if there)."""
    cut = cut_spans(docs, grouped_spans(docs, width), width)
    _, removed, kept = stacked(CUT, docs.columns)
    # texts that lose nothing keep their white space; null stays null
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    own = [text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cut.select(*own)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_spans(docs, grouped_spans(docs)).select("doc_id", F.col("_cut_n_words").alias("n_words"), F.col("_cut_n_removed").alias("n_removed"), F.sha2(F.col("_cut_text"), 256).alias("kept_sha256"))


_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)], ' ')) AS kept_sha256 FROM k
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL = {"op4_substring_dedup": _SQL}
