"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of target text (documents labelled good), one of
raw text (all documents). Their n-grams are words, pairs of words and stems (the first ``STEM`` characters of a word without
punctuation, once a document, so that a word that bursts in a few documents counts little). A document's log weight is the mean log ratio of its words and pairs under both, shrunk for short documents
and scaled to ``tokens`` n-grams, so that long documents are not decided by length alone. To it comes the log ratio of the
stems in the worst window of ``WINDOW`` words, over all windows of the whole text, so a bad passage counts alike in a short
and in a long document. A stem's ratio counts there as a cost, if it is rarer in target text than in raw text and only as
far as chance does not explain that; so the number of windows does not matter. Adding hash-seeded Gumbel noise and keeping
the k largest keys draws k documents without replacement in proportion to their weights (Gumbel top-k).

The noise has the scale ``temperature``, 1: keys are drawn by the weights themselves, exp(log weight). As log weights of
200 n-grams lie tens apart, so do keys, and noise decides only near the cut (2 of 861 documents at scale 0.01). A higher
temperature would draw more documents from below the cut, and lose as many good ones; for a filter that leaves clean
documents alone that is no gain, for a varied sample it is the parameter to raise.

k follows from labels that the target model has not seen, good and bad (toxic or of low quality) ones together: of the cuts
that keep at most a share ``recall`` of the good half, and at least 1 - ``MOST_LOST``, the one with the fewest wrong
verdicts (good below it, bad above it). k is the number of documents above that cut: labels are not spread as documents
are, and those that the model has seen have higher keys, so a share of held-out labels would move the cut.

Defined results: null text and text without words have log weight 0; a null doc_id counts as unlabelled; equal keys at the
cut are all kept; repeated rows get equal keys; without labels of both halves every document is kept; an empty table gives
an empty result; further columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import arrow_words, discard, materialize, small, stacked, table
from orrery.llm.shingles import rolling
from orrery.llm.token_counts import chunks

#: Hash buckets of the models: their size (a few MB), whatever the corpus.
BUCKETS = 1 << 17
#: At most about so many labelled rows are used (chosen by hash); counts of raw text always cover every document.
MAX_LABELS = 200_000
TOKENS, SHRINK, RECALL, SMOOTHING, TEMPERATURE = 200.0, 20.0, 0.995, 1.0, 1.0

#: Words of a window, weight of the worst one, and characters of a stem.
WINDOW, WORST, STEM = 200, 8.0, 6
#: Standard deviations by which a stem must be rarer in target text before it costs anything.
DOUBT = 3.0
#: Greatest share of held-out good labels that the cut may lose, and the number of cuts tried.
MOST_LOST, CUTS = 0.2, 80
PUNCTUATION = ".,;:!?()[]{}\"'*_"
#: Costs are summed as multiples of this, so that a sum does not depend on what else is in a batch.
UNIT = 2.0**-20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, and the word and the text of every place."""
    lists = arrow_words(texts, lower=True)
    encoded = pc.list_flatten(lists).dictionary_encode()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    # the split leaves one empty piece in a text without words
    there = pc.not_equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)
    index = encoded.indices.to_numpy()
    keep = there[index]
    return encoded.dictionary, index[keep], doc[keep]


def _hashes(strings: pa.Array) -> np.ndarray:
    encoded = strings.dictionary_encode()
    pool = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    return pool[encoded.indices.to_numpy()]


def _buckets(distinct: pa.Array, index: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch and the number of its text."""
    words = _hashes(distinct)[index]
    two = rolling(words, 2, 3)
    inside = doc[: len(two)] == doc[1 : 1 + len(two)]
    grams = np.concatenate([words, two[inside]]) >> np.uint64(7)
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[: len(two)][inside]])


def _stems(distinct: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of the stem of each distinct word; stems have half as many buckets as words and pairs."""
    bare = pc.utf8_trim(distinct, PUNCTUATION)
    bare = pc.if_else(pc.equal(bare, ""), distinct, bare)
    return ((_hashes(pc.utf8_slice_codeunits(bare, 0, STEM)) >> np.uint64(7)) % np.uint64(_own(buckets))).astype(np.int64)


def _own(buckets: int) -> int:
    return max(1, buckets // 2)


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) of all documents and of those with ``target`` true; summed in each task first.

    Buckets from 0: occurrences of words and pairs. Buckets from ``buckets``: documents that have a stem. The bucket -1: documents.
    """
    own = _own(buckets)
    size = buckets + own + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for whole in batches:
            for b in chunks(whole, 0):
                distinct, index, doc = _words(b.column(0))
                good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                grams, of = _buckets(distinct, index, doc, buckets)
                once = np.unique(doc * own + _stems(distinct, buckets)[index])
                everyone = np.arange(b.num_rows)
                for found, text in ((grams, of), (buckets + once % own, once // own), (np.full(b.num_rows, size - 1), everyone)):
                    raw += np.bincount(found, minlength=size)
                    target += np.bincount(found[good[text]], minlength=size)
        there = np.flatnonzero(raw)
        number = np.where(there == size - 1, -1, there)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])

    per_task = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def stem_costs(counts: DataFrame, buckets: int, doubt: float = DOUBT) -> np.ndarray:
    """Log ratio of the shares of target and raw documents that have each stem bucket, at most 0, in multiples of ``UNIT``.

    The target count is taken ``doubt`` standard deviations higher than it is. At most buckets / 2 + 1 rows come to the driver.
    """
    rows = counts.where(f"bucket < 0 or bucket >= {buckets}").toPandas()
    raw, target = np.zeros(_own(buckets) + 1), np.zeros(_own(buckets) + 1)
    place = np.where(rows["bucket"] < 0, _own(buckets), rows["bucket"] - buckets)
    raw[place], target[place] = rows["raw"], rows["target"]
    expected = raw[:-1] * target[-1] / max(1.0, raw[-1])
    most = target[:-1] + doubt * np.sqrt(target[:-1] + 1) + 1
    return np.round(np.minimum(0, np.log(most / (expected + 1))) / UNIT).astype(np.int64)


def worst_windows(cost: np.ndarray, doc: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Least sum of the costs of ``window`` words in a row in each of ``n`` texts; of all words in shorter ones."""
    sums = np.concatenate([[0], np.cumsum(cost)])
    starts, places = np.searchsorted(doc, np.arange(n)), np.arange(len(doc))
    ends = np.append(starts[1:], len(doc))
    out = np.zeros(n, np.int64)
    np.minimum.at(out, doc, sums[np.minimum(places + window, ends[doc])] - sums[places])
    return out


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket; at most ``buckets`` rows come to the driver."""
    rows = counts.where(f"bucket >= 0 and bucket < {buckets}").toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    # the target model backs off to the raw one, so rare n-grams that it has not seen cost little
    share = (raw + smoothing) / (raw.sum() + smoothing * buckets)
    mass = smoothing * 20
    return np.log((target + mass * share * buckets / 20) / (target.sum() + mass * buckets / 20)) - np.log(share)


def with_keys(docs: DataFrame, ratios: np.ndarray, costs: np.ndarray, text: str = "text", doc_id: str = "doc_id", tokens: float = TOKENS, shrink: float = SHRINK, seed: str = "resample", temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with _log_weight and _key (log weight plus Gumbel noise seeded by doc_id and text).

    ``docs`` has no columns of these names, as ``classify`` sees to.
    """
    names = list(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast((ratios, costs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, costs = shared.value
        for whole in batches:
            for b in chunks(whole, names.index(text)):
                distinct, index, place = _words(b.column(text))
                grams, doc = _buckets(distinct, index, place, len(values))
                total = np.bincount(doc, weights=values[grams], minlength=b.num_rows)
                count = np.bincount(doc, minlength=b.num_rows)
                cost = costs[_stems(distinct, len(values))][index]
                weight = tokens * total / (count + shrink) + WORST * UNIT * worst_windows(cost, place, b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(weight)], [*names, "_log_weight"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_log_weight double"])
    scored = docs.select(*docs.columns).mapInArrow(run, ddl)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return scored.withColumn("_key", F.col("_log_weight") - temperature * F.log(-F.log(u)))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of the column _key, by histograms of ever narrower ranges; no sort, and bounded answers."""
    low, high, n = keys.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
    if not n or k >= n:
        return -math.inf
    above = 0
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            return low
        number = F.least(F.lit(bins - 1), F.floor((F.col("_key") - low) / width))
        inside = keys.where((F.col("_key") >= low) & (F.col("_key") <= high))
        counted = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        for row in sorted(counted.collect(), key=lambda r: -r.bin):
            if above + row.n >= k:
                break
            above += row.n
        if row.low == row.high or above + row.n == k:
            return row.low
        low, high = row.low, row.high


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", max_labels: int = MAX_LABELS) -> DataFrame:
    """``docs`` with _good (null: no label) and _fit (the label counts for the target model, not for the cut).

    ``labels``: (doc_id, good). Of more than ``max_labels`` labels a share is taken by hash; repeated labels count as good
    only if all say so.
    """
    known = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("_good"))
    n = max(1, known.count())
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_labels / n))
    known = known.select(F.col("doc_id").alias("_id"), "_good", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("_fit"))
    known = materialize(known, "labels")
    return docs.join(small(known), docs[doc_id] == known["_id"], "left").drop("_id")


def best_cut(held_out: DataFrame, recall: float) -> float | None:
    """The key with the fewest good rows below and bad rows above it, among quantiles of the good ones; null without good rows."""
    shares = np.linspace(1 - recall, max(1 - recall, MOST_LOST), CUTS).tolist()
    cuts = held_out.where("_good").agg(F.percentile("_key", F.array(*map(F.lit, shares)))).first()[0]
    if cuts is None:
        return None
    wrong = held_out.agg(*(F.count_if(F.when(F.col("_good"), F.col("_key") < c).otherwise(F.col("_key") >= c)) for c in cuts)).first()
    return cuts[min(range(len(cuts)), key=lambda i: (wrong[i], i))]


#: What ``classify`` adds to the columns of ``docs``.
ADDED = ["_good", "_fit", "_log_weight", "_key"]


def classify(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, recall: float = RECALL) -> tuple[DataFrame, float]:
    """``docs`` with _good, _fit, _log_weight and _key, not yet written, and the least key that is kept.

    Where ``docs`` has columns of these names, the new ones get further underscores in front.
    """
    names = list(docs.columns)
    plain = [f"c{i}" for i in range(len(names))]
    text, doc_id = plain[names.index("text")], plain[names.index("doc_id")]
    rows = labelled(docs.toDF(*plain), labels, doc_id)
    counts = materialize(gram_counts(rows.select(F.col(text).alias("text"), (F.col("_good") & F.col("_fit")).alias("target")), buckets), "counts")
    keyed = with_keys(rows, log_ratios(counts, buckets), stem_costs(counts, buckets), text, doc_id)
    keys = materialize(keyed.select("_key", "_good", "_fit"), "keys")
    keyed = keyed.toDF(*names, *stacked(ADDED, names))
    cut = best_cut(keys.where("not _fit"), recall)
    if cut is None or not keys.where("_fit and _good").limit(1).count():
        least = -math.inf
    else:
        least = kth_largest(keys, keys.where(F.col("_key") >= cut).count())
    discard(keys, counts)
    return keyed, least


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    keyed, least = classify(docs, labels)
    return keyed.where(F.col(stacked(ADDED, docs.columns)[-1]) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every document; labels of quality 1 and not toxic are good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed, least = classify(docs, good_labels(table(spark, sf_dir, "labels")))
    return keyed.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("sample_key"), (F.col("_key") >= least).alias("kept"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
