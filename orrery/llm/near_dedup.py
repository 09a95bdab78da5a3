"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its distinct 5-word shingles (hashed to 64 bits) and a MinHash signature. Equal sets are
   one class; from here on only classes are compared, so copies cost nothing however many there are.
2. Signatures are cut into bands, as steep as the wanted miss probability allows. Classes that share a band are
   candidates. In each bucket, all members are compared with one leader, never all with each other.
3. A candidate pair is compared on batches of its signatures; after each batch it is dropped if the posterior probability
   that its similarity reaches the threshold is below ``miss``. Survivors are verified on the full sets.
4. Verified links give components. Buckets whose members are in one component are settled. The classes of the others are
   joined once more by a prefix filter: with shingles in order of rarity, two sets that reach the threshold share a
   shingle that stands early enough in both, so only pairs that share one, at places that leave room for the overlap
   they need, are compared. Inside a shingle's list, the rows of its largest component meet only the rows of other
   components. The filter is exact, so no candidate pair that could join two components goes untested, and a large group
   of texts that are alike, but below the threshold, shares frequent shingles only, which stand too late.

Defined results: null text or word-less text has no shingles and is linked with nothing; a row with null doc_id is linked with
nothing and has null component and verdict; repeated rows share a verdict (rows with one doc_id and different texts
are each in the component of their text); an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, small, table
from orrery.llm.components import components
from orrery.llm.shingles import band_keys, shingle_sets, signature, signature_params
from orrery.llm.token_counts import chunks

HASHES = 256
#: Ends of the batches in which signatures are compared.
BATCHES = (32, 64, 128, 192, 256)
#: Greatest probability that all bands miss a pair exactly at the threshold.
BAND_MISS = 1e-5
#: Rows of two shingle sets that go to a Python worker at a time.
SET_ROWS = 100


def banding(threshold: float, hashes: int = HASHES, miss: float = BAND_MISS) -> tuple[int, int]:
    """(bands, rows of a band): the steepest bands that miss a pair at the threshold with probability ``miss`` at most."""
    rows = max((r for r in range(1, hashes + 1) if (1 - threshold**r) ** (hashes // r) <= miss), default=1)
    return hashes // rows, rows


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n_shingles, digest, keys, sig) of each text.

    ``row`` is a hash of the text, ``digest`` the 128-bit digest of the whole set, ``keys`` the band keys and ``sig`` one
    byte of each MinHash value; the last three are null for an empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = signature_params(HASHES)
        for whole in batches:
            for b in chunks(whole, 1):
                sets = shingle_sets(b.column(1), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                values = np.array([signature(sets[i], params) for i in full], np.uint32).reshape(len(full), HASHES)
                keys = iter(band_keys(values, bands, rows).view(np.int64))
                sigs = iter(((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8))
                there = [len(s) > 0 for s in sets]
                cols = [
                    b.column(0),
                    b.column(2),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if t else None for t in there], pa.list_(pa.int64())),
                    pa.array([next(sigs).tobytes() if t else None for t in there], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n_shingles", "digest", "keys", "sig"])

    text = docs["text"]
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    return narrow.mapInArrow(run, "doc_id long, row long, n_shingles long, digest binary, keys array<long>, sig binary")


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): with fewer, similarity reaches the threshold with probability below ``miss``.

    The posterior follows from a uniform prior of the similarity s; bytes match with probability s + (1 - s) / 256.
    """
    grid = np.linspace(0, 1, 20_001)[1:-1]
    match = grid + (1 - grid) / 256
    out = []
    for n in BATCHES:
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= miss:
                out.append((n, m))
                break
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, id, digest), from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 2):
                sets = shingle_sets(b.column(2), k)
                ok = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == b.column(1)[i].as_py()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), pa.array([sets[i].view(np.int64) for i in ok], pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    chosen = texts.join(small(wanted), "id").select("node", "digest", "text")
    # repeated rows give a class twice
    return chosen.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _still_similar(limits: list[tuple[int, int]]):
    """Drops pairs of signatures, batch by batch: a later batch is compared only where the earlier ones passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, HASHES) for i in (2, 3))
            alive, sure, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, least in limits:
                sure = sure + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, sure, done = alive[sure >= least], sure[sure >= least], n
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(alive)) for i in (0, 1)], ["a", "b"])

    return run


def _verified(percent: int):
    """Keeps pairs of sorted sets with at least ``percent`` of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [pc.list_flatten(b.column(i)).to_numpy() for i in (2, 3)]
            ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(i)).to_numpy())]) for i in (2, 3)]
            keep = []
            for r in range(b.num_rows):
                x, y = (v[e[r] : e[r + 1]].view(np.uint64) for v, e in zip(values, ends, strict=True))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least ``percent`` of their union in common, written out."""
    limits = least_matches(percent / 100, miss)
    sig = classes.select("node", "sig")
    with_sigs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    alive = materialize(with_sigs.mapInArrow(_still_similar(limits), "a long, b long"), "candidates")
    with_sets = alive.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    links = materialize(with_sets.mapInArrow(_verified(percent), "a long, b long"), "links", SET_ROWS)
    discard(alive)
    return links


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of each member of a bucket with the bucket's leader.

    The leader is the member whose buckets hold most rows. That is the text that most others resemble, and the same in
    most buckets of a group, so a member meets few leaders.
    """
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "node")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("l")).select("key", F.col("l.node").alias("other"), F.col("l.n").alias("other_n"))
    near = members.join(leaders, "key").where((F.col("node") != F.col("other")) & sizes_fit(F.col("n"), F.col("other_n"), percent))
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def open_classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of the classes in buckets that hold several components."""
    labelled = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    unsettled = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return labelled.join(unsettled, "key").groupBy("node").agg(F.first("component").alias("component"))


def rare_places(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(h, node, component, n, i): the shingles at the first places i of each class in ``classes`` (node, component), rarest first.

    ``n`` is the size of the set. Shingles of one class only come first but can't be shared, so they have places but no
    rows. Of n places those up to n - ``percent`` of n are given: two sets that reach the similarity share one of them.
    """
    own = sets.join(classes, "node").select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    shared = own.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    lists = own.join(shared, "h").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    last = F.col("n") - F.ceil(F.col("n") * percent / 100.0).cast("int")
    early = F.slice("s", 1, F.greatest(F.lit(0), last - (F.col("n") - F.size("s")) + 1))
    placed = lists.select("node", "component", "n", (F.col("n") - F.size("s")).alias("before"), F.posexplode(early).alias("p", "x"))
    return placed.select(F.col("x.h").alias("h"), "node", "component", "n", (F.col("before") + F.col("p")).alias("i"))


def crossing_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of classes in different components that share a shingle early enough in both to reach the similarity."""
    counted = places.groupBy("h", "component").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("h").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k")).where("k > 1").select("h", F.col("m.component").alias("most"))
    rows = places.join(mixed, "h")
    x, y = rows.where("component != most").alias("x"), rows.alias("y")
    # the overlap that the pair needs
    need = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    room = (F.col("x.n") - F.col("x.i") >= need) & (F.col("y.n") - F.col("y.i") >= need)
    once = (F.col("y.component") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component")) & once & room & sizes_fit(F.col("x.n"), F.col("y.n"), percent))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _labelled(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept): ``near_duplicates`` with the hash of each row's text."""
    bands, rows = banding(percent / 100)
    sketched = materialize(sketches(docs, k, bands, rows), "sketches")
    linked = sketched.where("digest is not null and doc_id is not null")
    firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("keys", "keys"), ("sig", "sig"))]
    classes = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("id"), *firsts).withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(members.join(shared, "key"), "buckets")
    wanted = materialize(members.select("node").distinct().join(classes, "node").select("node", "id", "digest"), "wanted")
    sets = materialize(full_sets(docs, wanted, k), "sets")
    links = verify(star_pairs(members, percent), classes, sets, percent, miss)
    found = components(links)
    unsettled = materialize(open_classes(members, found), "open")
    places = materialize(rare_places(sets, unsettled, percent), "places")
    more = verify(crossing_pairs(places, percent), classes, sets, percent, miss)
    if not more.isEmpty():
        found = components(links.union(more))
    named = classes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = materialize(named.join(least, "component").select("digest", "component_id"), "components")
    discard(members, wanted, sets, links, unsettled, places, more, classes)
    ids = sketched.select("doc_id", "row", "n_shingles", "digest").join(named, "digest", "left")
    ids = ids.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return ids.select("doc_id", "row", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id) per row.

    Links: at least ``percent`` of the union of the sets in common. The bands miss a pair at 0.8 with probability 3e-6 (42
    bands of 6), at 0.85 with 9e-7 (36 of 7); pairs that only matter for components already joined by others are not
    tested. ``miss`` bounds the posterior in every batch; a pair exactly at the threshold is dropped on its signature,
    over all batches, with probability below 6e-6.
    """
    return _labelled(docs, k, percent, miss).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: one of the rows whose doc_id is its least and whose text is linked to it.

    Rows without a doc_id stay. Rows with one doc_id and different texts are judged one by one; of rows equal in doc_id
    and text one stays.
    """
    rows = _labelled(docs, k, percent, 1e-6).where("doc_id is not null")
    judged = rows.groupBy("doc_id", "row", "component_id", "n_shingles").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    judged = materialize(judged.where("not kept or n > 1 and n_shingles > 0").select("doc_id", "row", "kept"), "dropped")
    names = list(docs.columns)
    plain = [f"c{i}" for i in range(len(names))]
    doc, text = plain[names.index("doc_id")], plain[names.index("text")]
    same = (F.col(doc).cast("long") == F.col("gone")) & (F.xxhash64(text) == F.col("gone_row"))
    keys = [F.col("doc_id").alias("gone"), F.col("row").alias("gone_row")]
    left = docs.toDF(*plain).join(small(judged.where("not kept").select(*keys)), same, "left_anti")
    twice = judged.where("kept")
    if not twice.isEmpty():
        again = small(twice.select(*keys))
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc, text]))
    return left.select(*plain).toDF(*names)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i) UNION SELECT b, a FROM c WHERE 100 * i >= 85 * (na + nb - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m AS component_id, s.doc_id = m AS kept FROM s JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id
"""

QUERIES = {"op3_near_dedup": op3_near_dedup}
SQL = {"op3_near_dedup": _SQL}
