"""Ranked search over max-sketches, against scores of every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("orrery.llm")

from orrery.llm import lexical  # noqa: E402

TERM = re.compile("[0-9a-zA-Z\u0080-\U0010ffff]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text) rows."""
    own = [Counter(terms(t)) for _, t in docs]
    many, total = sum(1 for c in own if c), sum(c.total() for c in own)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (i, _), c in zip(docs, own, strict=True):
            if i is None or item is None or not c:
                continue
            m = 25 + 75 * c.total() * many // total
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def corpus(rng):
    vocab = [f"t{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab[: rng.choice((20, 400))]) for _ in range(n))
    docs = [say(rng.randint(1, 120)) for _ in range(220)]
    docs += [docs[3]] * 15 + [docs[4].upper()] * 12 + ["", None, " ,;", "Ünï日本 x\x00y", say(30_000), "only here zzz", "t1 " * 70_000]
    return docs


def as_frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, n long, score double").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("coordinates", "first_batch"), [(1 << 16, 50), (16, 3)])
def test_search(spark, monkeypatch, coordinates, first_batch):
    """With few coordinates most bounds are far too high, so many batches are scored before thresholds hold."""
    monkeypatch.setattr(lexical, "COORDINATES", coordinates)
    monkeypatch.setattr(lexical, "FIRST_BATCH", first_batch)
    rng = random.Random(9)
    docs = list(enumerate(corpus(rng)))
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice([t for _, t in docs if t]).split()[:25])) for i in range(12)]
    items += [(20, "T1 t1 t1"), (21, "zzz"), (22, "nowhere"), (23, ""), (24, None), (25, "ÜNÏ日本 ünï日本 Ünï日本"), (26, "x y"), (20, "t2"), (20, "t2"), (None, "t3")]
    frames = as_frames(spark, docs, items)
    got = sorted(tuple(r) for r in lexical.search(*frames).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(brute(docs, items, 10)) and len(got) > 120


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(1, 40)))) for i in range(80)]
    items = [(i, docs[i * 3][1]) for i in range(5)]
    frames = as_frames(spark, docs, items)
    assert sorted(tuple(r) for r in lexical.search(*frames, k=3).collect()) == sorted(brute(docs, items, 3))


def test_odd_rows(spark):
    docs = [(None, "a b"), (1, "a b"), (1, "a b"), (1, "a c"), (2, "b"), (3, None), (4, "d e f"), (5, "g")]
    items = [(7, "A b"), (7, "A b"), (8, "c")]
    frames = as_frames(spark, docs, items)
    got = sorted(tuple(r) for r in lexical.search(*frames).collect())
    assert got == sorted(brute(docs, items, 10)) and [r[2] for r in got if r[0] == 7] == [1, 1, 2, 1]
    assert lexical.search(frames[0].limit(0), frames[1]).count() == lexical.search(frames[0], frames[1].limit(0)).count() == 0
    assert lexical.search(frames[0].where("text is null"), frames[1]).count() == 0


def test_bounds_are_upper_bounds(spark):
    rng = random.Random(5)
    docs = [(i, t) for i, t in enumerate(corpus(rng)) if t and terms(t)]
    frame, _ = as_frames(spark, docs, [(1, "")])
    sketches = lexical.build(frame).orderBy("doc_id").collect()
    size = lexical.Corpus(len(docs), sum(len(terms(t)) for _, t in docs))
    assert sum(r.n for r in sketches) == size.terms
    assert all(len(r.coordinates) * 2 == len(r.frequencies) for r in sketches)
    items = [(0, {"t1": 500, "t7": 30, "nowhere": 9}), (1, {f"t{i}": i for i in range(300)})]
    block = lexical.Block.of(items)
    bounds = block.bounds(np.array([r.n for r in sketches]), [r.coordinates for r in sketches], [r.frequencies for r in sketches], size)
    for row, (_, text) in zip(bounds, docs, strict=True):
        c = Counter(terms(text))
        m = 25 + 75 * c.total() * size.documents // size.terms
        for b, (_, weights) in zip(row, items, strict=True):
            assert b >= sum(w * lexical.impact(c[t], m) for t, w in weights.items() if t in c)


def test_batches_descend(spark):
    rows = [(0, 9, 2), (0, 8, 40), (0, 7, 40), (1, 3, 500), (2, 5, 10), (2, 4, 10)]
    frame = spark.createDataFrame(rows, "q int, level int, n int").select("q", "level", F.explode(F.sequence(F.lit(1), "n")))
    assert lexical.next_batch(frame, 50) == {0: 8, 1: 3, 2: 4}
