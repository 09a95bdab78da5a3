"""Substring dedup on words that go round in a circle, and the words of a batch."""

import re

import pyarrow as pa
import pytest

pytest.importorskip("xxhash")
from orrery.llm import shingles, substring  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_circles_are_few_rows(spark):
    """Texts that repeat a pair of words hundreds of times have few spans, with all places, and lose what brute force says."""
    texts = [f"o{i} " + "idiot ti " * 300 + f"e{i} " + " ".join(f"w{i % 3}.{k}" for k in range(20)) for i in range(12)]
    words = [t.split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = {}
    for i, w in enumerate(words):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want[i] = (len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring.grouped_spans(docs).cache()
    assert spans.count() <= 12 * 8
    got = {r.doc_id: (r._cut_n_removed, r._cut_text) for r in substring.cut_spans(docs, spans).collect()}
    assert got == want and want[5][0] > 500
    # one row for each stretch of the flat form, which is cut alike
    flat = substring.repeated_spans(docs).cache()
    assert flat.count() > 12 * 100
    assert {r.doc_id: (r._cut_n_removed, r._cut_text) for r in substring.cut_spans(docs, flat).collect()} == want


def test_words_of_a_batch():
    texts = [None, "", " ", " a", "b\tc  ", "é\x0bö\x1cü x", None, "\n", "x" * 100 + " " + "y" * 65 + "\r\n" + "z" * 64, "12345678 123456789 12345678", "ends"]
    for kind in (pa.string(), pa.large_string()):
        for a, z in ((0, 11), (1, 9), (3, 3), (6, 8), (10, 11)):
            data, first, last, offsets, borders = shingles.word_bounds(pa.array(texts, kind).slice(a, z - a))
            raw = data.tobytes()
            got = [[raw[first[i] : last[i]].decode() for i in range(x, y)] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            assert got == [WORD.findall(t or "") for t in texts[a:z]]
            assert substring._joined(data, first, last, borders).to_pylist() == [" ".join(w) for w in got]
            hashes = shingles.word_hashes(data, first, last).tolist()
            flat = [w for ws in got for w in ws]
            assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))
            assert not set(hashes) & set(shingles.word_hashes(data, first, last, seed=1).tolist())
