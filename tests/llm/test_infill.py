"""Fill-in-middle over compressed frames, against plain Python."""

import hashlib
import random
import re

import pytest

pytest.importorskip("zstandard")
pytest.importorskip("orrery.llm")

import zstandard  # noqa: E402

from orrery.llm import infill  # noqa: E402

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), out, text


def texts():
    rng = random.Random(3)
    parts = ["a", "bc", "é日本", " ", "\x1c", " ", "  ", "\n", "\t\x0b", "word", "<P", ">"]
    out = [None, "", " ", "\n\t ", "x", " x ", "<P>", "say <M> now", "é" * 300, "y" * 5000 + " z", " " * 700]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    return [*out, " ".join(f"w{i}" for i in range(90_000))]


@pytest.mark.parametrize("frame_bytes", [7, 16_384])
def test_fill_in_middle(spark, frame_bytes):
    made = list(enumerate(texts() if frame_bytes > 60 else texts()[:-1])) + [(None, "no id at all"), (5, " x "), (5, " x ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in made], "doc_id long, text string, n long, data int").repartition(3)
    stored = infill.store(docs, frame_bytes)
    for r in stored.collect():
        assert len(r.ends) == len(r.units) == len(r.chars) and (not r.ends or r.ends[-1] == len(r.data))
    filled = infill.fill_in_middle(stored)
    outputs = {}
    for r in filled.collect():
        with zstandard.ZstdDecompressor().stream_reader(r.data, read_across_frames=True) as f:
            outputs[r.doc_id] = f.read().decode()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((tuple(r) for r in infill.read_back(filled).collect()), key=str)
    want = []
    for i, t in made:
        n, form, a, b, out, text = brute(i, t)
        assert outputs[i] == out
        want.append((i, n, form, a, b, digest(out), digest(text)))
    assert got == sorted(want, key=str) and len({w[2] for w in want}) == 3


def test_only_cut_frames_are_opened():
    press, opened = zstandard.ZstdCompressor(), []
    parts = [f" w{i} w{i}".encode() for i in range(20)]
    raw = [press.compress(p) for p in parts]
    sums = lambda x: [sum(x[: i + 1]) for i in range(len(x))]
    frames = infill.Frames(b"".join(raw), sums([len(x) for x in raw]), [2 * i + 2 for i in range(20)], sums([len(p) for p in parts]), lambda x: opened.append(x) or zstandard.ZstdDecompressor().decompress(x))
    pieces, counts = infill._pieces(frames, (8, 13), press.compress)
    assert opened == [raw[6]] and counts[:2] == [24, 15]
    assert [len(p) for p in pieces] == [4, 3, 14]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.read_back(infill.fill_in_middle(infill.store(docs))).count() == 0
