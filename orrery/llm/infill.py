"""Fill-in-middle transformation over seekable compressed frames.

``store`` keeps each text as independent zstandard frames, cut at ends of words, with the units, characters and bytes up to each frame's end.
A unit is a word with the whitespace before it, or whitespace at the end of the text. ``fill_in_middle`` seeks the frames
that hold the two cuts, decompresses only those, and writes the output as frames again: marks are frames of their own, the
pieces of cut frames are compressed anew, all others are taken as they are. One after another the frames are a plain
zstandard stream. ``read_back`` streams the frames of an output once for its digest, and visits prefix, middle and suffix in
this order for the digest of the text that it stands for; no more than one frame is decompressed at a time.

Defined results: null text is an empty text; a text that holds one of the marks is stored as it is (plain); a null doc_id is
drawn like the empty string; repeated rows give equal rows; a single word longer than a frame makes a longer frame; an empty
table gives an empty result; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import materialize, table
from orrery.llm.token_counts import chunks

#: Bytes of text after which a frame ends with the next word.
FRAME_BYTES = 16_384
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = b" \t\n\x0b\x0c\r"
_WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")

STORED = "doc_id long, marked boolean, data binary, ends array<long>, units array<long>, chars array<long>"
FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, data binary, ends array<long>, marks array<int>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_count(part: bytes) -> int:
    """Words, and one more for whitespace at the end."""
    return len(part.split()) + (part[-1:].isspace())


def frames_of(text: bytes, frame_bytes: int) -> Iterator[bytes]:
    """The text in parts that end with a word (the last one: with the text)."""
    at = 0
    while len(text) - at > frame_bytes:
        end = _WORD_END.search(text, at + frame_bytes - 1)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    if at < len(text):
        yield text[at:]


def cut_place(part: bytes, units: int) -> int:
    """Length of the first ``units`` units of a part."""
    if units == 0:
        return 0
    rest = part.split(None, units)
    if len(rest) > units:  # words go on: the cut is where the whitespace before the next one starts
        return len(part[: len(part) - len(rest[-1])].rstrip(SPACE))
    return len(part.rstrip(SPACE)) if units == len(rest) else len(part)


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, marks: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(doc_id, marked, data, ends, units, chars): frames of each text one after another, their ends in ``data``, units and characters up to each end."""
    found = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for value in b.column(1):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                data, sizes = [], []
                for part in frames_of(text, frame_bytes):
                    data.append(press.compress(part))
                    sizes.append((len(data[-1]), unit_count(part), len(part.decode())))
                sums = [list(accumulate(x)) for x in zip(*sizes, strict=True)] or [[], [], []]
                for own, x in zip(rows, (any(m in text for m in found), b"".join(data), *sums), strict=True):
                    own.append(x)
            kinds = pa.bool_(), pa.binary(), *[pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], ["doc_id", "marked", "data", "ends", "units", "chars"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, STORED)


class Frames:
    """Frames of one stored text."""

    def __init__(self, data: bytes, ends: list[int], units: list[int], chars: list[int], open_frame) -> None:
        self.data, self.ends, self.units, self.chars, self.open_frame = data, ends, units, chars, open_frame

    def raw(self, k: int) -> bytes:
        return self.data[self.ends[k - 1] if k else 0 : self.ends[k]]

    def seek(self, unit: int) -> tuple[int, int]:
        """(frame, units inside it) of a cut after ``unit`` units; a cut at a frame's end starts the next one."""
        k = bisect_right(self.units, unit)
        return k, unit - (self.units[k - 1] if k else 0)


def drawn(doc_id: int | None, n: int, seed: int, share: int, spm: int) -> tuple[str, int, int]:
    """Form and cuts of a document with n units, from the hash of its id."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    return ("plain" if c % 100 >= share else "spm" if d % 100 < spm else "psm"), lo, hi


def fill_in_middle(stored: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, data, ends, marks): outputs as frames.

    ``share`` percent of the texts are rearranged, ``spm`` percent of these with the suffix first. ``marks`` lists the numbers of
    the frames that are marks; data as a whole decompresses to the output. ``stored`` is the table of ``store``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        mark = {m: press.compress(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}
        names = [f.name for f in pa_schema]
        for b in (part for whole in batches for part in chunks(whole, 2)):
            out: list[tuple] = []
            for row in b.to_pylist():
                frames = Frames(row["data"], row["ends"], row["units"], row["chars"], unpress.decompress)
                n = frames.units[-1] if frames.units else 0
                form, lo, hi = drawn(row["doc_id"], n, seed, share, spm)
                if form == "plain" or n == 0 or row["marked"]:
                    out.append((row["doc_id"], n, "plain", None, None, frames.data, frames.ends, []))
                    continue
                parts, counts = _pieces(frames, (lo, hi), press.compress)
                order = [(PREFIX, parts[0]), (SUFFIX, parts[2]), (MIDDLE, parts[1])] if form == "psm" else [(SUFFIX, parts[2]), (PREFIX, parts[0]), (MIDDLE, parts[1])]
                data, ends, marks = [], [], []
                for name, own in order:
                    marks.append(len(data))
                    data += [mark[name], *own]
                at = 0
                for x in data:
                    at += len(x)
                    ends.append(at)
                out.append((row["doc_id"], n, form, counts[0], counts[1], b"".join(data), ends, marks))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(names), pa_schema, strict=True)], names)

    longs = pa.list_(pa.int64())
    pa_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("data", pa.binary()), ("ends", longs), ("marks", pa.list_(pa.int32()))])
    return stored.select("doc_id", "marked", "data", "ends", "units", "chars").mapInArrow(run, FILLED)


def _pieces(frames: Frames, cuts: tuple[int, int], press) -> tuple[list[list[bytes]], list[int]]:
    """Compressed frames of prefix, middle and suffix, and their characters; only frames of which a cut takes a part are opened."""
    places = [frames.seek(c) for c in cuts]
    parts: list[list[bytes]] = [[], [], []]
    counts = [0, 0, 0]
    for k in range(len(frames.ends)):
        inside = [u for f, u in places if f == k and u]
        side = sum(f < k or f == k and u == 0 for f, u in places)
        if not inside:
            parts[side].append(frames.raw(k))
            counts[side] += frames.chars[k] - (frames.chars[k - 1] if k else 0)
            continue
        text = frames.open_frame(frames.raw(k))
        at = 0
        for place in [*(cut_place(text, u) for u in inside), len(text)]:
            if place > at:
                parts[side].append(press(text[at:place]))
                counts[side] += len(text[at:place].decode())
            at, side = place, side + 1
    return parts, counts


def read_back(filled: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) from the frames of outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in (part for whole in batches for part in chunks(whole, 5)):
            output, restored = [], []
            for data, ends, marks, form in zip(*(b.column(c).to_pylist() for c in ("data", "ends", "marks", "form")), strict=True):
                raw = [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                whole, text = hashlib.sha256(), hashlib.sha256()
                # segments as they stand in the output; the text has them as prefix, middle, suffix
                segment = [sum(m <= k for m in marks) for k in range(len(raw))]
                first, later = ({"psm": (1, 3), "spm": (2, 3), "plain": (0,)}[form], {"psm": 2, "spm": 1, "plain": None}[form])
                for k, x in enumerate(raw):
                    part = unpress.decompress(x)
                    whole.update(part)
                    if segment[k] in first and k not in marks:
                        text.update(part)
                for k, x in enumerate(raw):
                    if segment[k] == later and k not in marks:
                        text.update(unpress.decompress(x))
                output.append(whole.hexdigest())
                restored.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), pa.array(output, pa.string()), pa.array(restored, pa.string())], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return filled.mapInArrow(run, DIGESTS)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are written once; outputs are made from them and read back."""
    return read_back(fill_in_middle(materialize(store(table(spark, sf_dir, "documents")), "frames")))


_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {"op13_fill_in_middle": _SQL}
