"""Token encoding inside Arrow batches, word by word with a bounded memo.

Both supported tokenizers split text before the merge step, so a text can be cut at places that their splitting rule
always cuts, and each distinct piece is encoded once by the library and remembered. Texts in which such places are not
certain (apostrophes, control characters, unusual white space, special strings) go to the library whole. Results equal
the library's on the whole text; tests compare both.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by one Python worker; the memo starts anew when full. It bounds memory only, never results.
MEMO_PIECES = 600_000

#: Letters whose lower case is one letter (dotted capital I gains a mark and is left out).
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PUNCT = r"[.,:;!?%&*$#|]+"
#: Word end and punctuation up to the next space: a cut for both splitting rules.
_WORD_END = rf"([{_LETTER}])({_PUNCT})( |$)"
_ODD_SPACE = r"\x00-\x09\x0B-\x1F\x7F-\xA0\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Characters for which lower case is one to one, so that differently cased words share a memo entry.
_PLAIN = re.compile(rf"[{_LETTER}]+")


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> WordTokenizer:
    """The encoder of this worker process: tasks that run in the same worker share its memo."""
    return WordTokenizer(path, kind)


class WordTokenizer:
    """Encoder for a tokenizer file; ``kind`` names the splitting rule: "word" (word ends, white space dropped) or "byte"."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        if self.kind == "word":
            keys = [p.lower() if _PLAIN.fullmatch(p) else p for p in pieces]
        else:
            keys = pieces
        memo = self.memo
        missing = list({k for k in keys if k not in memo})
        found = {k: memo[k] for k in keys if k in memo} if len(memo) + len(missing) > MEMO_PIECES else memo
        if found is not memo:
            self.memo = memo = {}
        for lo in range(0, len(missing), 16_384):
            part = missing[lo : lo + 16_384]
            raw = part if self.kind == "word" else [p[1:] if p[0] == "\x01" else f" {p}" for p in part]
            for key, e in zip(part, self.library.encode_batch_fast(raw, add_special_tokens=False), strict=True):
                found[key] = np.array(e.ids, dtype="<u4").tobytes()
        return [found[k] for k in keys]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and the offsets of each text (n + 1). Null text: empty."""
        original = texts = pc.fill_null(texts, "")
        if self.kind == "word":
            odd = pc.match_substring_regex(texts, rf"['<{_ODD_SPACE}]")
            texts = pc.replace_substring(texts, "\n", " ")
            texts = pc.replace_substring_regex(texts, _WORD_END, r"\1 \2\3")
        else:
            # a cut only before a single space between two visible characters
            odd = pc.match_substring_regex(texts, rf"['<{_ODD_SPACE}]|  | \n|\n | $|^ ")
            texts = pc.replace_substring_regex(texts, _WORD_END, "\\1 \x01\\2\\3")
            texts = pc.binary_join_element_wise("\x01", texts, "")
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            texts = pc.if_else(odd, "" if self.kind == "word" else "\x01", texts)
        lists = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(lists).dictionary_encode()
        encoded = self._encode(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        pool = np.frombuffer(b"".join(encoded), "<u4")
        starts = np.cumsum(lengths) - lengths
        index = flat.indices.to_numpy()
        per_piece = lengths[index]
        ends = np.cumsum(per_piece)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[index] - (ends - per_piece), per_piece) + np.arange(total)]
        first = lists.offsets.to_numpy()
        offsets = np.concatenate([[0], ends])[first - first[0]]
        if len(rows):
            ids, offsets = self._put_whole(original, rows, ids, offsets)
        return ids, offsets

    def _put_whole(self, texts: pa.Array, rows: np.ndarray, ids: np.ndarray, offsets: np.ndarray):
        """Fill the odd rows, which are empty so far, with what the library gives for the whole text."""
        extra = np.zeros(len(texts), np.int64)
        parts, at = [], 0
        for row in rows:
            own = np.frombuffer(self.whole(texts[int(row)].as_py()), "<u4")
            parts += [ids[at : offsets[row]], own]
            at = offsets[row]
            extra[row] = len(own)
        parts.append(ids[at:])
        return np.concatenate(parts), offsets + np.concatenate([[0], np.cumsum(extra)])
