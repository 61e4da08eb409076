"""Token ids of whole texts by a public tokenizer, with each distinct piece of text encoded once.

Both vocabularies split text into words before they merge, and no split ever joins the end of a
non-blank run with the white space after it, or a letter with the punctuation after it (but for the
apostrophe). A text may therefore be cut before every run of ASCII white space and between a letter
and ASCII punctuation, each distinct piece encoded by the tokenizers library, and the ids put
together again. Texts with other white space or with a special token's string are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from citeforge.llm.textvec import Flat, encode, gather

#: White space beyond ASCII, ASCII separators 0x1C-0x1F, and openings of special tokens.
_WHOLE = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|<\\|"

#: Kinds of bytes: other, ASCII white space, ASCII letter, ASCII mark but the apostrophe, 0xC3, and
#: what after 0xC3 makes a letter of U+00C0-U+00FF (all are, but the two signs 0x97 and 0xB7).
_BLANK, _LETTER, _MARK, _LEAD, _REST = 1, 2, 3, 4, 5
_KIND = bytearray(256)
for _c in range(256):
    if _c in b" \t\n\v\f\r":
        _KIND[_c] = _BLANK
    elif _c < 128 and chr(_c).isalpha():
        _KIND[_c] = _LETTER
    elif 32 < _c < 127 and not chr(_c).isalnum() and chr(_c) != "'":
        _KIND[_c] = _MARK
    elif 0x80 <= _c < 0xC0 and _c not in (0x97, 0xB7):
        _KIND[_c] = _REST
_KIND[0xC3] = _LEAD
_KIND = bytes(_KIND)


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NAMES = _byte_names()
_PLAIN = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def vocabulary_path(name: str) -> str:
    """A bundled vocabulary's file, or ``name`` itself where it is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _taken(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of coded pieces, end to end."""
    if not len(codes):
        return np.zeros(0, np.uint32)
    own = ids[gather(begin, length)]  # the pieces' ids in the order of their codes
    offs = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(own))
    return lists.take(pa.array(codes)).flatten().to_numpy()


class WordCoder:
    """Encodes slices of texts; keeps the ids of the first ``most`` distinct pieces that it meets."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.folds = bool(json.loads(self.tokenizer.to_str())["normalizer"])  # lower case, no white space
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(most + 1, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids end to end, and how many each has. Plain words go to the merges directly."""
        got: list = [None] * len(pieces)
        merge, rest = self.tokenizer.model.tokenize, []
        for i, p in enumerate(pieces):
            if _PLAIN.fullmatch(p):
                if self.folds:
                    p = p.lstrip().lower()
                got[i] = [t.id for t in merge(p.encode().decode("latin-1").translate(_NAMES))]
            else:
                rest.append(i)
        for a in range(0, len(rest), 2000):
            part = rest[a : a + 2000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                got[i] = e.ids
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(counts.sum())), counts

    def _of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and number in them of each piece's; the pieces are distinct."""
        k = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(k < 0)
        flat, counts = self._encoded([pieces[i] for i in fresh])
        ends = np.cumsum(counts)
        n = len(self.known)
        kept = min(len(fresh), self.most - n)
        if kept:
            more, first = int(ends[kept - 1]), int(self.at[n])
            if first + more > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), more), np.uint32)])
            self.ids[first : first + more] = flat[:more]
            self.at[n + 1 : n + 1 + kept] = first + ends[:kept]
            self.known.update(zip((pieces[i] for i in fresh[:kept]), range(n, n + kept), strict=True))
            k[fresh[:kept]] = np.arange(n, n + kept)
        ids, start, length = self.ids, self.at[k], self.at[k + 1] - self.at[k]
        if kept < len(fresh):  # no room: these pieces are encoded again where they come again
            used = int(self.at[len(self.known)])
            ids = np.concatenate([ids[:used], flat])
            start[fresh[kept:]], length[fresh[kept:]] = used + ends[kept:] - counts[kept:], counts[kept:]
        return ids, start, length

    def slice_ids(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice end to end, and the number of each row's ids."""
        texts = pa.LargeStringArray.from_buffers(flat.n, pa.py_buffer(np.ascontiguousarray(flat.offs)), pa.py_buffer(np.ascontiguousarray(flat.data)))
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        kind = np.frombuffer(flat.data.tobytes().translate(_KIND), np.uint8)
        first = kind == _BLANK
        first[1:] &= kind[:-1] != _BLANK
        if len(kind) > 1:
            letter = kind == _LETTER
            letter[1:] |= (kind[1:] == _REST) & (kind[:-1] == _LEAD)
            first[1:] |= letter[:-1] & (kind[1:] == _MARK)
        first[flat.offs[:-1][flat.offs[:-1] < len(first)]] = True
        starts = np.flatnonzero(first)
        at = np.searchsorted(starts, flat.offs)
        codes, pieces = encode(flat.data, np.diff(np.append(starts, len(flat.data))))
        ids, begin, length = self._of(pieces.to_numpy(zero_copy_only=False).tolist())
        lengths = length[codes] if len(codes) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        counts = before[at[1:]] - before[at[:-1]]
        out = _taken(ids, begin, length, codes)
        if whole.any():
            rows = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(whole):
                rows[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            counts = np.array([len(r) for r in rows], np.int64)
            out = np.concatenate(rows) if rows else out
        return out, counts


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    """One coder for each vocabulary and Python worker."""
    return WordCoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each row."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    total = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[total] = False
    out[keep] = ids
    return out, counts + 1
