"""Byte-level BPE of many texts: the tokenizers library once per distinct piece.

The library splits a text into pieces (a word with the space before it, a
number, punctuation, white space) and encodes each by itself. Pieces repeat, so
texts are split here with numpy, and only pieces that this process has not met
go to the library. Ids equal those of ``encode_batch`` on the whole texts. Pieces
are known by a 64-bit hash. Vocabularies that split in another way go to the
library text by text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from . import textkit

U = np.uint64
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a process keeps, about 30 bytes each, before it begins anew.
MOST_PIECES = 1_500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[SPACES] = SPACE
    return out


def split(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the library's byte-level pattern start; all texts are not empty."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[0] = first[n] = True
    first[1:n] = kind[1:] != kind[:-1]
    first[starts] = True
    text_start = np.zeros(n + 1, bool)
    text_start[starts] = text_start[n] = True
    # a run of white space before a word gives its last character away; a blank joins the word
    run_end = np.flatnonzero(first[1:] & (kind == SPACE)) + 1
    run_end = run_end[~text_start[run_end]]
    first[run_end - 1] = True
    blank = points[run_end - 1] == 32
    first[run_end[blank]] = False
    # 's 't 'm 'd 're 've 'll directly at the start of a piece
    at = np.flatnonzero((points == 39) & first[:n])
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~text_start[at + 1]]
    if len(at):
        one = np.isin(points[at + 1], [ord(c) for c in "stmd"])
        after = np.minimum(at + 2, n - 1)
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (points[at + 1] == ord(a)) & (points[after] == ord(b)) & (at + 2 < n) & ~text_start[at + 2]
        first[at[one | two] + 1] = False
        for where in (at[one] + 2, at[two] + 3):
            first[where[where < n]] = True
    return np.flatnonzero(first)


def splits_here(vocabulary: dict) -> bool:
    """Whether ``split`` is how this vocabulary splits texts; any other is left to the library as a whole."""
    pre, model = vocabulary.get("pre_tokenizer") or {}, vocabulary.get("model") or {}
    whole = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = not any(vocabulary.get(k) for k in ("normalizer", "truncation", "padding"))
    return whole and plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.known = splits_here(json.load(f))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)  # hashes of known pieces in order, where their ids begin, and how many
        self.offset = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.filled = 0

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encodes new pieces: those that begin with a blank in one call, as each is split off again."""
        whole = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and p[1] != "'" and not p[1:].isspace()]
        ids: list = [None] * len(pieces)
        for k in range(0, len(whole), 512):
            part = whole[k : k + 512]
            found = self.tokenizer.encode("".join(pieces[i] for i in part), add_special_tokens=False)
            words = np.array(found.word_ids)
            cut = np.searchsorted(words, np.arange(len(part) + 1))
            got = np.array(found.ids, np.uint32)
            if len(words) == 0 or words[-1] != len(part) - 1:
                continue
            for j, i in enumerate(part):
                ids[i] = got[cut[j] : cut[j + 1]]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, np.uint32)
        lengths = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.offset = np.insert(self.offset, at, self.filled + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, at, lengths)
        self.filled += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens of the library's own adding."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif not self.known or any(s in t for s in self.special) or not t.isprintable() and _surrogates(t):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        for a, b in textkit.blocks([texts[i] for i in plain]):
            for i, ids in zip(plain[a:b], self._block([texts[i] for i in plain[a:b]])):
                out[i] = ids
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        points, starts = textkit.code_points(texts)
        edges = split(points, starts[:-1])
        begin, end = edges[:-1], edges[1:]
        hashes, index, inverse = np.unique(textkit.span_hashes(points, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_PIECES:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            joined = "".join(texts)
            where = index[new]
            self._add(hashes[new], [joined[x:y] for x, y in zip(begin[where].tolist(), end[where].tolist())])
        piece = np.searchsorted(self.keys, hashes)[inverse]
        length = self.length[piece].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[np.repeat(self.offset[piece] - total[:-1], length) + np.arange(total[-1])]
        cut = total[np.searchsorted(begin, starts)]
        return [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _surrogates(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return True
    return False


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per process and vocabulary; its pieces stay from task to task."""
    return Encoder(path)
