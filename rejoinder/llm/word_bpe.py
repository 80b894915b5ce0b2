"""Token ids of a word-end BPE vocabulary file, a vectorised equal of the ``tokenizers`` library.

Texts are cut into pieces on arrays of code points; each distinct piece is encoded once a worker and its ids are
gathered. A byte-level BPE with ranks gives the same ids as the file's merge list: the word end is written as byte
0xFF, which no UTF-8 text holds, and for each merge (a, b) the ranks below the merged token's split its bytes into
exactly a and b (tests/llm checks all of them), so no other split of the token can meet its rank. Texts with
characters outside the checked range, or with the string of a special token, go to the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain, repeat

import numpy as np
import pandas as pd

from rejoinder.llm.shared import span_hashes

#: Code points below this one need no composition and keep their length in lower case (the listed ones aside).
SAFE = 0x180
UNSAFE = (0x130,)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
WHITE = {*range(9, 14), 0x20, 0x85, 0xA0}
SEGMENT = 1 << 18
#: Pieces whose ids a worker keeps; beyond, it begins anew.
KNOWN = 1 << 17


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[int, int], list[tuple[bytes, bytes]]]:
    """Ranks by bytes (word end: 0xFF), the file's id by rank, and the merges in order."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["id"] for t in file["added_tokens"]}
    byte_of = _byte_of()

    def raw(token: str) -> bytes:
        body, end = (token[:-4], b"\xff") if token.endswith("</w>") and token != "</w>" else (token, b"")
        return bytes(byte_of[c] for c in body) + end

    vocab, merges = file["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    order = {raw(t): i for t, i in vocab.items() if i not in special}
    ranks = {k: 1000 + i for k, i in order.items()}
    ranks |= {bytes([b, 255]): b for b in range(256)}
    if b"\xff" not in ranks:  # a rank of its own: it always merges with the byte before it
        ranks[b"\xff"] = 999
    return ranks, {ranks[k]: i for k, i in order.items()}, [(raw(a), raw(b)) for a, b in merges]


class WordBpe:
    """encode(texts) gives flat ids and each text's range in them. specials: strings of special tokens get their ids."""

    def __init__(self, path: str, specials: bool = True):
        import tiktoken

        ranks, id_of, _ = load_ranks(path)
        self.core = tiktoken.Encoding("word_ends", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ids = np.full(max(id_of) + 1, -1, dtype=np.int64)
        self.ids[list(id_of)] = list(id_of.values())
        self.path, self.library, self.specials = path, None, specials
        self.kind = np.full(SAFE, OTHER, dtype=np.uint8)
        self.low = np.arange(SAFE, dtype=np.uint32)
        for c in range(SAFE):
            group = unicodedata.category(chr(c))[0]
            self.kind[c] = SPACE if c in WHITE else LETTER if group == "L" else NUMBER if group == "N" else OTHER
            if len(chr(c).lower()) == 1:
                self.low[c] = ord(chr(c).lower())
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.at, self.size, self.pieces = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64), 0

    def _slow(self, text: str) -> np.ndarray:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.specials
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, keys: list[int], pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces, whose ids are stored."""
        encode = self.core.encode_single_piece
        found = [encode(p.encode() + b"\xff") for p in pieces]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = self.ids[np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))]
        first = self.pieces
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(keys) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(keys)] = sizes
        self.used, self.pieces = self.used + len(ids), first + len(keys)
        return np.arange(first, self.pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len(texts) + 1 offsets."""
        joined = "\n".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        odd = points >= SAFE
        for c in UNSAFE:
            odd |= points == c
        slow = set(np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1).tolist()) if odd.any() else set()
        if self.specials and "<|" in joined:
            slow |= {i for i, t in enumerate(texts) if "<|" in t}
        if slow:
            points = points.copy()
            for i in slow:
                points[starts[i] : starts[i] + sizes[i]] = 32
        ids, offsets = self._fast(points, starts)
        if not slow:
            return ids, offsets
        parts = [self._slow(t) if i in slow else ids[offsets[i] : offsets[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _fast(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(points) == 0:
            return np.empty(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
        kind, low = self.kind[points], self.low[points]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(points)]])
        keep = kind[first] != SPACE
        first, last = first[keep], last[keep]
        if len(first) and (low == 39).any():
            first, last = self._contractions(low, kind, first, last)
        if len(first) == 0:
            return np.empty(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
        keys = span_hashes(low, first, last) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        codes, distinct = pd.factorize(keys)
        if self.pieces > KNOWN:
            self.forget()
        where = np.empty(len(distinct), dtype=np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        keys = distinct.tolist()
        index = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        if len(new := np.flatnonzero(index < 0)):
            text = low.tobytes().decode("utf-32-le", "surrogatepass")
            i = where[new]
            spans = zip(first[i].tolist(), last[i].tolist(), strict=True)
            index[new] = self._learn([keys[j] for j in new.tolist()], [text[x:y] for x, y in spans])
        piece = index[codes]
        n = self.size[piece]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[piece] - (ends - n), n) + np.arange(int(ends[-1]))]
        before = np.searchsorted(first, starts, side="left")
        return ids, np.concatenate([np.concatenate([[0], ends])[before], [ends[-1]]]).astype(np.int64)

    @staticmethod
    def _contractions(low, kind, first, last):
        """An apostrophe alone before s, t, m, d, re, ve or ll takes these letters to itself."""
        n = len(low)
        at = np.flatnonzero((low[first] == 39) & (last - first == 1) & (last < n))
        nxt = last[at]
        at = at[kind[nxt] == LETTER]
        nxt = last[at]
        a, b = low[nxt], np.where((nxt + 1 < n), low[np.minimum(nxt + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        take = np.where(one, 1, np.where(two, 2, 0))
        at, take = at[take > 0], take[take > 0]
        first, last = first.copy(), last.copy()
        last[at] += take
        first[at + 1] += take
        keep = first < last
        return first[keep], last[keep]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text of any length, in segments that end at white space."""
        if len(text) <= SEGMENT:
            return self.encode([text])[0]
        parts, at = [], 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and text[end] not in " \n\t\r":
                end += 1
            parts.append(self.encode([text[at:end]])[0])
            at = end
        return np.concatenate(parts)


def encode_column(bpe: WordBpe, column):
    """For each row range of an Arrow string column: its first row, the ids and the offsets of its texts."""
    from rejoinder.llm.shared import text_slices

    for a, b in text_slices(column):
        texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
        if len(texts) == 1:
            ids = bpe.encode_long(texts[0])
            yield a, ids, np.array([0, len(ids)], dtype=np.int64)
        else:
            yield a, *bpe.encode(texts)


def worker_bpe(path: str, specials: bool = True, have: dict = {}) -> WordBpe:  # noqa: B006  kept for the worker's life
    if (path, specials) not in have:
        have[path, specials] = WordBpe(path, specials)
    return have[path, specials]
