"""Whole texts to token ids with a public tokenizer file, through a bounded table of text pieces.

The tokenizers split a text into pieces before they merge, and a piece's ids don't depend on its neighbours. Texts are
cut in numpy where such a split is certain from the bytes beside it; each piece is looked up by a 128-bit hash, new
ones are encoded once by the library, and a text's ids are its pieces' ids put together. What is not certain stays in
one piece: cuts are only made beside ASCII letters, digits and white space, and a byte-level text with other white
space is one piece as a whole.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import mix, powers

#: Pieces that a worker remembers, and their ids in all; slots of the table (a power of two, over twice the pieces).
CACHE, CACHE_IDS, SLOTS = 1_000_000, 8_000_000, 1 << 21
#: Bytes whose pieces are hashed at a time; new pieces that go to the library in one call.
SLICE, TOGETHER = 1_000_000, 500
_SPACE, _ALNUM, _MARK, _NEWLINE = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x0A] |= _NEWLINE
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ALNUM
_CLASS[[0x2C, 0x2E]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RNG = np.random.default_rng(0x70)
_BYTES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _odd_spaces(b: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII and of the four separators U+001C to U+001F, ascending."""
    at = np.flatnonzero((b >= 0x1C) & (b <= 0x1F))
    lead = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    if not len(lead):
        return at
    padded = np.concatenate([b, np.zeros(2, np.uint8)])
    x, y, z = b[lead], padded[lead + 1], padded[lead + 2]
    odd = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    odd |= (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
    odd |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    odd |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
    odd |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
    return np.sort(np.concatenate([at, lead[odd]]))


class Encoder:
    """Ids of texts as numbers of 2 bytes (vocabularies up to 65,536) or 4.

    kind ``byte``: byte-level BPE whose split keeps one space before a word; a cut stands before white space, behind a
    lone line feed, and before a comma or full stop behind a letter or digit. kind ``word``: white
    space is dropped and letters are lower-cased; a cut stands at white space, and on both sides of a comma or full
    stop between letters, digits and white space.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(True) <= 65536 else "<u4")
        self.word = kind == "word"
        vocabulary = self.library.get_vocab(True)
        self.spelled = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that each token stands for
        for token, i in vocabulary.items():
            self.spelled[i] = len(token.removesuffix("</w>"))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.second = np.zeros(CACHE, np.uint64)
        self.begin, self.count = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.flat = np.zeros(1 << 20, self.dtype)
        self.entries = self.ids = 0

    def _cuts(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces of all texts, and which of them are white space to drop."""
        c = _CLASS[b]
        space, alnum, mark = (c & _SPACE) > 0, (c & _ALNUM) > 0, (c & _MARK) > 0
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut = np.zeros(len(b) + 1, bool)
        if self.word:
            beside = alnum | space
            free = np.concatenate([[True], beside, [True]])  # free[i]: what stands before byte i
            free[first] = True
            behind = np.concatenate([beside, [True]])  # behind[i]: byte i
            behind[first] = True
            clean = mark & free[:-1][: len(b)] & behind[1:]
            cut[:-1] |= clean
            cut[1:] |= clean
            cut[1:-1] |= space[1:] != space[:-1]
        else:
            cut[1:-1] |= space[1:] & ~space[:-1]
            cut[2:-1] |= ~space[2:] & ((c[1:-1] & _NEWLINE) > 0) & ~space[:-2]
            cut[1:-1] |= mark[1:] & alnum[:-1]
            odd = _odd_spaces(b)
            for i in np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist():
                cut[offsets[i] : offsets[i + 1]] = False
        cut[first] = True
        starts = np.flatnonzero(cut[:-1])
        return starts, space[starts] if self.word else np.zeros(len(starts), bool)

    def _hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each piece b[start:end]; the first is never 0."""
        up, down = powers(len(b))
        out = []
        with np.errstate(over="ignore"):
            for table in _BYTES:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[b] * up)])
                out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        return np.maximum(out[0], np.uint64(1)), out[1]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = SLOTS - 1
        slot = (h >> np.uint64(20)).astype(np.int64) & mask
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        mask = SLOTS - 1
        slot = (h >> np.uint64(20)).astype(np.int64) & mask
        while len(h):
            empty = self.keys[slot] == 0
            self.keys[slot[empty]] = h[empty]  # of two that meet in a slot, the last stays
            stays = self.keys[slot] == h
            self.entry[slot[stays]] = entries[stays]
            h, entries, slot = h[~stays], entries[~stays], (slot[~stays] + 1) & mask

    def _alone(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _together(self, pieces: list[str], between: str) -> list[np.ndarray]:
        """Ids of pieces that are encoded many in a text: a call costs the library more than a piece does.

        Tokens spell their text, so that byte lengths tell which tokens are whose.
        """
        out: list[np.ndarray] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        gap = 0 if self.word else len(between)
        for some, e in zip(groups, self.library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            plain = self.library.normalizer.normalize_str(between.join(some)).split(between) if self.word else some
            ends = np.cumsum([len(x.encode()) + gap for x in plain]) - gap
            spelled = np.cumsum(self.spelled[ids])
            at = np.searchsorted(spelled, ends, side="right")
            begin = np.concatenate([[0], at[:-1] + (gap > 0)])
            if len(plain) != len(some) or not len(ids) or spelled[-1] != ends[-1] or (spelled[np.maximum(at - 1, 0)] != ends).any():
                out += self._alone(some)  # should a normalizer do more than this knows
            else:
                out += [ids[x:y] for x, y in zip(begin.tolist(), at.tolist(), strict=True)]
        return out

    def _learn(self, pieces: list[str], h: np.ndarray, second: np.ndarray) -> None:
        """Encode new pieces and put them into the table."""
        ids: list[np.ndarray | None] = [None] * len(pieces)
        if self.word:
            kinds = [([*range(len(pieces))], lambda some: self._together(some, " "))]
        else:
            inner = [i for i, x in enumerate(pieces) if not x[-1].isspace()]
            led = [i for i in inner if pieces[i][0] in " \n"]
            plain = [i for i in inner if not pieces[i][0].isspace()]
            rest = sorted({*range(len(pieces))} - {*led, *plain})
            kinds = [(led, lambda some: self._together(some, "")), (plain, lambda some: self._together(some, "\n")), (rest, self._alone)]
        for at, encode in kinds:
            for i, x in zip(at, encode([pieces[i] for i in at]), strict=True):
                ids[i] = x
        sizes = np.array([len(x) for x in ids], np.int64)
        a, b = self.entries, self.entries + len(pieces)
        if b > len(self.second):  # more new pieces at once than CACHE
            self.second, self.begin, self.count = (np.resize(x, b) for x in (self.second, self.begin, self.count))
        need = self.ids + int(sizes.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.ids], np.zeros(max(need, 2 * len(self.flat)) - self.ids, self.dtype)])
        self.flat[self.ids : need] = np.concatenate(ids)
        self.second[a:b], self.count[a:b] = second, sizes
        self.begin[a:b] = self.ids + np.cumsum(sizes) - sizes
        self._insert(h, np.arange(a, b, dtype=np.int32))
        self.entries, self.ids = b, need

    def _pieces(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces b[start:end], end to end, and how many each has."""
        h, second = self._hashes(b, starts, ends)
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, once = np.unique(h[new], return_index=True)
            new = new[once]
            if self.entries + len(new) > CACHE or self.ids > CACHE_IDS:
                self._forget()
                _, new = np.unique(h, return_index=True)
            raw = b.tobytes()
            self._learn([raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], h[new], second[new])
            at = self._find(h)
        if (self.second[at] != second).any():  # two pieces of one first hash
            ids = self._alone([b[s:e].tobytes().decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        n = self.count[at]
        return self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts b[offsets[i]:offsets[i + 1]] in UTF-8 -> their ids end to end, and the place where each text's begin (and the end)."""
        starts, drop = self._cuts(b, offsets)
        b = _LOWER[b] if self.word else b
        ends = np.append(starts[1:], len(b))
        if drop.any():
            starts, ends = starts[~drop], ends[~drop]
        ids, counts, at = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
            low = starts[at]
            x, n = self._pieces(b[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
            ids.append(x)
            counts.append(n)
            at = to
        before = np.cumsum(np.concatenate(counts))
        return np.concatenate(ids), before[np.searchsorted(starts, offsets)]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        ids, at = self.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [ids[a:z] for a, z in itertools.pairwise(at.tolist())]


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, kind)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls, and where each begins (and the end)."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str, most: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each; a longer text is a run of its own."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
