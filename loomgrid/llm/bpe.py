"""Byte-level BPE over the distinct words of a partition, by a pair occurrence index.

Words are cut from whole batches of text with array operations, equal words are kept once, and the
merges are applied to all of them together: every pair of adjacent tokens is listed under its rank with all
its positions, active ranks are worked off in ascending order, and only the lists of the pairs beside a merge are updated.
Lists of neighbouring ranks are kept together in bands, inside which each word takes its lowest rank first; words don't touch
each other, so the result is that of one list per rank (``bands=None``), with fewer and longer array operations.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

NONE = np.int32(2**30)
BANDS = 96
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """White space, letter, number or other, of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\s", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        out[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), np.uint32)] = kind
    out[0x1C:0x20] = _OTHER
    return out


class Vocabulary:
    """The merges of a byte-level BPE file: pair of ids -> rank and id of the merged token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.of_byte = np.array([ids[shown[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.size = max(ids.values()) + 1  # keys of pairs can't collide, however many ids there are
        spelled = {i: t for t, i in ids.items()}
        of_char = {c: b for b, c in shown.items()}
        self.spelled = [bytes(of_char[c] for c in spelled[i]) if i in spelled and all(c in of_char for c in spelled[i]) else b"" for i in range(self.size)]
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.byte_pairs = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def edges(self, ranks: np.ndarray, bands: int | None) -> np.ndarray:
        """The first rank of each list: of every rank, or of about 1.5 times ``bands`` bands, half of them by how often ranks occur."""
        if bands is None:
            return np.arange(len(self.keys) + 2)
        spread = np.quantile(ranks, np.linspace(0, 1, bands), method="nearest") if len(ranks) else []
        return np.unique(np.concatenate([[0], spread, np.linspace(0, len(self.keys), bands // 2), [len(self.keys) + 1]]).astype(np.int64))

    def encode_words(self, data: np.ndarray, offsets: np.ndarray, bands: int | None = BANDS) -> tuple[np.ndarray, np.ndarray]:
        """Of words (bytes and n + 1 offsets, no empty word): all token ids, and n + 1 offsets into them."""
        n = len(data)
        count = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
        word = np.repeat(np.arange(count, dtype=np.int32), np.diff(offsets))
        token = self.of_byte[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ends, begins = offsets[1:] - 1, offsets[:-1]
        after[ends], before[begins] = -1, -1
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.byte_pairs[data[:-1], data[1:]]
        rank[ends] = NONE
        dead = np.zeros(n, bool)
        listed = np.flatnonzero(rank < NONE).astype(np.int32)
        first = rank[listed]
        edges = self.edges(first, bands)
        lists: list[list[np.ndarray]] = [[] for _ in range(len(edges) - 1)]

        def enlist(at: np.ndarray, ranks: np.ndarray) -> None:
            band = np.searchsorted(edges, ranks, side="right") - 1
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            cuts = np.flatnonzero(np.diff(band)) + 1
            for part, b in zip(np.split(at, cuts), band[np.concatenate([[0], cuts])]):
                lists[b].append(part)

        if len(listed):
            enlist(listed, first)
        best = np.full(count, NONE, np.int32)
        b = 0
        while b < len(lists):
            if not lists[b]:
                b += 1
                continue
            top = edges[b + 1]
            at = np.unique(np.concatenate(lists[b]))
            lists[b] = []
            back = b + 1
            while True:
                ranks = rank[at]
                live = ranks < top
                at, ranks = at[live], ranks[live]
                if not len(at):
                    break
                words = word[at]
                np.minimum.at(best, words, ranks)
                lowest = ranks == best[words]
                best[words] = NONE
                left, rest, ranks = at[lowest], at[~lowest], ranks[lowest]
                right = after[left]
                chained = np.zeros(len(left), bool)
                chained[1:] = left[1:] == right[:-1]
                if chained.any():  # runs of one token: every second pair, from the left
                    number = np.arange(len(left))
                    begin = np.maximum.accumulate(np.where(chained, 0, number))
                    kept = (number - begin) % 2 == 0
                    left, right, ranks = left[kept], right[kept], ranks[kept]
                beyond = after[right]
                token[left] = self.merged[ranks]
                dead[right] = True
                rank[right] = NONE
                after[left] = beyond
                inner = beyond >= 0
                before[beyond[inner]] = left[inner]
                rank[left[~inner]] = NONE
                previous = before[left]
                changed = np.concatenate([left[inner], previous[previous >= 0]])
                new = self.rank(token[changed], token[after[changed]])
                rank[changed] = new
                now = new < top
                later = ~now & (new < NONE)
                if later.any():
                    enlist(changed[later], new[later])
                lower = now & (new < edges[b])  # a pair of an earlier list: its turn is next
                if lower.any():
                    enlist(changed[lower], new[lower])
                    now &= ~lower
                    back = min(back, int(np.searchsorted(edges, new[lower].min(), side="right")) - 1)
                at = np.unique(np.concatenate([rest, changed[now]]))
            b = back
        alive = ~dead
        sizes = np.add.reduceat(alive.astype(np.int64), begins) if count else np.zeros(0, np.int64)
        return token[alive], np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a word; ``first`` marks the first one of each text.

    Words: the endings 's 't 're 've 'm 'll 'd; letters, numbers or other signs with at most one
    blank before them; white space up to, not with, the last character before a word.
    """
    n = len(points)
    kind = char_classes()[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    joint = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~last[:-1])
    start[joint] = True
    start[joint[points[joint] == 32] + 1] = False
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & ~last[:-1])
    quote = quote[kind[quote + 1] == _LETTER]
    a = points[quote + 1]
    more = ~last[quote + 1]
    b = np.where(more, points[np.minimum(quote + 2, n - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    for which, size in ((one, 2), (two, 3)):
        at = quote[which]
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    return start


def plain_text(texts: pa.Array) -> tuple[bytes, str, np.ndarray]:
    """All texts as one UTF-8 buffer and one string, with n + 1 byte offsets. A null text is an empty one;
    bytes that aren't UTF-8 become replacement characters."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    buffer = texts.buffers()[2]
    raw = bytes(buffer[offsets[0] : offsets[-1]]) if buffer is not None and offsets[-1] > offsets[0] else b""
    offsets = (offsets - offsets[0]).astype(np.int64)
    try:
        return raw, raw.decode("utf-8"), offsets
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        plain = "".join(parts)
        return plain.encode("utf-8"), plain, np.concatenate([[0], np.cumsum([len(p.encode("utf-8")) for p in parts])])


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, as a dictionary array of bytes, and how many words each text has."""
    raw, plain, offsets = plain_text(texts)
    if not raw:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    if len(plain) == len(raw):
        points, at_byte = np.frombuffer(raw, np.uint8), None
    else:
        points = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
        bytes_ = np.frombuffer(raw, np.uint8)
        at_byte = np.flatnonzero((bytes_ & 0xC0) != 0x80).astype(np.int32)
    begins = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(points), bool)
    first[begins if at_byte is None else np.searchsorted(at_byte, begins)] = True
    starts = np.flatnonzero(word_starts(points, first))
    starts = (starts if at_byte is None else at_byte[starts]).astype(np.int32)
    bounds = np.append(starts, np.int32(len(raw)))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    counts = np.diff(np.searchsorted(starts, offsets))
    return words.dictionary_encode(), counts


class Words:
    """The distinct words met so far, with a number each, until they are encoded."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}

    def numbers(self, words: pa.DictionaryArray) -> np.ndarray:
        number = self.number
        mapped = np.fromiter((number.setdefault(w, len(number)) for w in words.dictionary.to_pylist()), np.int32, len(words.dictionary))
        return mapped[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)

    def encoded(self, vocabulary: Vocabulary, bands: int | None = BANDS) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, self.number), np.int64, len(self.number))
        return vocabulary.encode_words(np.frombuffer(b"".join(self.number), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), bands)


def gather(flat: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The tokens of a sequence of words."""
    sizes = (offsets[words + 1] - offsets[words]).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int32)
    shift = np.repeat((offsets[words] - (ends - sizes)), sizes)
    return flat[shift + np.arange(ends[-1])]
