"""Figures of texts, lines and blocks of lines, by array operations over whole batches of text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from loomgrid.llm.bpe import plain_text

BLANK, BREAK, LOWER, UPPER, DIGIT, MARK, SIGN, SYLLABLE = range(8)
# Characters that belong to sentences, that end them, and that may follow an end.
PUNCTUATION = ".,;:!?'\"()-‐‑–—…“”‘’„«»‹›¿¡。、！？「」『』・，：；"
ENDS = ".!?…。！？"
CLOSERS = "\"'”’»›)」』"
BREAKS = "\n\r\x0b\x0c\x85  "
HIRAGANA_KATAKANA = (0x3040, 0x30FF)
#: Counts by group and language, and words by language, that are held at a time: both bound the memory of a task with many languages.
HELD_COUNTS, HELD_PAIRS = 2_000_000, 2_000_000


@dataclass
class WordLists:
    """The common words of all languages: each word once, and its languages as n + 1 offsets and their numbers."""

    words: pa.Array
    starts: np.ndarray
    languages: np.ndarray
    n: int

    @classmethod
    def of(cls, words: pa.Array, languages: np.ndarray, n: int) -> WordLists:
        """From pairs of a word and the number of its language, each pair once."""
        each = words.dictionary_encode()
        which = each.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(each.dictionary)))])
        return cls(each.dictionary, starts, languages[np.argsort(which, kind="stable")].astype(np.int32), max(n, 1))

    @classmethod
    def of_sets(cls, sets: list[set[str]]) -> WordLists:
        pairs = [(w, i) for i, s in enumerate(sets) for w in sorted(s)]
        return cls.of(pa.array([w for w, _ in pairs], pa.string()), np.array([i for _, i in pairs], np.int32), len(sets))


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    out = np.full(0x110000, SIGN, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def put(pattern: str, kind: int) -> None:
        out[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), np.uint32)] = kind

    put(r"[\p{L}\p{M}]", LOWER)
    put(r"[\p{Lu}\p{Lt}]", UPPER)
    put(r"[\p{Hiragana}\p{Katakana}\p{Han}ー々]", SYLLABLE)
    put(r"\p{N}", DIGIT)
    put(r"[\p{Cf}\p{Cc}]", MARK)
    put(r"[\s\p{Zs}\x1c-\x1f]", BLANK)
    out[[ord(c) for c in PUNCTUATION]] = MARK
    out[[ord(c) for c in BREAKS]] = BREAK
    return out


def member(characters: str, points: np.ndarray) -> np.ndarray:
    return np.isin(points, np.array([ord(c) for c in characters], points.dtype if points.dtype != np.uint8 else np.uint32))


class Lines:
    """Of a batch of texts: per line its text, and counts of characters, words and sentence ends; of groups of lines the counts of common
    words (``most_common``)."""

    def __init__(self, texts: pa.Array, common: WordLists):
        self.lists = common
        raw, plain, offsets = plain_text(texts)
        self.texts = len(texts)
        if not plain:
            self.n = 0
            return
        if len(plain) == len(raw):
            points = np.frombuffer(raw, np.uint8)
            at_byte = None
            text_starts = offsets[:-1]
        else:
            points = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
            at_byte = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).astype(np.int32)
            text_starts = np.searchsorted(at_byte, offsets[:-1])
        n = len(points)
        kind = char_kinds()[points]
        text_ends = np.append(text_starts[1:], n)
        begins_text = text_starts[text_ends > text_starts]
        starts_line = np.zeros(n + 1, bool)
        starts_line[1:] = kind == BREAK
        starts_line = starts_line[:n]
        starts_line[begins_text] = True
        starts = np.flatnonzero(starts_line)
        line = np.cumsum(starts_line, dtype=np.int32) - 1
        self.n = len(starts)
        self.text = np.searchsorted(text_starts, starts, side="right") - 1
        counts = np.bincount(line * 8 + kind, minlength=8 * self.n).reshape(self.n, 8)
        self.signs = counts[:, SIGN].astype(np.int64)
        self.letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, SYLLABLE]
        self.syllables, self.digits, self.marks = counts[:, SYLLABLE], counts[:, DIGIT], counts[:, MARK]
        self.ink = self.letters + self.digits + self.marks + self.signs
        letter = (kind == LOWER) | (kind == UPPER) | (kind == SYLLABLE)
        # signs and marks before the first letter or digit of a line: marks of diffs, comments and quotes
        body = np.flatnonzero(letter | (kind == DIGIT))
        ends = np.append(starts[1:], n)
        first = np.append(body, n)[np.searchsorted(body, starts)]
        first = np.minimum(first, ends)
        leading = lambda mask: (s := np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]))[first] - s[starts]
        self.leading = leading((kind == SIGN) | (kind == MARK))
        self.signs_inside = self.signs - leading(kind == SIGN)
        # words: runs of letters
        edge = np.ones(n + 1, bool)
        edge[1:n] = letter[1:] != letter[:-1]
        edge[1:n] |= starts_line[1:]
        cuts = np.flatnonzero(edge)
        is_word = letter[cuts[:-1]]
        begin, size = cuts[:-1][is_word], np.diff(cuts)[is_word]
        bounds = (cuts if at_byte is None else np.append(at_byte, len(raw))[cuts]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        lower, which = pc.utf8_lower(pieces.dictionary), pieces.indices.to_numpy()[is_word]
        known = pc.index_in(lower, value_set=common.words).fill_null(-1).to_numpy(zero_copy_only=False)
        word_line = line[begin]
        per_line = lambda at, w=None: np.bincount(at, w, self.n)[: self.n]
        self.words = per_line(word_line)
        self.word_letters = per_line(word_line, size)
        listed = np.flatnonzero(known[which] >= 0)  # most words are in no list
        self.listed_line, self.listed = word_line[listed], known[which[listed]]
        humps = np.flatnonzero((kind[:-1] == LOWER) & (kind[1:] == UPPER))
        self.humps = per_line(line[humps])
        # sentence ends: an end sign, perhaps closers, then a blank, a break, the end, or (in scripts without blanks) a syllable
        end = np.flatnonzero(member(ENDS, points))
        after = np.minimum(end + 1, n - 1)
        closer = member(CLOSERS, points[after])
        after2 = np.where(closer, np.minimum(after + 1, n - 1), after)
        free = (kind[after2] <= BREAK) | starts_line[after2] | (after2 == end) | (kind[after2] == SYLLABLE) | (end + 1 >= n)
        free |= points[end] >= 0x3000
        before = kind[np.maximum(end - 1, 0)]
        free &= (before == LOWER) | (before == UPPER) | (before == SYLLABLE) | (before == BLANK) | (before == MARK) | (before == DIGIT)
        self.sentence_ends = per_line(line[end[free]])
        inked = np.flatnonzero(kind > BREAK)
        last_at = np.searchsorted(inked, ends) - 1
        last = inked[np.maximum(last_at, 0)] if len(inked) else np.zeros(self.n, np.int64)
        self.ends_in_mark = (self.ink > 0) & (kind[last] == MARK) & member(ENDS + CLOSERS + ":;,", points[last])
        self.upper = counts[:, UPPER]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(self.texts)
        return np.bincount(self.text, values, self.texts)

    def most_common(self, group: np.ndarray, n: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each of ``n`` groups of lines (ascending; only the lines ``inside`` count): the language with most common words, the first of
        equal ones, and how many it has. Groups, and words in them, are counted some at a time, so neither the length of the lists nor the
        number of languages adds to what is held."""
        language, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        line, word = self.listed_line, self.listed
        if inside is not None:
            kept = inside[line]
            line, word = line[kept], word[kept]
        at, lists = group[line], self.lists
        sizes = np.diff(lists.starts)[word]
        groups, words = max(1, HELD_COUNTS // lists.n), max(1, HELD_PAIRS // max(1, int(sizes.max(initial=1))))
        for a in range(0, n, groups):
            b = min(n, a + groups)
            begin, end = np.searchsorted(at, [a, b])
            counts = np.zeros((b - a) * lists.n, np.int64)
            for i in range(begin, end, words):
                size = sizes[i : min(end, i + words)]
                place = np.arange(size.sum()) + np.repeat(lists.starts[word[i : i + len(size)]] - np.cumsum(size) + size, size)
                counts += np.bincount(np.repeat((at[i : i + len(size)] - a) * lists.n, size) + lists.languages[place], minlength=len(counts))
            counts = counts.reshape(b - a, lists.n)
            language[a:b] = counts.argmax(1)
            most[a:b] = counts[np.arange(b - a), language[a:b]]
        return language, most

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that could be running text (mostly letters, hardly any signs), and the block of each: such lines in a row, blank
        ones between them allowed."""
        inside = np.maximum(self.ink - self.leading, 1)
        texty = (self.letters >= 0.7 * inside) & (self.signs_inside <= 0.02 * inside) & (self.humps <= 0) & (self.digits <= 0.15 * inside) & (self.letters > 0)
        blank = self.ink == self.leading
        breaks = ~texty & ~blank
        new_text = np.ones(self.n, bool)
        new_text[1:] = self.text[1:] != self.text[:-1]
        return texty, np.cumsum(breaks | new_text) - 1
