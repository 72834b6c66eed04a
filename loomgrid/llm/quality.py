"""Text quality statistics per document, their place in the distribution of their language, and natural prose.

Running text is told from code, names and word lists by its share of common words. How large that share is in sentences depends on the
language and its list, so it is read off the distribution over the whole corpus: sketches of the share, one per language, are built where
the texts are and merged, and what lies in their tails is no sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.encode import slices
from loomgrid.llm.lines import Lines, WordLists
from loomgrid.session import cut_lineage

MEASURED = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
STATISTICS = (*MEASURED, "sentence_share")
#: More than this share of a text's characters in sentences makes it prose.
PROSE = 0.5
#: Tails of a distribution, as shares of a language's documents on either side.
TAIL = 0.05
#: Bound on the word list of ``statistics`` unless another or none is given; ``quality`` takes lists of any length.
MOST_COMMON_WORDS = 100_000
#: Bins of a sketch of shares of common words, and the part of the mode's weight up to which a bin counts as empty.
BINS, EMPTY = 20, 0.01
#: Texts' worth of the distribution over all languages that is added to that of each, so that a rare one isn't judged by a few texts.
PRIOR_TEXTS = 100
#: Words, in all and a line, from which a block without a sentence end is running text and no title.
UNENDED = (8, 4)
#: The cells of scripts without blanks, which have no words to look up, and of text without any common word, whose language is open.
UNSPACED, UNLISTED = -1, -2


def running_text(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, cell and ink of each block of running text: one with a sentence end, or too long for a title (UNENDED). Lines in a row are judged together, so that a wrapped
    sentence counts as a whole. The cell is language * BINS + the bin of the share of common words, the language being the one whose list
    has most of the words; a block without common words is UNLISTED."""
    texty, block = lines.blocks()
    n = int(block[-1]) + 1
    total = lambda v: np.bincount(block[texty], np.asarray(v)[texty], n)
    words = total(lines.words)
    language, most = lines.most_common(block, n, texty)
    share = most / np.maximum(words, 1)
    cell = np.where(most > 0, language * BINS + np.minimum((share * BINS).astype(np.int64), BINS - 1), UNLISTED)
    unspaced = total(lines.syllables) >= 0.3 * total(lines.letters)
    ended = total(lines.sentence_ends) >= 1
    ended |= ~unspaced & (words >= UNENDED[0]) & (words >= UNENDED[1] * total(np.ones(lines.n)))
    kept = ended & (total(lines.words) > 0)
    text = np.zeros(n, np.int64)
    text[block] = lines.text
    return text[kept], np.where(unspaced, UNSPACED, cell)[kept], total(lines.ink)[kept]


def text_figures(texts: pa.Array, common: set[str] | list[set[str]] | WordLists) -> dict[str, np.ndarray]:
    """Of each text: words, lines (with ink), ink, and MEASURED; a statistic without anything to count is NaN. Besides ``cells``: n + 1
    offsets, and the cell and ink of the running text of each. ``common``: the common words of each language."""
    common = common if isinstance(common, WordLists) else WordLists.of_sets([common] if isinstance(common, set) else common)
    lines = Lines(texts, common)
    if not lines.n:
        empty = np.zeros(lines.texts)
        none = (np.zeros(lines.texts + 1, np.int32), np.zeros(0, np.int32), np.zeros(0))
        return {"words": empty, "lines": empty, "ink": empty, "cells": none} | {s: np.full(lines.texts, np.nan) for s in MEASURED}
    per_text = lines.per_text
    words, rows, ink = per_text(lines.words), per_text(lines.ink > 0), per_text(lines.ink)
    text, cell, weight = running_text(lines)
    wide = (common.n + 1) * BINS
    place, at = np.unique(text * wide + cell + BINS, return_inverse=True)
    cells = (np.searchsorted(place // wide, np.arange(lines.texts + 1)).astype(np.int32), (place % wide - BINS).astype(np.int32), np.bincount(at, weight, len(place)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return {
            "words": words,
            "lines": rows,
            "ink": ink,
            "cells": cells,
            "mean_word_length": per_text(lines.word_letters) / words,
            "symbol_ratio": per_text(lines.signs) / ink,
            "punctuated_lines": per_text(lines.ends_in_mark) / rows,
            "common_words": lines.most_common(lines.text, lines.texts)[1] / words,
        }


def word_lists(common_words: DataFrame, word: str, word_lang: str | None, most: int | None) -> WordLists:
    """The words of each language in order (of all together without ``word_lang``); more than ``most`` raise an error."""
    language = F.coalesce(F.col(word_lang).cast("string"), F.lit("")) if word_lang else F.lit("")
    listed = common_words.where(F.col(word).isNotNull()).select(language.alias("lang"), F.lower(F.trim(F.col(word))).alias("word")).distinct()
    rows = (listed if most is None else listed.limit(most + 1)).toArrow().combine_chunks()
    if most is not None and rows.num_rows > most:
        raise ValueError(f"more than {most} common words")
    named = pa.array(rows["lang"].to_pylist(), pa.string()).dictionary_encode()
    order = np.argsort(np.array(named.dictionary.to_pylist(), object))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return WordLists.of(pa.array(rows["word"].combine_chunks(), pa.string()), rank[named.indices.to_numpy()], len(order))


def statistics(
    documents: DataFrame, id: str, text: str, lang: str, common_words: DataFrame, word: str, word_lang: str | None = None, most_words: int | None = MOST_COMMON_WORDS
) -> DataFrame:
    """``id``, ``lang`` (lower case without blanks around, ``und`` where null or blank), ``words``, ``lines``, ``ink`` (characters other
    than white space), MEASURED and ``running`` (the ink of running text by cell) of every row; a statistic of a text without
    words, or without anything but white space, is null. Whole texts of any length are counted. No shuffle.

    ``common_words`` is gathered once and sent to the executors, each word once; more than ``most_words`` raise an error (None: any number).
    The share of common words is that of the language whose list has most of a text's words, so a wrong ``lang`` doesn't matter.
    """
    sent = documents.sparkSession.sparkContext.broadcast(word_lists(common_words, word, word_lang, most_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                figures = text_figures(part["text"], sent.value)
                columns = [pa.array(figures[c].astype(np.int64)) for c in ("words", "lines", "ink")]
                columns += [pa.array(figures[s], from_pandas=True) for s in MEASURED]
                offsets, cell, weight = map(pa.array, figures["cells"])
                columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([cell, weight], names=["cell", "ink"])))
                yield pa.RecordBatch.from_arrays([part["id"], part["lang"], *columns], names=["id", "lang", "words", "lines", "ink", *MEASURED, "running"])

    kind = documents.schema[id].dataType.simpleString()
    language = F.coalesce(F.nullif(F.lower(F.trim(F.col(lang).cast("string"))), F.lit("")), F.lit("und"))
    named = documents.select(F.col(id).alias("id"), language.alias("lang"), F.col(text).alias("text"))
    schema = f"id {kind}, lang string, words bigint, lines bigint, ink bigint, " + ", ".join(f"{s} double" for s in MEASURED) + ", running array<struct<cell int, ink double>>"
    return named.mapInArrow(run, schema)


def share_cuts(weights: np.ndarray) -> tuple[int, int]:
    """First and last bin of the main body of a distribution: from the median bin outwards up to the middle of the widest run of empty
    bins on either side (EMPTY), or to the end where there is none."""
    middle = int(np.searchsorted(np.cumsum(weights), weights.sum() / 2))
    empty = weights <= EMPTY * weights[middle]

    def widest(bins: range) -> tuple[int, int] | None:
        best, begin = None, None
        for b in [*bins, None]:
            if b is not None and empty[b]:
                begin = b if begin is None else begin
            elif begin is not None:
                end = bins[-1] if b is None else b - 1
                best = (begin, end) if best is None or end - begin > best[1] - best[0] else best
                begin = None
        return best

    low, high = widest(range(middle)), widest(range(middle + 1, BINS))
    return (0 if low is None else (low[0] + low[1] + 1) // 2), (BINS - 1 if high is None else (high[0] + high[1]) // 2)


def sentence_cells(rows: DataFrame) -> list[int]:
    """The cells that sentences lie in, from the merged sketches of all languages: at most BINS rows a language of the word list reach
    the driver. Weights are ink; each language's sketch is joined by PRIOR_TEXTS texts' worth of the sketch of all text, which also
    decides on text without common words (the lowest bin)."""
    spaced = rows.select(F.explode("running").alias("r")).where(F.col("r.cell") != UNSPACED)
    merged = spaced.groupBy("r.cell").agg(F.sum("r.ink").alias("ink")).toPandas()
    if merged.empty:
        return []
    texts = rows.where(F.size("running") > 0).count()
    listed = merged[merged["cell"] >= 0]
    sketches = np.zeros((int(merged["cell"].max()) // BINS + 1 if len(listed) else 0, BINS))
    sketches[listed["cell"] // BINS, listed["cell"] % BINS] = listed["ink"]
    everything = sketches.sum(0)
    everything[0] += merged.loc[merged["cell"] == UNLISTED, "ink"].sum()
    out = [UNLISTED] if share_cuts(everything)[0] == 0 else []
    for language, weights in enumerate(sketches):
        low, high = share_cuts(weights + everything * PRIOR_TEXTS / texts)
        out += [language * BINS + b for b in range(low, high + 1) if weights[b] > 0]
    return out


def quality(
    documents: DataFrame, id: str, text: str, lang: str, common_words: DataFrame, word: str, tail: float = TAIL, word_lang: str | None = None, cells: list[int] | None = None
) -> DataFrame:
    """``id``, ``lang``, ``words``, ``lines`` and STATISTICS, and of each ``<s>_z`` (robust z-score in its language: distance from the
    median over the interquartile range / 1.349; null where that range is 0) and ``<s>_tail`` (-1 low, 1 high, 0 neither, null where the
    statistic is).

    ``sentence_share`` is the ink of running text whose share of common words lies in the main body of its language's sketch
    (``sentence_cells``; ``cells`` sets them otherwise), over all ink. Distributions are mergeable quantile sketches per
    language, built where the documents are and merged; a language of any share of the corpus costs one sketch per task. A language of
    few documents has no tails beyond its extremes. The word list may have any number of words and languages.
    """
    rows = cut_lineage(statistics(documents, id, text, lang, common_words, word, word_lang, None))  # texts are read once
    cells = [UNSPACED, *(sentence_cells(rows) if cells is None else cells)]
    inside = F.aggregate(F.filter("running", lambda r: r["cell"].isin(*cells)), F.lit(0.0), lambda a, r: a + r["ink"])
    rows = rows.withColumn("sentence_share", F.try_divide(inside, F.col("ink")))
    sketches = rows.groupBy("lang").agg(*[F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS])
    cuts = {"low": tail, "q1": 0.25, "q2": 0.5, "q3": 0.75, "high": 1 - tail}
    some = {s: F.kll_sketch_get_n_double(s) > 0 for s in STATISTICS}
    places = sketches.select(
        F.col("lang").alias("_lang"),
        *[F.when(some[s], F.kll_sketch_get_quantile_double(s, F.lit(q))).alias(f"_{s}_{c}") for s in STATISTICS for c, q in cuts.items()],
    )
    joined = rows.join(places, F.col("lang") == F.col("_lang"), "left")
    marks: list[Column] = []
    for s in STATISTICS:
        value, low, high = F.col(s), F.col(f"_{s}_low"), F.col(f"_{s}_high")
        spread = F.col(f"_{s}_q3") - F.col(f"_{s}_q1")
        marks.append(F.try_divide((value - F.col(f"_{s}_q2")) * F.lit(1.349), spread).alias(f"{s}_z"))
        marks.append(F.when(value < low, -1).when(value > high, 1).when(value.isNotNull(), 0).alias(f"{s}_tail"))
    return joined.select(F.col("id").alias(id), "lang", "words", "lines", *STATISTICS, *marks)


def natural_prose(documents: DataFrame, id: str, text: str, lang: str, common_words: DataFrame, word: str, word_lang: str | None = None, cells: list[int] | None = None) -> DataFrame:
    """The rows of ``quality`` that are natural prose: with more than PROSE of their characters in running text that the sketches
    of their languages leave as sentences. Null and empty texts are none."""
    return quality(documents, id, text, lang, common_words, word, word_lang=word_lang, cells=cells).where(F.col("sentence_share") > PROSE)
