"""Training-text operators against libraries, brute force and round trips, with nulls, empty and long texts."""

import json
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm.bpe import Words, cut_words, gather, plain_text, vocabulary
from loomgrid.llm.encode import TOKENIZERS, decode_corpus, encode_corpus, text_offsets
from loomgrid.llm.lines import Lines, WordLists
from loomgrid.llm.packing import OpenWindows, pack_sizes, pack_tokens
from loomgrid.llm.quality import BINS, STATISTICS, UNLISTED, natural_prose, quality, share_cuts, statistics, text_figures
from loomgrid.llm.topn import latest_items, top_n_per_group

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer file")
PROSE = "It turned out that the record had been written before the index was closed. She said that nothing else depends on it. "
CODE = "+def edge(report_census, report=None):\n-    return county_parser.migration()[2805:]\n+    x = {'a': 1};\n"


def texts() -> list:
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'LL", "a", "B", "é", "ß", "中", "1", "٣", "²", "-", "=", "\x1c", "\x85", " ", "　", "🙂", "\x00", "﻿", "<|endoftext|>", "́", "x" * 50]
    made = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(1500)]
    return [None, "", " ", "=" * 3000, "ab" * 4000, "a" * 5001, " " * 777, PROSE * 3000, CODE * 50, *made]


@needs_file
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    given = texts()
    want = [e.ids for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in encode_corpus(rows, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(given))] == want
    assert library.decode(got[7]) == given[7]
    assert encode_corpus(rows.limit(0), "doc_id", "text").collect() == []
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(rows, "doc_id", "text"), "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(given))] == [t or "" for t in given]


@needs_file
def test_one_list_per_rank_gives_the_same():
    words, v = Words(), vocabulary(FILE)
    words.numbers(cut_words(pa.array(texts()))[0])
    banded, ranked = words.encoded(v), words.encoded(v, None)
    assert banded[0].tolist() == ranked[0].tolist() and banded[1].tolist() == ranked[1].tolist()


def test_ids_beyond_65536_and_lower_ranks_after_a_merge(tmp_path):
    """A file whose ids are far apart, and where a late merge forms a pair of an early one."""
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = [chr(b) for b in letters] + [chr(256 + i) for i in range(256 - len(letters))]
    vocab = {c: 70_000 * i for i, c in enumerate(shown)} | {t: 70_000 * 256 + i for i, t in enumerate(["bc", "abc", "abcd", "ab", "xy"])}
    merges = [["b", "c"], ["a", "bc"], ["abc", "d"], ["x", "y"], ["a", "b"], ["ab", "c"]]
    merges = [merges[i] for i in (2, 4, 5, 3)]  # abc + d ranks first, but only the last but one merge makes abc
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    v = vocabulary(str(path))
    for bands in (None, 2, 96):
        words = Words()
        words.numbers(pa.array([b"abcd", b"xyabcd", b"ba"]).dictionary_encode())
        flat, offsets = words.encoded(v, bands)
        assert [[v.spelled[i] for i in flat[a:b]] for a, b in zip(offsets[:-1], offsets[1:])] == [[b"abcd"], [b"xy", b"abcd"], [b"b", b"a"]]


@needs_file
def test_batches_do_not_matter():
    given = pa.array(texts())
    v = vocabulary(FILE)

    def ids(part: pa.Array) -> list:
        words = Words()
        cut, counts = cut_words(part)
        numbers = words.numbers(cut)
        flat, offsets = words.encoded(v)
        ends = text_offsets(numbers, counts, offsets)
        flat = gather(flat, offsets, numbers)
        return [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]

    assert ids(given[:300]) == [x for k in range(0, 300, 7) for x in ids(given[k : min(k + 7, 300)])]


def test_invalid_bytes_become_replacements():
    raw, plain, offsets = plain_text(pa.array([b"ok", b"a\xff", b"z"]).cast(pa.binary()).view(pa.string()))
    assert plain == "oka�z" and offsets.tolist() == [0, 2, 6, 7] and raw.decode() == plain


def test_windows_place_best_fit_and_close_the_fullest():
    w = OpenWindows(10, 2, 0)
    assert w.place(6) == (0, 0) and w.place(7) == (1, 0)
    assert w.place(3) == (1, 7)  # fills the fuller one exactly, which closes
    assert w.place(5) == (2, 0)
    assert w.place(9) == (3, 0)  # no room: the fullest open one (container 0) is closed
    assert w.place(4) == (2, 5)
    rows, _ = pack_sizes(np.array([25, 0, 3]), 10, 4, 0)
    assert [r[:4] for r in rows] == [(0, 0, 0, 10), (0, 1, 10, 10), (0, 2, 20, 5), (2, 0, 0, 3)]


@needs_file
def test_packing_is_whole(spark):
    rng = random.Random(3)
    given = [(i, rng.choice([None, "", PROSE * rng.randint(1, 60), CODE * rng.randint(1, 20), "word " * rng.randint(1, 900)])) for i in range(400)]
    given += [(400, PROSE * 2000), (401, "x")]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("container", F.lit(1)).repartition(5)
    df = df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
    sizes = {r.doc_id: len(r.ids) for r in encode_corpus(df, "doc_id", "text").collect()}
    placed = pack_tokens(df, "doc_id", "text", 2048).toPandas()
    whole = placed.groupby("doc_id")["n_tokens"].sum()
    assert whole.to_dict() == {k: n for k, n in sizes.items() if n}
    assert set(placed.groupby("doc_id").size()[lambda s: s > 1].index) == {k for k, n in sizes.items() if n > 2048}
    fill = placed.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.9
    for _, rows in placed.sort_values("container_offset").groupby("container"):
        assert (rows["container_offset"].to_numpy() == np.concatenate([[0], np.cumsum(rows["n_tokens"])[:-1]])).all()
    for _, rows in placed.sort_values("piece").groupby("doc_id"):
        assert (rows["token_start"].to_numpy() == np.concatenate([[0], np.cumsum(rows["n_tokens"])[:-1]])).all()
    assert pack_tokens(df.limit(0), "doc_id", "text", 2048).collect() == []


@pytest.mark.parametrize("salts", [1, 5, 64])
def test_top_n(spark, salts):
    rng = random.Random(2)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 1.0, 2.5]
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(scores), rng.choice(scores), rng.choice(["x", "é", "z", None]), f"n{i:04d}") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s double, w double, k string, n string").withColumn("r", F.lit("clash"))
    got = sorted((str(r.g), r.place, r.n) for r in top_n_per_group(df, "g", ["s", "w"], ["k", "n"], 3, "place", salts).collect())
    key = lambda v: (v is None or not math.isfinite(v), 0.0 if v is None or not math.isfinite(v) else v)
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (key(r[1]), key(r[2]), (r[3] is not None, (r[3] or "").encode()), r[4]))
        want += [(str(g), i + 1, r[4]) for i, r in enumerate(own[:3])]
    assert got == sorted(want)
    assert top_n_per_group(df.limit(0), "g", ["s", "w"], ["k", "n"], 3, "place").collect() == []


def test_latest_items(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, 4, 2.0), ("a", 2, 6, 3.0), ("b", None, 1, 1.0)], "k string, w int, id int, v double")
    assert {r.k: r.id for r in latest_items(df, ["k"], ["w", "id"], ["id", "v"]).collect()} == {"a": 6, "b": 1}


COMMON = {"the", "that", "and", "it", "had", "been", "was", "on", "else", "before", "she", "out"}


def test_figures_of_plain_texts():
    f = text_figures(pa.array(["One two, three.\n\nx = 1;", "", None, "  \n ", "Hello"]), {"one", "two"})
    assert f["words"].tolist() == [4, 0, 0, 0, 1] and f["lines"].tolist() == [2, 0, 0, 0, 1]
    assert f["mean_word_length"][0] == pytest.approx(12 / 4) and np.isnan(f["mean_word_length"][1])
    assert f["common_words"][0] == 0.5 and f["punctuated_lines"][0] == 1.0 and f["punctuated_lines"][4] == 0
    assert f["symbol_ratio"][0] == pytest.approx(1 / (13 + 4))


def documents(spark):
    listed = "\n".join("the and that it was on".split() * 6)
    japanese = "この修正により、記録の更新が終わるまで暦は待つようになります。暦が空のときは行列を読み込まないように変更しました。"
    rows = [
        (1, PROSE * 4, "en", True), (2, CODE * 9, "en", False), (3, "\n".join("+# " + w for w in (PROSE * 3).split(". ")) + ".", "EN ", True), (4, listed, "en", False),
        (5, japanese * 3, "ja", True), (6, None, None, False), (7, "", "en", False), (8, CODE + PROSE, "en", True), (9, CODE * 4 + PROSE, "en", False),
        (10, PROSE.lower() * 3, "de", True), (11, "1. hidden metric.\n2. empty report.\n3. old sampler.\n" * 5, "en", False), (12, PROSE * 4000, "en", True), (13, "\x00﻿ ​", "en", False),
        (14, "| a | 0.5 |\n| b | 0.7 |\n" * 20, "en", False), (15, "\n".join("+" + " ".join(PROSE.split()[i : i + 4]) for i in range(0, 21, 4)), "en", True),
    ]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, prose boolean").withColumn("words", F.lit("clash"))


def test_natural_prose(spark):
    df, words = documents(spark), spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.doc_id for r in natural_prose(df, "doc_id", "text", "lang", words, "word").collect()}
    assert got == {r.doc_id for r in df.where("prose").collect()}
    assert natural_prose(df.limit(0), "doc_id", "text", "lang", words, "word").collect() == []


def test_sketches_decide_what_is_a_sentence(spark):
    rng = random.Random(4)
    german = "Es zeigte sich dass der Eintrag vor dem Schluss geschrieben wurde. Die Kollegin meinte dass nichts anderes davon abhing. "
    words = [(w, "en") for w in sorted(COMMON)] + [(w, "de") for w in ("es", "sich", "dass", "der", "vor", "dem", "die", "nichts", "davon")] + [(None, "en"), ("the ", None)]
    names = lambda n: " ".join(rng.choice(["ledger", "census", "matrix", "sampler", "shard", "parser"]) for _ in range(n)) + ". "
    only = lambda n: " ".join(rng.choice(sorted(COMMON)) for _ in range(n)) + ". "
    rows = [(i, PROSE * 3, "en", True) for i in range(40)] + [(100 + i, german * 3, "ru", True) for i in range(40)]  # a wrong label doesn't matter
    rows += [(200 + i, names(30), "en", False) for i in range(9)] + [(300 + i, only(30), "en", False) for i in range(9)] + [(400, (names(14) + "the ") * 3 + ".", "en", False)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, prose boolean")
    listed = spark.createDataFrame(words, "word string, lang string")
    found = lambda **k: {r.doc_id for r in natural_prose(df, "doc_id", "text", "lang", listed, "word", word_lang="lang", **k).collect()}
    assert found() == {r[0] for r in rows if r[3]}
    assert found(cells=[UNLISTED, *range(4 * BINS)]) == {r[0] for r in rows}  # without the sketches
    assert share_cuts(np.ones(BINS)) == (0, BINS - 1)
    one = np.zeros(BINS)
    one[[0, 9, 19]] = 1, 50, 1
    assert share_cuts(one) == (5, 14)


def test_quality_places(spark):
    df, words = documents(spark), spark.createDataFrame([(w,) for w in COMMON], "word string")
    rows = quality(df, "doc_id", "text", "lang", words, "word").collect()
    assert len(rows) == 15 and {r.lang for r in rows} == {"en", "ja", "de", "und"}
    en = [r for r in rows if r.lang == "en" and r.symbol_ratio is not None]
    middle = np.median([r.symbol_ratio for r in en])
    assert all((r.symbol_ratio_z >= 0) == (r.symbol_ratio >= middle) for r in en if abs(r.symbol_ratio - middle) > 0.02)
    assert all(getattr(r, f"{s}_tail") in (-1, 0, 1, None) for r in rows for s in STATISTICS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].words == 0 and by_id[7].mean_word_length is None
    many = spark.createDataFrame([(f"w{i}",) for i in range(100_001)], "word string")
    with pytest.raises(ValueError):
        statistics(df, "doc_id", "text", "lang", many, "word")


def test_word_lists_of_any_length(spark):
    """100,600 more words in 301 languages: the same documents are prose, with the same share of common words."""
    df, few = documents(spark), [(w, "en") for w in sorted(COMMON)]
    more = few + [(f"{w}q{i}", f"x{i % 300}") for i in range(100_600 // len(COMMON) + 1) for w in sorted(COMMON)]
    tell = lambda words: sorted((r.doc_id, r.common_words, r.sentence_share) for r in quality(df, "doc_id", "text", "lang", spark.createDataFrame(words, "word string, lang string"), "word", word_lang="lang").collect() if r.words)
    assert len(more) > 100_001 and tell(more) == tell(few)


def test_most_common_counts_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = pa.array(["\n".join(" ".join(rng.choices("abcdefg", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for _ in range(60)])
    sets = [set(rng.sample("abcdefg", k)) for k in (3, 4, 4, 2)]
    lines_of = [t.as_py().split() for t in texts]
    counts = np.array([[sum(w in s for w in words) for s in sets] for words in lines_of])
    for held in (2_000_000, 5, 1):
        monkeypatch.setattr("loomgrid.llm.lines.HELD_COUNTS", held)
        monkeypatch.setattr("loomgrid.llm.lines.HELD_PAIRS", held)
        lines = Lines(texts, WordLists.of_sets(sets))
        language, most = lines.most_common(lines.text, lines.texts)
        assert language.tolist() == counts.argmax(1).tolist() and most.tolist() == counts.max(1).tolist()


@needs_file
def test_queries_agree_with_sql(spark, data):
    import duckdb

    from loomgrid.llm import ORACLES, QUERIES

    db = duckdb.connect()
    for name in ("posterior_predictive_summary", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, data)
        rel = db.sql(sql)
        order = sorted(df.columns)
        assert order == sorted(rel.columns)
        rows = lambda cols, rs: sorted(str([r[cols.index(c)] for c in order]) for r in rs)
        assert rows(df.columns, df.collect()) == rows(list(rel.columns), rel.fetchall())
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, data).count() > 0
    assert QUERIES["p6_ids"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
