"""Signals of lexicons on texts with counts worked out by hand."""

import pytest

from foliant.operators import signals as S

LEXICON = [
    (0, "historical/classic_literature", ["thou", "'tis", "art thou"]),
    (1, "horror_gothic", ["dark", "aa", ""]),
    (2, "sea", ["dark sea", "été"]),
    (3, "sea/storm", ["dark sea", "wave"]),
]
TEXTS = [
    (1, "Though a thousand, although: thou art. Art thou? thou_x THOU"),  # thou 3 times, art thou once
    (2, "'tis x'tis dark aaaaa too quiet Too Quiet."),  # 'tis only behind a word: x'tis; dark 1, aa 2, atmosphere 2
    (3, "dark sea dark sea été"),
    (4, None),
    (5, ""),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "ord int, key string, signals array<string>")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 12])
def test_hits(spark, lexicon, texts, shard_bytes):
    atmosphere = spark.createDataFrame([("too quiet",), ("sea",)], "signal string")
    got = {(r["doc_id"], r["ord"], r["weight"]): r["hits"] for r in S.hits(texts, S.signal_table(lexicon, atmosphere=atmosphere), shard_bytes).collect()}
    assert got == {(1, 0, 1.0): 4, (2, 0, 1.0): 1, (2, 1, 1.0): 3, (2, 1, 0.8): 2, (3, 1, 1.0): 2, (3, 1, 0.8): 2, (3, 2, 1.0): 3, (3, 3, 1.0): 2}


def test_genres(lexicon, texts):
    scored = S.scores(texts, S.signal_table(lexicon))
    assert {(r["doc_id"], r["ord"]): r["score"] for r in scored.collect()} == {(1, 0): 13.33, (2, 0): 3.33, (2, 1): 10.0, (3, 1): 6.67, (3, 2): 10.0, (3, 3): 6.67}
    got = {r["doc_id"]: tuple(r)[1:] for r in S.genres(texts, scored).collect()}
    assert got[3] == ("sea", 10.0, "horror_gothic", 6.67) and got[4] == got[5] == ("neutral", 0.0, None, None)
    assert got[1] == ("historical/classic_literature", 13.33, None, None)


def test_no_signals(lexicon, texts):
    assert S.hits(texts, S.signal_table(lexicon.where("false"))).collect() == []
    assert {r["genre"] for r in S.genres(texts, S.scores(texts, S.signal_table(lexicon.where("false")))).collect()} == {"neutral"}


def test_food(spark):
    cooking = spark.createDataFrame([(0, "c", ["boil", "bake"])], "ord int, key string, signals array<string>")
    moods = spark.createDataFrame([(0, "cosy", ["soup", "tea"]), (1, "fresh", ["salad"])], "ord int, key string, signals array<string>")
    rows = [(1, "boil and bake"), (2, "tea"), (3, "soup and tea"), (4, "tea and salad"), (5, "tea tea boil"), (6, "boil bake " + "x " * 3000), (7, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["food"] for r in S.is_food(texts, S.signal_table(cooking), S.signal_table(moods)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}
    found = {r["doc_id"]: tuple(r)[1:] for r in S.food_moods(texts, S.scores(texts, S.signal_table(moods), cap=False)).collect()}
    assert found[3] == ("cosy", 6.67, None, None) and found[4] == ("cosy", 3.33, "fresh", 3.33) and found[7] == ("home_cooking", 0.0, None, None)
