import time

import pytest

from foliant.operators import lexicon as X
from foliant.operators import signals as S
from foliant.plans.structure_queries import typed
from foliant.sinks import writers
from foliant.sources import files, lexicon, store, themes
from foliant.sources.lexicon import seed_lexicon
from foliant.streaming.folder import parse_stream


def test_html_markdown():
    source = "<body><nav>n</nav><h2>T</h2>loose<div><p>A <b>b</b></p><span>s</span></div><ul><li>x</li></ul></body>"
    assert files.html_markdown(source) == "## T\n\nA b\n\n- x"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "b.HTML").write_text("<p>hi</p>")
    (tmp_path / "c.bin").write_bytes(b"x\xff")
    (tmp_path / "d.docx").write_bytes(writers.docx_bytes([("heading", 2, "Head"), ("list", 0, "a\nb"), ("table", 0, "| k | v |\n| 1 | 2 |")]))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["text"], r["error"] is None) for r in files.to_text(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.md"] == ("text", "# A\n\ntext", True)
    assert got["b.HTML"] == ("html", "hi", True)
    assert got["c.bin"] == ("other", "x�", True)
    assert got["d.docx"] == ("docx", "## Head\n\n- a\n- b\n\n| k | v |\n|---|---|\n| 1 | 2 |", True)
    assert got["e.docx"][1:] == (None, False)


def theme(i, name):
    return (i, name, "", "", {"p": name}, {"h": (name, None)})


def names(df):
    return sorted((r["id"], r["name"], r["properties"]["p"]) for r in df.collect())


def test_theme_store(spark, tmp_path):
    own = themes.store(spark, str(tmp_path / "t"))
    make = lambda *rows: spark.createDataFrame([theme(*r) for r in rows], themes.SCHEMA)
    assert own.load().collect() == [] and own.versions() == []
    assert themes.save(own, make(("a b", "A"), ("c", "C"), ("c", "D"))) == 1
    assert names(own.load()) == [("a_b", "A", "A"), ("c", "D", "D")]
    assert themes.save(own, make(("c", "B"), ("e", "E"))) == 2
    assert own.delete(spark.createDataFrame([("a_b",), ("none",)], "id string")) == 3
    assert names(own.load()) == [("c", "B", "B"), ("e", "E", "E")]
    assert names(own.load(1)) == [("a_b", "A", "A"), ("c", "D", "D")] and own.versions() == [1, 2, 3]
    with pytest.raises(store.Conflict):
        own.save(make(("x", "X")), after=2)
    assert names(own.load()) == [("c", "B", "B"), ("e", "E", "E")]
    assert themes.save(own, make(("a_b", "Z"))) == 4 and ("a_b", "Z", "Z") in names(own.load())


def test_unreadable_files_are_told(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"id": "a", "name": "A", "properties": {"p": "1"}}')
    (tmp_path / "bad.json").write_text('{"id": "b", ')
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in themes.load(spark, str(tmp_path)).collect()}
    assert rows["good.json"]["id"] == "a" and rows["good.json"]["unreadable"] is None
    assert rows["bad.json"]["id"] is None and rows["bad.json"]["unreadable"] == '{"id": "b", '
    assert {r["unreadable"] is None for r in lexicon.read_lexicon(spark, str(tmp_path)).collect()} == {True, False}


def test_lexicon_ways_agree(spark):
    docs = spark.createDataFrame([(1, "There the theatre than sea sea"), (2, None), (3, "aaaa")], "doc_id long, text string")
    own = {(r["doc_id"], r["key"]): r["hits"] for r in X.phrase_hits(docs, seed_lexicon(spark)).where("hits > 0").collect()}
    other = {(r["doc_id"], r["key"]): r["hits"] for r in S.hits(docs, S.signal_table(seed_lexicon(spark)), shard_bytes=20).collect()}
    assert own == other and own[1, "voyage"] == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "# A\n\ntext")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = parse_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    time.sleep(0.1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_records_keep_all_blocks(spark):
    own = typed(spark, "/root/testdata/sf0.001")
    assert writers.to_docx(own).count() == own.select("doc_id").distinct().count()


def test_large_file_is_read(spark, tmp_path):
    (tmp_path / "long.txt").write_text("word " * (7 << 20))  # 35 MB
    from foliant.sources.files import documents

    assert [r["n"] for r in documents(spark, str(tmp_path)).selectExpr("length(text) AS n").collect()] == [35 << 20]
