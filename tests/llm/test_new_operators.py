"""Language identification, whitening and the manifest against plain versions."""

import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pytest

from foliant.llm import language_id, merkle, whitening

R = random.Random(5)
WORDS = {"xx": "ba bo bu bana boru bulat baron bisko".split(), "yy": "ket kit kott kelit kanat kroven kuri kes".split(), "zz": "mla mlo zmia zmorn zlat mozl zumla mizo".split()}


def speech(lang, n):
    return " ".join(R.choice(WORDS[lang]) for _ in range(n))


def crc(k):
    return zlib.crc32(str(k).encode())


@pytest.fixture(scope="module")
def spoken():
    rows = [(k, speech(lang, R.choice([12, 40, 300])), lang) for k, lang in enumerate(R.choice(list(WORDS)) for _ in range(240))]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "12 - 34 !", "yy"), (None, speech("zz", 30), "zz"), (903, speech("yy", 30), None), (904, speech("xx", 40_000), "xx"), (0, rows[0][1], rows[0][2])]
    return rows + odd


def test_language_held_out(spark, spoken):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in spoken], "doc_id long, text string, lang string, best int, slot double")
    got = language_id.identified(docs).collect()
    assert len(got) == len(spoken)
    by = {r["doc_id"]: r for r in got}
    held = [(k, lang) for k, text, lang in spoken if k is not None and lang and text and crc(k) % 3 == 1 and any(c.isalpha() for c in text)]
    assert len(held) > 50 and np.mean([by[k]["lang_pred"] == lang for k, lang in held]) > 0.97
    assert all(by[k]["held_out"] == (crc(k) % 3 == 1) for k, _, _ in spoken if k is not None) and by[None]["held_out"] is False
    assert [by[k]["lang_pred"] for k in (900, 901, 902, None, 903, 904)] == ["und", "und", "und", "zz", "yy", "xx"]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)


def test_language_learns_from_the_other_folds_only(spark):
    rows = [(k, speech("xx", 30), "xx") for k in range(60) if crc(k) % 3 != 1] + [(k, speech("yy", 30), "yy") for k in range(60) if crc(k) % 3 == 1] + [(100, speech("zz", 9), None)]
    pieces = language_id.training_pieces(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang"] for r in pieces.collect()} == {"xx"}


def test_language_blocks_agree(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    rows = [sorted(map(str, language_id.identified(docs, language_id.Settings(langs_per_block=n)).collect())) for n in (1, 2, 64)]
    assert rows[0] == rows[1] == rows[2]


def test_language_against_plain_compression(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    pieces = language_id.training_pieces(docs)
    content = {}
    for r in sorted(pieces.collect()):
        content.setdefault(r["lang"], []).append(language_id.folded(r["piece"]))
    coder = language_id.Coder({k: b"\n".join(v) for k, v in content.items()})
    for r in language_id.predicted(docs.where("doc_id < 240").dropDuplicates(["doc_id"]), pieces).collect():
        sizes = sorted(zip(coder.sizes(spoken[r["doc_id"]][1]), coder.langs, strict=True))
        assert r["lang_pred"] == sizes[0][1] and r["margin"] == 1 - sizes[0][0] / sizes[1][0] and r["rejected"] == (r["margin"] < 0.01)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "ba bo"), (2, None)], "doc_id long, text string")
    assert {r["lang_pred"] for r in language_id.identified(docs).collect()} == {"und"}
    one = spark.createDataFrame([(k, "ba bo", "xx") for k in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["margin"]) for r in language_id.identified(one).collect()} == {("xx", 1.0)}
    assert language_id.identified(one.where("false")).count() == 0


VECTORS = np.random.default_rng(3).normal(size=(300, 7)) @ np.diag([9, 5, 3, 2, 1, 0.5, 0.1])


def whitening_rows():
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(VECTORS)]
    rows += [(900, rows[4][1]), (901, rows[4][1]), (None, rows[5][1]), (4, rows[6][1])]
    return rows, [(910, None), (911, []), (912, [1.0] * 6), (913, [None] + [1.0] * 6), (914, [float("nan")] * 7), (915, [float("inf")] + [0.0] * 6)]


def test_whitening_against_numpy(spark):
    rows, dropped = whitening_rows()
    got = whitening.whitened(spark.createDataFrame([(k, v, 1, "a") for k, v in rows + dropped], "vec_id long, embedding array<float>, x int, component string")).collect()
    assert len(got) == 4 * len(rows)
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want = (x - s / n) @ u / np.sqrt(e)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for (key, _), own, w in zip(rows, x, want, strict=True):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s, strict=True))
        for j in range(4):
            found = [r for r in by[key, j + 1] if r["deviation"] == exact and abs(abs(r["whitened"]) - abs(w[j])) < 1e-9]
            assert found, (key, j)
            r = found[0]
            if abs(w[j]) > 1e-6:
                signs.setdefault(j, set()).add(round(r["whitened"] / w[j]))
            assert r["n"] == n and abs(r["explained"] - e[j] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9
    assert all(len(x) == 1 for x in signs.values())


def test_whitening_edges(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, [])]) == [] and run([(1, None)]) == []
    assert run([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []  # one distinct vector has no variance
    line = run([(k, [k / 4, k / 2, 1.0]) for k in range(10)])  # on a line: one component, as the others have no direction
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    assert {r["component"] for r in run([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0])])} == {1, 2}


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening.deviations(x, 1000, (7, -(1 << 70))) == [sum((1000 * int(a) - b) ** 2 for a, b in zip(row, (7, -(1 << 70)), strict=True)) for row in x]


def plain_manifest(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])

    def climb(level, at):
        sides = []
        while len(level) > 1:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            sides.append((run[: at % 16], run[at % 16 + 1 :]))
            level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], at // 16
        return level[0], sides

    by = {}
    for row in docs:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subroots = [climb([leaf(r) for r in trees[s]], 0)[0] for s in sources]
    out = []
    for i, s in enumerate(sources):
        hashes = [leaf(r) for r in trees[s]]
        root, upper = climb(subroots, i)
        for k, row in enumerate(trees[s]):
            sides = climb(hashes, k)[1] + upper
            hit = row[0] is not None and crc(row[0]) % 5 == 0 and row[4] is not None
            acc = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))) if hit else hashes[k]
            for before, after in sides:
                acc = h(*before, acc, *after)
            out.append((row[0], hashes[k], subroots[i], root, h(*[x for before, after in sides for x in before + after]), acc, acc == root))
    return sorted(map(str, out))


def manifest_rows():
    rows = [(k, f"s{k % 3}", "en", 3, f"Text {k} É") for k in range(0, 600, 2)] + [(k, "a" * 30, None, k, "x") for k in (5, -7, 3)]
    rows += [(2**62 + k, "s1", "en", 1, "Far") for k in range(40)] + [(7, None, None, None, None), (None, None, "de", 2, "A"), (8, "", "", 0, ""), (9, "é", "q", 1, "Z" * 5000)]
    rows += [(11, "dup", "en", 4, "Same Text")] * 40 + [(11, "dup", "en", 4, f"Other {k}") for k in range(30)] + [(1, "lone", "en", 1, "One")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string")


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_manifest_against_plain(spark):
    rows = manifest_rows()
    assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_manifest_small_bins(spark, monkeypatch):
    """Many rounds of histograms, and copies dealt out in several blocks."""
    monkeypatch.setattr(merkle, "BIN", 4)
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rows = manifest_rows()
    assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(table(spark, []).where("false")).collect() == []
    for rows in ([(1, "s", "en", 1, "Ab")], [(k, f"s{k:03}", "en", 1, "Ab") for k in range(40)], [(k, "s", "en", 1, "Ab") for k in range(17)]):
        assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_manifest_sql(spark):
    rows = [r for r in manifest_rows() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    names = json.loads(json.dumps(merkle.OUT))
    got = con.execute(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    assert sorted(map(str, got)) == plain_manifest(rows)
