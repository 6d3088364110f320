"""Queries on doodles: a vocabulary made from the corpus by a rule, placed at every density.

Words of four letters or more whose digest begins with 0 to 5 are in the vocabulary, beside three phrases; the digest also
gives a word its order and one of 95 icons.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators import doodles as D
from foliant.plans import structure_queries as Q
from foliant.plans.oracle import over_corpus
from foliant.session import settled, table

ICONS = 95
PHRASES = ("iron crown", "magic plan", "third item")


def vocabulary(spark, sf_dir):
    """(ord, word, icon) from the words of the typed blocks."""
    own = Q.typed(spark, sf_dir).select(F.explode(tokens(F.col("content"), 4)).alias("word")).distinct().where(F.md5("word") < "6")
    order = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("int")
    listed = own.unionByName(spark.createDataFrame([(p,) for p in PHRASES], "word string")).select(order.alias("ord"), "word")
    return settled(listed.withColumn("icon", F.concat(F.lit("i"), (F.col("ord") % ICONS).cast("string"))), "vocabulary")


def doodle_candidates(spark, sf_dir):
    """The first place of every word in every block; shards of 1,024 bytes, so that several automata take part where words are many."""
    return D.candidates(Q.typed(spark, sf_dir), vocabulary(spark, sf_dir), 4, shard_bytes=1024).select("doc_id", "seq", "at", "word", "icon")


def doodle_placement(spark, sf_dir):
    """Doodles of every document, at densities 0 to 4 in turn."""
    return D.doodles(Q.typed(spark, sf_dir), vocabulary(spark, sf_dir), F.pmod("doc_id", F.lit(5)).cast("int"))


def doodle_assets(spark, sf_dir):
    """Icons of the vocabulary without a picture, where parts name the pictures that there are."""
    assets = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), F.col("p_size").cast("string")).alias("icon"))
    return D.missing(vocabulary(spark, sf_dir), assets)


QUERIES = {f.__name__: f for f in (doodle_candidates, doodle_placement, doodle_assets)}

_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(word || seq || place, ''), lambda b: ascii(b)::UBIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: {_STEP})), 4294967295::UBIGINT)"""
_VOC = f""", voc0 AS (SELECT word FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM typed) WHERE regexp_full_match(word, '[a-z]{{4,}}') AND md5(word) < '6' UNION ALL SELECT unnest([{','.join(repr(p) for p in PHRASES)}])),
voc AS (SELECT concat('0x', md5(word)[1:6])::INT AS ord, word, 'i' || (concat('0x', md5(word)[1:6])::INT % {ICONS}) AS icon FROM voc0),
txt AS (SELECT doc_id, seq, ' ' || regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ' AS x FROM typed WHERE type IN ('paragraph', 'heading', 'quote')),
fnd AS (SELECT doc_id, seq, strpos(x, ' ' || word || ' ') - 1 AS "at", ord, word, icon FROM txt JOIN voc ON contains(x, ' ' || word || ' '))"""
SQL = {
    "doodle_candidates": over_corpus(_VOC + " SELECT doc_id, seq, \"at\", word, icon FROM fnd"),
    "doodle_placement": over_corpus(
        _VOC
        + f""", pre AS (SELECT * FROM (VALUES {','.join(f'({d}, {m}, {g}, {b})' for d, (m, g, b) in D.PRESETS.items())}) AS v(density, most, gap, per)),
    cnd AS (SELECT doc_id, seq, word, icon, most, gap, per, row_number() OVER (PARTITION BY doc_id ORDER BY seq, "at", ord) AS k FROM fnd JOIN pre ON density = doc_id % 5 WHERE density > 0),
    run AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, NULL::BIGINT AS block, (-gap)::BIGINT AS last, 0 AS n, 0 AS here, []::VARCHAR[] AS used, NULL::VARCHAR AS before, false AS hit, NULL::VARCHAR AS word FROM cnd
      UNION ALL SELECT doc_id, k, seq, last, n + hit::INT, here + hit::INT, CASE WHEN hit THEN list_append(used, icon) ELSE used END, CASE WHEN hit THEN icon ELSE before END, hit, word FROM (
        SELECT *, n < most AND here < per AND seq - last >= gap AND NOT list_contains(used, icon) AND icon IS DISTINCT FROM before AS hit FROM (
          SELECT c.doc_id, c.k, c.seq, c.word, c.icon, c.most, c.gap, c.per, r.n, r.before, CASE WHEN r.block IS DISTINCT FROM c.seq AND r.here > 0 THEN r.block ELSE r.last END AS last,
            CASE WHEN r.block IS DISTINCT FROM c.seq THEN 0 ELSE r.here END AS here, CASE WHEN r.block IS DISTINCT FROM c.seq THEN [] ELSE r.used END AS used FROM run r JOIN cnd c ON c.doc_id = r.doc_id AND c.k = r.k + 1))),
    put AS (SELECT doc_id, block AS seq, here - 1 AS place, word, before AS icon, CASE WHEN n % 2 = 1 THEN 'left' ELSE 'right' END AS side FROM run WHERE hit), dig AS (SELECT *, {_CRC} AS d FROM put)
    SELECT doc_id, seq, place, word, icon, side, (18 + d % 41)::INT AS size, (d >> 8)::BIGINT % 45 - 22 AS turn, (70 + (d >> 16) % 23) / 100 AS opacity FROM dig"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "doodle_assets": over_corpus(_VOC + " SELECT DISTINCT icon FROM voc WHERE icon NOT IN (SELECT 'i' || p_size FROM part)"),
}
