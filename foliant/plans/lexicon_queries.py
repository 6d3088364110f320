"""Queries against a lexicon of full size, made from the corpus by a rule: 674 entries with 5,006 signals.

Words of five letters or more are ordered by their digests; the first 5,006 are dealt to 674
entries in turn. One entry in eight is a parent of the others. Entry 7 counts whole words only, and 34 further
words are the atmosphere of entry 11.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators import signals as S
from foliant.session import settled, table

ENTRIES, SIGNALS, ATMOSPHERE = 674, 5006, 34
WHOLE, ALSO = "g0/k7", "g1/k11"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _vocabulary(spark, sf_dir):
    """(at, signal): the first words by digest."""
    words = texts(spark, sf_dir).select(F.explode(tokens(F.coalesce("text", F.lit("")), 5)).alias("signal")).distinct()
    first = words.orderBy(F.md5("signal")).limit(SIGNALS + ATMOSPHERE)
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.md5("signal").alias("d"), "signal"))), lambda x: x["signal"]).alias("all"))
    return listed.select(F.posexplode("all").alias("at", "signal"))


def lexicon(spark, sf_dir):
    """(ord, key, signals) and the atmosphere (signal)."""
    words = settled(_vocabulary(spark, sf_dir), "vocabulary")
    k = F.col("at") % ENTRIES
    group = F.concat(F.lit("g"), F.floor(k / 8).cast("string"))
    key = F.when(k % 8 == 0, group).otherwise(F.concat(group, F.lit("/k"), k.cast("string")))
    entries = words.where(F.col("at") < SIGNALS).groupBy(k.cast("int").alias("ord"), key.alias("key")).agg(F.collect_list("signal").alias("signals"))
    return entries, words.where(F.col("at") >= SIGNALS).select("signal")


def _signals(spark, sf_dir):
    entries, atmosphere = lexicon(spark, sf_dir)
    return settled(S.signal_table(entries, (WHOLE,), atmosphere, ALSO), "signals")


def signal_hits(spark, sf_dir):
    return S.hits(texts(spark, sf_dir), _signals(spark, sf_dir)).select("doc_id", "key", "weight", "hits")


def sparse_scores(spark, sf_dir):
    return S.scores(texts(spark, sf_dir), _signals(spark, sf_dir)).select("doc_id", "key", "score")


def full_genres(spark, sf_dir):
    own = texts(spark, sf_dir)
    return S.genres(own, settled(S.scores(own, _signals(spark, sf_dir)), "scores"))


def _part(spark, sf_dir, low, high):
    return _signals(spark, sf_dir).where(f"ord >= {low} AND ord < {high} AND weight = 1")


def food_texts(spark, sf_dir):
    """Entries 20 to 25 serve as cooking words, 60 to 79 as moods."""
    return S.is_food(texts(spark, sf_dir), _part(spark, sf_dir, 20, 26), _part(spark, sf_dir, 60, 80))


def food_mood_blends(spark, sf_dir):
    own = texts(spark, sf_dir)
    return S.food_moods(own, S.scores(own, _part(spark, sf_dir, 60, 80), cap=False))


QUERIES = {f.__name__: f for f in (signal_hits, sparse_scores, full_genres, food_texts, food_mood_blends)}

WS = r"'[ \t\n\x0B\f\r]+'"
_LEXICON = rf"""t AS (SELECT doc_id, lower(coalesce(text, '')) AS x, len(list_filter(regexp_split_to_array(coalesce(text, ''), {WS}), lambda w: w <> '')) AS n FROM documents),
tk AS (SELECT doc_id, regexp_split_to_array(x, '[^\p{{L}}\p{{N}}_]+') AS ws FROM t),
voc AS (SELECT w, row_number() OVER (ORDER BY md5(w)) - 1 AS i FROM (SELECT DISTINCT unnest(ws) AS w FROM tk) WHERE regexp_full_match(w, '[a-z]{{5,}}')),
lex AS (SELECT i % 674 AS ord, w, 1.0::DOUBLE AS weight FROM voc WHERE i < 5006 UNION ALL SELECT 11, w, 0.8 FROM voc WHERE i >= 5006 AND i < 5040),
hit AS (SELECT doc_id, ord, weight, sum((length(x) - length(replace(x, w, ''))) // length(w)) AS hits FROM t JOIN lex ON contains(x, w) WHERE ord <> 7 GROUP BY ALL
 UNION ALL SELECT doc_id, 7, 1, count(*) FROM (SELECT doc_id, unnest(ws) AS w FROM tk) JOIN lex USING (w) WHERE ord = 7 GROUP BY ALL),
named AS (SELECT *, 'g' || (ord // 8) AS parent, CASE WHEN ord % 8 = 0 THEN 'g' || (ord // 8) ELSE 'g' || (ord // 8) || '/k' || ord END AS key FROM hit),
sc AS (SELECT doc_id, ord, parent, key, round(sum(hits * weight) / greatest(least(greatest(n, 1) / 300, 20), 0.3), 2) AS score FROM named JOIN t USING (doc_id) GROUP BY doc_id, ord, parent, key, n),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM sc),
best AS (SELECT * FROM rk WHERE k = 1),
sub AS (SELECT r.doc_id, arg_min(r.key, r.k) AS key, min_by(r.score, r.k) AS score FROM rk r JOIN best b ON b.doc_id = r.doc_id AND b.key = b.parent AND r.parent = b.parent AND r.k > 1 AND r.score >= b.score * 0.85 GROUP BY r.doc_id),
run AS (SELECT r.doc_id, arg_min(r.key, r.k) AS key, min_by(r.score, r.k) AS score FROM rk r JOIN best b ON b.doc_id = r.doc_id AND r.parent <> b.parent GROUP BY r.doc_id),
pick AS (SELECT t.doc_id, coalesce(sub.score, best.score, 0) AS score, best.score >= 1.2 AS enough, coalesce(sub.key, best.key) AS key, run.key AS rkey, run.score AS rscore FROM t LEFT JOIN best USING (doc_id) LEFT JOIN sub USING (doc_id) LEFT JOIN run USING (doc_id))"""

SQL = {
    "signal_hits": f"WITH {_LEXICON} SELECT doc_id, key, weight, hits::BIGINT AS hits FROM named",
    "sparse_scores": f"WITH {_LEXICON} SELECT doc_id, key, score FROM sc",
    "full_genres": f"WITH {_LEXICON} SELECT doc_id, CASE WHEN enough THEN key ELSE 'neutral' END AS genre, score, CASE WHEN enough AND rscore >= score * 0.55 THEN rkey END AS runner, CASE WHEN enough AND rscore >= score * 0.55 THEN rscore END AS runner_score FROM pick",
    "food_texts": f"""WITH {_LEXICON}, c AS (SELECT doc_id, sum(hits) AS cooking FROM hit WHERE ord BETWEEN 20 AND 25 GROUP BY doc_id),
    m0 AS (SELECT doc_id, ord, count(*) AS n FROM t JOIN lex ON contains(x, w) WHERE ord BETWEEN 60 AND 79 GROUP BY ALL), m AS (SELECT doc_id, max(n) AS best, sum(n) AS total FROM m0 GROUP BY doc_id),
    f AS (SELECT doc_id, n, coalesce(cooking, 0) AS c, coalesce(best, 0) AS b, coalesce(total, 0) AS a FROM t LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id))
    SELECT doc_id, c + a >= 2 AND (c >= 2 OR b >= 2 OR (b >= 1 AND c >= 1)) AND (c + a) / greatest(n / 300, 0.3) >= 2.2 AS food FROM f""",
    "food_mood_blends": f"""WITH {_LEXICON}, s AS (SELECT doc_id, ord, key, round(sum(hits) / greatest(greatest(n, 1) / 300, 0.3), 2) AS score FROM named JOIN t USING (doc_id) WHERE ord BETWEEN 60 AND 79 GROUP BY doc_id, ord, key, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM s), a AS (SELECT t.doc_id, b.key AS k1, coalesce(b.score, 0) AS s1, u.key AS k2, u.score AS s2, coalesce(b.score >= 0.8, false) AS e FROM t LEFT JOIN r b ON b.doc_id = t.doc_id AND b.k = 1 LEFT JOIN r u ON u.doc_id = t.doc_id AND u.k = 2)
    SELECT doc_id, CASE WHEN e THEN k1 ELSE 'home_cooking' END AS mood, s1 AS score, CASE WHEN e AND s2 >= s1 * 0.6 AND s2 >= 0.5 THEN k2 END AS runner, CASE WHEN e AND s2 >= s1 * 0.6 AND s2 >= 0.5 THEN s2 END AS runner_score FROM a""",
}
