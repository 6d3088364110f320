"""Queries on sources, sinks and decoration; binary and tree-shaped results have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import inline_html
from foliant.operators import decoration as K
from foliant.plans import score_queries as S
from foliant.plans import structure_queries as Q
from foliant.plans.score_queries import _ESC, scored_sql
from foliant.session import shared_path, table
from foliant.sinks import writers
from foliant.sources import files, themes


def html_markdown(spark, sf_dir):
    return files.html_documents(table(spark, sf_dir, "pages"))


def format_dispatch(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*map(F.lit, (".MD", ".txt", ".Html", ".docx", ".pdf", ".bin"))), F.pmod("p_partkey", F.lit(6)).cast("int") + 1)).alias("path"))
    return own.select("p_partkey", files.format_of(F.col("path")).alias("format"))


def docx_roundtrip(spark, sf_dir):
    made = writers.to_docx(Q.typed(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("path"), F.lit("docx").alias("format"), F.col("docx").alias("content"), F.lit(None).cast("string").alias("error"))
    return files.to_text(made).select(F.col("path").cast("long").alias("doc_id"), "text")


def json_records(spark, sf_dir):
    return writers.json_records(S.scored(spark, sf_dir))


def inline_html_blocks(spark, sf_dir):
    return Q.typed(spark, sf_dir).select("doc_id", "seq", inline_html(F.col("content")).alias("html"))


def decoration_mood(spark, sf_dir):
    return K.mood(Q.typed(spark, sf_dir))


def decoration_fallback(spark, sf_dir):
    return K.fallback(Q.doc_title(spark, sf_dir).withColumnRenamed("title", "name"))


def conversation_lines(spark, sf_dir):
    """Turns of a conversation as ordered blocks: speaker and text."""
    own = table(spark, sf_dir, "conversations")
    return own.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "quote").otherwise("paragraph").alias("type"), F.concat_ws(": ", "role", "text").alias("content"))


def theme_versions(spark, sf_dir):
    """Themes of all nations, saved again for region 1 under another name, deleted for region 2, and what each version shows."""
    nation = table(spark, sf_dir, "nation")
    theme = lambda name: nation.select("n_regionkey", F.lower("n_name").alias("id"), name.alias("name"), F.lit("").alias("description"), F.lit("").alias("icon"), F.create_map(F.lit("--accent"), name).alias("properties"), F.create_map(F.lit("h1"), F.struct(name.alias("fg"), F.lit(None).cast("string").alias("bg"))).alias("elements"))
    own = themes.store(spark, shared_path(spark, "themes"))
    themes.save(own, theme(F.col("n_name")).drop("n_regionkey"))
    themes.save(own, theme(F.concat(F.lit("New "), F.col("n_name"))).where("n_regionkey = 1").drop("n_regionkey"))
    own.delete(nation.where("n_regionkey = 2").select(F.lower("n_name").alias("id")))
    shown = lambda v: own.load(v).select(F.lit(v).alias("version"), "id", "name", F.element_at("properties", "--accent").alias("accent"))
    return shown(1).unionByName(shown(2)).unionByName(shown(3))


QUERIES = {f.__name__: f for f in (html_markdown, format_dispatch, docx_roundtrip, json_records, inline_html_blocks, decoration_mood, decoration_fallback, conversation_lines, theme_versions)}

_MOOD = "CASE " + " ".join(f"WHEN w IN ({','.join(repr(w) for w in ws.split())}) THEN {k}" for k, (_, ws) in enumerate(K.MOODS)) + " END"
SQL = {
    "format_dispatch": "SELECT p_partkey, (['text','text','html','docx','pdf','other'])[(p_partkey % 6 + 1)::INT] AS format FROM part",
    "inline_html_blocks": scored_sql(rf" SELECT doc_id, seq, regexp_replace(regexp_replace(regexp_replace({_ESC}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'gs'), '\*(.+?)\*', '<em>\1</em>', 'gs'), '`(.+?)`', '<code>\1</code>', 'gs') AS html FROM typed"),
    "decoration_mood": scored_sql(
        f""" , ww AS (SELECT doc_id, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM typed WHERE seq < 40), mm AS (SELECT doc_id, {_MOOD} AS k FROM ww), cc AS (SELECT doc_id, k, count(*) AS n FROM mm WHERE k IS NOT NULL GROUP BY doc_id, k),
        rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS p FROM cc) SELECT doc_id, ([{','.join(repr(n) for n, _ in K.MOODS)}])[(k + 1)::INT] AS mood FROM rr WHERE p = 1"""
    ),
    "theme_versions": """WITH v AS (SELECT unnest([1, 2, 3]) AS version), n AS (SELECT version, n_regionkey, lower(n_name) AS id, CASE WHEN version >= 2 AND n_regionkey = 1 THEN 'New ' ELSE '' END || n_name AS name FROM nation, v)
    SELECT version, id, name, name AS accent FROM n WHERE version < 3 OR n_regionkey <> 2""",
    "conversation_lines": "SELECT conv_id AS doc_id, turn AS seq, CASE WHEN role = 'user' THEN 'quote' ELSE 'paragraph' END AS type, concat_ws(': ', role, text) AS content FROM conversations",
}
