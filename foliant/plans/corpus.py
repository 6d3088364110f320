"""A structured corpus synthesised from the relational tables: one Markdown document per supplier.

The raw documents table has no Markdown structure, so queries on structure run over this
corpus. It is one projection over supplier and nation, the same text in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import table

NAMES = ("Mira Vale", "Old Harbor", "Iron Crown", "Sable Reach", "The Keep")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) for every supplier."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(k, F.lit(5)).cast("int") + 1)
    other = F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(k + 1, F.lit(5)).cast("int") + 1)
    n = k.cast("string")
    odd = F.pmod(k, F.lit(2)) == 1
    third = F.pmod(k, F.lit(3))
    lines = [
        F.concat(F.lit("# "), F.col("s_name"), F.lit(" Notes")),
        F.lit(""),
        F.concat(F.lit("The supplier must keep **key** records of "), F.col("n_name"), F.lit(".")),
        F.lit("A second line follows with main data and analysis of the results."),
        F.lit(""),
        F.when(third == 0, "## Chapter One").when(third == 1, "## Data Review").otherwise("## Quest and World"),
        F.concat(F.lit("Opening words about "), name, F.lit(" and the magic plan for region "), n, F.lit(".")),
        F.lit(""),
        F.concat(F.lit("### "), name),
        F.concat(F.lit("A scout of "), F.lower("n_name"), F.lit(" who never sleeps.")),
        F.lit(""),
        F.concat(F.lit("- first item: "), n),
        F.concat(F.lit("- second item: "), F.pmod(k, F.lit(7)).cast("string")),
        F.lit("* third item: 5"),
        F.lit(""),
        F.lit("| name | value |"),
        F.lit("|---|---|"),
        F.concat(F.lit("| balance | "), n, F.lit(" |")),
        F.lit("| nation | 7 |"),
        F.lit("| region | 3% |"),
        F.when(odd, "| extra | 2,5 |").otherwise("| other | none |"),
        F.lit(""),
        F.lit("> To be is to do - Someone"),
        F.lit("> A second quote about research and evidence"),
        F.lit(""),
        F.lit("Warning: the stock is low and critical"),
        F.lit("**Important**: count every part"),
        F.lit("Note: a plain note"),
        F.lit(""),
        F.lit("1999: founded in the north"),
        F.concat(F.lit("Year 204 - moved to the south with "), n, F.lit(" crates")),
        F.lit(""),
        F.concat(F.lit("Allied with "), other),
        F.lit("Definition: a supplier supplies what others need"),
        F.lit(""),
        F.lit("---"),
        F.lit(""),
        F.lit("```python"),
        F.lit("x = 1"),
        F.lit("- not a list"),
        F.lit("```"),
        F.lit(""),
        F.lit("![map of it](img/map.png)"),
        F.lit("*A map of the place*"),
        F.lit(""),
        F.lit("## Tasks"),
        F.lit("- [ ] open task"),
        F.lit("  - [x] sub task"),
        F.when(odd, "    - [ ] deep task").otherwise("  - [ ] other sub task"),
        F.lit("- [x] done task"),
        F.lit(""),
        F.concat(F.lit("### "), other),
        F.concat(F.lit("About 40% growth in the north. The rival of "), name, F.lit(" sold 12 crates of rare goods.")),
        F.lit(""),
        F.lit("A last paragraph line"),
        F.lit("1999: absorbed here"),
        F.lit("and the end with main results"),
    ]
    return s.select(F.col("s_suppkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


def _name(shift: int) -> str:
    k = f"((s_suppkey + {shift}) % 5 + 1)::INT"
    return "(['" + "','".join(NAMES) + f"'])[{k}]"


CORPUS_SQL = f"""
corpus AS (SELECT s_suppkey AS doc_id, concat_ws(chr(10),
 '# ' || s_name || ' Notes', '',
 'The supplier must keep **key** records of ' || n_name || '.',
 'A second line follows with main data and analysis of the results.', '',
 CASE s_suppkey % 3 WHEN 0 THEN '## Chapter One' WHEN 1 THEN '## Data Review' ELSE '## Quest and World' END,
 'Opening words about ' || {_name(0)} || ' and the magic plan for region ' || s_suppkey || '.', '',
 '### ' || {_name(0)}, 'A scout of ' || lower(n_name) || ' who never sleeps.', '',
 '- first item: ' || s_suppkey, '- second item: ' || (s_suppkey % 7), '* third item: 5', '',
 '| name | value |', '|---|---|', '| balance | ' || s_suppkey || ' |', '| nation | 7 |', '| region | 3% |',
 CASE WHEN s_suppkey % 2 = 1 THEN '| extra | 2,5 |' ELSE '| other | none |' END, '',
 '> To be is to do - Someone', '> A second quote about research and evidence', '',
 'Warning: the stock is low and critical', '**Important**: count every part', 'Note: a plain note', '',
 '1999: founded in the north', 'Year 204 - moved to the south with ' || s_suppkey || ' crates', '',
 'Allied with ' || {_name(1)}, 'Definition: a supplier supplies what others need', '', '---', '',
 '```python', 'x = 1', '- not a list', '```', '', '![map of it](img/map.png)', '*A map of the place*', '',
 '## Tasks', '- [ ] open task', '  - [x] sub task', CASE WHEN s_suppkey % 2 = 1 THEN '    - [ ] deep task' ELSE '  - [ ] other sub task' END, '- [x] done task', '',
 '### ' || {_name(1)}, 'About 40% growth in the north. The rival of ' || {_name(0)} || ' sold 12 crates of rare goods.', '',
 'A last paragraph line', '1999: absorbed here', 'and the end with main results') AS text
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""
