"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

A line's ratio is the number of the site's pages that hold it over the site's pages. Lines
above the ratio on at least min_pages pages are dropped from that site's texts. A line is
compared without the spaces, tabs and carriage returns around it; blank lines always stay.
Lines are counted by a 64-bit hash with map-side sums; a site's totals and its dropped lines
are dealt over SALTS keys, so a site with a third of all pages is no single task. A site
drops at most (lines of a mean page / ratio) different lines, which bounds its array.
The dropped lines are worked out first; while all sites' together number at most
BROADCAST_KEYS they are broadcast and the texts stay where they are, else both meet by
site and salt.

Null texts stay null and count as pages without lines. Null sites are one site of their own.
A line that recurs within a page counts once for it. Rows that repeat an id count as pages
of their own. Texts are used whole, however long. Empty tables give empty ones. All columns
of the input stay as they are, but for the text; with counts, n_lines and n_dropped are added,
with underscores behind the name where the input has such a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused

SALTS = 32
#: Keys of dropped lines that are broadcast (8 MB).
BROADCAST_KEYS = 1_000_000
#: What is trimmed from both ends of a line before it is compared.
AROUND = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(AROUND)))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 5, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(__site, __drop): for each site with boilerplate the keys of its dropped lines."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("__site")
    pages = docs.select(site, F.col(text_col).alias("__text"))
    totals = _salted(pages.groupBy("__site").agg(F.count("*").alias("__pages")))
    keys = F.array_distinct(
        F.transform(F.filter(_lines(F.col("__text")), lambda x: F.trim(x, F.lit(AROUND)) != ""), _key)
    )
    counts = pages.select("__site", F.explode(keys).alias("__key")).groupBy("__site", "__key").agg(F.count("*").alias("__n"))
    often = counts.where(F.col("__n") >= min_pages).withColumn("__salt", F.pmod("__key", F.lit(SALTS)).cast("int"))
    over = often.join(totals, ["__site", "__salt"]).where(F.col("__n") / F.col("__pages") > ratio)
    return over.groupBy("__site").agg(F.collect_list("__key").alias("__drop"))


def drop_boilerplate(
    docs: DataFrame,
    ratio: float = 0.1,
    min_pages: int = 5,
    site_col: str = "source",
    text_col: str = "text",
    counts: bool = False,
) -> DataFrame:
    """docs with the boilerplate lines gone from its text; with counts also n_lines and n_dropped."""
    drop = cut(boilerplate(docs, ratio, min_pages, site_col, text_col))
    columns = docs.columns
    # Maps have no hash; rows that agree in all other columns are few.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name != site_col and not re.search("map<|variant", f.dataType.simpleString())]
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("__site")
    salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int").alias("__salt")
    # The row travels as one struct, so that no column of it meets one of the operator's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), site, salt)
    size = drop.agg(F.sum(F.size("__drop")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_KEYS:
        joined = rows.join(F.broadcast(drop), "__site", "left")
    else:
        joined = rows.join(_salted(drop), ["__site", "__salt"], "left")
    # By attribute, not by name: an output column may bear the name of one of these.
    row, gone = joined["__row"], joined["__drop"]
    text, lines = row.getField(text_col), _lines(row.getField(text_col))
    stay = F.filter(
        lines, lambda x: (F.trim(x, F.lit(AROUND)) == "") | ~F.coalesce(F.array_contains(gone, _key(x)), F.lit(False))
    )
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(stay, "\n")).alias(text_col)
    out = [kept if c == text_col else row.getField(c).alias(c) for c in columns]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        left = F.when(gone.isNull(), n).otherwise(F.coalesce(F.size(stay), F.lit(0)).cast("long"))
        n_lines = F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long")
        n_dropped = F.when(text.isNull(), F.lit(0)).otherwise(n - left).cast("long")
        out += [n_lines.alias(unused(docs, "n_lines")), n_dropped.alias(unused(docs, "n_dropped"))]
    return joined.select(*out)


#: The op5 query in DuckDB, ratio 0.1 on at least 5 pages.
SQL = r"""
WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM p),
t AS (SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT t.source, t.bare FROM t JOIN totals ON t.source IS NOT DISTINCT FROM totals.source
  WHERE t.bare <> '' GROUP BY t.source, t.bare, totals.pages
  HAVING count(DISTINCT t.doc_id) >= 5 AND count(DISTINCT t.doc_id)::DOUBLE / totals.pages > 0.1
),
marked AS (
  SELECT t.*, o.bare IS NOT NULL AS gone FROM t LEFT JOIN often o ON t.source IS NOT DISTINCT FROM o.source AND t.bare = o.bare
),
kept AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN md5(k.kept) END AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
