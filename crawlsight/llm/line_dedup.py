"""Line dedup by overlapping windows of three consecutive lines, in DataFrame functions only.

Every window is hashed (128 bits), blank ones too. A window found at several places stays at the first one, by (doc_id,
text key, position): all three lines of that place are kept. Its later places are covered. A document loses the lines
that its covered windows hold, less those of the first places kept in it; the lines left are put together from the gaps
between the positions lost. So each repeated window is still there as it was, and no line's content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import written

WINDOW = 3
LAST_ID = 9223372036854775807


def place_columns(docs: DataFrame, text: str = "text") -> list[Column]:
    """did (doc_id, a null after all others) and tk (from the text's MD5): the order of documents, and their identity."""
    key = F.conv(F.substring(F.md5(F.col(text)), 1, 15), 16, 10).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.coalesce(key, F.lit(-1)).alias("tk")]


def windows(docs: DataFrame) -> DataFrame:
    """(did, tk, pos, h1, h2): a row for each window of three lines."""
    lines = docs.select(*place_columns(docs), F.split("text", "\n").alias("lines")).where(F.size("lines") >= WINDOW)
    hashed = F.expr(
        """inline(transform(sequence(0, size(lines) - 3), i -> struct(i AS pos,
             xxhash64(lines[i], lines[i + 1], lines[i + 2]) AS h1, xxhash64(lines[i + 2], lines[i + 1], lines[i], 1) AS h2)))"""
    )
    return lines.select("did", "tk", hashed)


#: Positions of the three lines of windows.
LINES = "flatten(transform({starts}, p -> array(p, p + 1, p + 2)))"


def lost(found: DataFrame) -> DataFrame:
    """(did, tk, gone): sorted positions of the lines that a document loses; documents without any are left out."""
    first = F.min(F.struct("did", "tk", "pos")).alias("first")
    repeated = written(found.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "line-windows")
    met = found.join(repeated, ["h1", "h2"]).select("did", "tk", "pos", (F.struct("did", "tk", "pos") == F.col("first")).alias("kept"))
    places = lambda kept: F.collect_set(F.when(F.col("kept") == kept, F.col("pos")))
    starts = met.groupBy("did", "tk").agg(places(False).alias("covered"), places(True).alias("stays"))
    gone = F.expr(f"array_sort(array_except({LINES.format(starts='covered')}, {LINES.format(starts='stays')}))")
    return starts.select("did", "tk", gone.alias("gone")).where(F.size("gone") > 0)


#: The lines before, between and after the positions lost.
KEPT = """flatten(transform(sequence(0, size(gone)), j -> slice(lines,
    CASE WHEN j = 0 THEN 1 ELSE gone[j - 1] + 2 END,
    CASE WHEN j = size(gone) THEN size(lines) ELSE gone[j] END - CASE WHEN j = 0 THEN 0 ELSE gone[j - 1] + 1 END)))"""


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with text less its repeated lines, and n_lines and n_removed (long).

    A null text stays null (0 lines); a text of fewer than three lines stays as it is; a text of which all lines go is
    empty. Of a window that follows on itself (four equal lines, or more) the first three lines stay. Rows with the same doc_id and text count as one place and get the same result; a null doc_id comes after all
    others. Columns of docs named n_lines or n_removed are replaced; others stay. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = lost(windows(docs))
    # The rest is packed, so that no other column of docs can clash with ours.
    rows = docs.select(*place_columns(docs), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = rows.join(found, ["did", "tk"], "left").withColumn("lines", F.split("row.text", "\n"))
    unchanged = F.col("gone").isNull()
    kept = F.when(unchanged, F.col("row.text")).otherwise(F.array_join(F.expr(KEPT), "\n"))
    total = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(unchanged, 0).otherwise(F.size("gone"))
    out = [kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*out, total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


SQL = """
WITH docs AS (
  SELECT DISTINCT doc_id, text, coalesce(doc_id, 9223372036854775807) AS did,
         coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS tk
  FROM documents),
lines AS (
  SELECT did, tk, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM docs WHERE text IS NOT NULL),
windows AS (
  SELECT a.did, a.tk, a.pos, a.line AS l1, b.line AS l2, c.line AS l3
  FROM lines a JOIN lines b ON b.did = a.did AND b.tk = a.tk AND b.pos = a.pos + 1
               JOIN lines c ON c.did = a.did AND c.tk = a.tk AND c.pos = a.pos + 2),
ranked AS (
  SELECT did, tk, pos, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY did, tk, pos) AS k,
         count(*) OVER (PARTITION BY l1, l2, l3) AS n FROM windows),
placed AS (
  SELECT did, tk, pos + step AS pos, k FROM ranked, (VALUES (0), (1), (2)) AS s(step) WHERE n > 1),
covered AS (
  SELECT did, tk, pos FROM placed WHERE k > 1 EXCEPT SELECT did, tk, pos FROM placed WHERE k = 1),
kept AS (
  SELECT l.did, l.tk, string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text,
         count(*) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON c.did = l.did AND c.tk = l.tk AND c.pos = l.pos
  GROUP BY l.did, l.tk)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k
  ON k.did = coalesce(d.doc_id, 9223372036854775807) AND k.tk = coalesce(('0x' || substr(md5(d.text), 1, 15))::BIGINT, -1)
"""
