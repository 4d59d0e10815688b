"""Removal of repeated lines by overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines are hashed (96 bits: XXH64 and Murmur3). A window whose hash stands
more than once in the whole table is repeated; its first occurrence, by doc_id and position, stays,
and the lines that any later occurrence covers are removed. Covered positions of overlapping windows
merge as a set. Only hashes and positions are shuffled to find them; counts are combined before the
shuffle, so a passage that a third of all rows holds is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.runtime import materialise

WINDOW = 3
#: Documents with lines to remove, and such lines, up to which they are broadcast to the texts (some
#: 70 MB); beyond, both are shuffled by document.
BROADCAST_ROWS, BROADCAST_LINES = 500_000, 8_000_000


def _lines(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(d, t, lines): the id, a hash of the text (rows equal in both are one document), its lines."""
    return docs.where(F.col(text).isNotNull()).select(F.col(id).alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def covered(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(d, t, gone): for each document with such lines, the positions (from 0) to remove."""
    lined = _lines(docs, text, id).where(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    at = F.transform(starts, lambda i: F.concat_ws("\n", F.slice("lines", i + 1, window)))
    rows = lined.select("d", "t", F.posexplode(at).alias("p", "w")).where(F.trim(F.translate("w", "\n\t\r", "   ")) != "")
    seen = materialise(rows.select(F.xxhash64("w").alias("h"), F.hash("w").alias("g"), "d", "t", "p"), "windows")
    # documents without an id come after all others
    place = F.struct(F.col("d").isNull().alias("last"), "d", "t", "p")
    first = seen.groupBy("h", "g").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("h", "g", F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.p").alias("fp")), "repeated")
    later = seen.join(first, ["h", "g"]).where(~(_same("d", "fd") & (F.col("t") == F.col("ft")) & (F.col("p") == F.col("fp"))))
    gone = F.array_distinct(F.flatten(F.collect_set(F.sequence("p", F.col("p") + window - 1))))
    return later.select("d", "t", "p").groupBy("d", "t").agg(gone.alias("gone"))


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id", counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and, if ``counts``, with ``n_lines`` and
    ``n_removed`` in the place of columns of these names; all others stay, whatever their names.

    Lines are what stands between line feeds, taken as they are. Windows of blank lines only are not
    looked at; a text of fewer than three lines has none and stays. A text whose lines all go becomes
    empty; its row stays. A null text stays null, with zero lines. Rows equal in id and text count as
    one document and keep the same lines; rows with a null id come last in order. An empty table gives
    no rows.
    """
    gone = materialise(covered(docs, window, text, id), "covered")
    n = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    if n.rows <= BROADCAST_ROWS and n.lines <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id).alias("d"), F.xxhash64(text).alias("t"))
    found = keyed.alias("k").join(gone.alias("g"), _same("k.d", "g.d") & (F.col("k.t") == F.col("g.t")), "left").select("row", "gone")
    lined = found.select("row", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.split(F.col("row").getField(text), "\n", -1).alias("lines"))
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    clean = F.when(F.size("gone") == 0, F.col("row").getField(text)).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get("lines", i))))
    added = [n.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed")] if counts else []
    columns = [clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names if not (counts and c in ("n_lines", "n_removed"))]
    return lined.select(*columns, *added)


#: The same rows in SQL (doc_id unique and not null).
SQL = """
with docs as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
windows as (
  select doc_id, i - 1 as p, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] as w
  from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as i from docs where len(lines) >= 3)),
later as (
  select doc_id, p from (
    select *, row_number() over (partition by w order by doc_id, p) as k from windows
    where trim(translate(w, chr(10) || chr(9) || chr(13), '   ')) <> '')
  where k > 1),
gone as (select distinct doc_id, p + o as p from later, (values (0), (1), (2)) t(o)),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.p) as text
  from (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as p from docs) l
  left join gone g on g.doc_id = l.doc_id and g.p = l.p
  where g.p is null group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
       coalesce(len(d.lines), 0)::bigint as n_lines, coalesce(n.n, 0)::bigint as n_removed
from docs d left join kept k using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) n using (doc_id)"""
