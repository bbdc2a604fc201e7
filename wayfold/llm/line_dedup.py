"""Line dedup: windows of three lines that were seen before are removed, whichever document holds them.

Every three consecutive lines make a window. A window's occurrences are ordered by (doc_id, text key, line number) over the whole
corpus; the first one stays, each later one marks its three lines, and the union of the marks is removed. Consequences:

* the first occurrence of every distinct line survives, because a line is only removed where an equal one stands earlier;
* documents with fewer than three lines are left alone;
* windows without a visible character (anything but ASCII white space) do not count.

Defined results: null text stays null with n_lines 0; an empty text has one (empty) line; a null doc_id is a valid identity and
sorts first; rows that agree in doc_id and text are one document and are treated alike (each keeps what the first keeps);
extra columns do not matter, all names used inside are chosen by this module.

Scale: what is shuffled is 40 bytes per window, grouped with map-side partial aggregation (a window that stands in a third of all
rows is one partial row per task), then joined back by an equi-join whose hot side AQE may split; texts move once, to meet the
line numbers to remove. Windows are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, let, packed, table

WIDTH = 3
#: Anything but ASCII white space.
VISIBLE = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: _id, _key (hash of the text), _pos (number of its first line, from 0), _h1, _h2."""

    def of(lines: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [F.get(lines, i + k) for k in range(width)]
            seen = F.concat(*parts).rlike(VISIBLE)
            return F.struct(i.alias("_pos"), F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit("w"), *reversed(parts)).alias("_h2"), seen.alias("_seen"))

        return F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(0), F.size(lines) - width), one))

    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).where(F.col("_text").contains("\n"))
    rows = rows.select("_id", F.xxhash64("_text").alias("_key"), F.explode(let(_lines(F.col("_text")), of)).alias("_w"))
    return rows.where("_w._seen").select("_id", "_key", "_w._pos", "_w._h1", "_w._h2")


def later_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with something to remove: _id, _key, _from (numbers of the first lines of later occurrences)."""
    seen = windows(docs, width, id_col, text_col)
    place = F.struct("_id", "_key", "_pos")
    first = seen.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = seen.join(first, ["_h1", "_h2"]).where(~place.eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_from"))


def line_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and _n_lines, _n_removed added (these two names are replaced if docs has them)."""
    later = later_lines(docs, width, id_col, text_col)
    rows = docs.select(packed(docs).alias("_row")).withColumn("_key1", F.xxhash64(F.col("_row")[text_col]))
    text = F.col("_row")[text_col]
    joined = rows.join(later, F.col("_row")[id_col].eqNullSafe(F.col("_id")) & (F.col("_key1") == F.col("_key")), "left")
    gone = F.array_distinct(F.flatten(F.transform("_from", lambda p: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: p + k))))
    kept = let(_lines(text), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)))
    changed = F.col("_from").isNotNull()
    new = {
        text_col: F.when(changed, F.array_join(kept, "\n")).otherwise(text),
        "_n_lines": F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long"),
        "_n_removed": F.when(changed, F.size(gone)).otherwise(0).cast("long"),
    }
    same = {c: F.col("_row")[c] for c in docs.columns}
    return joined.select(*[c.alias(name) for name, c in (same | new).items()])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


SQL = """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
w as (select doc_id, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c from l window d as (partition by doc_id order by pos)),
v as (select * from w where c is not null and regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')),
r as (select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k from v),
g as (select distinct doc_id, pos + unnest([0, 1, 2]) as pos from r where k > 1),
k as (select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
  from l left join g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, k.text from documents d left join k on d.doc_id = k.doc_id
"""
