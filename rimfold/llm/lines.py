"""Line dedup: later copies of repeated runs of lines are deleted. DataFrame functions only.

The sequence of a document is its lines that are not blank. A run is deleted where an earlier copy of it exists (by
doc_id, then text hash, then place) and it has at least `lines` lines or at least `chars` characters, whatever its length.

1. A document whose whole sequence is that of an earlier one goes as a whole, if it has so many lines or characters. It
   can tell nothing that the earlier one does not, so it takes no further part.
2. Every position of the other sequences starts a suffix. Prefix doubling names the first 1, 2, 4, ... lines of every
   suffix: the name at depth 2h is made of the names at depth h of the position and of the one h further on. Positions
   of one name are an LCP interval of the suffix array at that depth, and its earliest position is the copy that stays.
   Suffixes whose name is alone leave the loop, which ends when none is left.
3. A repeated run of length L is the union of the two windows of the largest power of two up to L at its ends, each of
   which has an earlier copy too; below `lines`, where runs count by their characters, lengths between two depths
   are named by two overlapping names. What windows of a document cover together are its maximal runs.

Names are two 64-bit hashes of the lines. Groups are only aggregated (with partial sums) and joined; the first places
of repeated names are a table of their own, so that a join with a very common line is split between tasks. What is
collected for a document are its own runs.

Defined cases: a null text is left null and an empty one empty; blank lines are never deleted; rows of equal doc_id
and text count as one document and get the same result; overlapping copies inside one text count as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.llm.common import read, stored

LINES, CHARS = 4, 200
BLANK = " \t\r\x0b\x0c"
KEY, NAME = ["_doc", "_text"], ["n1", "n2"]


def split_lines(text: str) -> F.Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def filled(s: F.Column) -> F.Column:
    return F.btrim(s, F.lit(BLANK)) != ""


def sequences(docs: DataFrame, text: str, lines: int) -> DataFrame:
    """_doc, _text (hash), s1, s2 (hashes of the sequence) and own: for each line that is not blank two hashes, its length, and
    the lengths of lines / 2 lines from it on."""
    names = F.transform(F.filter(split_lines(text), filled), lambda s: F.struct(F.xxhash64(s).alias("n1"), F.xxhash64(s, F.lit(1)).alias("n2"), F.length(s).alias("chars")))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_text"), names.alias("own")).where(F.size("own") > 0)

    def following(chars):  # bound once: a slice, or the field of the structs, would be made anew for each line
        return F.transform("own", lambda x, i: F.struct(x["n1"].alias("n1"), x["n2"].alias("n2"), x["chars"].alias("chars"), F.array(*[F.coalesce(F.get(chars, i + k), F.lit(0)) for k in range(lines // 2)]).cast("array<int>").alias("ahead")))

    ahead = F.transform(F.array("own.chars"), following)[0]
    return stored(rows.withColumns({"s1": F.xxhash64("own.n1"), "s2": F.xxhash64("own.n2")})).withColumn("own", ahead)


def whole_copies(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that are first with their sequence, and those that are copies."""
    first = stored(every.groupBy("s1", "s2").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last")).where("first <> last").drop("last"))
    both = every.join(first.hint("merge"), ["s1", "s2"], "left").withColumn("_copy", F.col("first").isNotNull() & (F.struct(*KEY) != F.col("first")))
    return both.where(~F.col("_copy")).dropDuplicates(KEY), both.where("_copy").dropDuplicates(KEY)


def repeated(rows: DataFrame) -> DataFrame:
    """Rows whose name is not alone, with `later`: an earlier row has the same name."""
    place = F.struct(*KEY, "at")
    first = stored(rows.groupBy(*NAME).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return rows.join(first, NAME).withColumn("later", place > F.col("_first")).drop("_first")


def joined_names(rows: DataFrame, ahead: int) -> DataFrame:
    """rows with the name and characters (_n1, _n2, _chars) of the place `ahead` lines on in the same sequence, where it is in rows."""
    on = rows.select("s1", "s2", (F.col("at") - ahead).alias("at"), F.col("n1").alias("_n1"), F.col("n2").alias("_n2"), F.col("chars").alias("_chars"))
    return rows.join(on, ["s1", "s2", "at"])


def windows(rows: DataFrame, lines: int, chars: int) -> DataFrame:
    """_doc, _text, at, length: windows of sequences that have an earlier copy and qualify; at every depth."""
    found, depth, rows = None, 1, stored(repeated(rows))
    while True:
        here = rows.where(F.col("later") & ((F.col("chars") >= chars) | F.lit(depth >= lines))).select(*KEY, "at", F.lit(depth).alias("length"))
        found = here if found is None else found.unionByName(here)
        for more in range(depth + 1, min(2 * depth, lines)):
            # the last `depth` lines of `more`, and the characters of the lines before these
            before = F.aggregate(F.slice("ahead", 1, more - depth), F.lit(0), lambda s, x: s + x)
            wide = joined_names(rows, more - depth).withColumn("chars", F.col("_chars") + before)
            wide = wide.where(F.col("chars") >= chars).select("s1", "s2", *KEY, "at", F.xxhash64("n1", "_n1").alias("n1"), F.xxhash64("n2", "_n2").alias("n2"))
            found = found.unionByName(repeated(wide).where("later").select(*KEY, "at", F.lit(more).alias("length")))
        double = joined_names(rows, depth)
        ahead = F.col("ahead") if 2 * depth < lines else F.array().cast("array<int>")
        double = double.select("s1", "s2", *KEY, "at", F.xxhash64("n1", "_n1").alias("n1"), F.xxhash64("n2", "_n2").alias("n2"), (F.col("chars") + F.col("_chars")).alias("chars"), ahead.alias("ahead"))
        rows, depth = stored(repeated(double)), 2 * depth
        if rows.isEmpty():
            return found


def repeated_runs(docs: DataFrame, *, text: str = "text", lines: int = LINES, chars: int = CHARS) -> DataFrame:
    """_doc, _text (hash) and runs: the maximal runs (at, end) of filled lines to delete, in order; a row for each
    document that has any."""
    firsts, copies = whole_copies(sequences(docs, text, lines))
    rows = firsts.select("s1", "s2", *KEY, F.posexplode("own").alias("at", "x")).select("s1", "s2", *KEY, "at", "x.*")
    found = windows(rows, lines, chars)
    order = Window.partitionBy(*KEY).orderBy("at", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    laid = found.select(*KEY, "at", (F.col("at") + F.col("length")).alias("end")).withColumn("new", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1)))
    numbered = laid.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*KEY, "run").agg(F.min("at").alias("at"), F.max("end").alias("end")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("runs"))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    gone = copies.where((F.size("own") >= lines) | (total >= chars)).select(*KEY, F.array(F.struct(F.lit(0).alias("at"), F.size("own").alias("end"))).alias("runs"))
    return runs.unionByName(gone)


def without(lines: F.Column, runs: F.Column) -> F.Column:
    """The lines without the filled ones of the runs, joined again; lines and places are bound once, so all is linear."""

    def kept(own):
        index = F.filter(F.transform(own, lambda s, i: F.when(filled(s), i)), lambda i: i.isNotNull())
        drop = F.transform(F.array(index), lambda at: F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["at"], r["end"] - 1), lambda k: F.get(at, k)))))[0]
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), drop), lambda i: F.get(own, i)), "\n")

    return F.transform(F.array(lines), kept)[0]


def drop_repeated_lines(docs: DataFrame, *, text: str = "text", lines: int = LINES, chars: int = CHARS) -> DataFrame:
    """docs with _kept_text, _n_lines (filled lines) and _n_removed, which take the place of columns of these names; all other
    columns stay as they are, whatever their names."""
    runs = repeated_runs(docs, text=text, lines=lines, chars=chars)
    made = ["_kept_text", "_n_lines", "_n_removed"]
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in made]).alias("own")
    keyed = docs.select(rest, F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    joined = keyed.join(runs.hint("merge"), keyed["id"].eqNullSafe(runs["_doc"]) & (keyed["hash"] == runs["_text"]), "left")
    removed = F.aggregate("runs", F.lit(0), lambda s, r: s + r["end"] - r["at"])
    found = joined.select(
        "own", F.when(F.col("runs").isNull(), F.col("own")[text]).otherwise(without(split_lines(f"own.`{text}`"), F.col("runs"))).alias("_kept_text"),
        F.size(F.filter(split_lines(f"own.`{text}`"), filled)).alias("_n_lines"), F.coalesce(removed, F.lit(0)).alias("_n_removed"),
    )
    return found.select("own.*", *made)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"),
        F.length(F.coalesce("_kept_text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("_kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
raw as (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) as line, unnest(string_split(t, chr(10))) as s from d),
f as (select doc_id, line, s, row_number() over (partition by doc_id order by line) as k, length(s) as chars from raw
      where trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
w as (
  select doc_id, k, 1 as len, md5(s) as name, chars from f
  union all
  select a.doc_id, a.k, 2, md5(md5(a.s) || md5(b.s)), a.chars + b.chars from f a join f b on a.doc_id = b.doc_id and b.k = a.k + 1
  union all
  select a.doc_id, a.k, 3, md5(md5(a.s) || md5(b.s) || md5(c.s)), a.chars + b.chars + c.chars from f a
  join f b on a.doc_id = b.doc_id and b.k = a.k + 1 join f c on a.doc_id = c.doc_id and c.k = a.k + 2
  union all
  select a.doc_id, a.k, 4, md5(md5(a.s) || md5(b.s) || md5(c.s) || md5(e.s)), a.chars + b.chars + c.chars + e.chars from f a
  join f b on a.doc_id = b.doc_id and b.k = a.k + 1 join f c on a.doc_id = c.doc_id and c.k = a.k + 2
  join f e on a.doc_id = e.doc_id and e.k = a.k + 3
),
m as (select *, row_number() over (partition by len, name order by doc_id, k) as nth from w),
gone as (select distinct doc_id, k + unnest(range(0, len)) as k from m where nth > 1 and (chars >= 200 or len = 4)),
r as (select raw.doc_id, raw.line, raw.s, f.k, gone.k is not null as dropped from raw
      left join f on raw.doc_id = f.doc_id and raw.line = f.line left join gone on f.doc_id = gone.doc_id and f.k = gone.k),
o as (select doc_id, count(k) as n_lines, count(*) filter (where dropped) as n_removed,
             coalesce(string_agg(s, chr(10) order by line) filter (where not dropped), '') as kept from r group by doc_id)
select doc_id, n_lines, n_removed, length(kept) as kept_chars, sha256(kept) as kept_sha256 from o
"""
