"""Lines repeated across documents, found by hash and returned as keep bitmaps.

1. Every line long enough becomes (128-bit hash of its key, document, position); texts do not move.
2. These rows are range-partitioned by (hash, document descending) and sorted by (hash, document descending,
   position): the first occurrence in stream order is in the largest document.  A hash that fills several
   partitions is cut between documents, so no task holds a hot line alone.
3. Each partition gives one row per hash (documents counted, first document); these are combined per hash.
   Hashes in too few documents go, the winner goes back to the partitions.
4. Lines after the winning document are struck: 64 positions to a word, a document's words collected into a
   sparse bitmap that lists only words with a struck line.

Results for odd input: null or empty text is one empty line.  Rows that share a doc_id count as one document and
each keeps its own bitmap.  A null doc_id is one document, smaller than any other.  Empty tables give no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import BLANKS, ascii_lower, partitions, read, same_row, saved, texts


def occurrences(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """h1, h2, doc_id, twin, pos of every line whose key has at least ``min_chars`` code points."""
    lines = texts(docs).select("doc_id", "twin", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # trimming needs several times a line's size in memory, and most lines have nothing to trim; char_length goes first for the same reason
    edged = F.substring("line", 1, 1).isin(*BLANKS) | F.substring("line", -1, 1).isin(*BLANKS)
    bare = F.when(edged, F.btrim("line", F.lit(BLANKS))).otherwise(F.col("line"))
    long = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "twin", "pos", bare.alias("bare")).filter(F.char_length("bare") >= min_chars)
    key = long.select("doc_id", "twin", "pos", ascii_lower(F.col("bare")).alias("key"))
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "twin", "pos")


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, parts: int | None = None) -> DataFrame:
    """doc_id, twin, keep: words (word, bits) of 64 lines, lowest bit first; words not listed keep all lines.

    Only documents that lose a line have a row.
    """
    n, latest = parts or partitions(docs), F.desc_nulls_last("doc_id")
    found = saved(occurrences(docs, min_chars))  # dealing out by ranges reads it twice
    ranged = found.repartitionByRange(n, "h1", "h2", latest).sortWithinPartitions("h1", "h2", latest, "pos")
    occ = saved(ranged.withColumn("part", F.spark_partition_id()))

    # all lines of one (hash, document) are in one partition, so the counts add up
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    runs = occ.groupBy("part", "h1", "h2").agg(documents.alias("n_docs"), F.max("doc_id").alias("head"))
    heads = runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("head").alias("winner")).filter(F.col("n_docs") >= min_docs)
    winners = runs.select("part", "h1", "h2").join(heads.select("h1", "h2", "winner"), ["h1", "h2"])

    struck = occ.join(winners, ["part", "h1", "h2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("winner")))
    words = struck.groupBy("doc_id", "twin", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.expr("~bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits")
    )
    return words.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


#: Words are laid out densely once per document (bound by the outer lambdas), then looked up per line.
KEPT = r"""
transform(array(struct(split(text, '\n') AS l, map_from_entries(keep) AS m, keep[size(keep) - 1].word AS top)), s ->
  transform(array(struct(s.l AS l, transform(sequence(0, s.top), w -> coalesce(try_element_at(s.m, w), -1L)) AS d)), z ->
    array_join(filter(z.l, (x, i) -> i div 64 >= size(z.d) OR getbit(z.d[cast(i div 64 as int)], i % 64) = 1), '\n'))[0])[0]"""


def without_struck(docs: DataFrame, bitmaps: DataFrame, *others: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the lines kept, joined), and ``others`` of the documents' columns."""
    t = texts(docs, *others)
    joined = t.join(bitmaps, same_row(t, bitmaps), "left")
    return joined.select(
        t["doc_id"],
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(keep, 0L, (a, w) -> a + bit_count(~w.bits))"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.expr(KEPT)).alias("kept"),
        *others,
    )


def query(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    result = without_struck(docs, keep_bitmaps(docs))
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, repeated lines taken out of their texts; n_chars follows the text."""
    result = without_struck(docs, keep_bitmaps(docs), "lang", "source")
    return result.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS winner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id < r.winner AS struck FROM lines l LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (struck) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT struck), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
