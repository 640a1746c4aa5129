"""Duplicate lines across documents, dropped everywhere but in the first document (DataFrame functions only).

Only hashes travel. Line hashes are range-partitioned and sorted by document
and position inside; each run of equal hashes streams past its first document,
and what is returned per document is a bitmap of the lines to keep.

A key that holds over a thousandth of all lines would fill a range of its own. There are
fewer than a thousand of those; they are found by a frequent-items sketch, settled
by partial minima and a broadcast of at most that many rows, and skip the sort.

Defined results: null or empty text is one empty line; a null id sorts behind
every other id and counts as one document; rows that repeat an id are the same
document (each row keeps its own bitmap); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.tables import let, lower_ascii, pick
from demandloom.session import cut_lineage

MIN_KEY_CHARS = 10
MAX_HOT_KEYS = 1000
_SKETCH_ITEMS = 10_000
_BITS = 64
_LAST_ID = (1 << 63) - 1
# The characters stripped from both ends of a line (fixed values).
STRIPPED = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line as it is compared: ASCII white space off both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(STRIPPED)))


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of every line whose key is long enough; 128 bits name the key."""
    lines = docs.select(
        F.coalesce(F.col("id"), F.lit(_LAST_ID)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"),
    )
    # the cheap bound first: a key is never longer than its line
    keys = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    keys = keys.where(F.char_length("key") >= min_chars)
    return keys.select(
        "id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _hot_hashes(hashes: DataFrame) -> list[int]:
    """At most MAX_HOT_KEYS values of h1; no result depends on which they are."""
    found = hashes.selectExpr(f"approx_top_k(h1, {MAX_HOT_KEYS}, {_SKETCH_ITEMS}) AS top", "count(*) AS n").first()
    return [x["item"] for x in found["top"] or () if x["count"] * MAX_HOT_KEYS > found["n"]]


def dropped_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(id, text_hash, pos) of the lines that an earlier document already holds."""
    hashes = cut_lineage(_line_hashes(docs, min_chars))
    spark = docs.sparkSession
    hot_values = _hot_hashes(hashes)
    hot_keys = F.broadcast(spark.createDataFrame([(x,) for x in hot_values], "h1 long"))
    cold = hashes.join(hot_keys, "h1", "left_anti").repartitionByRange("h1", "h2")
    cold = cold.sortWithinPartitions("h1", "h2", "id", "pos")
    first = F.first("id").over(Window.partitionBy("h1", "h2").orderBy("id", "pos"))
    late = cold.withColumn("first_id", first).where(F.col("id") > F.col("first_id"))
    late = late.select("id", "text_hash", "pos")
    if not hot_values:
        return late
    hot = hashes.join(hot_keys, "h1", "left_semi")
    owners = F.broadcast(hot.groupBy("h1", "h2").agg(F.min("id").alias("first_id")))
    hot = hot.join(owners, ["h1", "h2"]).where(F.col("id") > F.col("first_id"))
    return late.unionByName(hot.select("id", "text_hash", "pos"))


def _words_of_bits(words: Column) -> Column:
    """Sorted (word, dropped bits) to a dense array of keep words; nothing is stored after the last word with a zero."""
    dense = lambda by_word: F.transform(
        F.sequence(F.lit(0), F.array_max(F.map_keys(by_word))),
        lambda w: F.bitwise_not(F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("long"))),
    )
    return let(F.map_from_entries(words), dense)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, keep, n_dropped) for every document that loses a line.

    ``keep`` holds 64 lines per long, the lowest bit first; words of lines that
    all stay are left out at the end, and a document that loses nothing has no row.
    """
    lost = dropped_lines(pick(docs, id=doc_id, text=text), min_chars).distinct()
    bit = F.expr(f"shiftleft(1L, cast(pos % {_BITS} AS int))")
    words = lost.groupBy("id", "text_hash", F.floor(F.col("pos") / _BITS).cast("int").alias("word"))
    words = words.agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    packed = words.groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("word", "bits")).alias("words"), F.sum("n").alias("n_dropped")
    )
    return packed.select("id", "text_hash", _words_of_bits(F.col("words")).alias("keep"), "n_dropped")


def _stays(keep: Column, position: Column) -> Column:
    word = F.coalesce(F.get(keep, (position / _BITS).cast("int")), F.lit(-1).cast("long"))
    return F.getbit(word, position % _BITS) == 1


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_KEY_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) and the columns named in ``carry``, one row per input row."""
    others = {f"carry_{i}": name for i, name in enumerate(carry)}
    source = pick(docs, doc_id=doc_id, text=text, **others)
    keyed = source.withColumns(
        {"id": F.coalesce(F.col("doc_id"), F.lit(_LAST_ID)), "text_hash": F.xxhash64("text")}
    )
    bitmaps = keep_bitmaps(docs, min_chars, doc_id, text)
    marked = keyed.join(bitmaps, ["id", "text_hash"], "left")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda line, i: _stays(F.col("keep"), i))
    whole = F.coalesce(F.col("text"), F.lit(""))
    return marked.select(
        "doc_id",
        F.when(F.col("keep").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(inner).alias(name) for inner, name in others.items()],
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_id, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
