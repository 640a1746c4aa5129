"""Benchmark passages in documents, found by winnowing (DataFrame functions only).

A window of benchmark words is represented by the smallest hash of the k-grams
inside it. The same words anywhere in a document have the same smallest hash,
so comparing the documents' sets of smallest hashes with the benchmark's misses
no window. Only documents that share one are looked at again: every shared
k-gram is extended to the whole window and compared word by word.

Items shorter than a window are one window of their own length; each such
length is one more class with a k-gram as long as the window.

Defined results: null or empty texts have no words; an item without words has
no window; rows that repeat an id are judged one by one; windows held by many
items are compared once and dealt out to their items at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import let, lower_ascii, pick, same

WINDOW = 10
GRAM = 5
# Bytes each side of a join may have to be sent whole to every executor.
BROADCAST_BYTES = 32 << 20
# Words are runs of other characters than these, after lower-casing A-Z (fixed value).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same on text whose A-Z are not yet lower-cased.
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Shape(NamedTuple):
    """Windows of ``window`` words, fingerprinted by the smallest hash of their ``gram``-word grams."""

    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def _positions(count: Column) -> Column:
    """0 .. count-1, empty when there are none."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _gram_hashes(words: Column, gram: int) -> Column:
    """One hash per run of ``gram`` words, over word hashes so that no text is hashed twice."""
    run = lambda h: lambda i: F.xxhash64(F.lit(gram), *[F.get(h, i + step) for step in range(gram)])
    grams = lambda h: F.transform(_positions(F.size(h) - gram + 1), run(h))
    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def _window_minima(hashes: Column, grams: int) -> Column:
    if grams == 1:
        return hashes
    reach = lambda h: lambda i: F.least(*[F.get(h, i + step) for step in range(grams)])
    return let(hashes, lambda h: F.transform(_positions(F.size(h) - grams + 1), reach(h)))


def _shapes(items: DataFrame, window: int, gram: int) -> list[Shape]:
    """The window lengths that the benchmark has: at most ``window`` numbers."""
    lengths = F.least(F.size("words"), F.lit(window)).alias("n")
    found = sorted(r["n"] for r in items.select(lengths).where("n > 0").distinct().collect())
    return [Shape(n, gram if n == window else n) for n in found]


def benchmark_windows(items: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(item_id, window: array of words, n) of every item."""
    parts = []
    for shape in shapes:
        chosen = items.where(
            F.size("words") >= shape.window if shape is shapes[-1] else F.size("words") == shape.window
        )
        cut = _slices(F.col("words"), shape.window)
        parts.append(chosen.select("item_id", F.explode(cut).alias("window"), F.lit(shape.window).alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _smallest_at(hashes: Column) -> Column:
    """Positions of the k-grams that carry the window's smallest hash."""
    return let(hashes, lambda h: F.filter(_positions(F.size(h)), lambda i: F.get(h, i) == F.array_min(h)))


def _slices(words: Column, length: int) -> Column:
    return let(
        words, lambda w: F.transform(_positions(F.size(w) - length + 1), lambda i: F.slice(w, i + 1, length))
    )


def _fits(df: DataFrame, bytes_per_row: int) -> bool:
    return df.limit(BROADCAST_BYTES // bytes_per_row + 1).count() <= BROADCAST_BYTES // bytes_per_row


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, hit_starts: array of (start, n), items: sorted item ids) of documents that hold a window."""
    items = pick(benchmark, item_id=item_id, text=item_text).select("item_id", words_of(F.col("text")).alias("words"))
    shapes = _shapes(items, window, min(gram, window))
    spark = docs.sparkSession
    empty = "doc_id long, text_hash long, hit_starts array<struct<start:int,n:int>>, items array<string>"
    if not shapes:
        return spark.createDataFrame([], empty)
    windows = benchmark_windows(items, shapes).withColumn("h1", F.xxhash64("window"))
    windows = windows.withColumn("h2", F.xxhash64(F.lit(1), "window"))
    distinct = windows.select("window", "n", "h1", "h2").dropDuplicates(["n", "window"])
    # a window of ten words takes well under a kilobyte
    fits = _fits(distinct, 1024)
    prints = None
    for shape in shapes:
        grams = _gram_hashes(F.col("window"), shape.gram)
        part = distinct.where(F.col("n") == shape.window)
        part = part.select("window", "n", "h1", "h2", F.array_min(grams).alias("print"), F.explode(_smallest_at(grams)).alias("offset"))
        prints = part if prints is None else prints.unionByName(part)

    keyed = pick(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    words = words_of(F.col("text"))
    minima = [_window_minima(_gram_hashes(words, s.gram), s.grams) for s in shapes]
    minima = F.array_distinct(minima[0] if len(minima) == 1 else F.concat(*minima))
    doc_prints = keyed.select("doc_id", "text_hash", F.explode(minima).alias("print"))
    known = _small(prints.select("print").distinct(), fits)
    suspects = doc_prints.join(known, "print", "left_semi").select("doc_id", "text_hash").distinct()

    again = keyed.join(suspects, same(keyed, suspects, "doc_id", "text_hash"), "left_semi")
    again = again.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words.alias("words"))
    grams = sorted({s.gram for s in shapes})
    reach = max(s.window for s in shapes)
    spots = F.flatten(
        F.array(
            *[
                F.transform(
                    _gram_hashes(F.col("words"), g),
                    lambda h, i: F.struct(h.alias("print"), i.alias("at")),
                )
                for g in grams
            ]
        )
    )
    spots = again.select("doc_id", "text_hash", "words", F.explode(spots).alias("spot")).select(
        "doc_id",
        "text_hash",
        F.col("spot.print").alias("print"),
        F.col("spot.at").alias("at"),
        F.greatest(F.lit(0), F.col("spot.at") - reach + 1).alias("from"),
        F.slice("words", F.greatest(F.lit(0), F.col("spot.at") - reach + 1) + 1, 2 * reach).alias("near"),
    )
    hits = spots.join(_small(prints, fits), "print").withColumn("start", F.col("at") - F.col("offset"))
    found = F.slice("near", F.col("start") - F.col("from") + 1, F.col("n"))
    hits = hits.where(F.col("start") >= 0).where(found == F.col("window"))
    hits = hits.select("doc_id", "text_hash", "h1", "h2", "n", "start").distinct()

    owners = windows.select("h1", "h2", "n", F.col("item_id").cast("string").alias("item_id")).distinct()
    touched = hits.select("doc_id", "text_hash", "h1", "h2", "n").distinct()
    touched = touched.join(_small(owners, _fits(owners, 128)), ["h1", "h2", "n"])
    by_doc = touched.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    starts = hits.select("doc_id", "text_hash", "start", "n").distinct().groupBy("doc_id", "text_hash")
    starts = starts.agg(F.collect_list(F.struct("start", "n")).alias("hit_starts"))
    joined = starts.join(by_doc, same(starts, by_doc, "doc_id", "text_hash"))
    return joined.select(starts["doc_id"], starts["text_hash"], "hit_starts", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row."""
    source = pick(docs, doc_id=doc_id, text=text)
    counted = source.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("n_words")
    )
    hits = find_contamination(docs, benchmark, doc_id=doc_id, text=text, **options)
    covered = F.array_distinct(
        F.flatten(F.transform("hit_starts", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    )
    hits = hits.select(
        "doc_id", "text_hash", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("items"),
    )
    joined = counted.join(hits, same(counted, hits, "doc_id", "text_hash"), "left")
    return joined.select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


_LEADS = ", ".join(f"lead(word, {step}) OVER text_order" for step in range(1, WINDOW))

SQL = rf"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda w: w <> '') AS words FROM texts),
spread AS (
  SELECT kind, id, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM words),
ahead AS (
  SELECT kind, id, size, pos, [word, {_LEADS}] AS next_words FROM spread
  WINDOW text_order AS (PARTITION BY kind, id ORDER BY pos)),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(size, {WINDOW}) AS n,
         array_to_string(next_words[1:least(size, {WINDOW})], ' ') AS w
  FROM ahead WHERE kind = 'i' AND pos + least(size, {WINDOW}) - 1 <= size),
lengths AS (SELECT DISTINCT n FROM item_windows),
hits AS (
  SELECT DISTINCT a.id AS doc_id, a.pos, l.n, i.item_id
  FROM ahead a JOIN lengths l ON a.pos + l.n - 1 <= a.size
  JOIN item_windows i ON i.n = l.n AND i.w = array_to_string(a.next_words[1:l.n], ' ')
  WHERE a.kind = 'd'),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hits))
  GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.id AS doc_id, len(d.words) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit_words w ON w.doc_id = d.id LEFT JOIN hit_items i ON i.doc_id = d.id
WHERE d.kind = 'd'
"""
