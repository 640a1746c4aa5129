"""Repeated passages: every window of 35 words that occurs twice is cut out of every text.

Windows are named by two Rabin-Karp hashes (96 bits) and counted in Spark. So
that not every window of every text has to travel, each window first names its
anchor, the 6-gram of smallest hash inside it. Equal windows have equal
anchors, so a window whose anchor occurs once in the corpus cannot repeat. Only
windows under repeated anchors are shuffled and counted. The repeated ones go
back to their texts, where overlapping windows merge into intervals.

Equal texts are folded: one of them stands for all and counts twice. Windows are shuffled once and
counted where they meet. Those under common anchors (a hot passage) are dealt out by a salt; nearly all
meet an equal in their part, the rest look up the sum over all parts. The shuffled
texts serve both joins; Spark reuses the exchange.

Defined results: null or empty texts and texts shorter than a window keep all
their words unless the whole text is one repeated window; rows that repeat an id
are texts of their own, so equal rows repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm import hashing as H
from demandloom.llm.tables import pick

_INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

WINDOW = 35
GRAM = 6
# Windows under an anchor with more occurrences are dealt out over SALTS parts.
HOT_ANCHOR = 1000
SALTS = 64
# Kinds of window rows: under an uncommon anchor 0, a common one 1; KNOWN are common ones that their own text repeats.
KNOWN = 2


def window_anchors(words: np.ndarray, first: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple:
    """(hash, leftmost place, rightmost place) of the smallest ``gram``-word hash inside each window.

    A sliding minimum by doubling steps. The two places differ where the gram occurs twice in the window.
    """
    at, hashes = H.window_hashes(words, first, gram)
    smallest = np.full(len(words) + window, np.iinfo(np.uint64).max, np.uint64)
    smallest[at] = hashes
    left = np.arange(len(smallest))
    right = left.copy()

    def joined(low: slice | np.ndarray, high: slice | np.ndarray) -> tuple:
        a, b = smallest[low], smallest[high]
        return np.minimum(a, b), np.where(a <= b, left[low], left[high]), np.where(b <= a, right[high], right[low])

    width, need = 1, window - gram + 1
    while width * 2 <= need:
        low, high = slice(None, -width), slice(width, None)
        smallest[low], left[low], right[low] = joined(low, high)
        width *= 2
    return joined(starts, starts + (need - width))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, H.Words]]:
    for low, high in H.text_slices(batch.column("text")):
        part = batch.slice(low, high - low)
        yield part, H.Words(part.column("text"), H.WHITE_SPACE)


def _anchor_rows(window: int, gram: int):
    """(t1, t2, anchor, n): the anchors of each text; n is 2 where the text has the anchor at two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _slices(batch):
                hashes = words.hashes()
                room = np.repeat(words.first[1:], words.lengths) - np.arange(len(hashes))
                starts = np.flatnonzero(room >= window)
                if not len(starts):
                    continue
                anchors, left, right = window_anchors(hashes, words.first, starts, window, gram)
                text = words.text_of_word()[starts]
                # neighbours mostly share their anchor: fold runs before sorting
                run_start = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])))
                left, right = np.minimum.reduceat(left, run_start), np.maximum.reduceat(right, run_start)
                text, anchors = text[run_start], anchors[run_start]
                order = np.lexsort((anchors, text))
                text, anchors, left, right = text[order], anchors[order], left[order], right[order]
                group = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])))
                twice = np.minimum.reduceat(left, group) != np.maximum.reduceat(right, group)
                rows = pa.array(text[group])
                yield pa.record_batch(
                    {
                        "t1": part.column("t1").take(rows),
                        "t2": part.column("t2").take(rows),
                        "anchor": pa.array(H.as_long(anchors[group])),
                        "n": pa.array(np.where(twice, 2, 1).astype(np.int32)),
                    }
                )

    return run


def _window_rows(window: int, gram: int):
    """(kind, h1, h2, t1, t2, start, n) of the windows whose anchor is among the text's repeated anchors.

    kind 1 is a window under an anchor of more than ``hot_anchor`` occurrences, KNOWN one of those that its own text
    repeats; n is 2 where the window occurs twice in any case, because its text repeats it or has equals; start is -1
    in rows that only count for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("stands_for_all"))
            for part, words in _slices(batch):
                first_lane = words.hashes()
                starts, h1 = H.window_hashes(first_lane, words.first, window)
                if not len(starts):
                    continue
                h2 = H.window_hashes(words.hashes(1), words.first, window, 1)[1] >> np.uint64(32)
                anchors = window_anchors(first_lane, words.first, starts, window, gram)[0]
                text = words.text_of_word()[starts]
                # (text, anchor) pairs mixed into one number; a chance match only sends a window that is then counted once
                mine = H.mix(anchors + H.mix(text.astype(np.uint64)))
                hot = np.isin(mine, _pairs(part.column("hot_anchors")))
                chosen = np.flatnonzero(hot | np.isin(mine, _pairs(part.column("anchors"))))
                order = chosen[np.lexsort((starts[chosen], h2[chosen], h1[chosen], text[chosen]))]
                if not len(order):
                    continue
                text, h1, h2, hot = text[order], h1[order], h2[order], hot[order]
                begin = starts[order] - words.first[text]
                head = np.append(True, (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
                size = np.diff(np.append(np.flatnonzero(head), len(head)))
                again, copied = np.repeat(size > 1, size), part.column("n").to_numpy(zero_copy_only=False)[text] > 1
                # windows that count for others only: of equal texts, and of common windows that their text repeats
                for_others = np.flatnonzero(head & (copied | (again & hot)))
                own = np.flatnonzero(~copied)
                rows = np.append(for_others, own)
                kind = np.append(hot[for_others], np.where(hot & again, KNOWN, hot)[own])
                start = np.append(np.full(len(for_others), -1), begin[own])
                n = np.append(np.full(len(for_others), 2), np.where(again, 2, 1)[own])
                texts = pa.array(text[rows])
                yield pa.record_batch(
                    {
                        "kind": pa.array(kind.astype(np.int32)),
                        "h1": pa.array(H.as_long(h1[rows])),
                        "h2": pa.array(h2[rows].astype(np.uint32).view(np.int32)),
                        "t1": part.column("t1").take(texts),
                        "t2": part.column("t2").take(texts),
                        "start": pa.array(start.astype(np.int32)),
                        "n": pa.array(n.astype(np.int32)),
                    }
                )

    return run


def _pairs(lists: pa.Array) -> np.ndarray:
    """One number for every (row, element) of a column of lists."""
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return H.mix(values + H.mix(np.repeat(np.arange(len(lists)), sizes).astype(np.uint64)))


def merge_windows(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [from, to) covered by windows at sorted ``starts``; touching ones become one."""
    if not len(starts):
        return starts, starts
    opens = np.flatnonzero(np.diff(starts, prepend=starts[0] - window - 1) > window)
    closes = np.append(opens[1:] - 1, len(starts) - 1)
    return starts[opens], starts[closes] + window


def _cut(window: int):
    """(doc_id, kept_text, n_words, n_removed, removed) from the starts of each text's repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, counts, gone, removed = [], [], [], []
            texts, starts, copies = (batch.column(c) for c in ("text", "starts", "copies"))
            for row in range(len(batch)):
                # bytes split at ASCII white space only, as the words are defined
                words = (texts[row].as_py() or "").encode().split()
                if copies[row].as_py() > 1:
                    hits = np.arange(max(0, len(words) - window + 1))
                else:
                    listed = starts[row].values
                    hits = np.empty(0, np.int64) if listed is None else np.sort(listed.to_numpy(zero_copy_only=False))
                low, high = (x.tolist() for x in merge_windows(hits, window))
                kept, last = [], 0
                for a, b in zip(low, high, strict=True):
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                kept_texts.append(b" ".join(kept).decode())
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                removed.append([{"start": a, "stop": b} for a, b in zip(low, high, strict=True)])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "kept_text": pa.array(kept_texts, pa.string()),
                    "n_words": pa.array(counts, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "removed": pa.array(removed, _INTERVALS),
                }
            )

    return run


def dedup_passages(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    doc_id: str = "doc_id",
    text: str = "text",
    hot_anchor: int = HOT_ANCHOR,
) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, removed), one row per input row.

    ``removed`` lists the maximal [start, stop) word intervals that were cut.
    """
    if not 0 < gram <= window:
        raise ValueError("the gram must fit into the window")
    key = ["t1", "t2"]
    hashes = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    source = pick(docs, doc_id=doc_id, text=text).withColumns(hashes)
    id_type = source.schema["doc_id"].dataType.simpleString()

    owners = source.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    anchors = source.select("t1", "t2", "text").mapInArrow(
        _anchor_rows(window, gram), "t1 long, t2 long, anchor long, n int"
    )
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = anchors.select("t1", "t2", "anchor").join(repeated, "anchor").groupBy(*key)
    hot = F.col("n") > hot_anchor
    wanted = wanted.agg(
        F.collect_set(F.when(~hot, F.col("anchor"))).alias("anchors"),
        F.collect_set(F.when(hot, F.col("anchor"))).alias("hot_anchors"),
    )

    # the first of equal texts stands for all of them
    # (marked, not filtered: as a key of the join it would have the texts shuffled once more)
    chosen = source.join(owners, key).join(wanted, key)
    chosen = chosen.select(
        *key, "text", "anchors", "hot_anchors", F.least("copies", F.lit(2)).cast("int").alias("n"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("stands_for_all"),
    )
    windows = chosen.mapInArrow(
        _window_rows(window, gram), "kind int, h1 long, h2 int, t1 long, t2 long, start int, n int"
    )
    # a window under an uncommon anchor has few rows, which meet in one sort; the others are dealt out by a salt,
    # and only those that are alone in their part ask for the sum over all parts. All three uses of the counted rows
    # name the same columns and filters, so one exchange serves them
    windows = windows.where("h1 IS NOT NULL AND h2 IS NOT NULL")
    salt = F.when(F.col("kind") == 1, F.pmod(F.hash("t1"), F.lit(SALTS)))
    salt = salt.when(F.col("kind") == KNOWN, F.pmod(F.hash("t1", "start"), F.lit(SALTS))).otherwise(0)
    total = F.sum("n").over(Window.partitionBy("h1", "h2", "salt"))
    counted = windows.withColumn("salt", salt).withColumn("total", total)
    met = counted.where("start >= 0")
    alone = met.where("kind = 1 AND total = 1").select("h1", "h2", *key, "start")
    parts = counted.where("kind = 1 AND start >= -1 AND t1 IS NOT NULL AND t2 IS NOT NULL")
    common = parts.groupBy("h1", "h2", "salt").agg(F.max("total").alias("total"))
    common = common.groupBy("h1", "h2").agg(F.sum("total").alias("sum")).where("sum > 1")
    alone = alone.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")
    hits = met.where(f"total > 1 AND kind IN (0, 1, {KNOWN})").select(*key, "start").union(alone.select(*key, "start"))
    hits = hits.groupBy(*key).agg(F.collect_set("start").alias("starts"))

    marked = source.join(owners, key).join(hits, key, "left").select("doc_id", "text", "copies", "starts")
    schema = f"doc_id {id_type}, kept_text string, n_words long, n_removed long, removed array<struct<start:int,stop:int>>"
    return marked.mapInArrow(_cut(window), schema)


def passage_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256."""
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
spread AS (
  SELECT doc_id, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM words),
windows AS (
  SELECT doc_id, pos, word,
         CASE WHEN pos + 34 <= size THEN string_agg(word, ' ') OVER (
           PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS w
  FROM spread),
counted AS (SELECT doc_id, pos, word, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS again FROM windows),
covered AS (
  SELECT doc_id, pos, word, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM counted)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(c.n_removed, 0) AS n_removed,
       sha256(coalesce(c.kept, '')) AS kept_sha256
FROM words d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
