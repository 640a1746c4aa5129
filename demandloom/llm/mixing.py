"""Sources mixed to target weights by a low-discrepancy schedule of equal blocks of words.

Slot numbers become van der Corput points (their bits reversed), which are mapped through the cumulative
weights of the sources; a source's slots are ranked and take its blocks in turn. Its blocks are runs of
``BLOCK_WORDS`` words of its documents in shuffled order. After any number of slots every source is within a
few slots (the logarithm of their number) of its share. A source whose slots fall short at the end gets the
rest after the last point, surplus ones are dropped, and the last slot is cut, so that the words a
source gives are its target rounded to whole words.

Targets share all words by weight; what would exceed ``MAX_EPOCHS`` times a source's size is shared by the others.

The shuffle is a hash of the id, so reruns agree. Documents and slots are numbered by running totals over range
partitions, whatever share a source holds; points meet the sources by bucket of the grid.

Defined results: null or empty text has size 0 and gives no words; a null source is one source, the last; null and
repeated ids are rows of their own (equal rows share what they give in any order); sources without words have target 0;
an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm import ranking
from demandloom.llm.tables import pick, stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
_POINT_BITS = 48
_BUCKET_BITS = 10


def shuffle_key(doc_id: Column) -> Column:
    """60 bits that order the documents of a source at random."""
    text = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def set_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size).

    In rising order of size per weight, let the sources before one be full: the level ``words per weight`` that
    the others would then reach is never above the true one, and is it where exactly those are full. So the true level is
    the largest of all.
    """
    one = F.lit(1).cast("long")
    numbered = ranking.running(sizes.withColumn("all", F.lit(0)), "all", ["source"], {"position": one, "words": F.col("source_size")})
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = stage(
        numbered.select(
            "source", "source_size", "all", F.col("words_all").alias("words"),
            F.get(cycle, F.col("position_before") % len(weights)).cast("long").alias("weight"),
        ).withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    )
    full = {"full": F.col("source_size") * most, "used": F.col("weight")}
    levels = ranking.running(weighted, "all", ["ratio", "source"], full)
    level = levels.agg(F.max((F.col("words") - F.col("full_before")).cast("double") / (F.col("used_all") - F.col("used_before"))))
    # one number
    reached = level.first()[0]
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(reached).cast("double") * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def _needs(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``words`` (the whole words to take), ``blocks`` (per pass over the source) and ``need`` (slots)."""
    size, words = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    ceil = lambda n: F.expr(f"({n} + {block - 1}) div {block}")
    counted = targets.withColumn("words", words).withColumn("blocks", ceil("source_size"))
    rest = F.expr("words div source_size") * F.col("blocks") + ceil("words % source_size")
    return counted.withColumn("need", F.when(size > 0, rest).otherwise(F.lit(0)).cast("long"))


def van_der_corput(number: Column) -> Column:
    """The point of a slot on a grid of 2 ** 48: its bits in reverse."""
    bits = F.lpad(F.bin(number), _POINT_BITS, "0")
    return F.conv(F.reverse(bits), 2, 10).cast("long")


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, epoch, block, n_words, whole): what every slot of the mix takes, in the order of ``slot``.

    Slots that a source is still owed after the last point come last, ordered by source under one number.
    """
    spark = targets.sparkSession
    needed = _needs(targets, block).where("need > 0").withColumn("all", F.lit(0))
    shares = stage(ranking.running(needed, "all", ["source"], {"need": F.col("need")}))
    n = shares.agg(F.coalesce(F.max("need_all"), F.lit(0))).first()[0]
    # the source's part of the grid, and the buckets of the grid that it touches
    bound = lambda c: F.floor(c.cast("double") / F.col("need_all") * float(1 << _POINT_BITS)).cast("long")
    width = 1 << (_POINT_BITS - _BUCKET_BITS)
    parts = shares.select(
        "source", bound(F.col("need_before")).alias("low"), bound(F.col("need_before") + F.col("need")).alias("high")
    ).where("low < high")
    parts = parts.withColumn("bucket", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    points = spark.range(n).withColumnsRenamed({"id": "slot"}).withColumn("point", van_der_corput(F.col("slot")))
    drawn = points.withColumn("bucket", F.expr(f"point div {width}")).join(parts, "bucket")
    drawn = drawn.where("point >= low AND point < high").select("slot", "source")

    placed, offsets = ranking.place(drawn, "source", ["slot"], {"rank": F.lit(1).cast("long")})
    # a source has one row per part here, so what is known of it reaches its slots without their meeting in one task
    shares = shares.select("source", "source_size", "words", "blocks", "need")
    ranked = ranking.number(placed, offsets.join(shares, "source"), "source", ["slot"], ["rank"])
    ranked = ranked.withColumnRenamed("rank_before", "rank").drop("rank_all").where("rank < need")
    had = offsets.groupBy("source").agg(F.max("rank_all").alias("had"))
    owed = shares.join(had, "source", "left").where("coalesce(had, 0) < need")
    owed = owed.withColumns({"slot": F.lit(n), "rank": F.explode(F.expr("sequence(coalesce(had, 0), need - 1)"))}).drop("had")

    used = ranked.unionByName(owed)
    first = F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {block}")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block).cast("long")
    used = used.withColumns({"epoch": F.expr("rank div blocks"), "block": F.expr("rank % blocks"), "_first": first})
    return used.withColumn("whole", whole).select(
        "slot", "source", "epoch", "block", F.least("whole", F.col("words") - F.col("_first")).alias("n_words"), "whole"
    )


def blocks_of(start: str, size: str, block: int) -> Column:
    """The numbers of the blocks that a document's words lie in."""
    return F.expr(f"sequence({start} div {block}, ({start} + {size} - 1) div {block})")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(slots, documents): the schedule, and per document (doc_id, size, source, source_size, target, start, taken).

    ``start`` is the document's first word in its source's shuffled order, so that slots and documents can be joined
    to the mixed stream by block. Sources are named by a ``0`` and their name, the null source by ``1``.
    """
    source = pick(docs, doc_id="doc_id", text="text", source="source")
    sized = source.select(
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("source"),
        "doc_id",
        shuffle_key(F.col("doc_id")).alias("key"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = stage(sized).withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "doc_id", "text_hash", "tie"]
    placed, offsets = ranking.place(sized, "source", order, {"start": F.col("size")})
    sizes = offsets.groupBy("source").agg(F.max("start_all").alias("source_size"))
    targets = stage(set_targets(sizes, weights, most))
    slots = stage(schedule(targets, block))

    offsets = offsets.join(targets, "source")
    rows = ranking.number(placed, offsets, "source", order, ["start"])
    rows = rows.select("doc_id", "size", "source", "source_size", "target", F.col("start_before").alias("start"))
    uses = slots.groupBy("source", "block").agg(F.collect_list("n_words").alias("uses"))  # at most one per epoch
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, blocks_of("start", "size", block))))
    met = pieces.join(uses, ["source", "block"], "left")
    low, high = F.col("block") * block, F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    piece = lambda n: F.greatest(F.lit(0), F.least(high, low + n) - F.greatest(F.col("start"), low))
    given = F.aggregate("uses", F.lit(0).cast("long"), lambda total, n: total + piece(n))
    kept = ["doc_id", "size", "source", "source_size", "target", "start"]
    inside = "size > 0 AND start div {0} = (start + size - 1) div {0}".format(block)
    met = met.select(*kept, F.coalesce(given, F.lit(0)).cast("long").alias("taken"))
    # a document in one block is done; the start names a document of several blocks
    spread = met.where(f"size > 0 AND NOT ({inside})").groupBy(*kept).agg(F.sum("taken").alias("taken"))
    return slots, met.where(f"size = 0 OR ({inside})").unionByName(spread)


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    return mix(docs)[1].select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source,
         CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][
           CAST((row_number() OVER (ORDER BY source) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(source_size * {MAX_EPOCHS}) OVER before, 0) AS filled, coalesce(sum(weight) OVER before, 0) AS used
  FROM sources
  WINDOW before AS (ORDER BY source_size * {MAX_EPOCHS} / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(source_size * {MAX_EPOCHS} AS DOUBLE),
           (SELECT max(CAST(words - filled AS DOUBLE) / CAST(weights - used AS DOUBLE)) FROM filling) * weight) AS target
  FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
         coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized JOIN targets USING (source))
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
         words // source_size * size + greatest(0, least(size, words % source_size - start)) END AS taken
FROM placed
"""
