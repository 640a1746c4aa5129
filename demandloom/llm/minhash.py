"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its five-word shingles, the weight being how
often a shingle occurs. The similarity is the probability Jaccard index; where no
shingle repeats it is the plain Jaccard index. A signature is drawn by Poisson
processes: every shingle sends arrivals at a rate equal to its weight, each
arrival lands in a random component, and a component keeps the shingle that
arrived first. A shingle stops as soon as its next arrival is later than all
components' first ones, so long documents cost about one arrival per shingle.

Documents that share a band of components are candidates. Copies are folded
first. In each band bucket all members are compared with the first one; buckets whose
members then are one component are finished. In the others the members of different
components meet block by block, and pairs whose signatures, in all components, come near the
similarity are verified there. A task returns a spanning set of the links it finds. So no link
between two different texts is lost to the classes, but by the stated chance of a signature,
and groups that hang together never list their pairs.

Defined results: words are runs of letters, digits and characters beyond ASCII,
lower-cased. A document of fewer than five words is one shingle; one without words is
like no other and is its own class. A document is an id with a text: rows that repeat both are one
document, rows that repeat an id with another text are another one, and both texts may have copies. A null id
comes after all others; a class of documents without ids only has a null class id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm import hashing as H
from demandloom.llm.components import connected_components
from demandloom.llm.tables import pick, stage

SHINGLE = 5
SIMILARITY = 0.8
# At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS = 32
ROWS = 5
# Components of a signature; the bands take the first BANDS * ROWS, estimates take all.
COMPONENTS = 320
# A pair is not verified if its estimate lies this many standard deviations below the similarity asked for.
DEVIATIONS = 4.5
# Members of a bucket, and their words, that are compared with as many others at once.
BLOCK = 512
BLOCK_WORDS = 500_000
# Arrivals drawn at once for a batch of texts whose shingles are few.
_ARRIVALS = 1 << 16


def shingles(words: H.Words, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text and hash."""
    hashes = words.hashes(lane)
    starts, windows = H.window_hashes(hashes, words.first, size, lane)
    text = words.text_of_word()[starts]
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < size))
    if len(short):
        whole = H.sequence_hashes(hashes, words.first, lane)[short]
        text, windows = np.append(text, short), np.append(windows, whole)
    order = np.lexsort((windows, text))
    text, windows = text[order], windows[order]
    heads = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (windows[1:] != windows[:-1]))) if len(text) else text
    return text[heads], windows[heads], np.diff(np.append(heads, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, components: int) -> np.ndarray:
    """ProbMinHash of every text: per component the shingle whose Poisson process arrives first.

    All texts of a batch advance together, one arrival per living shingle and round; the
    fewer are left, the more arrivals each draws at once.
    """
    first = np.full(n * components, np.inf)
    owner = np.zeros(n * components, np.uint64)
    clock, drawn = np.zeros(len(shingle)), 0
    while len(shingle):
        ahead = max(1, min(256, _ARRIVALS // len(shingle)))
        numbers = np.arange(drawn + 1, drawn + ahead + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seed = H.mix(shingle[:, None] + numbers)
        uniform = ((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        times = np.cumsum(np.column_stack([clock, -np.log(uniform) / weight[:, None]]), axis=1)[:, 1:]
        target = text[:, None] * components + (
            (seed & np.uint64(0x7FF)) * np.uint64(components) >> np.uint64(11)
        ).astype(np.int64)
        np.minimum.at(first, target.ravel(), times.ravel())
        won = first[target] == times
        owner[target[won]] = np.broadcast_to(shingle[:, None], target.shape)[won]
        latest = first.reshape(n, components).max(axis=1)
        drawn, clock = drawn + ahead, times[:, -1]
        alive = clock < latest[text]
        text, shingle, weight, clock = (v[alive] for v in (text, shingle, weight, clock))
    return owner.reshape(n, components)


def _signature_rows(size: int, bands: int, rows: int, components: int):
    """(doc, h, t1, t2, n_words, bands, signature): 128 bits naming the word sequence, one hash per band, one byte per component."""
    spread = H._power_tables(H.WORD_BASES[1], rows)[0][:rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in H.text_slices(batch.column("text"), H.SLICE_BYTES // 2):
                part = batch.slice(low, high - low)
                words = H.Words(part.column("text"), H.NOT_WORD)
                n = len(part)
                drawn = signatures(*shingles(words, size), n, components)
                banded = drawn[:, : bands * rows].reshape(n, bands, rows)
                by_band = H.mix((banded * spread).sum(axis=2, dtype=np.uint64))
                whole = [H.as_long(H.sequence_hashes(words.hashes(lane), words.first, lane)) for lane in (0, 1)]
                flat = pa.array(H.as_long(by_band.ravel()))
                short = (drawn >> np.uint64(56)).astype(np.uint8)
                yield pa.record_batch(
                    {
                        "doc": part.column("doc"),
                        "h": part.column("h"),
                        "t1": pa.array(whole[0]),
                        "t2": pa.array(whole[1]),
                        "n_words": pa.array(words.lengths.astype(np.int64)),
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat),
                        "signature": pa.array([x.tobytes() for x in short], pa.binary()),
                    }
                )

    return run


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets given as (sorted hashes, counts).

    The sum over common elements d of 1 / sum over e of max(a_e / a_d, b_e / b_d); the
    inner sums are running sums over elements ordered by the ratio of their weights.
    """
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    if (x[common] == 1).all() and (y[common] == 1).all() and x.max() == 1 and y.max() == 1:
        return float(common.sum() / len(both))
    # max(x_e / x_d, y_e / y_d) is the first where x_e / y_e >= x_d / y_d
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, common = x[order], y[order], ratio[order], common[order]
    x_from = np.append(np.cumsum(x[::-1])[::-1], 0.0)
    y_below = np.append(0.0, np.cumsum(y))
    at = np.searchsorted(ratio, ratio[common], side="left")
    return float((1.0 / (x_from[at] / x[common] + y_below[at] / y[common])).sum())


def _verify_rows(size: int, similarity: float):
    """(a, b, similar) for each pair of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = np.zeros(len(batch), bool)
            for low, high in H.text_slices(batch.column("text_b")):
                sides = []
                for name in ("text_a", "text_b"):
                    words = H.Words(batch.column(name).slice(low, high - low), H.NOT_WORD)
                    text, shingle, count = shingles(words, size)
                    sides.append((np.searchsorted(text, np.arange(high - low + 1)), shingle, count))
                for row in range(high - low):
                    a, b = ((s[at[row] : at[row + 1]], c[at[row] : at[row + 1]]) for at, s, c in sides)
                    similar[low + row] = probability_jaccard(a, b) >= similarity - 1e-12
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similar": pa.array(similar)})

    return run


def _spanning(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, blocks, half, band, id, component) of the members of buckets that span several components.

    A bucket is cut into blocks of bounded members and words, and ``half`` is the block of the member. Buckets
    meet their members block by block, so a hot bucket is dealt over tasks.
    """
    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("half", F.pmod(F.hash("id"), F.col("blocks")))
    spans = placed.groupBy("bucket", "blocks").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    halves = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("half")
    placed = placed.join(spans.where("low < high").select("bucket", halves), ["bucket", "half"], "left_semi")
    return placed.select("bucket", "blocks", "half", "band", "id", "component")


def _cross_rows(cut: float, size: int, similarity: float):
    """(a, b): links between members of one bucket and two components, a spanning set for each two blocks.

    Rows come sorted by bucket and pair of blocks. A pair is compared in the first band it shares only, exactly
    if its signatures agree in at least ``cut`` components, and not at all once links join its members.
    """

    def likely(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        half, band = group.column("half").to_numpy(), group.column("band")[0].as_py()
        sides = [np.flatnonzero(half == group.column(c)[0].as_py()) for c in ("left", "right")]
        one_block = group.column("left")[0].as_py() == group.column("right")[0].as_py()
        parts = group.column("component").to_numpy(zero_copy_only=False)
        signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(group), -1)
        bands = group.column("bands").flatten().to_numpy().reshape(len(group), -1)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for low in range(0, len(sides[0]), 32):
            some = sides[0][low : low + 32]
            agree = (signs[some][:, None, :] == signs[sides[1]][None, :, :]).sum(axis=2)
            x, y = np.nonzero((agree >= cut) & (parts[some][:, None] != parts[sides[1]][None, :]))
            x, y = some[x], sides[1][y]
            mine = (bands[x] == bands[y]).argmax(axis=1) == band if len(x) else np.empty(0, bool)
            mine &= (x < y) | (not one_block)
            found.append((x[mine], y[mine]))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))

    def compare(group: pa.RecordBatch) -> pa.RecordBatch:
        x, y = likely(group)
        rows = np.unique(np.append(x, y))
        words = H.Words(group.column("text").take(pa.array(rows)), H.NOT_WORD)
        text, shingle, count = shingles(words, size)
        at = np.searchsorted(text, np.arange(len(rows) + 1))
        sets = [(shingle[low:high], count[low:high]) for low, high in zip(at, at[1:], strict=False)]
        place = dict(zip(rows.tolist(), range(len(rows)), strict=True))
        # members of one component are joined from the start
        parts = group.column("component").to_pylist()
        root: dict = {}

        def top(part):
            while (above := root.get(part, part)) != part:
                root[part] = root.get(above, above)
                part = above
            return part

        links = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            high, low = top(parts[a]), top(parts[b])
            if high != low and probability_jaccard(sets[place[a]], sets[place[b]]) >= similarity - 1e-12:
                root[high] = low
                links.append((a, b))
        ids = group.column("id")
        return pa.record_batch({c: ids.take(pa.array([p[i] for p in links], pa.int64())) for i, c in enumerate("ab")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "left", "right")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), len(batch)]
            for low, high in zip(edges, edges[1:], strict=False):
                part = batch.slice(low, high - low)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("bucket", "left", "right")):
                    yield compare(_joined(held))
                    held = []
                held.append(part)
        if held:
            yield compare(_joined(held))

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _cross_links(spanning: DataFrame, texts: DataFrame, size: int, similarity: float, components: int) -> DataFrame:
    """(a, b): verified links among members of one bucket and different components, found block by block.

    Every two blocks of a bucket meet in a group of their own. What leaves a task is linear in what it has read.
    """
    placed = spanning.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "bucket", F.least("half", "other").alias("left"), F.greatest("half", "other").alias("right"),
        "half", "band", "id", "component",
    )
    placed = placed.join(texts, "id")
    grouped = placed.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "id")
    chance = similarity + (1 - similarity) / 256
    cut = components * (chance - DEVIATIONS * np.sqrt(chance * (1 - chance) / components))
    id_type = spanning.schema["id"].dataType.simpleString()
    return stage(grouped.mapInArrow(_cross_rows(cut, size, similarity), f"a {id_type}, b {id_type}"))


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, class_id, kept, n_rows, n_links), one row per document, an id with a text.

    ``class_id`` is the smallest doc_id of the class, and ``kept`` holds for one document of it, the first by
    id and hash of text. ``n_rows`` counts the rows that repeat the document; ``n_links`` counts the
    verified links of the document's text to different texts (a spanning set, not all pairs).
    """
    source = pick(docs, doc=doc_id, text=text)
    source = source.select("doc", F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    id_type = source.schema["doc"].dataType.simpleString()
    components = max(COMPONENTS, bands * rows)
    signed = source.mapInArrow(
        _signature_rows(size, bands, rows, components),
        f"doc {id_type}, h long, t1 long, t2 long, n_words long, bands array<long>, signature binary",
    )
    # one row per document; rows with the same text have the same signature
    any_row = F.first(F.struct("t1", "t2", "n_words", "bands", "signature")).alias("s")
    signed = stage(signed.groupBy("doc", "h").agg(any_row, F.count("*").alias("n_rows")).select("doc", "h", "n_rows", "s.*"))
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "h")
    filled = signed.where("n_words > 0")
    # one node per text, numbered in a written table, so that it keeps its number in every use
    nodes = filled.groupBy("t1", "t2").agg(F.min(place).alias("head"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("id"), "t1", "t2", "head"))
    owned = filled.select("doc", "h", "n_rows", "t1", "t2").join(nodes.drop("head"), ["t1", "t2"]).drop("t1", "t2")

    head = nodes.select("id", F.col("head.doc").alias("head_doc"), F.col("head.h").alias("head_h"))
    heads = filled.join(head, (F.col("h") == F.col("head_h")) & F.col("doc").eqNullSafe(F.col("head_doc")))
    spread = heads.select("id", "n_words", F.posexplode("bands").alias("band", "hash"))
    spread = spread.select("id", "n_words", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = spread.groupBy("bucket").agg(
        F.count("*").alias("size"), F.sum("n_words").alias("words"), F.min("id").alias("first")
    )
    members = stage(spread.drop("n_words").join(shared.where("size > 1"), "bucket"))
    involved = members.select("id").distinct()
    names = heads.join(involved, "id", "left_semi").select("id", "head_doc", "head_h", "bands", "signature")
    texts = source.join(names, (F.col("h") == F.col("head_h")) & F.col("doc").eqNullSafe(F.col("head_doc")))
    texts = stage(texts.select("id", "bands", "signature", "text").dropDuplicates(["id"]))

    pairs = members.where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    links = _verified(pairs, texts.select("id", "text"), size, similarity)
    labels = stage(connected_components(links))
    # the two members of a pair have met
    spanning = _spanning(members.where("size > 2"), labels)
    more = _cross_links(spanning, texts, size, similarity, components)
    if not more.isEmpty():
        links = links.union(more)
        labels = connected_components(links)

    ends = links.distinct()
    ends = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id")))
    counts = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    placed = owned.join(labels.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id")).drop("id")
    # a component is known by some node; the class is named after its first document
    first = placed.groupBy("component").agg(F.min(place).alias("head"))
    none = F.lit(0).cast("long")
    found = placed.join(first, "component").select(
        F.col("doc").alias("doc_id"), F.col("h").alias("text_hash"), F.col("head.doc").alias("class_id"),
        (F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("h") == F.col("head.h"))).alias("kept"),
        "n_rows", F.coalesce("n_links", none).alias("n_links"),
    )
    alone = signed.where("n_words = 0").select(
        F.col("doc").alias("doc_id"), F.col("h").alias("text_hash"), F.col("doc").alias("class_id"),
        F.lit(True).alias("kept"), "n_rows", none.alias("n_links"),
    )
    return found.union(alone)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose texts are similar enough, the smaller id first."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = ordered.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    id_type = joined.schema["a"].dataType.simpleString()
    checked = joined.select("a", "b", "text_a", "text_b").mapInArrow(
        _verify_rows(size, similarity), f"a {id_type}, b {id_type}, similar boolean"
    )
    return stage(checked.where("similar").select("a", "b"))
