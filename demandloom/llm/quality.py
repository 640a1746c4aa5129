"""Quality scores from a generalised additive model with pairwise interactions.

Cyclic boosting: each round visits every feature in turn and adds a small
shallow tree on that feature's bins to the feature's lookup table; then pairs of
features with the strongest joint signal are boosted the same way. A score is
the sum of one table entry per feature and per pair, through the logistic function.

Features are counts over the whole text, computed for a batch of texts at once
from their bytes. The model is fitted on the driver from at most ``max_rows``
labelled ids (those with the smallest hashes), one text each; its tables are a few kilobytes.

Defined results: null text is empty text and gets a score like any other; labels
that are null are ignored, contradicting labels of one id are averaged; without
labels of both kinds every score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm import hashing as H
from demandloom.llm.tables import pick

MAX_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 32
COARSE = 8

_SYMBOLS = H.byte_class("23-26 2A 2B 3C-3E 40 5B-60 7B-7E")
_CLASSES = {
    "upper": H.byte_class("41-5A"),
    "lower": H.byte_class("61-7A"),
    "digit": H.byte_class("30-39"),
    "stop": H.byte_class("2E"),
    "comma": H.byte_class("2C 3A-3B"),
    "shout": H.byte_class("21 3F"),
    "symbol": _SYMBOLS,
    "beyond_ascii": H.byte_class("80-FF"),
    "line_end": H.byte_class("0A"),
}
FEATURES = [
    "log_words", *_CLASSES, "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word",
    "same_as_previous", "distinct_pairs", "odd_endings", "lone_symbols", "capitalised", "words_per_line",
]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, largest count of one value) per text."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.empty(0, np.int64)
    counts = np.diff(np.append(heads, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, t[heads], counts)
    return np.bincount(t[heads], minlength=n).astype(float), most


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    out = []
    for low, high in H.text_slices(texts):
        words = H.Words(texts.slice(low, high - low), H.WHITE_SPACE)
        n = high - low
        text, data = words.text_of_word(), words.bytes
        size = _per_text((words.ends - words.starts).astype(float), words.first)
        some = np.maximum(words.lengths, 1).astype(float)
        length = (words.ends - words.starts).astype(float)
        hashes = words.hashes()
        spread = _per_text(length**2, words.first) / some - (size / some) ** 2
        longest = np.zeros(n)
        np.maximum.at(longest, text, length)
        distinct, top = _distinct(hashes, text, n)
        follows = np.append(False, text[1:] == text[:-1]) if len(text) else np.empty(0, bool)
        previous = np.roll(hashes, 1)
        pairs, _ = _distinct(H.mix(hashes + H.mix(previous))[follows], text[follows], n)
        last, head = data[words.ends - 1], data[words.starts]
        odd = _SYMBOLS[last] | _CLASSES["shout"][last]
        lone = (length == 1) & _SYMBOLS[head]
        # bytes of a text: from its first byte to the separator behind it
        edges = np.append(0, np.flatnonzero(_text_ends(texts, low, high, len(data))) + 1)
        shares = []
        bytes_in = np.maximum(np.diff(edges) - 1, 1).astype(float)
        for table in _CLASSES.values():
            marks = table[data]
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(marks, out=sums[1:])
            shares.append((sums[edges[1:]] - sums[edges[:-1]]) / bytes_in)
        lines = shares[-1] * bytes_in + 1
        columns = [
            np.log1p(words.lengths), *shares, size / some, np.sqrt(np.maximum(spread, 0)), longest, distinct / some,
            top / some, _per_text((follows & (hashes == previous)).astype(float), words.first) / some,
            (pairs + 1) / some, _per_text(odd.astype(float), words.first) / some,
            _per_text(lone.astype(float), words.first) / some,
            _per_text(_CLASSES["upper"][head].astype(float), words.first) / some, words.lengths / lines,
        ]
        out.append(np.column_stack(columns))
    return np.vstack(out) if out else np.empty((0, len(FEATURES)))


def _text_ends(texts: pa.Array, low: int, high: int, size: int) -> np.ndarray:
    """Marks the byte that was put behind each text."""
    marks = np.zeros(size, bool)
    lengths = pc.binary_length(texts.slice(low, high - low)).fill_null(0).to_numpy(zero_copy_only=False)
    marks[np.cumsum(lengths.astype(np.int64) + 1) - 1] = True
    return marks


@dataclass
class AdditiveModel:
    """``edges`` cut each feature into bins; ``tables`` and ``pair_tables`` hold what each bin adds."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray = field(default_factory=lambda: np.empty((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.empty((0, COARSE, COARSE)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        return np.column_stack(columns) if columns else np.empty((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = self.bins(x)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[_coarse(bins[:, a]), _coarse(bins[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * COARSE // BINS


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values per bin of the best tree of ``depth`` cuts over ordered bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total = _gain(g.sum(), h.sum())
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - total
    if not depth or not len(gains) or gains.max() <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    cut = int(gains.argmax()) + 1
    return np.append(_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best pair of cuts, one on each of two features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(c: np.ndarray) -> np.ndarray:
        top, side = c[:-1, -1:], c[-1:, :-1]
        a = c[:-1, :-1]
        return np.stack([a, top - a, side - a, c[-1, -1] - top - side + a])

    qg, qh = corners(cg), corners(ch)
    gains = _gain(qg, qh).sum(0)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    leaf = qg[:, i, j] / (qh[:, i, j] + 1.0)
    values = np.empty_like(g)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaf[0], leaf[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return float(gains[i, j]), values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 6, rate: float = 0.2) -> AdditiveModel:
    """Boosts main effects feature by feature, then the pairs that explain most of what is left."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return AdditiveModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    model = AdditiveModel(float(np.log(share / (1 - share))))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(column, quantiles)) for column in x.T]
    model.tables = np.zeros((x.shape[1], BINS))
    bins = model.bins(x)
    raw = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(x.shape[1]):
            g, h = slopes()
            by_bin = [np.bincount(bins[:, f], weights=w, minlength=BINS) for w in (g, h)]
            step = rate * _shallow_tree(*by_bin, depth=2)
            model.tables[f] += step
            raw += step[bins[:, f]]

    coarse = _coarse(bins)
    cells = {
        (a, b): coarse[:, a] * COARSE + coarse[:, b] for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])
    }

    def joint(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        grids = [np.bincount(cells[pair], weights=w, minlength=COARSE**2).reshape(COARSE, COARSE) for w in slopes()]
        return _quadrants(*grids)

    model.pairs = sorted(cells, key=lambda p: -joint(p)[0])[:n_pairs]
    model.pair_tables = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for k, pair in enumerate(model.pairs):
            step = rate * joint(pair)[1]
            model.pair_tables[k] += step
            raw += step.ravel()[cells[pair]]
    return model


def held_out(doc_id: Column) -> Column:
    """The fifth of ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled documents outside the held-out part, one row per id."""
    known = pick(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(known), "doc_id")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "label": batch.column("label"),
                    "h": batch.column("h"),
                    "x": pa.array(list(x), pa.list_(pa.float64())),
                }
            )

    found = rows.select("doc_id", "label", F.xxhash64("text").alias("h"), "text")
    found = found.mapInArrow(run, f"doc_id {id_type}, label double, h long, x array<double>")
    # an id that is repeated is one row, its first text by hash; so the bound on ids is one on rows and takes no more away
    found = found.groupBy("doc_id").agg(F.min(F.struct("h", "label", "x")).alias("first")).select("first.label", "first.x")
    # the order of rows must not change the fit
    found = found.orderBy("label", "x").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return x, (found["label"].to_numpy() >= 0.5).astype(float)


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with score and predicted added in front of any of the same name."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(text_features(batch.column("text")))
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["score"] = pa.array(scores, pa.float64())
            columns["predicted"] = pa.array((scores >= threshold).astype(np.int32))
            yield pa.record_batch(columns)

    return schema.mapInArrow(run, f"{types}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    model = fit(*training_rows(docs, labels, max_rows))
    source = pick(docs, doc_id="doc_id", text="text")
    scored = score_quality(source, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
