"""Quality classifier by Bradley-Terry ranking of preference pairs.

Features. Steadied rates of the quality counts (symbols, repetition, capitals, marks, lengths), and learned ones: the
shares of a text's words, and of its three-byte runs, that hash into each of ``WORD_BINS`` and ``RUN_BINS`` bins, as square
roots less those of an even spread's share. So wording counts, and not just counts of marks.

Learning. All labelled texts outside the held-out fold are learnt from; their feature vectors, never
their language, source or id, lie in a table of the shared folder. Each text of label 1 is preferred
to each text of label 0. The score of a text is linear in its features; the chance that a is preferred to b is the
logistic function of the difference of their scores, so the loss is logistic in feature differences. It is minimised
over all pairs, by Newton steps with a ridge term (a stronger one for bins): a text's part of the gradient depends on its own
score and on how the scores of the other label lie, which is counted on a grid of ``GRID`` steps a unit, with scores
between two steps shared out (chances within 2e-6). Curvature is taken at scores in bins of ``COARSE`` a unit, which sets the steps and
not where they end. Every step reads the table twice; ``SUM_TASKS`` sums reach the driver.

Threshold. On the learning texts, the score quantile at the share of label 0
(halfway over the gap there) is where 0.7 lies on the scale from 0 to 1. Quantiles are exact, by counts of narrowing ranges.

Scoring is one pass over the texts, with the weights as parameters of the task.

Defined results. A null or empty text has the features of no words and gets a
score; repeated rows get equal scores; repeated or null labels of an id count once
with their least value, ids without a label are not learnt from; of several texts of an id the one of the least
digest is learnt from; without labels of
both values every score is 0.5; an empty table gives an empty result. Columns named
in ``carry`` are kept, and one that clashes with a result column is refused.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import STATS, count_texts
from .shared import few, settle, small_batches
from .textkit import LOWER, Spans, U, mix, text_pieces, words

GRID, COARSE = 256, 2
SUM_TASKS = 24
WORD_BINS, RUN_BINS = 96, 96
RIDGE, BIN_RIDGE = 3e-3, 3e-2
CUT = 0.7
_FOLD_OF = "crc32(cast(cast({} as string) as binary)) % 4"


def rates(counts: np.ndarray) -> np.ndarray:
    """Rates of STATS, steadied for short texts; a column of squares lets mid rates differ from high ones."""
    c = {k: counts[:, i].astype(float) for i, k in enumerate(STATS)}
    n = c["n_words"]
    found = [
        np.sqrt(c["n_symbols"] / (n + 5)),
        np.sqrt(c["n_repeat_words"] / (n + 5)),
        np.sqrt(c["n_dup_lines"] / (c["n_lines"] + 2)),
        np.sqrt(c["n_capitals"] / (c["n_letters"] + 25)),
        np.sqrt(c["n_marks"] / (n + 5)),
        1 - (c["n_distinct_words"] + 10) / (np.minimum(n, 60) + 10) * np.where(n > 60, 60 / np.maximum(n, 1), 1),
        np.log((c["word_chars"] + 50) / (n + 10)) - math.log(5),
        np.log1p(n) / 10,
        1 / (1 + n),
    ]
    x = np.minimum(np.stack(found, 1), 3)
    return np.concatenate([x, np.minimum(x[:, :5], 0.5)], 1)


def _binned(owner: np.ndarray, hashes: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """Roots of the shares of a text's hashes in each bin, steadied by an even spread of one hash a bin."""
    at = owner * bins + (hashes >> U(32)).astype(np.int64) % bins
    found = np.bincount(at, minlength=texts * bins).reshape(texts, bins)
    return np.sqrt((found + 1.0) / (found.sum(1, keepdims=True) + bins)) - math.sqrt(1 / bins)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text of a buffer: rates, bins of words (A-Z lowered), bins of three-byte runs."""
    n, low = len(offsets) - 1, LOWER[data]
    starts, ends, firsts = words(low, offsets)
    by_word = _binned(np.repeat(np.arange(n), np.diff(firsts)), Spans(low).hashes(starts, ends), n, WORD_BINS)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    code = low.astype(U)
    run = np.flatnonzero(owner[2:] == owner[:-2]) if len(low) > 2 else np.zeros(0, np.int64)
    by_run = _binned(owner[run], mix(code[run] | code[run + 1] << U(8) | code[run + 2] << U(16)) if len(run) else np.zeros(0, U), n, RUN_BINS)
    return np.concatenate([rates(count_texts(data, offsets)), by_word, by_run], 1)


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of a batch of the training table."""
    raw = batch.column("x").to_pylist()
    return batch.column("y").to_numpy(), np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)


def _collected(table: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], object], add: Callable) -> list:
    """What kernel(y, x) gives for the batches of each of SUM_TASKS tasks, put together by add, in the tasks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = kernel(*_rows_of(batch))
                total = got if total is None else add(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["part", "data"])

    found = sorted(table.select("y", "x").coalesce(SUM_TASKS).mapInArrow(run, "part int, data binary").collect())
    return [pickle.loads(bytes(r.data)) for r in found]


def _added(one: dict[int, float], two: dict[int, float]) -> dict[int, float]:
    for k, v in two.items():
        one[k] = one.get(k, 0.0) + v
    return one


def _spread(s: np.ndarray, y: np.ndarray) -> list[dict[int, float]]:
    """Counts of label 0 and 1 on the grid, a score between two steps shared out; then in coarse bins."""
    out = []
    for label in (0, 1):
        at = s[y == label] * GRID
        low = np.floor(at).astype(np.int64)
        steps, place = np.unique(np.concatenate([low, low + 1]), return_inverse=True)
        mass = np.bincount(place, np.concatenate([low + 1 - at, at - low]), len(steps))
        out.append(dict(zip(steps.tolist(), mass.tolist(), strict=True)))
    for label in (0, 1):
        bins, n = np.unique(np.floor(s[y == label] * COARSE).astype(np.int64), return_counts=True)
        out.append(dict(zip(bins.tolist(), n.astype(float).tolist(), strict=True)))
    return out


def _dense(zero: dict[int, float], one: dict[int, float]) -> tuple[int, np.ndarray, np.ndarray]:
    """The first step, and the counts of both labels from there on."""
    low, high = min(*zero, *one), max(*zero, *one)
    both = np.zeros((2, high - low + 1))
    for row, counts in zip(both, (zero, one), strict=True):
        row[np.array(list(counts)) - low] = list(counts.values())
    return low, both[0], both[1]


def _seen(counts: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For every step k the sum over steps l of counts[l] * f(k - l)."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(f(np.arange(1 - n, n)), size), size)[n - 1 : 2 * n - 1]


def _logistic(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def _step(table: DataFrame, w: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The Newton step from w for the mean loss of all pairs."""
    parts = _collected(table, lambda y, x: _spread(x @ w, y), lambda one, two: [_added(a, b) for a, b in zip(one, two, strict=True)])
    counts: list[dict[int, float]] = [{}, {}, {}, {}]
    for part in parts:
        counts = [_added(a, b) for a, b in zip(counts, part, strict=True)]
    low, zero, one = _dense(*counts[:2])
    # of label 0: the chances that the texts of label 1 lose to it; of label 1: that it loses to those of label 0
    pull = -_seen(one, lambda d: _logistic(d / GRID)), _seen(zero, lambda d: _logistic(-d / GRID))
    first, bad, good = _dense(*counts[2:])
    bend = lambda d: (p := _logistic(d / COARSE)) * (1 - p)
    curve = _seen(good, bend), _seen(bad, bend)
    bins, width = len(bad), len(w)

    def sums(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = x @ w
        at = s * GRID
        k = np.floor(at).astype(np.int64) - low
        share, q = at - low - k, np.floor(s * COARSE).astype(np.int64) - first
        force, weight = ((np.where(y == 1, f(1), f(0))) for f in (lambda i: pull[i][k] * (1 - share) + pull[i][np.minimum(k + 1, len(zero) - 1)] * share, lambda i: curve[i][q]))
        by_bin = np.zeros((2 * bins, width))
        np.add.at(by_bin, y * bins + q, x)
        return np.concatenate([(force @ x)[None], (x * weight[:, None]).T @ x, by_bin])

    total = sum(_collected(table, sums, np.add))
    pairs = zero.sum() * one.sum()
    met = total[1 + width : 1 + width + bins].T @ bend(np.subtract.outer(np.arange(bins), np.arange(bins))) @ total[1 + width + bins :]
    hessian = (total[1 : 1 + width] - met - met.T) / pairs
    return np.linalg.solve(hessian + np.diag(ridge), total[0] / pairs - ridge * w)


def at_ranks(values: DataFrame, ranks: list[int], ways: int = 1024) -> list[float]:
    """The values (s double) that stand at the ranks, from 0, in ascending order: counts of ever narrower ranges."""
    found: dict[tuple, list] = {}

    def parts(low: float, high: float) -> list:
        if (low, high) not in found:
            place = F.least(F.floor((F.col("s") - low) / (high - low) * ways), F.lit(ways))
            inside = values.filter(F.col("s").between(low, high)).groupBy(place.alias("k"))
            found[low, high] = sorted(inside.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        return found[low, high]

    n, least, most = values.agg(F.count("*"), F.min("s"), F.max("s")).first()
    out = []
    for rank in ranks:
        low, high, count = least, most, n
        while 0 < rank < count - 1 and low < high:
            for r in parts(low, high):
                if rank < r.n:
                    low, high, count = r.low, r.high, r.n
                    break
                rank -= r.n
        out.append(low if rank == 0 else high)
    return out


def learn(table: DataFrame) -> dict:
    """Weights from all preference pairs (label 1 over label 0) of the training table (y, x), and the cut's score."""
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    n = {r.y: r.n for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"w": np.zeros(width), "cut": 0.0, "scale": 0.0}
    ridge = np.where(np.arange(width) < width - WORD_BINS - RUN_BINS, RIDGE, BIN_RIDGE)
    w = np.zeros(width)
    for _ in range(50):
        step = _step(table, w, ridge)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_rows_of(batch)[1] @ w)], ["s"])

    every = n[0] + n[1]
    below, above, low, high = at_ranks(settle(table.select("y", "x").mapInArrow(run, "s double")), [n[0] - 1, n[0], (every - 1) // 4, 3 * (every - 1) // 4])
    return {"w": w, "cut": (below + above) / 2, "scale": 1.0 / max(1.0, (high - low) / 4)}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if not model["scale"]:
        return np.full(len(x), 0.5)
    u = (x @ model["w"] - model["cut"]) * model["scale"] + math.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def training_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int | None = 2) -> DataFrame:
    """(y, x) of all texts of label 0 or 1 outside the held-out fold; x: features as bytes of floats."""
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y")).filter("y in (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if held_out is not None:
        label, texts = (t.filter(F.expr(_FOLD_OF.format("id")) != held_out) for t in (label, texts))
    chosen = small_batches(texts).join(few(settle(label)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column("text")):
                x = pa.array([r.tobytes() for r in features(data, offsets).astype(np.float32)], pa.binary())
                digest = pa.array(Spans(data).hashes(offsets[:-1], offsets[1:]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), digest, x], ["id", "y", "digest", "x"])

    kind = dict(chosen.dtypes)["id"]
    found = chosen.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, digest long, x binary")
    return settle(found.groupBy("id").agg(F.min("y").alias("y"), F.min_by("x", "digest").alias("x")).sortWithinPartitions("id").select("y", "x"))


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, score and predicted of every row, with the columns of carry."""
    picked = small_batches(docs).select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("_text"))
    if clash := {c.lower() for c in carry} & {"score", "predicted", id_col.lower()}:
        raise ValueError(f"carried columns clash with the result: {sorted(clash)}")
    n = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(n)):
                s = scores(features(data, offsets), model)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*picked_names, "score", "predicted"])

    picked_names = picked.columns[:n]
    schema = picked.drop("_text").schema
    schema.add("score", "double").add("predicted", "integer")
    return picked.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn, then score every row: id, held_out, score, predicted."""
    model = learn(training_table(docs, labels, id_col, text_col))
    scored = score_texts(docs, model, id_col, text_col)
    fold = F.coalesce(F.expr(_FOLD_OF.format(f"`{id_col}`")) == 2, F.lit(False))
    return scored.select(id_col, fold.alias("held_out"), "score", "predicted")
