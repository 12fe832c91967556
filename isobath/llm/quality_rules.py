"""Quality rules: base counts of every whole text and robust multivariate outliers (minimum covariance determinant).

Counts are taken by one vectorised pass. Six transformed statistics (root rates
and a log mean, each steadied by a prior of a few words, so that short texts are
not outliers for being short) form a vector per text. For each language and
source the minimum-covariance-determinant estimate is sought from three deterministic
starts (medians with deviations from them; spatial signs; tanh correlations) by concentration
steps: the ``KEEP`` share of the smallest Mahalanobis distances, their mean and covariance, again. After
two steps the start of the least determinant goes on until no group's determinant falls. A last step
reweights. Texts whose squared distance passes a chi-square quantile are rejected.

Every group has ``PRIOR`` rows of its language's moments added, and every language as many of all rows', so that
groups of any size, down to one row, are treated by the same rule.

Medians and distance quantiles are exact on a fixed grid (``GRID`` steps a unit, ``RINGS`` rings an octave): counts of
grid cells are added up, so they do not depend on partitions. All steps are grouped aggregations with map-side
combination over a table of a few numbers per text. If the groups are counted to be few (BROADCAST_GROUPS), their estimates are
parameters of the tasks, else rows of tables, met by joins that deal a group's rows to several tasks; the rules are the same.

Defined results. A null text counts as empty; null language and source are values
of their own; repeated rows are counted and judged like others; an empty table
gives an empty result. Columns of the input are kept as they are, whatever their names, but one that is
called like the result column is replaced by it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import salted_join, settle, shared_folder, small_batches
from .textkit import SPACE, Spans, earlier, lines, per_text, shingles, text_pieces, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WIDTH = 5
#: The least standard deviation of each statistic of _vector that a covariance may claim; wider for the repetition rates, whose excess the base rule rejects.
FLOORS = (0.06, 0.06, 0.15, 0.15, 0.06, 0.06)
#: The share of a group that a concentration step keeps.
KEEP = 0.75
STARTS = 3
#: Rows of the language's moments that are added to a group, and of all rows' to a language.
PRIOR = 50.0
GRID = 512
RINGS = 32
#: Fall of the log determinant that is none, and the steps after which the search is given up as an error.
STILL = 1e-3
MOST_STEPS = 100
#: Groups up to which the estimates are broadcast; a group's row has about 1 kB.
BROADCAST_GROUPS = 20_000
#: The chance of a larger squared distance at the cutoff, for a normal vector.
TAIL = 1e-9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_letters", "n_capitals", "n_marks", "n_distinct_words")
STATS = COUNTS + EXTRA

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def count_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text of a buffer."""
    out = np.zeros((len(offsets) - 1, len(STATS)), np.int64)
    spans = Spans(data)
    starts, ends, firsts = words(data, offsets)
    hashes = spans.hashes(starts, ends)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    inner = ~SPACE[data]
    out[:, 0] = np.diff(firsts)
    out[:, 1] = per_text(inner & ((data & 0xC0) != 0x80), offsets)
    out[:, 2] = per_text(_SYMBOL[data], offsets)
    line_starts, line_ends, line_firsts = lines(data, offsets)
    filled = np.concatenate([[0], np.cumsum(inner)])
    filled = filled[line_ends] > filled[line_starts]
    line_owner = np.repeat(np.arange(len(line_firsts) - 1), np.diff(line_firsts))
    _, repeated = earlier(spans.hashes(line_starts[filled], line_ends[filled]), line_owner[filled])
    np.add.at(out[:, 3], line_owner[filled][repeated], 1)
    windows, at = shingles(hashes, firsts, REPEAT_WIDTH)
    found, _ = earlier(windows, owner[at])
    covered = np.zeros(len(hashes), bool)
    for k in range(REPEAT_WIDTH):
        covered[at[found] + k] = True
    out[:, 4] = per_text(covered, firsts)
    np.add.at(out[:, 5], line_owner[filled], 1)
    out[:, 6] = per_text(_LETTER[data], offsets)
    out[:, 7] = per_text(_CAPITAL[data], offsets)
    out[:, 8] = per_text(_MARK[data], offsets)
    _, again = earlier(hashes, owner)
    out[:, 9] = per_text(~again, firsts)
    return out


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(_row, _stats): a struct of docs' columns, without the text unless keep_text, and a struct of STATS."""
    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    packed = small_batches(docs).select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("_stats", T.StructType([T.StructField(c, T.LongType()) for c in STATS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                counts = count_texts(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(len(STATS))], list(STATS))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), struct], ["_row", "_stats"])

    return packed.mapInArrow(run, schema)


def base_failed(stats: str):
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def _vector(stats: str) -> list:
    s = {c: F.col(f"{stats}.{c}").cast("double") for c in STATS}
    rate = lambda x, n, prior: F.sqrt(F.least(F.lit(4.0), s[x] / (s[n] + prior)))
    return [
        F.log((s["word_chars"] - s["n_symbols"] + 250) / (s["n_words"] + 50)),
        rate("n_symbols", "n_words", 20),
        rate("n_dup_lines", "n_lines", 5),
        rate("n_repeat_words", "n_words", 20),
        rate("n_capitals", "n_letters", 60),
        rate("n_marks", "n_words", 20),
    ]


DIM = 6


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 400):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_cdf(x: float, k: int) -> float:
    return _gamma_p(k / 2, x / 2)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def consistency(share: float, k: int = DIM) -> float:
    """What the covariance of the central share of a normal sample is multiplied with."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


UPPER = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: Places of a moment row: the count, the sums, the products of UPPER.
MOMENTS = 1 + DIM + len(UPPER)


def _sums(values: list) -> F.Column:
    """The moment row of some columns."""
    return F.array(F.count("*").cast("double"), *[F.sum(x) for x in values], *[F.sum(values[i] * values[j]) for i, j in UPPER])


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("m")[k]) for k in range(MOMENTS)]).alias("m"))


def unpacked(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariances of moment rows."""
    n = np.maximum(m[:, 0], 1e-300)
    mean = m[:, 1 : 1 + DIM] / n[:, None]
    second = np.zeros((len(m), DIM, DIM))
    for k, (i, j) in enumerate(UPPER):
        second[:, i, j] = second[:, j, i] = m[:, 1 + DIM + k] / n
    return m[:, 0], mean, second - mean[:, :, None] * mean[:, None, :]


def with_prior(own: np.ndarray, language: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Moment rows of groups with PRIOR rows of their languages' added, these with PRIOR rows of all."""
    wide = language + PRIOR * every / np.maximum(every[:, :1], 1)
    return own + PRIOR * wide / np.maximum(wide[:, :1], 1)


_ESTIMATE = "g string, l string, start int, mu array<double>, inv array<double>, det double"


def _estimate_rows(g, l, start, mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    flat = np.linalg.inv(cov).reshape(-1, DIM * DIM)
    return pa.RecordBatch.from_arrays([g, l, start, pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(flat), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])], ["g", "l", "start", "mu", "inv", "det"])


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """(g, l, start, m) to estimates: the mean, the inverse covariance, floored and made consistent, and its log determinant."""
    moments = settle(moments)
    language, every = _added(moments, "l", "start"), _added(moments, "start")
    wide = moments.join(language.withColumnRenamed("m", "ml"), ["l", "start"]).join(F.broadcast(every.withColumnRenamed("m", "ma")), "start").select("g", "l", "start", "m", "ml", "ma")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, lang, every = (np.array(batch.column(c).to_pylist(), float) for c in ("m", "ml", "ma"))
                _, mean, cov = unpacked(with_prior(own, lang, every))
                yield _estimate_rows(*(batch.column(c) for c in ("g", "l", "start")), mean, cov * factor + np.diag(np.square(FLOORS)))

    return settle(wide.mapInArrow(run, _ESTIMATE))


def _distance(v: str = "v"):
    d = [F.col(v)[k] - F.col("mu")[k] for k in range(DIM)]
    terms = [d[i] * d[j] * F.col("inv")[i * DIM + j] for i in range(DIM) for j in range(DIM)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _ring(d2: F.Column) -> F.Column:
    """The number of a squared distance's ring; rings widen with the distance."""
    return F.floor(F.log2(1 + F.least(F.greatest(d2, F.lit(0.0)), F.lit(1e12))) * RINGS)


def _quantile(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and the least bin up to which at least the share of their rows lies. rows: keys and bin."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    own = W.partitionBy(*keys)
    placed = counts.select(*keys, "bin", F.sum("n").over(own.orderBy("bin")).alias("below"), F.sum("n").over(own).alias("all"))
    return placed.filter(F.col("below") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("bin"))


class Groups:
    """The rows (g, l, v) of sound texts, and the way to bring a row of each group to them."""

    def __init__(self, rows: DataFrame):
        self.rows = settle(rows)
        self.few = self.rows.select("g").distinct().count() <= BROADCAST_GROUPS

    def meet(self, rows: DataFrame, per_group: DataFrame, spread: str = "v") -> DataFrame:
        return rows.join(F.broadcast(per_group), "g", "left") if self.few else salted_join(rows, per_group, ["g"], spread, "left")


def _middles(groups: Groups, centre: DataFrame | None = None) -> DataFrame:
    """(g, med): the medians of each statistic, or of its distance from a centre, at the middle of a grid step."""
    rows = groups.rows.select("g", "v") if centre is None else groups.meet(groups.rows.select("g", "v"), centre)
    values = [F.col("v")[k] if centre is None else F.abs(F.col("v")[k] - F.col("med")[k]) for k in range(DIM)]
    cells = rows.select("g", F.posexplode(F.array(*[F.floor(x * GRID) for x in values])).alias("k", "bin"))
    found = _quantile(cells, ["g", "k"], 0.5)
    return settle(found.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "bin"))).alias("m")).select("g", F.transform("m", lambda x: (x["bin"] + 0.5) / GRID).alias("med")))


def start_shapes(signs: np.ndarray, bent: np.ndarray) -> np.ndarray:
    """[group, start]: correlation matrices of no correlation, of spatial signs (moments about the centre, of trace 1) and of bent scores, steadied."""
    _, mean, cov = unpacked(signs)
    by_sign = DIM * (cov + mean[:, :, None] * mean[:, None, :])
    _, _, cov = unpacked(bent)
    deviation = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 1e-12))
    shapes = [np.broadcast_to(np.eye(DIM), cov.shape), by_sign, cov / deviation[:, :, None] / deviation[:, None, :]]
    return 0.9 * np.stack(shapes, 1) + 0.1 * np.eye(DIM)


def _starts(groups: Groups) -> DataFrame:
    """The estimates of every group from the three starts."""
    centre = _middles(groups)
    spread = _middles(groups, centre)
    both = settle(centre.join(spread.withColumnRenamed("med", "mad"), "g"))
    rows = groups.meet(groups.rows, both)
    z = [(F.col("v")[k] - F.col("med")[k]) / F.sqrt(F.pow(1.4826 * F.col("mad")[k], 2) + FLOORS[k] ** 2) for k in range(DIM)]
    rows = rows.select("g", "l", F.array(*z).alias("z"))
    norm = F.sqrt(F.greatest(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-12)))
    signs, bent = [F.col("z")[k] / F.col("norm") for k in range(DIM)], [F.tanh(F.col("z")[k]) for k in range(DIM)]
    moments = rows.withColumn("norm", norm).groupBy("g", "l").agg(_sums(signs).alias("signs"), _sums(bent).alias("bent"))
    wide = moments.join(both, "g").select("g", "l", "signs", "bent", "med", "mad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, bent, med, mad = (np.array(batch.column(c).to_pylist(), float) for c in ("signs", "bent", "med", "mad"))
            scale = np.sqrt(np.square(1.4826 * mad) + np.square(FLOORS))
            shapes = start_shapes(signs, bent)
            for k in range(STARTS):
                yield _estimate_rows(batch.column("g"), batch.column("l"), pa.array([k] * len(med), pa.int32()), med, shapes[:, k] * scale[:, :, None] * scale[:, None, :])

    return settle(wide.mapInArrow(run, _ESTIMATE))


def _concentrated(groups: Groups, estimates: DataFrame) -> DataFrame:
    """One concentration step of every group's estimates (g, l, start, ...)."""
    per_group = estimates.groupBy("g").agg(F.collect_list(F.struct("start", "mu", "inv")).alias("e"))
    near = groups.meet(groups.rows, per_group).select("g", "l", "v", F.explode("e").alias("e")).select("g", "l", "v", "e.start", "e.mu", "e.inv")
    near = near.select("g", "l", "v", "start", _ring(_distance()).alias("bin"))
    most = settle(_quantile(near.select("g", "start", "bin"), ["g", "start"], KEEP).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("start", "bin"))).alias("most")))
    inner = groups.meet(near, most).filter(F.col("bin") <= F.col("most")[F.col("start")])
    return _estimates(inner.groupBy("g", "l", "start").agg(_sums([F.col("v")[k] for k in range(DIM)]).alias("m")), consistency(KEEP))


def _fit_many(groups: Groups) -> DataFrame:
    """The estimates (g, mu, inv) of any number of groups, in tables."""
    now = _starts(groups)
    now = _concentrated(groups, now)
    now = _concentrated(groups, now)
    now = settle(now.groupBy("g", "l").agg(F.min_by(F.struct("start", "mu", "inv", "det"), F.struct("det", "start")).alias("e")).select("g", "l", "e.*"))
    for _ in range(MOST_STEPS):
        new = _concentrated(groups, now)
        both = now.join(new.select("g", F.col("start").alias("s"), F.struct("mu", "inv", "det").alias("new")), "g").withColumn("falls", F.col("new.det") < F.col("det") - STILL)
        taken = lambda c: F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        after = settle(both.select("g", "l", "start", taken("mu"), taken("inv"), taken("det"), "falls"))
        now = after.drop("falls")
        if after.filter("falls").isEmpty():
            break
    else:
        raise RuntimeError("the determinants did not settle")
    near = groups.meet(groups.rows, now.select("g", "mu", "inv")).filter(_distance() <= chi2_quantile(0.975, DIM))
    last = near.groupBy("g", "l").agg(_sums([F.col("v")[k] for k in range(DIM)]).alias("m"))
    # a group none of whose rows is near has the moments of no rows
    none = now.select("g", "l", F.array(*[F.lit(0.0)] * MOMENTS).alias("m"))
    return _estimates(_added(last.unionByName(none), "g", "l").withColumn("start", F.lit(0)), consistency(0.975)).select("g", "mu", "inv")


def moment_rows(values: np.ndarray) -> np.ndarray:
    """One moment row for each row of values; rows add up."""
    return np.concatenate([np.ones((len(values), 1)), values, np.stack([values[:, i] * values[:, j] for i, j in UPPER], 1)], 1)


def squared_distances(v: np.ndarray, mu: np.ndarray, inv: np.ndarray) -> np.ndarray:
    d = v - mu
    return np.einsum("ni,nij,nj->n", d, inv, d)


def rings(d2: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(1 + np.clip(d2, 0, 1e12)) * RINGS).astype(np.int64)


class FewGroups:
    """Steps over all rows for groups that are few: their estimates are arrays on the driver and parameters of the tasks; counts and moments are added up by Spark."""

    def __init__(self, groups: Groups):
        self.rows = groups.rows
        # at most BROADCAST_GROUPS rows
        found = sorted((r.g, r.l) for r in self.rows.select("g", "l").distinct().collect())
        self.names, self.n = [g for g, _ in found], len(found)
        languages = {x: k for k, x in enumerate(sorted({x for _, x in found}))}
        self.language = np.array([languages[x] for _, x in found], np.int64)

    def _each(self, work, schema: str) -> DataFrame:
        """work(group numbers, vectors) of each batch, as columns of schema."""
        names = pa.array(self.names, pa.string())
        fields = [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = pc.index_in(batch.column("g"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) if c.ndim == 1 else pa.array(list(c)) for c in work(own, batch.column("v").flatten().to_numpy().reshape(-1, DIM))], fields)

        return self.rows.select("g", "v").mapInArrow(run, schema)

    def quantile(self, cells, most: int, share: float) -> np.ndarray:
        """For each group and number below most the bin of the share; cells(groups, vectors) gives numbers and bins, one column a number."""

        def work(own: np.ndarray, v: np.ndarray) -> tuple:
            bins = cells(own, v)
            key = (np.repeat(own, most) * most + np.tile(np.arange(most), len(own))) << 32 | (bins.ravel() + (1 << 31))
            key, n = np.unique(key, return_counts=True)
            return key >> 32, (key & 0xFFFFFFFF) - (1 << 31), n

        counts = self._each(work, "k long, bin long, n long").groupBy("k", "bin").agg(F.sum("n").alias("n"))
        own = W.partitionBy("k")
        placed = counts.select("k", "bin", F.sum("n").over(own.orderBy("bin")).alias("below"), F.sum("n").over(own).alias("all"))
        found = placed.filter(F.col("below") >= F.ceil(share * F.col("all"))).groupBy("k").agg(F.min("bin").alias("bin")).toArrow()
        out = np.zeros(self.n * most, np.int64)
        out[np.array(found["k"], np.int64)] = np.array(found["bin"], np.int64)
        return out.reshape(self.n, most)

    def moments(self, values, most: int) -> np.ndarray:
        """Summed moment rows of each group and number below most; values(groups, vectors) gives for each number the values and which of them count."""

        groups = self.n

        def work(own: np.ndarray, v: np.ndarray) -> tuple:
            out = np.zeros((groups * most, MOMENTS))
            for k, (x, counts) in enumerate(values(own, v)):
                np.add.at(out, own[counts] * most + k, moment_rows(x[counts]))
            some = np.flatnonzero(out[:, 0])
            return some, out[some]

        found = self._each(work, "k long, m array<double>").groupBy("k").agg(F.array(*[F.sum(F.col("m")[k]) for k in range(MOMENTS)]).alias("m")).toArrow()
        out = np.zeros((self.n * most, MOMENTS))
        out[np.array(found["k"], np.int64)] = np.array(found["m"].to_pylist(), float).reshape(-1, MOMENTS)
        return out.reshape(self.n, most, MOMENTS)

    def estimates(self, own: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means, inverse covariances and log determinants of moment rows [group, start]."""
        wide = np.zeros((int(self.language.max(initial=-1)) + 1, *own.shape[1:]))
        np.add.at(wide, self.language, own)
        flat = lambda m: m.reshape(-1, MOMENTS)
        every = np.broadcast_to(own.sum(0), own.shape)
        _, mean, cov = unpacked(with_prior(flat(own), flat(wide[self.language]), flat(every)))
        cov = cov * factor + np.diag(np.square(FLOORS))
        return mean.reshape(*own.shape[:2], DIM), np.linalg.inv(cov).reshape(*own.shape[:2], DIM, DIM), np.linalg.slogdet(cov)[1].reshape(own.shape[:2])

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        med = (self.quantile(lambda own, v: np.floor(v * GRID).astype(np.int64), DIM, 0.5) + 0.5) / GRID
        mad = (self.quantile(lambda own, v: np.floor(np.abs(v - med[own]) * GRID).astype(np.int64), DIM, 0.5) + 0.5) / GRID
        scale = np.sqrt(np.square(1.4826 * mad) + np.square(FLOORS))

        def values(own: np.ndarray, v: np.ndarray) -> list:
            z = (v - med[own]) / scale[own]
            every = np.ones(len(own), bool)
            return [(z / np.sqrt(np.maximum((z * z).sum(1, keepdims=True), 1e-12)), every), (np.tanh(z), every)]

        both = self.moments(values, 2)
        cov = start_shapes(both[:, 0], both[:, 1]) * scale[:, None, :, None] * scale[:, None, None, :]
        return np.repeat(med[:, None], STARTS, 1), np.linalg.inv(cov)

    def concentrated(self, mu: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = mu.shape[1]
        ring = lambda own, v: np.stack([rings(squared_distances(v, mu[own, s], inv[own, s])) for s in range(k)], 1)
        most = self.quantile(ring, k, KEEP)
        return self.estimates(self.moments(lambda own, v: [(v, b <= most[own, s]) for s, b in enumerate(ring(own, v).T)], k), consistency(KEEP))


def _fit_few(few: FewGroups) -> tuple[np.ndarray, np.ndarray]:
    """Means and inverse covariances of all groups."""
    mu, inv = few.starts()
    for _ in range(2):
        mu, inv, det = few.concentrated(mu, inv)
    best = np.argmin(det, 1)[:, None]
    mu, inv, det = (np.take_along_axis(x, best.reshape(-1, 1, *[1] * (x.ndim - 2)), 1) for x in (mu, inv, det))
    for _ in range(MOST_STEPS):
        new = few.concentrated(mu, inv)
        falls = new[2] < det - STILL
        mu, inv, det = (np.where(falls.reshape(-1, 1, *[1] * (x.ndim - 2)), y, x) for x, y in zip((mu, inv, det), new, strict=True))
        if not falls.any():
            break
    else:
        raise RuntimeError("the determinants did not settle")
    bound = chi2_quantile(0.975, DIM)
    last = few.moments(lambda own, v: [(v, squared_distances(v, mu[own, 0], inv[own, 0]) <= bound)], 1)
    mu, inv, _ = few.estimates(last, consistency(0.975))
    return mu[:, 0], inv[:, 0]


def fit(rows: DataFrame) -> tuple[DataFrame, Groups]:
    """The estimates (g, mu, inv) of all groups of rows (g, l, v)."""
    groups = Groups(rows)
    if not groups.few:
        return _fit_many(groups), groups
    few = FewGroups(groups)
    mu, inv = _fit_few(few) if few.n else (np.zeros((0, DIM)), np.zeros((0, DIM, DIM)))
    table = pa.table({"g": pa.array(few.names, pa.string()), "mu": pa.array(list(mu), pa.list_(pa.float64())), "inv": pa.array(list(inv.reshape(-1, DIM * DIM)), pa.list_(pa.float64()))})
    return rows.sparkSession.createDataFrame(table), groups


def _key(column: F.Column) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def judge(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", out: str = "quality", keep_text: bool = True) -> DataFrame:
    """docs with a struct ``out``: the counts, base_failed, the squared distance d2 and the verdict kept.

    The texts are read once: docs with their counts are written to the shared folder. Without keep_text the texts are not in
    the result, and only the other columns are written. A language or source without a sound text is judged by the base rules alone.
    """
    counted = with_counts(docs, text_col, keep_text)
    if keep_text:
        place = f"{shared_folder(docs.sparkSession).rstrip('/')}/counted-{uuid.uuid4().hex}"
        counted.write.option("parquet.block.size", 16 << 20).parquet(place)
        counted = docs.sparkSession.read.schema(counted.schema).parquet(place)
    else:
        counted = settle(counted)
    keys = {"l": _key(F.col("_row").getField(lang)), "s": _key(F.col("_row").getField(source))}
    keyed = counted.select("_row", "_stats", keys["l"].alias("l"), F.concat_ws("\x1f", keys["l"], keys["s"]).alias("g"), F.array(*_vector("_stats")).alias("v"))
    estimates, groups = fit(keyed.filter(~base_failed("_stats")).select("g", "l", "v"))
    judged = groups.meet(keyed, estimates).withColumn("d2", _distance())
    good = ~base_failed("_stats") & F.coalesce(F.col("d2") <= chi2_quantile(1 - TAIL, DIM), F.lit(True))
    verdict = F.struct(*[F.col(f"_stats.{c}").alias(c) for c in STATS], base_failed("_stats").alias("base_failed"), F.col("d2"), good.alias("kept"))
    kept = [c for c in docs.columns if c.lower() != out.lower() and (keep_text or c != text_col)]
    return judged.select(*[F.col("_row").getField(c).alias(c) for c in kept], verdict.alias(out))
