"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its windows of five words (fewer words: one window).
Weights are whole counts. For each window a hierarchy of Poisson processes over
dyadic weight intervals (0,1], (1,2], (2,4], ... is seeded by the window's hash: an
interval's process has the interval's length as its rate, its points carry a register
and a level inside the interval, and a point counts if its level is within the
window's weight (only the highest interval can be cut so). Register i holds the
earliest counted point dealt to it, so that two texts agree in it with exactly
the chance of their weighted Jaccard similarity (Ertl, BagMinHash, KDD 2018). Points are
drawn in the order of time, several at once, up to a text's time limit; where that leaves a register
empty, the text is drawn again up to a later one.

Registers are banded; texts that share a band are candidates. Identical texts (equal 128-bit
digests of the bytes and of the windows; bytes are not compared) form one class first.

1. Every band's bucket verifies its members against one pivot: the member whose buckets are largest,
   as the source of many copies lies in the buckets of most of them. Verified links give the first classes.
2. A bucket that still holds several classes is open. Open buckets that share a class make a cluster.
   In a cluster the texts outside its largest class are sought among all its texts: both are dealt to
   blocks of about BLOCK windows, each pair of blocks is one bounded task, and there an inverted index of the windows
   gives the exact overlaps of all pairs of different classes. A text of which too few windows are found
   in the other block is left at once. A task gives out only links that join two of its classes, so what leaves it
   is bounded by its classes, and no pairs within a class are ever made.

So every two texts of different classes that share a band are compared on their windows, whatever the
size of the bucket; there is no cap, and no candidate is judged by its signature. What a pair can
miss is all bands: at exactly 0.8 with chance (1 - 0.8**8)**40 = 0.0006.

Defined results. A null text or one without words is a class of its own; a null id
is a row of its own class (null) and never a duplicate; repeated rows with one id are one
document; an empty table gives an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .shared import few, grouped_tables, rows_of, salted_join, settle, small_batches
from .textkit import Spans, U, mix, salted, shingles, text_pieces, words

WIDTH = 5
REGISTERS = 320
BANDS = 40
SIMILARITY = 0.8
#: Windows of all texts of a block; a task of the last step holds two blocks.
BLOCK = 200_000
#: Pairs of a pivot that are dealt to one task.
STAR = 256
#: Bytes of texts that are signed at once.
PIECE = 300_000
#: The time limit holds all registers' points with chance exp(-exp(-SLACK)).
SLACK = 2.5
#: Points' times are whole multiples of 1 / UNIT, so that sums do not depend on what is drawn beside them.
UNIT = 2.0**24
NAME_BITS = 26
_EMPTY = U(2**64 - 1)
_STEP = U(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 44-bit hash of each window, with repetitions, sorted by text and hash."""
    spans = Spans(data)
    starts, ends, firsts = words(data, offsets)
    hashes = spans.hashes(starts, ends)
    found, at = shingles(hashes, firsts, width)
    n = np.diff(firsts)
    owner = np.repeat(np.arange(len(n)), n)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = [int(mix(np.array([np.bitwise_xor.reduce(salted(hashes[firsts[i] : firsts[i + 1]] + np.arange(n[i]).astype(U), 3))], U))[0]) for i in short]
        found, owner = np.concatenate([found, np.array(whole, U)]), np.concatenate([owner, short])
    keys = (owner.astype(U) << U(44)) | (found >> U(20))
    keys.sort()
    return (keys >> U(44)).astype(np.int64), keys & U((1 << 44) - 1)


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of each text and their counts."""
    if not len(owner):
        return owner, hashes, np.zeros(0, np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def _draw(best: np.ndarray, text: np.ndarray, seed: np.ndarray, rate: np.ndarray | None, share: np.ndarray | None, limit: np.ndarray, registers: int) -> None:
    """Lower best (time and name of the earliest point of each register) by all points of the processes up to their texts' limits."""
    now, drawn = np.zeros(len(seed), np.int64), np.zeros(len(seed), U)
    bound, live = limit[text], np.arange(len(seed))
    while len(live):
        left = (bound[live] - now[live]) / UNIT
        n = (left * (1.0 if rate is None else rate[live]) + 2.0).astype(np.int64)
        first = np.cumsum(n) - n
        who = np.repeat(live, n)
        k = np.arange(len(who)) - np.repeat(first, n)
        bits = mix(seed[who] + (drawn[who] + k.astype(U)) * _STEP)
        gap = np.log(((bits >> U(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) * np.float32(-UNIT)
        if rate is not None:
            gap /= rate[who]
        time = np.cumsum(gap.astype(np.int64))
        time += np.repeat(now[live] - np.concatenate([[0], time[first[1:] - 1]]), n)
        now[live] = time[first + n - 1]
        drawn[live] += n.astype(U)
        due = np.flatnonzero(time <= bound[who])
        who, bits, time = who[due], bits[due], time[due]
        slot = text[who] * registers + (((bits & U(0xFFFFFFFF)) * U(registers)) >> U(32)).view(np.int64)
        value = (time.view(U) << U(NAME_BITS)) | ((bits * U(0xA0761D6478BD642F)) >> U(64 - NAME_BITS))
        if share is not None:
            counts = np.flatnonzero((mix(bits ^ U(0x2545F4914F6CDD1D)) >> U(40)).astype(float) * 2.0**-24 < share[who])
            slot, value = slot[counts], value[counts]
        np.minimum.at(best, slot, value)
        live = live[now[live] <= bound[live]]


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """texts x registers names of the earliest points (equal ones for texts without windows)."""
    best = np.full(texts * registers, _EMPTY)
    if len(owner):
        total = np.bincount(owner, weights, minlength=texts)
        # dyadic intervals: (0,1] of every window, (2**j, 2**(j+1)] of those that reach into it
        many = np.flatnonzero(weights > 1)
        top = np.ceil(np.log2(weights[many])).astype(np.int64)
        item = np.repeat(many, top)
        level = np.arange(len(item)) - np.repeat(np.cumsum(top) - top, top)
        rate = 2.0**level
        share = np.minimum(1.0, (weights[item] - rate) / rate)
        low, high = salted(hashes * U(64), 5), salted(hashes[item] * U(64) + (level + 1).astype(U), 5)
        limit = registers / np.maximum(total, 1) * (np.log(registers) + SLACK) * UNIT
        todo = total > 0
        while todo.any():
            at = np.flatnonzero(todo[owner])
            _draw(best, owner[at], low[at], None, None, limit.astype(np.int64), registers)
            at = np.flatnonzero(todo[owner[item]])
            _draw(best, owner[item[at]], high[at], rate[at], share[at], limit.astype(np.int64), registers)
            todo &= (best.reshape(texts, registers) == _EMPTY).any(1)
            limit *= 1.4
    return best.reshape(texts, registers) & U((1 << NAME_BITS) - 1)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of windows with repetitions."""
    if not len(a) or not len(b):
        return 0.0
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, True, True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def _sign(docs: DataFrame, id_col: str, text_col: str, registers: int, bands: int) -> DataFrame:
    """(id, h1, h2, total, bands) of every row with an id and words: digests of text and windows, number of windows, band hashes."""
    picked = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    per = registers // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1), PIECE):
                owner, hashes = windows(data, offsets)
                total = np.bincount(owner, minlength=hi - lo)
                sig = signatures(*counted(owner, hashes), hi - lo, registers)
                h1 = Spans(data).hashes(offsets[:-1], offsets[1:])
                h2 = salted(np.bitwise_xor.reduceat(np.append(hashes * U(2) + U(1), U(0)), np.searchsorted(owner, np.arange(hi - lo))), 9) + total.astype(U) if len(hashes) else h1
                folded = np.zeros((hi - lo, bands), U)
                for k in range(per):
                    folded = folded * U(0xD6E8FEB86659FD93) + sig[:, k::per]
                band = mix(folded + np.arange(bands).astype(U) * _STEP)
                keep = pa.array(np.flatnonzero(total > 0))
                band = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                out = [batch.column(0).slice(lo, hi - lo), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(total), band]
                yield pa.RecordBatch.from_arrays([x.take(keep) for x in out], ["id", "h1", "h2", "total", "bands"])

    return picked.mapInArrow(run, T.StructType([picked.schema["id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("total", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), one row for each of ids; of several texts of an id the least."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows_of(rows, ids).groupBy("id").agg(F.min("text").alias("text"))


def _stars(rows: DataFrame) -> DataFrame:
    """(pivot, id, salt): members and pivots of their buckets; a pivot's pairs are dealt by salt to tasks of about STAR pairs.

    rows: (bucket, id, n). The pivot is the member whose buckets are largest in sum, of these the least id.
    """
    size = rows.groupBy("id").agg(F.sum("n").alias("size"))
    sized = rows.join(size, "id")
    pivots = sized.groupBy("bucket").agg(F.max_by("id", F.struct("size", F.xxhash64("id"))).alias("pivot"), F.first("n").alias("n"))
    parts = pivots.groupBy("pivot").agg(F.max(F.ceil(F.col("n") / STAR)).cast("int").alias("parts"))
    pivots = pivots.select("bucket", "pivot").join(parts, "pivot")
    pairs = rows.select("bucket", "id").join(pivots, "bucket").filter("id <> pivot")
    return pairs.select("pivot", "id", "parts", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int").alias("salt")).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(a, b): pairs of _stars whose window multisets overlap enough."""
    ids = settle(pairs.select(F.col("pivot").alias("id")).union(pairs.select("id")).distinct())
    texts = settle(_texts(docs, ids, id_col, text_col))
    parts = pairs.select("pivot", "parts").distinct()
    spread = texts.join(parts, texts["id"] == parts["pivot"]).select("pivot", F.col("text").alias("tp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    joined = pairs.select("pivot", "id", "salt").join(texts, "id").join(spread, ["pivot", "salt"]).select(F.col("pivot").alias("a"), F.col("id").alias("b"), "tp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good, a = np.zeros(batch.num_rows, bool), batch.column("a").to_pylist()
            for lo, hi, data, offsets in text_pieces(batch.column("text")):
                owner, hashes = windows(data, offsets)
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    if a[i] != last[0]:
                        raw = np.frombuffer((batch.column("tp")[i].as_py() or "").encode(), np.uint8)
                        last = a[i], windows(raw, np.array([0, len(raw)]))[1]
                    good[i] = overlap(last[1], hashes[at[i - lo] : at[i - lo + 1]]) >= similarity
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return joined.mapInArrow(run, joined.select("a", "b").schema)


def _relabelled(rows: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """rows (with an id) whose values of a column are replaced by the component that links (a, b) put them in."""
    found = components(links, "a", "b").withColumnsRenamed({"node": column, "component": "_found"})
    return salted_join(rows, found, [column], "id", "left").withColumn(column, F.coalesce("_found", column)).drop("_found")


def block_links(owner: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, asks: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts that join their classes (kinds) by an overlap of at least similarity, no more than make the classes one.

    owner, hashes: windows with repetitions, sorted by text. Texts with asks are sought among all others; with side, only
    among those of the other side.
    """
    n = len(kinds)
    total = np.bincount(owner, minlength=n)
    # the k-th occurrence of a window is an element of its own, so that multisets are sets
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    place = np.arange(len(owner))
    times = place - np.maximum.accumulate(np.where(new, place, 0))
    _, number, holders = np.unique(salted(hashes + times.astype(U) * _STEP, 21), return_inverse=True, return_counts=True)
    post = owner[np.argsort(number, kind="stable")]
    begin = np.cumsum(holders) - holders
    first = np.searchsorted(owner, np.arange(n + 1))
    root = {k: k for k in set(kinds.tolist())}

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for q in np.flatnonzero(asks):
        mine = number[first[q] : first[q + 1]]
        mine = mine[holders[mine] > 1]
        if not len(mine) or len(mine) < similarity * total[q]:
            continue
        size = holders[mine]
        at = np.arange(size.sum()) + np.repeat(begin[mine] - (np.cumsum(size) - size), size)
        common = np.bincount(post[at], minlength=n)
        near = common >= similarity * (total + total[q] - common)
        near &= (common > 0) & (kinds != kinds[q])
        if side is not None:
            near &= side != side[q]
        for y in np.flatnonzero(near):
            x, z = top(kinds[q]), top(kinds[y])
            if x != z:
                root[max(x, z)] = min(x, z)
                out.append((int(q), int(y)))
    return out


def _open(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """(bucket, id, total, class) of the buckets that hold several classes."""
    inside = rows.select("bucket", "id", "total").join(grouped, "id")
    mixed = inside.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("bucket", "least")
    return inside.join(mixed, "bucket")


def _across(left: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, block: int) -> DataFrame:
    """(a, b): links between classes of texts that share an open bucket. left: what _open gives."""
    edges = left.select(F.col("class").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    texts = _relabelled(left.select("id", "total", "class", F.col("class").alias("cluster")).distinct(), edges, "cluster")
    texts = settle(texts)
    sizes = texts.groupBy("cluster", "class").agg(F.sum("total").alias("n"))
    big = sizes.groupBy("cluster").agg(F.max_by("class", F.struct("n", "class")).alias("big"), F.max("n").alias("most"), F.sum("n").alias("n"))
    # blocks 0..asking-1 hold the texts that ask, the next ones the largest class; a cluster of one block has all in block 0
    few = F.col("n") <= block
    big = big.select("cluster", "big", F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / block)).cast("int").alias("asking"), F.when(few, 0).otherwise(F.ceil(F.col("most") / block)).cast("int").alias("asked"))
    asks = F.col("class") != F.col("big")
    drawn = F.xxhash64("id", F.lit(7))
    own = F.when(asks | (F.col("asked") == 0), F.pmod(drawn, F.col("asking"))).otherwise(F.col("asking") + F.pmod(drawn, F.greatest("asked", F.lit(1)))).cast("int")
    # every block meets all blocks of texts that ask, and those all blocks
    last = F.when(F.col("own") < F.col("asking"), F.col("asking") + F.col("asked")).otherwise(F.col("asking")) - 1
    dealt = texts.join(big, "cluster").select("id", "class", "cluster", asks.alias("asks"), own.alias("own"), "asking", "asked")
    dealt = dealt.select("id", "class", "cluster", "asks", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("id", "class", "asks", "own", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    words_ = _texts(docs, texts.select("id"), id_col, text_col)
    ready = dealt.join(words_, "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").select("cluster", "i", "j", "class", "asks", "own", "text")
    kind = ready.schema["class"].dataType

    def links(group: pa.Table, whole: bool) -> list[tuple]:
        numbers, kinds = np.unique(np.array(group.column("class").to_pylist()), return_inverse=True)
        parts = []
        for lo, _, data, offsets in text_pieces(group.column("text")):
            owner, hashes = windows(data, offsets)
            parts.append((owner + lo, hashes))
        owner, hashes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        side = None if whole else np.array(group.column("own"))
        found = block_links(owner, hashes, kinds, np.array(group.column("asks")), side, similarity)
        return [(numbers[kinds[q]].item(), numbers[kinds[y]].item()) for q, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in grouped_tables(batches, ("cluster", "i", "j")):
            found = links(group, i == j)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], group.schema.field("class").type) for k in (0, 1)], ["a", "b"])

    return ready.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, registers: int = REGISTERS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, representative) for every distinct non-null id with words; class_id is the class's least id.

    representative: the least id of the identical texts.
    """
    signed = settle(_sign(small_batches(docs), id_col, text_col, registers, bands))
    same = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = salted_join(signed.select("id", "h1", "h2"), same, ["h1", "h2"], "id").select("id", F.least("id", "rep").alias("rep"))
    member = settle(signed.select("id", F.col("id").alias("rep")).union(copies).groupBy("id").agg(F.min("rep").alias("rep")))
    reps = signed.join(member.filter("id <> rep").select("id"), "id", "left_anti")
    buckets = reps.groupBy("id").agg(F.min(F.struct("total", "bands")).alias("r")).select("id", "r.total", F.explode("r.bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = settle(buckets.join(shared, "bucket"))
    pairs = settle(_stars(rows))
    links = _linked(pairs, docs, id_col, text_col, similarity)
    grouped = settle(_relabelled(rows.select("id", F.col("id").alias("class")).distinct(), links, "class"))
    left = settle(_open(rows, grouped))
    more = _across(left, docs, id_col, text_col, similarity, block)
    final = _relabelled(grouped, more, "class").select(F.col("id").alias("rep"), F.col("class").alias("class_id")).filter("rep <> class_id")
    found = salted_join(member, final, ["rep"], "id", "left")
    return found.select("id", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("representative"))


def classify_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, class_id (the id itself where it has no words), representative."""
    found = classes(docs, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("id")).join(found, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("representative", "id").alias("representative"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose class has a lesser id; rows without an id stay, and all rows of a kept id."""
    found = classes(docs, id_col, text_col, **how)
    gone = settle(found.filter("id <> class_id").select("id"))
    return docs.join(few(gone.withColumnRenamed("id", id_col)), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
