"""Benchmark decontamination by spaced seeds.

Tokens are the maximal runs of bytes that are neither ASCII white space nor ASCII
punctuation, of the text in lower case (one function for texts and items). A seed is a fixed mask of
token positions, some of which are ignored: two places that differ only there still hash alike. Hashes of
all placements of all masks in the items are joined with those of the texts; a hit
fixes an item, a text and a diagonal, and the overlap on that diagonal is
verified token by token: the best run, +1 for an equal token and -``MISS_COST`` for another, must hold
``MIN_MATCHED`` equal tokens (for a shorter item all but one in five).
The masks of an item go by its length, and are so chosen that no run that is enough lacks
a seed: a run cannot begin or end within four tokens of a miss, and for every place that
the misses can then have one of the masks lies between them (tests enumerate them).

Plan. The items' seeds are a table (hash, item, place). A bitmap of at most 2**``MAX_BITS`` bits of
their hashes' heads goes to the tasks that read the texts; only places whose head is in it leave them. These
are joined with the seeds by hash, grouped to the diagonals of a text and an item, and met with both
texts for the check. A side of a join is broadcast if it is counted to be small, else the join shuffles; texts are read
twice and are shuffled only if very many of them have hits. The benchmark may be of any size: it never passes through the
driver, and a fuller bitmap only lets more places reach the join.

Defined results. Items with equal texts are one item, called by their least id. Null or empty texts and items have no tokens and no hits; a null id
of a text is carried as null, a null item id likewise; repeated rows give repeated findings; empty tables give no
findings. Ids may have any type. Other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import few, free_name, settle, small_batches
from .textkit import SPACE, Spans, U, mix, runs, salted, sliced, strings, text_pieces

#: Masks of weight 8; 1 is compared, 0 ignored. None is longer than the MIN_MATCHED tokens that are enough.
MASKS = ("1111011101", "111111011", "111110100101", "111101010011")
#: Masks of items under 16 tokens by their number; an item of one to three has only itself.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111",),
    6: ("11111",),
    7: ("111111",),
    8: ("1111111",),
    9: ("11110111",),
    10: ("11110111",),
    11: ("111101111",),
    12: ("111101111",),
    13: ("111101111", "1111011101"),
    14: ("111101111", "1111011101", "1111101101"),
    15: ("111101111", "1111011101", "1111101101", "1111110101"),
}
ALL_MASKS = tuple(sorted({m for own in SHORT_MASKS.values() for m in own} | set(MASKS)))
MIN_MATCHED = 13
MISS_COST = 3
#: The bitmap has 2**12 bits for each seed, 2**MAX_BITS at most (16 MB).
MAX_BITS = 27
#: Diagonals of a text and an item that are formed at once.
LOT = 1_000_000

_BREAK = SPACE.copy()
_BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens before each text (n + 1)."""
    starts, ends = runs(~_BREAK[data], offsets)
    return Spans(data).hashes(starts, ends), np.searchsorted(starts, offsets)


def lowered(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes, tokens before each text) of bounded pieces of a column."""
    for lo, hi, data, offsets in text_pieces(pc.utf8_lower(strings(column))):
        yield lo, hi, *tokens(data, offsets)


def masks_of(length: int) -> tuple[str, ...]:
    """The masks of an item of so many tokens."""
    return SHORT_MASKS.get(length, MASKS) if length else ()


def _placed(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for k, m in enumerate(mask):
        if m == "1":
            total *= U(0xD6E8FEB86659FD93)
            total += hashes[k : k + n]
    return salted(total, int(mask, 2))


def seeds_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and number in ALL_MASKS of all seeds of an item's tokens."""
    parts = [(h, np.arange(len(h)), np.full(len(h), ALL_MASKS.index(m))) for m in masks_of(len(hashes)) for h in [_placed(hashes, m)]]
    return tuple(np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]).astype(kind) for k, kind in enumerate((U, np.int32, np.int32)))


def places(hashes: np.ndarray, firsts: np.ndarray, masks: tuple[str, ...], sieve: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of all placements whose hash's head is in the bitmap."""
    out = []
    for mask in masks:
        h = _placed(hashes, mask)
        head = h >> U(64 - bits)
        at = np.flatnonzero(sieve[(head >> U(3)).astype(np.int64)] >> (head & U(7)).astype(np.uint8) & 1)
        text = np.searchsorted(firsts[1:], at, "right")
        inside = at + len(mask) <= firsts[text + 1]
        at, text = at[inside], text[inside]
        out.append((text, at - firsts[text], h[at]))
    return tuple(np.concatenate([np.zeros(0, kind), *(o[k] for o in out)]) for k, kind in enumerate((np.int64, np.int64, U)))


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(first, past the last, equal tokens) of the best-scoring run."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISS_COST))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    start = int(np.flatnonzero(gain[: end + 1] == low[end])[-1]) if end else 0
    return start, end, int(equal[start:end].sum())


def enough(matched: int, length: int) -> bool:
    return matched >= min(MIN_MATCHED, length - length // 5) > 0


def best_overlap(text: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, first token in the text, tokens) of the best run on the diagonals; zeros if none is enough.

    Diagonals go by falling length, and end where none can hold more equal tokens.
    """
    lo, hi = np.maximum(0, shifts), np.minimum(len(text), shifts + len(item))
    best = (0, 0, 0)
    for k in np.lexsort((shifts, lo - hi)):
        if hi[k] - lo[k] < max(best[0], 1):
            break
        a, b, matched = best_run(text[lo[k] : hi[k]] == item[lo[k] - shifts[k] : hi[k] - shifts[k]])
        if enough(matched, len(item)):
            best = max(best, (matched, int(lo[k]) + a, b - a))
    return best


def diagonals(hits: list[tuple[int, int]], item: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct shifts of a text's hits (hash, place) against an item's seeds (hash, place)."""
    h, p = np.array([x[0] for x in hits], np.int64), np.array([x[1] for x in hits], np.int64)
    ih, ip = item
    order = np.argsort(ih, kind="stable")
    ih, ip = ih[order], ip[order]
    lo, hi = np.searchsorted(ih, h, "left"), np.searchsorted(ih, h, "right")
    found, at = np.zeros(0, np.int64), 0
    ends = np.cumsum(hi - lo)
    while at < len(h):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, "right")))
        n = hi[at:stop] - lo[at:stop]
        k = np.arange(n.sum()) + np.repeat(lo[at:stop] - (np.cumsum(n) - n), n)
        found = np.unique(np.concatenate([found, np.repeat(p[at:stop], n) - ip[k]]))
        at = stop
    return found


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, text, key) of the distinct item texts; key: a hash of the text."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text is not null")
    return rows.groupBy("text").agg(F.min("item").alias("item")).select("item", "text", F.xxhash64("text").alias("key"))


def _seeds(items: DataFrame) -> DataFrame:
    """(hash, key, mask) of the items' seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, firsts in lowered(batch.column("text")):
                for i in range(lo, hi):
                    h, _, mask = seeds_of(hashes[firsts[i - lo] : firsts[i - lo + 1]])
                    h, at = np.unique(h, return_index=True)
                    for a in range(0, len(h), 50_000):
                        part = slice(a, a + 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(np.full(len(h[part]), batch.column("key")[i].as_py(), np.int64)), pa.array(mask[at][part])], ["hash", "key", "mask"])

    return items.select("text", "key").mapInArrow(run, "hash long, key long, mask int")


def _sieve(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes' heads and the bits of a head; at most 2**(MAX_BITS - 6) words of 64 bits reach the driver."""
    bits = min(MAX_BITS, max(16, seeds.count().bit_length() + 12))
    head = F.shiftrightunsigned("hash", 64 - bits)
    words = seeds.groupBy(F.shiftright(head, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.array(words["word"], np.int64)] = np.array(words["bits"], np.int64)
    return out.view(np.uint8), bits


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(_key, doc, item, first_token, n_tokens, n_matched, item_tokens): a row for each text row and distinct item that overlap. _key: hash of id and text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = small_batches(rows).withColumn("_key", F.xxhash64("doc", "text"))
    items = settle(_items(benchmark, item_id, item_text))
    seeds = settle(_seeds(items))
    sieve, bits = _sieve(seeds)
    masks = tuple(ALL_MASKS[r.mask] for r in seeds.select("mask").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, firsts in lowered(batch.column("text")):
                text, place, h = places(hashes, firsts, masks, shared.value, bits)
                if len(h):
                    yield pa.RecordBatch.from_arrays([batch.column("_key").slice(lo, hi - lo).take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["_key", "place", "hash"])

    hits = rows.select("_key", "text").mapInArrow(seek, "_key long, place int, hash long")
    meet = hits.join(few(seeds.select("hash", "key")), "hash")
    pairs = settle(meet.groupBy("_key", "key").agg(F.collect_set(F.struct("hash", "place")).alias("hits")))
    # the check needs both texts of each pair
    against = pairs.join(few(items), "key").select("_key", "hits", "item", F.col("text").alias("item_text"))
    joined = rows.join(few(settle(against)), "_key").select("_key", "doc", "text", "item", "item_text", "hits")
    kinds = {f.name: f.dataType for f in joined.schema}
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("doc", kinds["doc"]), T.StructField("item", kinds["item"]), *(T.StructField(n, T.LongType()) for n in ("first_token", "n_tokens", "n_matched", "item_tokens"))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sought = [hashes[firsts[i] : firsts[i + 1]] for lo, hi, hashes, firsts in lowered(batch.column("item_text")) for i in range(hi - lo)]
            take, out = [], []
            for lo, hi, hashes, firsts in lowered(batch.column("text")):
                for i in range(lo, hi):
                    item = sought[i]
                    hits = [(x["hash"], x["place"]) for x in batch.column("hits")[i].as_py()]
                    h, place, _ = seeds_of(item)
                    matched, first, n = best_overlap(hashes[firsts[i - lo] : firsts[i - lo + 1]], item, diagonals(hits, (h.view(np.int64), place)))
                    if matched:
                        take.append(i)
                        out.append((first, n, matched, len(item)))
            if take:
                at = pa.array(take)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("_key", "doc", "item")), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], schema.names)

    return joined.mapInArrow(check, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and distinct benchmark item that overlap: ids, first_token, n_tokens, n_matched, item_tokens."""
    found = _found(docs, benchmark, id_col, text_col, item_id, item_text)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "first_token", "n_tokens", "n_matched", "item_tokens")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that overlap an item; all columns and all other rows as they are."""
    bad = settle(_found(docs, benchmark, id_col, text_col, item_id, item_text).select(F.col("_key").alias("key")).distinct())
    hidden = free_name("_key", docs.columns)
    marked = docs.withColumn(hidden, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")))
    return marked.join(few(bad.withColumnRenamed("key", hidden)), hidden, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
