"""Language-model scores from a sharded n-gram trie in Elias-Fano coding.

Model. Words are lower-cased (A-Z) runs of bytes other than white space, each text ends in
one end token, and the end token is also the context of a text's first token. The
base distribution is p1(w) = (c(w) + 1) / (N + V + 1); the bigram level is smoothed with it:
p(w | h) = (c(h w) + MU p1(w)) / (c(h) + MU), the mean of a Dirichlet prior. The trie stores
the part c(h w) / (c(h) + MU) of every bigram as a 16-bit code on a log scale; the rest of
p follows from the two unigram counts.

Levels. Word hashes form level 1. A level-2 shard holds contexts (monotone, Elias-Fano), pointers to
their successors (monotone, Elias-Fano) and the successors relative to their
context (made monotone by the context's number, Elias-Fano), all in one memory-mapped
buffer, found by successor search: the bucket of the high bits, then its low bits.

Plan. Texts become blocks of a bounded size, written once as token codes. A block sends each
shard its distinct words (then bigrams) with training counts: one message is both
the block's share of the counts and its question; the shard adds the counts of all
blocks, builds its part of the trie and answers every message in order. So a key
reaches a shard once a block at most, however often it stands in the texts; contexts with over a
fair share of all tokens are split by successor. Shards grow in number with the input; the
driver sees only totals and one count per shard.

Defined results. A null or empty text is one end token; a null id is never held
out; repeated rows count as often as they occur; without training texts N = V = 0 and every
probability is 1; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, small_batches
from .textkit import LOWER, Spans, U, mix, pieces, strings, buffer_of, words

BLOCK_BYTES = 6_000_000
SHARD_ENTRIES = 1_500_000
MU = 200.0
END = U(0x5851F42D4C957F2D)
#: Codes 1..65535 cover log10 values from -CODE_RANGE to 0; code 0 is absence.
CODE_RANGE = 12.0


def pack(x: np.ndarray) -> bytes:
    """Whole numbers >= 0 as compressed byte planes."""
    x = np.ascontiguousarray(x).astype("<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T)
    return len(x).to_bytes(8, "little") + bytes([k]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    n, k = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:], max_output_size=n * k + 1), np.uint8).reshape(k, n).T
    return out.view("<u8").ravel()


_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [b for b in range(8) if _byte >> b & 1]
    _SELECT[_byte, : len(_ones)] = _ones


class EliasFano:
    """A monotone sequence below a bound: low bits packed, high bits in unary, in a buffer that may be mapped."""

    HEAD = 5

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> bytes:
        n, values = len(values), values.astype(U)
        low = max(0, int(max(bound, 1) // max(n, 1)).bit_length() - 1)
        lows = np.zeros(((n * low + 63) // 64 + 1) * 64, np.uint8)
        if low and n:
            bits = ((values[:, None] >> np.arange(low).astype(U)) & U(1)).astype(np.uint8)
            lows[: n * low] = bits.ravel()
        buckets = (int(bound) >> low) + 2
        highs = np.zeros(((n + buckets + 63) // 64 + 1) * 64, np.uint8)
        highs[((values >> U(low)).astype(np.int64)) + np.arange(n)] = 1
        low_bytes, high_bytes = np.packbits(lows, bitorder="little"), np.packbits(highs, bitorder="little")
        zeros = 8 - np.bitwise_count(high_bytes).astype(np.int64)
        every = np.concatenate([[0], np.cumsum(zeros.reshape(-1, 8).sum(1))]).astype("<i8")
        head = np.array([n, low, len(low_bytes), len(high_bytes), len(every)], "<i8")
        return head.tobytes() + low_bytes.tobytes() + high_bytes.tobytes() + every.tobytes()

    def __init__(self, buffer, at: int = 0):
        n, self.low, a, b, c = (int(v) for v in np.frombuffer(buffer, "<i8", self.HEAD, at))
        at += 8 * self.HEAD
        self.n = n
        self.lows = np.frombuffer(buffer, np.uint8, a, at)
        self.highs = np.frombuffer(buffer, np.uint8, b, at + a)
        self.zeros = np.frombuffer(buffer, "<i8", c, at + a + b)
        self.end = at + a + b + 8 * c

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number k, from 0."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[word]
        byte = word * 8
        for _ in range(8):
            here = 8 - np.bitwise_count(self.highs[byte]).astype(np.int64)
            on = left >= here
            left, byte = np.where(on, left - here, left), byte + on
        return byte * 8 + _SELECT[~self.highs[byte], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        byte, shift = bit >> 3, (bit & 7).astype(U)
        total = np.zeros(len(i), U)
        for k in range((self.low + 14) // 8 if self.low else 0):
            part = self.lows[np.minimum(byte + k, len(self.lows) - 1)].astype(U)
            total |= (part << U(8 * k)) >> shift if 8 * k < 64 else U(0)
        return total & U((1 << self.low) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value (below the bound), or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> U(self.low)).astype(np.int64)
        at = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - high + 1, 0)
        stop = self._select0(high) - high
        want = values & U((1 << self.low) - 1)
        end = stop.copy()
        live = np.flatnonzero(at < stop)
        # low bits rise within a bucket: halve the range, as a frequent context can fill a bucket with many successors
        while len(live):
            mid = (at[live] + stop[live]) >> 1
            less = self._lows(mid) < want[live]
            at[live] = np.where(less, mid + 1, at[live])
            stop[live] = np.where(less, stop[live], mid)
            live = live[at[live] < stop[live]]
        some = np.flatnonzero(at < end)
        hit = self._lows(at[some]) == want[some]
        out[some[hit]] = at[some[hit]]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index (used for pointers): the place of the one number i less i is the high part."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        left, byte = i - ones[word], word * 8
        for _ in range(8):
            here = np.bitwise_count(self.highs[byte]).astype(np.int64)
            on = left >= here
            left, byte = np.where(on, left - here, left), byte + on
        high = byte * 8 + _SELECT[self.highs[byte], left] - i
        return (high.astype(U) << U(self.low)) | self._lows(i)


class Trie:
    """One shard: contexts, pointers, successors and codes in one mapped buffer."""

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, codes: np.ndarray, words_bound: int, contexts_bound: int) -> bytes:
        """From rows sorted by (context, word)."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        parts = [
            EliasFano.build(context[first], contexts_bound),
            EliasFano.build(np.append(first, len(context)), len(context) + 1),
            EliasFano.build(number.astype(U) * U(words_bound) + word.astype(U), max(1, len(first)) * words_bound),
        ]
        return np.array([words_bound, len(codes)], "<i8").tobytes() + b"".join(parts) + codes.astype("<u2").tobytes()

    def __init__(self, buffer):
        self.words_bound, n = (int(v) for v in np.frombuffer(buffer, "<i8", 2))
        self.contexts = EliasFano(buffer, 16)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, "<u2", n, self.successors.end)

    def query(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of (context, word); 0 where the trie has none."""
        out = np.zeros(len(context), np.uint16)
        number = self.contexts.find(context.astype(U))
        some = np.flatnonzero(number >= 0)
        number = number[some]
        at = self.successors.find(number.astype(U) * U(self.words_bound) + word[some].astype(U))
        lo, hi = self.pointers.get(number).astype(np.int64), self.pointers.get(number + 1).astype(np.int64)
        good = (at >= lo) & (at < hi)
        out[some[good]] = self.codes[at[good]]
        return out


def mapped(raw: bytes) -> mmap.mmap:
    """An anonymous memory map of raw; it leaves no file behind."""
    out = mmap.mmap(-1, max(1, len(raw)))
    out[: len(raw)] = raw
    return out


def to_codes(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((np.log10(np.maximum(share, 1e-300)) + CODE_RANGE) / CODE_RANGE * 65534), 0, 65534).astype(np.int64) + 1


def from_codes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(float) - 1) / 65534 * CODE_RANGE - CODE_RANGE), 0.0)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def token_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, end tokens included, and n + 1 offsets."""
    data, offsets = buffer_of(strings(array))
    hashes, lengths = [], []
    for lo, hi in pieces(np.diff(offsets), 2_000_000):
        part, own = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, firsts = words(part, own)
        n = np.diff(firsts)
        out = np.full(len(starts) + len(n), END)
        out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = Spans(part).hashes(starts, ends)
        hashes.append(out)
        lengths.append(n + 1)
    return np.concatenate([*hashes, np.zeros(0, U)]), np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.zeros(0, np.int64)]))]).astype(np.int64)


_BLOCK = "block long, ids array<{}>, held binary, lengths binary, codes binary, vocabulary binary, counts binary, n_words int"


def make_blocks(docs: DataFrame, id_col: str, text_col: str, held: F.Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of texts as token codes: the block's vocabulary by falling frequency, and the training counts of its words."""
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    kind = dict(picked.dtypes)["id"]
    arrow_id = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def block_row(part: pa.Table, number: int) -> pa.RecordBatch:
        tokens, offsets = token_hashes(part.column("text"))
        held_ = np.array(part.column("held").to_pylist(), bool)
        vocabulary, first, code, count = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[code]
        train = np.repeat(~held_, np.diff(offsets))
        counts = np.bincount(code[train], minlength=len(order))
        ids = part.column("id").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        values = [
            pa.array([number]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(arrow_id)),
            *(pa.array([v], pa.binary()) for v in (held_.tobytes(), pack(np.diff(offsets)), pack(code), np.ascontiguousarray(vocabulary[order]).tobytes(), pack(counts))),
            pa.array([len(order)], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(values, ["block", "ids", "held", "lengths", "codes", "vocabulary", "counts", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0
        for batch in batches:
            lengths = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column("text")).to_pylist()], np.int64)
            for lo, hi in pieces(lengths, block_bytes):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if waiting and size + int(lengths[lo:hi].sum()) > block_bytes:
                    yield block_row(pa.concat_tables(waiting), number)
                    waiting, size, number = [], 0, number + 1
                waiting.append(part)
                size += int(lengths[lo:hi].sum())
        if waiting:
            yield block_row(pa.concat_tables(waiting), number)

    return picked.mapInArrow(run, _BLOCK.format(kind))


def _word_messages(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "vocabulary", "counts")), strict=True):
                keys, counts = np.frombuffer(vocabulary, U), unpack(counts)
                shard = (mix(keys) % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(s, block, keys[order[a:b]].tobytes(), pack(counts[order[a:b]])) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 256], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "keys", "counts"])

    return blocks.select("block", "vocabulary", "counts").mapInArrow(run, "shard int, block long, keys binary, counts binary")


def _answer_words(messages: DataFrame) -> DataFrame:
    """Every message's numbers in the shard's list of known words (from 1; 0 is unknown) and their counts; a row without block has the shard's totals."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, U) for k in group.column("keys").to_pylist()]
        counts = [unpack(c) for c in group.column("counts").to_pylist()]
        all_keys, total = _sum_by(np.concatenate(keys), np.concatenate(counts))
        known = total > 0
        all_keys, total = all_keys[known], total[known].astype(np.int64)
        shard = group.column("shard")[0].as_py()
        level = EliasFano(mapped(EliasFano.build(all_keys >> U(1), 1 << 63)))
        numbers, found = [], []
        for k in keys:
            at = level.find(k >> U(1))
            good = at >= 0
            good[good] = all_keys[at[good]] == k[good]
            numbers.append(pack(np.where(good, at + 1, 0)))
            found.append(pack(np.where(good, total[np.maximum(at, 0)], 0)) if len(total) else pack(np.zeros(len(k))))
        n = len(keys)
        return pa.table({
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()),
            "numbers": pa.array([*numbers, None], pa.binary()),
            "found": pa.array([*found, None], pa.binary()),
            "n": pa.array([None] * n + [int(total.sum())], pa.int64()),
            "v": pa.array([None] * n + [len(total)], pa.int64()),
        })

    return messages.groupBy("shard").applyInArrow(run, "shard int, block long, numbers binary, found binary, n long, v long")


class Block:
    """A block's tokens with its words' global numbers and counts, and its distinct bigrams by shard."""

    def __init__(self, row: dict, word_shards: int, first: np.ndarray, shards: int, split: int):
        self.lengths, codes = unpack(row["lengths"]).astype(np.int64), unpack(row["codes"]).astype(np.int64)
        self.held = np.frombuffer(row["held"], bool)
        keys = np.frombuffer(row["vocabulary"], U)
        own = (mix(keys) % U(word_shards)).astype(np.int64)
        self.number, self.count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for answer in row["words"]:
            at = np.flatnonzero(own == answer["shard"])
            local = unpack(answer["numbers"]).astype(np.int64)
            self.number[at] = np.where(local > 0, local + first[answer["shard"]], 0)
            self.count[at] = unpack(answer["found"]).astype(np.int64)
        self.codes = codes
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)])
        end = int(np.flatnonzero(keys == END)[0])
        self.context = np.empty_like(codes)
        self.context[1:] = codes[:-1]
        self.context[self.firsts[:-1]] = end
        pair, self.which = np.unique(self.context * len(keys) + codes, return_inverse=True)
        self.h, self.w = pair // len(keys), pair % len(keys)
        train = np.repeat(~self.held, self.lengths)
        self.times = np.bincount(self.which[train], minlength=len(pair))
        self.asked = np.flatnonzero((self.count[self.h] > 0) & (self.count[self.w] > 0))
        h, w = self.number[self.h[self.asked]], self.number[self.w[self.asked]]
        order = np.lexsort((w, h))
        self.asked, h, w = self.asked[order], h[order], w[order]
        parts = 1 + self.count[self.h[self.asked]] // max(1, split)
        shard = ((mix(h.astype(U)) + mix(w.astype(U)) % parts.astype(U)) % U(shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.at = np.searchsorted(shard[self.order], np.arange(shards + 1))
        self.gh, self.gw = h, w

    def part(self, shard: int) -> np.ndarray:
        return self.order[self.at[shard] : self.at[shard + 1]]


def _pair_messages(joined: DataFrame, setting: tuple) -> DataFrame:
    shards = setting[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, *setting)
                rows = []
                for s in range(shards):
                    at = b.part(s)
                    if not len(at):
                        continue
                    h, w = b.gh[at], b.gw[at]
                    new = np.ones(len(h), bool)
                    new[1:] = h[1:] != h[:-1]
                    first = np.flatnonzero(new)
                    rows.append((s, row["block"], pack(h[first]), pack(b.count[b.h[b.asked[at[first]]]]), pack(np.diff(np.append(first, len(h)))), pack(w), pack(b.times[b.asked[at]])))
                for lo in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 64], strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["shard", "block", "contexts", "totals", "sizes", "words", "times"])

    return joined.mapInArrow(run, "shard int, block long, contexts binary, totals binary, sizes binary, words binary, times binary")


def _answer_pairs(messages: DataFrame, words_bound: int, mu: float) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        h, w, total, times, at = [], [], [], [], [0]
        for row in group.select(["contexts", "totals", "sizes", "words", "times"]).to_pylist():
            sizes = unpack(row["sizes"]).astype(np.int64)
            h.append(np.repeat(unpack(row["contexts"]), sizes))
            total.append(np.repeat(unpack(row["totals"]), sizes))
            w.append(unpack(row["words"]))
            times.append(unpack(row["times"]))
            at.append(at[-1] + len(w[-1]))
        h, w, total, times = (np.concatenate(x) for x in (h, w, total, times))
        seen = np.flatnonzero(times > 0)
        order = seen[np.lexsort((w[seen], h[seen]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(times[order], first).astype(float) if len(first) else np.zeros(0)
        rows = order[first]
        trie = Trie(mapped(Trie.build(h[rows], w[rows], to_codes(count / (total[rows].astype(float) + mu)), words_bound, words_bound)))
        answers = [pack(trie.query(h[a:b], w[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"shard": group.column("shard"), "block": group.column("block"), "answer": pa.array(answers, pa.binary())})

    return messages.groupBy("shard").applyInArrow(run, "shard int, block long, answer binary")


def _scores(asked: DataFrame, setting: tuple, n_total: int, v_total: int, mu: float, id_kind: T.DataType, id_col: str) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, id_kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.drop_columns(["ids"]).to_pylist()[0]
                b = Block(row, *setting)
                codes = np.zeros(len(b.asked), np.int64)
                for answer in row["pairs"] or ():
                    codes[b.part(answer["shard"])] = unpack(answer["answer"]).astype(np.int64)
                stored = np.zeros(len(b.h))
                stored[b.asked] = from_codes(codes)
                p1 = (b.count + 1.0) / (n_total + v_total + 1)
                p = stored + mu / (b.count[b.h] + mu) * p1[b.w]
                score = np.add.reduceat(np.log10(p)[b.which], b.firsts[:-1])
                base = np.add.reduceat(np.log10(p1)[b.codes], b.firsts[:-1])
                known = np.add.reduceat((b.count > 0).astype(np.int64)[b.codes], b.firsts[:-1])
                n = len(b.lengths)
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(b.held), pa.array(b.lengths), pa.array(known), pa.array(np.full(n, n_total, np.int64)), pa.array(base), pa.array(score)], schema.names)

    return asked.mapInArrow(run, schema)


def score_texts(docs: DataFrame, held: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; rows with held are not learnt from."""
    blocks = settle(make_blocks(docs, id_col, text_col, F.lit(False) if held is None else held, block_bytes))
    sized = blocks.agg(F.sum("n_words").alias("words"), F.count("*").alias("blocks")).first()
    word_shards = max(4, -(-(sized.words or 0) // shard_entries))
    answers = settle(_answer_words(_word_messages(blocks, word_shards)))
    totals = answers.filter("block is null").select("shard", "n", "v").collect()
    n_total, v_total = sum(r.n for r in totals), sum(r.v for r in totals)
    by_shard = {r.shard: r.v for r in totals}
    first = np.concatenate([[0], np.cumsum([by_shard.get(s, 0) for s in range(word_shards)])])[:-1]
    shards = max(8, 4 * word_shards)
    setting = (word_shards, first, shards, max(1, n_total // (4 * shards)))
    words_ = answers.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "numbers", "found")).alias("words"))
    joined = blocks.join(words_, "block")
    replies = _answer_pairs(_pair_messages(joined, setting), v_total + 1, mu).groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("pairs"))
    return _scores(joined.join(replies, "block", "left"), setting, n_total, v_total, mu, docs.schema[id_col].dataType, id_col)


def held_out_fold(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 7 = 2"), F.lit(False))
