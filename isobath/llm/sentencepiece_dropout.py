"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary of a BPE model file is read through the public library; nothing is
trained. A text becomes units: spaces are written as the model's space mark, one mark is put
before the text, and a unit is a run of marks with the letters up to the next mark or
line feed (a line feed is its own unit). No piece of the model reaches over such an edge, which is
checked when the model is read, so units are encoded apart.

The agenda of a unit holds all adjacent pairs that form a piece, by score, leftmost first. A
candidate merge is skipped for good when the keyed hash of (seed, text id, place of the unit,
unit, place in it, the two symbols) falls below the dropout; a new neighbour makes a new
candidate. So dropout is drawn for every occurrence of a unit, and equally on every run.
The distinct units of a block of texts are first cut without dropout; an occurrence that
skips none of the merges made there has that cut, as merges that are not made change nothing. All other
occurrences are processed together, one merge of every unit at a step; a long unit has a heap of its own,
so that its time grows with its length but for a logarithm.

Letters outside the vocabulary become byte pieces, and so does a literal space mark,
wherefore decoding gives back every text. Decoding joins the pieces' bytes.

Defined results. A null text counts as empty and has no tokens; a null id is a value
of its own in the key; repeated rows are encoded alike; an empty table gives an
empty result. Other columns are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .textkit import Spans, U, mix, salted, text_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: At most so many cuts of a unit in all texts; 0: every occurrence draws its own.
VARIANTS = 0
#: Occurrences drawn at once.
DRAWN_UNITS = 100_000
#: Units of more letters have an agenda each (a heap), shorter ones are merged side by side; the cuts are the same.
LONG_UNIT = 100
SEED = 2024
MARK = "▁"


class Model:
    """Tables of a BPE model: pair -> (rank, piece), letters, bytes of each piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(MARK in p.lstrip(MARK) for p in ids) or any("\n" in p for p in ids):
            raise ValueError("a piece reaches over the edge of a unit")
        self.size = n
        self.byte_ids = np.zeros(256, np.int32)
        raw: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(p.replace(MARK, " ").encode() if normal[i] else b"")
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        # symbols: piece ids, then letters that are no piece of their own but part of one
        letters = {c for p in ids for c in p}
        symbols = dict(ids)
        for c in sorted(letters - set(ids)):
            symbols[c] = n + len(symbols) - len(ids)
        self.letter_codes = np.array(sorted(map(ord, letters)), np.int64)
        self.letter_symbols = np.array([symbols[chr(c)] for c in self.letter_codes], np.int64)
        order = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-sp.get_score(i), i)))}
        found = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    found.append(((a << 20) | b, order[i], i))
        found.sort()
        self.pair = np.array([f[0] for f in found], np.int64)
        self.rank = np.array([f[1] for f in found], np.int64)
        self.piece = np.array([f[2] for f in found], np.int64)
        size = 1 << max(4, int(len(found) * 4).bit_length())
        self.shift = U(64 - (size.bit_length() - 1))
        self.slots = np.full(size + 64, -1, np.int64)
        for k, home in enumerate(self._home(self.pair)):
            while self.slots[home] >= 0:
                home += 1
            self.slots[home] = k

    @cached_property
    def _numbers(self) -> dict[int, int]:
        return dict(zip(self.pair.tolist(), range(len(self.pair)), strict=True))

    @cached_property
    def ranks(self) -> list[int]:
        return self.rank.tolist()

    @cached_property
    def pieces(self) -> list[int]:
        return self.piece.tolist()

    def pair_number(self, left: int, right: int) -> int:
        return self._numbers.get((left << 20) | right, -1) if left >= 0 and right >= 0 else -1

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair in the table, or -1."""
        key = (left << 20) | right
        out = np.full(len(key), -1, np.int64)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(key[live])
        while len(live):
            k = self.slots[at]
            hit = (k >= 0) & (self.pair[k] == key[live])
            out[live[hit]] = k[hit]
            on = (k >= 0) & ~hit
            live, at = live[on], at[on] + 1
        return out


@lru_cache(maxsize=2)
def model(path: str = MODEL) -> Model:
    return Model(path)


_FAR = np.int64(1) << 40


def _drawn(keys: np.ndarray, pairs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The keyed hash of candidate merges: table numbers of the pairs and their places in the units."""
    return mix(keys + pairs.astype(U) * U(0xD1342543DE82EF95) + places.astype(U) * U(0x9E3779B97F4A7C15))


def _drawn_one(key: int, pair: int, place: int) -> int:
    """_drawn of one candidate, in whole numbers."""
    x = (key + pair * 0xD1342543DE82EF95 + place * 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (2**64 - 1)
    return x ^ x >> 31


def _limit(dropout: float) -> U:
    return U(min(int(dropout * 2.0**64), 2**64 - 1))


def merge_units(m: Model, codes: np.ndarray, firsts: np.ndarray, keys: np.ndarray, dropout: float, marks: np.ndarray, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all units. codes: code points of all units; marks: which of them are written spaces; keys: hash of each unit's agenda.

    Returns symbols (unknown letters as -1 - code point) and their number for each unit.
    made: gets (units, table numbers of the pairs, places) of all merges.
    """
    lengths = np.diff(firsts)
    at = np.minimum(np.searchsorted(m.letter_codes, codes), max(len(m.letter_codes) - 1, 0))
    known = (m.letter_codes[at] == codes) & ((codes != ord(MARK)) | marks)
    flat = np.where(known, m.letter_symbols[at], -1 - codes)
    out = np.empty(len(lengths), object)
    counts = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], [0, 2, 4, 6, 8, 10, 13, 16, 20, 26, 34, 50, LONG_UNIT + 1, 10**12])
    results, places = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        for a in range(lo, hi, 60_000):
            rows = order[a : min(hi, a + 60_000)]
            width = int(lengths[rows].max()) if len(rows) else 0
            if len(rows) * width > 30_000_000:
                parts = np.array_split(rows, -(-len(rows) * width // 30_000_000))
            else:
                parts = [rows] if len(rows) else []
            for part in parts:
                if width > LONG_UNIT:
                    cut = [_merge_long(m, flat[firsts[k] : firsts[k + 1]], int(k), int(keys[k]), dropout, made) for k in part]
                    results.extend(cut)
                    counts[part] = [len(c) for c in cut]
                else:
                    symbols, live = _merge_block(m, flat, firsts, lengths, part, keys, dropout, made)
                    results.append(symbols[live])
                    counts[part] = live.sum(1)
                places.append(part)
    del out
    if not results:
        return np.zeros(0, np.int64), counts
    joined, rows = np.concatenate(results), np.concatenate(places)
    starts = np.cumsum(counts[rows]) - counts[rows]
    begin = np.zeros(len(lengths), np.int64)
    begin[rows] = starts
    return joined[ragged(begin, counts)], counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... of lengths[i] each, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def _merge_block(m: Model, flat: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, keys: np.ndarray, dropout: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    width = int(lengths[rows].max())
    column = np.arange(width)
    live = column < lengths[rows][:, None]
    symbols = np.where(live, flat[np.minimum(firsts[rows][:, None] + column, max(len(flat) - 1, 0))], -(1 << 30))
    following = np.where(column + 1 < lengths[rows][:, None], column + 1, width)
    preceding = np.broadcast_to(column - 1, live.shape).copy()
    limit = _limit(dropout)
    key = keys[rows]

    def candidates(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda rank and table number of the pair that begins at column c of row r."""
        nxt = following[r, c]
        right = np.where(nxt < width, symbols[r, np.minimum(nxt, width - 1)], -1)
        k = m.lookup(symbols[r, c], right)
        rank = np.where(k >= 0, m.rank[k], _FAR)
        if dropout > 0:
            some = np.flatnonzero(k >= 0)
            drawn = _drawn(key[r[some]], k[some], c[some])
            rank[some[drawn < limit]] = _FAR
        return rank, k

    r, c = np.nonzero(live)
    rank, pair = np.full(live.shape, _FAR), np.full(live.shape, -1, np.int64)
    rank[r, c], pair[r, c] = candidates(r, c)
    active = np.arange(len(rows))
    while len(active):
        c = rank[active].argmin(1)
        on = rank[active, c] < _FAR
        active, c = active[on], c[on]
        if not len(active):
            break
        if made is not None:
            made.append((rows[active], pair[active, c], c))
        symbols[active, c] = m.piece[pair[active, c]]
        gone = following[active, c]
        after = following[active, gone]
        live[active, gone] = False
        rank[active, gone] = _FAR
        following[active, c] = after
        inner = np.flatnonzero(after < width)
        preceding[active[inner], after[inner]] = c[inner]
        before = preceding[active, c]
        left = np.flatnonzero(before >= 0)
        again_r, again_c = np.concatenate([active, active[left]]), np.concatenate([c, before[left]])
        rank[again_r, again_c], pair[again_r, again_c] = candidates(again_r, again_c)
    return symbols, live


def _merge_long(m: Model, symbols: np.ndarray, unit: int, key: int, dropout: float, made: list | None = None) -> np.ndarray:
    """Pieces of one unit of any length: a heap of candidate merges by rank, leftmost first; entries of symbols that have changed are passed over."""
    n = len(symbols)
    here, limit = symbols.tolist(), int(_limit(dropout))
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = m.lookup(symbols[:-1], symbols[1:])
    at = np.flatnonzero(pair >= 0)
    if dropout > 0:
        at = at[_drawn(np.full(len(at), key, U), pair[at], at) >= U(limit)]
    # the pair that a place stands for now; -1: none, or skipped for good
    current = np.full(n, -1, np.int64)
    current[at] = pair[at]
    current = current.tolist()
    agenda = list(zip(m.rank[pair[at]].tolist(), at.tolist(), pair[at].tolist(), strict=True))
    heapq.heapify(agenda)
    merges = []

    def consider(c: int) -> None:
        k = m.pair_number(here[c], here[following[c]]) if following[c] < n else -1
        if k >= 0 and dropout > 0 and _drawn_one(key, k, c) < limit:
            k = -1
        current[c] = k
        if k >= 0:
            heapq.heappush(agenda, (m.ranks[k], c, k))

    while agenda:
        _, c, k = heapq.heappop(agenda)
        if current[c] != k:
            continue
        merges.append((k, c))
        gone = following[c]
        here[c], here[gone], current[gone] = m.pieces[k], None, -1
        following[c] = after = following[gone]
        if after < n:
            preceding[after] = c
        consider(c)
        if preceding[c] >= 0:
            consider(preceding[c])
    if made is not None and merges:
        made.append((np.full(len(merges), unit), np.array([k for k, _ in merges]), np.array([c for _, c in merges])))
    return np.array([s for s in here if s is not None], np.int64)


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every unit of texts that begin with the dummy space, and units before each text."""
    space, feed = data == 32, data == 10
    head = np.zeros(len(data) + 1, bool)
    head[1:-1] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    head[offsets] = True
    starts = np.flatnonzero(head[:-1])
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def encode(data: np.ndarray, offsets: np.ndarray, text_keys: np.ndarray, m: Model, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, and n + 1 offsets. text_keys: a hash of each text's id."""
    lengths = np.diff(offsets)
    full = lengths > 0
    grown = np.concatenate([[0], np.cumsum(lengths + full)])
    padded = np.full(grown[-1], 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.cumsum(full), lengths)] = data
    starts, ends, firsts = _units(padded, grown)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    per = np.diff(firsts)
    order = np.arange(len(starts)) - np.repeat(firsts[:-1], per)
    spans = Spans(padded)
    unit = spans.hashes(starts, ends)
    seeded = unit + salted(np.array([seed], U), 7)
    if dropout > 0:
        occurrence = salted(np.repeat(text_keys, per) + order.astype(U) * U(0x9E3779B97F4A7C15), seed)
        agenda = mix(seeded + ((occurrence % U(variants) if variants else occurrence) + U(1)) * U(0xA0761D6478BD642F))
    else:
        agenda = mix(seeded)
    _, at, back = np.unique(unit, return_index=True, return_inverse=True)
    made: list = []
    tokens, n = _cut(m, padded, starts[at], ends[at], agenda[at], 0.0, made)
    if dropout > 0:
        redrawn = np.flatnonzero(_skips(agenda, back, len(at), made, dropout))
        # equal units of one agenda are cut once: rows that repeat an id, or variants
        _, own, again = np.unique(agenda[redrawn], return_index=True, return_inverse=True)
        own = redrawn[own]
        more, more_n = _cut(m, padded, starts[own], ends[own], agenda[own], dropout)
        back[redrawn] = len(at) + again
        tokens, n = np.concatenate([tokens, more]), np.concatenate([n, more_n])
    begin = np.cumsum(n) - n
    tokens = tokens[ragged(begin[back], n[back])]
    total = np.concatenate([[0], np.cumsum(n[back])])
    return tokens, total[firsts]


def _cut(m: Model, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, agenda: np.ndarray, dropout: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the units one after another, and their number for each unit."""
    size = hi - lo
    mine = data[ragged(lo, size)]
    head = (mine & 0xC0) != 0x80
    byte_first = np.concatenate([[0], np.cumsum(size)])
    count = np.concatenate([[0], np.cumsum(head)])
    codes = np.frombuffer(mine.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    marks = codes == 32
    codes = np.where(marks, ord(MARK), codes)
    return _to_ids(m, *merge_units(m, codes, count[byte_first], agenda, dropout, marks, made))


def _skips(agenda: np.ndarray, unit: np.ndarray, units: int, made: list, dropout: float) -> np.ndarray:
    """Which occurrences skip a merge of their unit's cut without dropout. made: those merges, as merge_units gives them."""
    out = np.zeros(len(agenda), bool)
    if not made:
        return out
    owner, pair, place = (np.concatenate([x[k] for x in made]) for k in range(3))
    order = np.argsort(owner, kind="stable")
    pair, place = pair[order], place[order]
    n = np.bincount(owner, minlength=units)
    first = np.cumsum(n) - n
    for lo in range(0, len(agenda), DRAWN_UNITS):
        mine = unit[lo : lo + DRAWN_UNITS]
        which = ragged(first[mine], n[mine])
        by = np.repeat(np.arange(len(mine)), n[mine])
        low = _drawn(agenda[lo : lo + DRAWN_UNITS][by], pair[which], place[which]) < _limit(dropout)
        out[lo + by[low]] = True
    return out


def _to_ids(m: Model, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown letters and letters that are no piece become their bytes."""
    strange = (symbols < 0) | (symbols >= m.size)
    if not strange.any():
        return symbols.astype(np.int32), counts
    back = dict(zip(m.letter_symbols.tolist(), m.letter_codes.tolist(), strict=True))
    code = np.array([-1 - s if s < 0 else back[s] for s in symbols[strange].tolist()], np.int64)
    width = np.ones(len(symbols), np.int64)
    width[strange] = np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4)
    owner = np.repeat(np.arange(len(counts)), counts)
    raw = np.frombuffer("".join(map(chr, code)).encode(), np.uint8)
    out = np.repeat(symbols, width)
    out[np.repeat(strange, width)] = m.byte_ids[raw]
    return out.astype(np.int32), np.bincount(owner, width, len(counts)).astype(np.int64)


def decode(tokens: np.ndarray, offsets: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; the space before each text is taken off."""
    size = m.lengths[tokens]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = m.bytes[ragged(m.offsets[tokens], size)]
    text = ends[offsets]
    keep = np.ones(len(raw), bool)
    keep[text[:-1][np.diff(text) > 0]] = False
    return raw[keep], text - np.concatenate([[0], np.cumsum(np.diff(text) > 0)])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS, ids: bool = True) -> DataFrame:
    """id, n_tokens, n_bytes, decodes (decoding the tokens gives the text), and token_ids if ids."""
    picked = small_batches(docs).select(F.col(id_col), F.xxhash64(F.col(id_col)).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([picked.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("decodes", T.BooleanType()), *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            keys = np.array(batch.column(1)).astype(np.int64).view(U)
            for lo, hi, data, offsets in text_pieces(batch.column(2), 800_000):
                tokens, at = encode(data, offsets, keys[lo:hi], m, dropout, seed, variants)
                raw, back = decode(tokens, at, m)
                if len(raw) == len(data) and (back == offsets).all():
                    wrong = np.concatenate([[0], np.cumsum(raw != data)])
                    good = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    good = np.array([raw[back[i] : back[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(hi - lo)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(np.diff(offsets)), pa.array(good)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens)))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return picked.mapInArrow(run, schema)


def decode_tokens(encoded: DataFrame, id_col: str = "doc_id", path: str = MODEL) -> DataFrame:
    """id and text of rows with token_ids; null tokens give an empty text."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            raw, back = decode(np.concatenate([*lists, np.zeros(0, np.int64)]), at, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].tobytes().decode() for a, b in zip(back[:-1], back[1:], strict=True)], pa.string())], schema.names)

    return encoded.select(id_col, "token_ids").mapInArrow(run, schema)
