"""Removal of globally repeated line chunks with content-defined boundaries.

A text's lines are hashed; a rolling hash over each line and the one before it
decides whether a chunk ends after the line, so that an insertion moves only the
boundaries beside it. A line of ``LONG_WORDS`` words or more is a chunk of its own. Chunks
of at least two lines, and such long lines, are candidates. A chunk that several ids
hold stays in the text of the least id and goes from the others; a repetition within
one text stays at its first place. Before anything goes its bytes are compared
with those of the copy that stays.

Passages need no boundary: the least runs of lines of ``LONG_WORDS`` words or more from
every line on and up to every line are candidates too. All repeated line runs of so many
words are unions of them, so they go whole, head and tail, wherever chunks end. What a
repeated passage has beyond the chunks that go is compared and taken out; a line that goes
lies in the least id that holds the passage, or before in the same text, and by the same
rule one copy of every line stays.

Plan: one light table of (fingerprint, id, place), combined to the fingerprints of
several places; passages of one text that lie alike in the same other text are joined; the
spans come back to their texts by one shuffle of texts by id; their bytes alone, equal ones
combined first, are shuffled for the comparison. Copies of a frequent chunk are dealt to several tasks. ``removed_chunks`` counts chunks, ``removed_bytes`` all bytes.

Defined results. A null id takes no part and its text is unchanged; a null or empty
text is unchanged; rows that repeat an id are the same document, are treated alike
and keep what that id keeps; two different texts under one id likewise; an empty table gives an
empty result. Other columns are kept; the result columns replace input columns of the
same name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import few, is_few, salted_join, settle, small_batches
from .textkit import SPACE, Spans, U, lines, mix, salted, sliced, text_pieces

#: One line in so many ends a chunk.
MEAN_LINES = 3
LONG_WORDS = 50
MIN_LINES = 2
#: A remainder of fewer words is no document of its own.
MIN_WORDS_LEFT = 10
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of all lines, lines before each text, text and words of each line."""
    starts, ends, firsts = lines(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    heads = ~SPACE[data]
    heads[1:] &= SPACE[data[:-1]]
    heads[offsets[:-1][offsets[:-1] < len(data)]] |= ~SPACE[data[offsets[:-1][offsets[:-1] < len(data)]]]
    count = np.concatenate([[0], np.cumsum(heads)])
    return starts, ends, firsts, owner, count[ends] - count[starts]


def chunks(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All chunks of all texts: text number, first byte, byte after the last (line feed included), lines, words, hash."""
    return _chunks(Spans(data), offsets, *_lines(data, offsets))


def _chunks(spans: Spans, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, owner: np.ndarray, n_words: np.ndarray) -> dict[str, np.ndarray]:
    hashes = spans.hashes(starts, ends)
    before = np.concatenate([[U(0)], hashes[:-1]]) if len(hashes) else hashes
    first = np.zeros(len(hashes), bool)
    first[firsts[:-1]] = True
    rolled = mix(hashes * U(3) + np.where(first, U(0), before) * U(0x9E3779B97F4A7C15))
    long = n_words >= LONG_WORDS
    last = np.zeros(len(hashes), bool)
    last[firsts[1:] - 1] = True
    end = (rolled % U(MEAN_LINES) == 0) | long | last
    end[:-1] |= long[1:]
    stop = np.flatnonzero(end)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64) if len(stop) else stop
    lo, hi = starts[start], ends[stop]
    words_before = np.concatenate([[0], np.cumsum(n_words)])
    return {
        "text": owner[start],
        "lo": lo,
        "hi": np.minimum(hi + 1, offsets[owner[start] + 1]),
        "lines": stop - start + 1,
        "words": words_before[stop + 1] - words_before[start],
        "fp": salted(spans.hashes(lo, hi), 8),
    }


def _candidates(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["words"] > 0) & ((c["lines"] >= MIN_LINES) | (c["words"] >= LONG_WORDS))


def _passages(spans: Spans, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, owner: np.ndarray, n_words: np.ndarray) -> dict[str, np.ndarray]:
    """The least line runs of LONG_WORDS words from every line on and up to every line: text, first byte, byte after the last (no line feed), hash."""
    total, place = np.concatenate([[0], np.cumsum(n_words)]), np.arange(len(starts))
    onward = np.searchsorted(total, total[:-1] + LONG_WORDS, "left") - 1
    upward = np.searchsorted(total, total[1:] - LONG_WORDS, "right") - 1
    fits, reaches = onward < firsts[owner + 1], upward >= firsts[owner]
    # a run that both rules give counts once
    both = np.unique(np.concatenate([place[fits] * len(place) + onward[fits], upward[reaches] * len(place) + place[reaches]]))
    first, last = both // max(len(place), 1), both % max(len(place), 1)
    return {"text": owner[first], "lo": starts[first], "hi": ends[last], "fp": salted(spans.hashes(starts[first], ends[last]), 9)}


def _light(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, id, lo, hi) of the candidates of texts with an id; places in bytes. A passage's fp is odd, a chunk's even."""
    picked = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                spans, parts = Spans(data), _lines(data, offsets)
                c, p = _chunks(spans, offsets, *parts), _passages(spans, *parts)
                at = np.flatnonzero(_candidates(c))
                text, first, last = (np.concatenate([c[k][at], p[k]]) for k in ("text", "lo", "hi"))
                fp = np.concatenate([c["fp"][at] & ~U(1), p["fp"] | U(1)])
                if len(fp):
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array(text))
                    own = offsets[text]
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), ids, pa.array((first - own).astype(np.int32)), pa.array((last - own).astype(np.int32))], ["fp", "id", "lo", "hi"])

    return picked.mapInArrow(run, T.StructType([T.StructField("fp", T.LongType()), picked.schema["id"], T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: bool = True, least_words: int = 0) -> DataFrame:
    """docs with repeated chunks and passages taken out of the text.

    counted: adds ``removed_chunks`` and ``removed_bytes`` (long). Rows that lost any and have fewer than least_words left go.
    """
    light = _light(small_batches(docs), id_col, text_col)
    # the first place of the least id; repeated rows of an id are the same place
    held = light.groupBy("fp").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("n"))
    spread = held.filter("n > 1").select("fp", F.col("first.id").alias("keeper"), F.col("first.lo").alias("from"))
    keeps = F.col("id") == F.col("keeper")
    spans = (
        salted_join(light, spread, ["fp"], "id")
        .filter((F.col("fp").bitwiseAND(F.lit(1)) == 0) | ~keeps | (F.col("lo") != F.col("from")))
        .groupBy("id")
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "fp", keeps.alias("keeps"), "keeper", "from"))).alias("spans"))
    )
    cuts = settle(_cuts(spans))
    asked = cuts.select(F.explode("_outer").alias("p")).groupBy(F.col("p.keeper").alias("_id")).agg(F.sort_array(F.collect_set(F.struct(F.col("p.from").alias("from"), (F.col("p.hi") - F.col("p.lo")).alias("n")))).alias("_asked"))
    # the input's columns travel in one struct, so that none can clash with these
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marks = settle(cuts.join(asked, "_id", "full"))
    if is_few(marks):
        # the marks go to every task, and texts stay where they are read
        joined = packed.join(F.broadcast(marks), "_id", "left")
        differing = few(settle(_differing(packed.join(F.broadcast(marks), "_id"), text_col)))
    else:
        # one exchange of the texts serves the comparison and the rewriting, in one plan
        joined = packed.join(marks, "_id", "left")
        differing = _differing(joined, text_col)
    return _rewrite(joined, differing, text_col, docs.schema, counted, least_words)


def split_spans(spans: list[dict]) -> tuple[list[dict], list[dict], list[dict]]:
    """Sorted spans of one id: its chunks; its passages that lie before in the same text; of the others, joined where they lie alike in the same text, what no chunk of another id covers."""
    spanned = [s for s in spans if not s["fp"] & 1]
    inner = [s for s in spans if s["fp"] & 1 and s["keeps"]]
    joined: dict[tuple, list[list[int]]] = {}
    for s in spans:
        if s["fp"] & 1 and not s["keeps"]:
            own = joined.setdefault((s["keeper"], s["from"] - s["lo"]), [])
            if own and s["lo"] <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], s["hi"])
            else:
                own.append([s["lo"], s["hi"]])
    gone = [(s["lo"], s["hi"]) for s in spanned if not s["keeps"]]
    begins = [lo for lo, _ in gone]
    outer = []
    for (keeper, shift), runs in joined.items():
        for lo, hi in runs:
            k = max(bisect_right(begins, lo) - 1, 0)
            while lo < hi:
                while k < len(gone) and gone[k][1] <= lo:
                    k += 1
                stop = gone[k][0] if k < len(gone) else hi
                if lo < min(stop, hi):
                    outer.append({"lo": lo, "hi": min(stop, hi), "keeper": keeper, "from": lo + shift, "fed": stop < hi})
                lo = gone[k][1] if stop < hi else hi
    return spanned, inner, outer


def _cuts(spans: DataFrame) -> DataFrame:
    """(_id, _spans, _inner, _outer): split_spans of every id."""
    key = spans.schema["id"].dataType
    place = [T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]
    chunk = T.StructType([*place, T.StructField("fp", T.LongType()), T.StructField("keeps", T.BooleanType())])
    inner = T.StructType([*place, T.StructField("from", T.IntegerType())])
    outer = T.StructType([*place, T.StructField("keeper", key), T.StructField("from", T.IntegerType()), T.StructField("fed", T.BooleanType())])
    schema = T.StructType([T.StructField("_id", key), *(T.StructField(n, T.ArrayType(t)) for n, t in (("_spans", chunk), ("_inner", inner), ("_outer", outer)))])
    own = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [split_spans(s.as_py()) for s in batch.column(1)]
            columns = [pa.array([[{f.name: s[f.name] for f in own.field(k + 1).type.value_type} for s in row[k]] for row in split], own.field(k + 1).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], own.names)

    return spans.select("id", "spans").mapInArrow(run, schema)


def _differing(joined: DataFrame, text_col: str) -> DataFrame:
    """(_id, _differs): chunks and passages whose bytes in that id are not those of the copy that stays; none, but for a hash collision.

    Equal bytes of a key are one row before they are shuffled, so copies of a frequent chunk do not meet in one task.
    """
    touched = joined.filter(F.col("_spans").isNotNull() | F.col("_asked").isNotNull()).select("_id", F.col("_row").getField(text_col).cast("string").alias("text"), "_spans", "_outer", "_asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts, spans, outer, asked = batch.columns
            rows = []
            for i in range(batch.num_rows):
                raw, own = (texts[i].as_py() or "").encode(), ids[i].as_py()
                rows += [(i, f"c{s['fp']}", f"c{s['fp']}", s["keeps"], raw[s["lo"] : s["hi"]].rstrip(b"\n")) for s in spans[i].as_py() or ()]
                rows += [(i, f"p{s['from']}:{s['hi'] - s['lo']}:{s['keeper']}", tag(s), False, raw[s["lo"] : s["hi"]]) for s in outer[i].as_py() or ()]
                rows += [(i, f"p{s['from']}:{s['n']}:{own}", "", True, raw[s["from"] : s["from"] + s["n"]]) for s in asked[i].as_py() or ()]
            if rows:
                take, key, tags, keeps, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(take)), pa.array(tags), pa.array(keeps), pa.array(data, pa.binary())], ["key", "_id", "tag", "keeps", "data"])

    schema = T.StructType([T.StructField("key", T.StringType()), touched.schema["_id"], T.StructField("tag", T.StringType()), T.StructField("keeps", T.BooleanType()), T.StructField("data", T.BinaryType())])
    found = touched.mapInArrow(run, schema)
    pieces = found.groupBy("key", "data").agg(F.bool_or("keeps").alias("keeps"), F.bool_or(~F.col("keeps")).alias("goes"))
    # of the copies under a key that stay (rows that repeat an id), the least bytes are the ones that count
    stays = F.min(F.when(F.col("keeps"), F.col("data")))
    compared = pieces.groupBy("key").agg(stays.alias("stays"), F.collect_list(F.when(F.col("goes"), F.col("data"))).alias("gone")).select("key", "stays", F.explode("gone").alias("data"))
    named = lambda rows, *more: rows.select("key", F.sha2("data", 256).alias("digest"), *more)
    bad = named(compared.filter(~F.col("data").eqNullSafe(F.col("stays"))))
    return named(found.filter("not keeps"), "_id", "tag").join(bad, ["key", "digest"], "left_semi").groupBy("_id").agg(F.collect_set("tag").alias("_differs"))


def tag(piece: dict) -> str:
    """What a passage is called among those of its id that differ."""
    return f"p{piece['lo']}:{piece['hi']}:{piece['keeper']}:{piece['from']}"


def cut_text(raw: bytes, spans: list[dict], inner: list[dict], outer: list[dict], differs: set[str]) -> tuple[bytes, int]:
    """The text without the spans that do not stay, and how many chunks went."""
    cuts, seen = [], {}
    for s in spans:
        piece = raw[s["lo"] : s["hi"]]
        if f"c{s['fp']}" in differs:
            continue
        if s["keeps"] and seen.setdefault(s["fp"], piece.rstrip(b"\n")) == piece.rstrip(b"\n") and (s["fp"], "at") not in seen:
            seen[(s["fp"], "at")] = s["lo"]
            continue
        if s["keeps"] and seen[s["fp"]] != piece.rstrip(b"\n"):
            continue
        cuts.append((s["lo"], s["hi"]))
    gone = len(cuts)
    for s in outer:
        if tag(s) not in differs:
            # a piece before a chunk has its last line feed in it
            cuts.append((s["lo"], s["hi"] + (not s["fed"])))
    for s in inner:
        size = s["hi"] - s["lo"]
        if raw[s["lo"] : s["hi"]] == raw[s["from"] : s["from"] + size]:
            # where a passage overlaps its first place, that stays whole
            lo = max(s["lo"], s["from"] + size + 1)
            if lo < s["hi"]:
                cuts.append((lo, s["hi"] + 1))
    out, at = [], 0
    for lo, hi in sorted(cuts):
        if lo > at:
            out.append(raw[at:lo])
        at = max(at, min(hi, len(raw)))
    out.append(raw[at:])
    left = b"".join(out)
    if cuts and at == len(raw) and left.endswith(b"\n") and not raw.endswith(b"\n"):
        left = left[:-1]
    return left, gone


def _rewrite(joined: DataFrame, differing: DataFrame, text_col: str, columns: T.StructType, counted: bool, least_words: int) -> DataFrame:
    marked = joined.join(differing, "_id", "left")
    extra = [("removed_chunks", T.LongType()), ("removed_bytes", T.LongType())] if counted else []
    names = {n for n, _ in extra}
    kept = [i for i, f in enumerate(columns) if f.name.lower() not in names]
    schema = T.StructType([*(columns[i] for i in kept), *(T.StructField(n, k) for n, k in extra)])
    at = [columns[i].name for i in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, *places, differs = batch.columns
            fields = row.flatten()
            out = [fields[i] for i in kept]
            touched = np.flatnonzero(np.array(places[0].is_valid()))
            texts = out[at].to_pylist() if len(touched) else None
            gone, lost, stays = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            for i in touched:
                if texts[i] is None:
                    continue
                raw = texts[i].encode()
                left, gone[i] = cut_text(raw, *(p[int(i)].as_py() for p in places), set(differs[int(i)].as_py() or ()))
                lost[i] = len(raw) - len(left)
                texts[i] = left.decode()
                stays[i] = not lost[i] or len(_WORD.findall(left)) >= least_words
            if texts is not None:
                out[at] = pa.array(texts, pa.string())
            done = pa.RecordBatch.from_arrays([*out, *([pa.array(gone), pa.array(lost)] if counted else [])], schema.names)
            yield done if stays.all() else done.filter(pa.array(stays))

    return marked.select("_row", "_spans", "_inner", "_outer", "_differs").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated chunks and passages taken out; rows that lost any and have under MIN_WORDS_LEFT words left go, others stay, with all columns."""
    return remove_repeated_chunks(docs, id_col, text_col, counted=False, least_words=MIN_WORDS_LEFT)
