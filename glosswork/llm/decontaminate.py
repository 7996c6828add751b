"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are normalised (lower case, runs of other signs as one space) and compared as UTF-8
bytes. A benchmark item of up to SEGMENT bytes is one segment; a longer one is cut into
segments of that length at half-length steps, so a copied passage of one and a half segments
holds at least one whole segment. A region of a document matches a segment of m bytes if at
most e = rate * m edits turn one into the other. Such a region shares at least m - q + 1 - q * e
q-grams with the segment, and their diagonals (place in the document less place in the segment)
lie within e of each other. So shared q-grams are counted in diagonal bands of 2 * (e + 1) that
overlap by half; bands that reach the bound are aligned in a band of diagonals, and the rest
cannot match.

Some q-grams stand in very many segments. Of a segment with COMMON ones among its grams the
commonest are left out of the index, and each lowers by one the number that a match must share,
down to KEEP: a match still shares that many of the rest. So no document meets all segments
over a stock phrase, and none is lost.

Each document is worked on alone. The benchmark goes to every task in parts of at most
PART_BYTES of text, and a Python worker builds a part's q-gram index once; a larger benchmark
takes one scan per part.

Rows: a null or empty document matches nothing; null items and items with fewer than q bytes
after normalisation match nothing. Repeated documents each give their rows, repeated items too.
Extra columns are ignored by ``matches`` and pass through ``without_matches``. Empty tables
give no matches. Long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import cut, small_batches
from glosswork.llm.wordkit import blocks, lower_latin

Q = 8
RATE = 0.09
SEGMENT = 100
PART_BYTES = 2_000_000
COMMON, KEEP = 64, 6
#: Slots of the bitmap before the index: about 16 for each q-gram, within these powers of two.
LEAST_BITS, MOST_BITS = 18, 26
ROW_GAP = 1 << 12
#: Meetings of a text's q-grams with segments that are counted at once; one text with more is counted by itself.
MEETINGS = 2_000_000
_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, row offsets there, and the place of each byte in the input."""
    data = lower_latin(data)
    sign = _SIGN[data]
    keep = ~sign
    keep[1:] |= sign[1:] & ~sign[:-1]
    head = offsets[:-1][offsets[:-1] < len(data)]
    keep[head] = ~sign[head]  # no row begins with a space
    place = np.flatnonzero(keep)
    out = np.where(sign[place], np.uint8(0x20), data[place])
    return out, np.searchsorted(place, offsets), place


def codes(data: np.ndarray) -> np.ndarray:
    """Each run of Q = 8 bytes as one integer."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        if len(x) <= width:
            return np.zeros(0, np.uint64)
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    return x


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


@dataclass
class Index:
    """Segments of a part of the benchmark, and where each q-gram occurs in them."""

    item: np.ndarray  # item number of each segment
    segments: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that a match needs
    code: np.ndarray
    first: np.ndarray  # CSR: occurrences of code[i] are first[i]:first[i + 1]
    segment_of: np.ndarray
    at: np.ndarray

    @property
    def bits(self) -> int:
        return int(np.clip(math.ceil(math.log2(16 * max(1, len(self.code)))), LEAST_BITS, MOST_BITS))

    @property
    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, bool)
        out[_slot(self.code, self.bits)] = True
        return out


def build_index(texts: pa.Array, rate: float = RATE, segment: int = SEGMENT) -> Index | None:
    """The index of the given items; None if no item is long enough."""
    item, segments = [], []
    for block in blocks(texts):
        flat, offsets, _ = normalised(block.data, block.offsets)
        for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            x = flat[a:b]
            x = x[:-1] if len(x) and x[-1] == 0x20 else x
            last = max(0, len(x) - segment)
            for s in dict.fromkeys([*range(0, last, segment // 2), last]):
                if len(x[s : s + segment]) >= Q:
                    item.append(block.lo + r)
                    segments.append(x[s : s + segment].copy())
    if not segments:
        return None
    m = np.array([len(x) for x in segments])
    edits = np.minimum((rate * m).astype(int), (m - Q) // Q)  # beyond that the lemma asks for no q-gram
    least = m - Q + 1 - Q * edits
    grams = [codes(x) for x in segments]
    code = np.concatenate(grams)
    of = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    at = np.concatenate([np.arange(len(g), dtype=np.int16) for g in grams])
    keep = _indexed(code, of, least)
    least = least - np.bincount(of[~keep], minlength=len(m))
    code, of, at = code[keep], of[keep], at[keep]
    order = np.argsort(code, kind="stable")
    distinct, first = np.unique(code[order], return_index=True)
    return Index(np.array(item), segments, edits, least, distinct, np.append(first, len(code)), of[order], at[order])


def _indexed(code: np.ndarray, of: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which q-grams of the segments go into the index: all but the commonest, as far as a segment's bound allows."""
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    often = count[inverse]
    common = np.flatnonzero(often > COMMON)
    common = common[np.lexsort((-often[common], of[common]))]
    segment = of[common]
    rank = np.arange(len(common)) - np.searchsorted(segment, segment)
    keep = np.ones(len(code), bool)
    keep[common[rank < least[segment] - KEEP]] = False
    return keep


def banded_distance(pattern: np.ndarray, text: np.ndarray, anchor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the least edit distance of the pattern to a stretch of the text, and the diagonal where it ends.

    pattern: (n, m), zero-padded; text: (n, m + width - 1). Only diagonals 0 to width - 1 are used, where diagonal d
    sets pattern byte i against text byte i + d. The stretch begins anywhere, or at text byte ``anchor``.
    Zeros in the pattern end it; zeros in the text match nothing.
    """
    n, m = pattern.shape
    width = text.shape[1] - m + 1
    step = np.arange(width)
    begin = np.zeros(width) if anchor is None else np.where(step < anchor, 1 << 20, step - anchor)
    now = np.broadcast_to(begin, (n, width)).astype(np.int32)
    live = pattern > 0
    for i in range(m):
        diagonal = now + (text[:, i : i + width] != pattern[:, i : i + 1])
        diagonal[:, :-1] = np.minimum(diagonal[:, :-1], now[:, 1:] + 1)  # a pattern byte without partner
        new = np.minimum.accumulate(diagonal - step, axis=1) + step  # text bytes without partner
        now = np.where(live[:, i : i + 1], new, now)
    end = now.argmin(axis=1)
    return now[np.arange(n), end], end


class Matcher:
    """Finds matches of an index's segments in blocks of texts."""

    def __init__(self, index: Index) -> None:
        self.index, self.bitmap, self.bits = index, index.bitmap, index.bits
        m = np.array([len(x) for x in index.segments])
        self.m, self.top = m, int(m.max())
        self.span, self.need = int((m + index.edits).max()), int(index.least.min())
        self.pattern = np.zeros((len(m), self.top), np.uint8)
        self.turned = np.zeros_like(self.pattern)
        for i, x in enumerate(index.segments):
            self.pattern[i, : len(x)] = x
            self.turned[i, : len(x)] = x[::-1]

    def _hits(self, code: np.ndarray) -> np.ndarray:
        """Places whose q-gram is in the index, where enough of them stand close together."""
        maybe = self.bitmap[_slot(code, self.bits)]
        run = np.zeros(len(code) + self.span + 1, np.int32)
        np.cumsum(maybe, out=run[1 : len(code) + 1])
        run[len(code) + 1 :] = run[len(code)]
        dense = run[self.span : self.span + len(code)] - run[: len(code)] >= self.need  # windows by their start
        edge = np.zeros(len(code) + 1, np.int32)
        starts = np.flatnonzero(dense)
        edge[starts] += 1
        np.subtract.at(edge, np.minimum(starts + self.span, len(code)), 1)
        at = np.flatnonzero(maybe & (np.cumsum(edge[:-1]) > 0))
        return at

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, edits, first and last + 1 byte (in the given data, from the row's start) of each matching segment."""
        ix = self.index
        flat, rows_at, place = normalised(data, offsets)
        code = codes(flat)
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(code):
            return none
        at = self._hits(code)
        where = np.minimum(np.searchsorted(ix.code, code[at]), len(ix.code) - 1)
        true = ix.code[where] == code[at]
        at, where = at[true], where[true]
        row = np.searchsorted(rows_at, at, side="right") - 1
        inside = at + Q <= rows_at[row + 1]
        at, where, row = at[inside], where[inside], row[inside]
        n = ix.first[where + 1] - ix.first[where]
        # whole rows at a time, so that few meetings of q-grams and segments are held at once
        total = np.concatenate([[0], np.cumsum(n)])
        edges, begin = [0], np.searchsorted(row, np.arange(len(rows_at)))
        while edges[-1] < len(row):
            full = int(np.searchsorted(total, total[edges[-1]] + MEETINGS, side="right")) - 1
            ahead = begin[(begin > edges[-1])]
            inside = ahead[ahead <= full]
            edges.append(int(inside[-1]) if len(inside) else int(ahead[0]))
        found = [self._bands(at[a:b], where[a:b], row[a:b], n[a:b]) for a, b in zip(edges, edges[1:])]
        if not found:
            return none
        segment, row, low = np.concatenate(found, axis=1)
        if not len(segment):
            return none
        low = low - ROW_GAP - row * ROW_GAP
        out = [self._verify(flat, rows_at, segment[i : i + 2048], row[i : i + 2048], low[i : i + 2048]) for i in range(0, len(segment), 2048)]
        row, segment, edits, start, end = (np.concatenate(x) for x in zip(*out))
        return row, ix.item[segment], edits, place[start] - offsets[row], place[end - 1] + 1 - offsets[row]

    def _bands(self, at: np.ndarray, where: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Segment, row and lowest diagonal of the bands that reach a segment's bound, from the places whose q-grams are in the index."""
        ix = self.index
        occ = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ix.first[where], n)
        segment = ix.segment_of[occ].astype(np.int64)
        # rows far apart, so that no band holds two of them
        diagonal = np.repeat(at + row * ROW_GAP, n) - ix.at[occ] + ROW_GAP
        row = np.repeat(row, n)
        half = ix.edits[segment] + 1
        found = []
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            key = segment * np.int64(1 << 40) + band
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, int)
            count = np.diff(np.append(first, len(key)))
            pick = order[first]
            good = pick[count >= ix.least[segment[pick]]]
            found.append(np.stack([segment[good], row[good], band[good] * 2 * half[good] - shift * half[good]]))
        return np.concatenate(found, axis=1)

    def _verify(self, flat, rows_at, segment, row, low) -> tuple[np.ndarray, ...]:
        ix, most = self.index, int(self.index.edits.max())
        width = 4 * most + 3

        def taken(at: np.ndarray, row: np.ndarray) -> np.ndarray:
            ok = (at >= rows_at[row][:, None]) & (at < rows_at[row + 1][:, None])
            return np.where(ok, flat[np.clip(at, 0, len(flat) - 1)], 0)

        base = low - most
        text = taken(base[:, None] + np.arange(self.top + width - 1), row)
        edits, end = banded_distance(self.pattern[segment], text)
        good = edits <= ix.edits[segment]
        segment, row, edits = segment[good], row[good], edits[good]
        m = self.m[segment]
        stop = np.minimum(base[good] + m + end[good], rows_at[row + 1])
        # where the stretch starts: the same, backwards from its end
        text = taken(stop[:, None] - 1 + most - np.arange(self.top + 2 * most), row)
        text[:, :most] = 0
        _, back = banded_distance(self.turned[segment], text, most)
        start = np.maximum(stop - m - back + most, rows_at[row])
        return row, segment, edits.astype(np.int64), start, stop


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[pa.Table]:
    """item_id and text of each part of the benchmark, of about ``part_bytes`` of text; items with too little text are left out."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    rows = benchmark.where(F.octet_length("text") >= Q).select("item_id", "text")
    if parts > 1:
        rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")).repartition("part"))
    for p in range(parts):
        yield (rows if parts == 1 else rows.where(F.col("part") == p).drop("part")).toArrow().combine_chunks()


@lru_cache(maxsize=1)
def _matcher(texts: bytes) -> Matcher | None:
    """The matcher of a part's texts (an Arrow stream); a Python worker keeps the last one."""
    column = pa.ipc.open_stream(texts).read_all().column("text").combine_chunks()
    index = build_index(column) if len(column) else None
    return None if index is None else Matcher(index)


def _stream(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    texts = part.select(["text"])
    with pa.ipc.new_stream(sink, texts.schema) as writer:
        writer.write_table(texts)
    return sink.getvalue().to_pybytes()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that match: doc_id, item_id, n_segments, edits (of the best segment),
    start_byte and end_byte (of the text that the matching segments span)."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_segments long, edits long, start_byte long, end_byte long"
    out = small_batches(docs).sparkSession.createDataFrame([], schema)
    for part in benchmark_parts(benchmark):
        items, texts = part.column("item_id").combine_chunks(), _stream(part)

        def found(batches: Iterator[pa.RecordBatch], items=items, texts=texts) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(texts)
            for batch in batches:
                for block in blocks(batch.column(1)) if matcher else ():
                    yield _pairs(batch, block, items, matcher)

        out = out.union(docs.select("doc_id", "text").mapInArrow(found, schema))
    return out


def _pairs(batch: pa.RecordBatch, block, items: pa.Array, matcher: Matcher) -> pa.RecordBatch:
    row, item, edits, start, end = matcher.find(block.data, block.offsets)
    # a segment may be found in two overlapping bands, at one place
    order = np.lexsort((edits, start, item, row))
    row, item, edits, start, end = (x[order] for x in (row, item, edits, start, end))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    distinct = np.ones(len(row), bool)
    distinct[1:] = new[1:] | (start[1:] != start[:-1])

    def per_pair(function, x: np.ndarray) -> np.ndarray:
        return function.reduceat(x, first) if len(first) else np.zeros(0, np.int64)

    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column(0).take(pa.array(row[first] + block.lo)),
            "item_id": items.take(pa.array(item[first])),
            "n_segments": pa.array(per_pair(np.add, distinct.astype(np.int64)), pa.int64()),
            "edits": pa.array(per_pair(np.minimum, edits), pa.int64()),
            "start_byte": pa.array(per_pair(np.minimum, start), pa.int64()),
            "end_byte": pa.array(per_pair(np.maximum, end), pa.int64()),
        }
    )


#: Parts of the benchmark that one stage goes through: each has a Python worker of its own in every task.
PARTS_IN_STAGE = 4


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that match no item. What is left is written down every PARTS_IN_STAGE
    parts of the benchmark."""
    at = small_batches(docs).columns.index("text")
    for i, part in enumerate(benchmark_parts(benchmark)):
        if i and i % PARTS_IN_STAGE == 0:
            docs = cut(docs)

        def clean(batches: Iterator[pa.RecordBatch], texts=_stream(part)) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(texts)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in blocks(batch.column(at)) if matcher else ():
                    keep[block.lo + matcher.find(block.data, block.offsets)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op4(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
