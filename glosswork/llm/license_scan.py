"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

Words are runs of letters, digits and non-ASCII bytes in lower case; a shingle is five
words. Windows of 5 * s shingles start at every s-th shingle of a text, for s = 1, 2, 4, ...
A notice of n shingles belongs to the smallest s with n <= 4 * s + 1, so some window holds
any whole copy of it, and more than two fifths of that window are the notice (one fifth for
a notice of one shingle). A window that holds at least 0.8 of the notice then has a Jaccard
similarity with it of at least J = 0.8 * 0.4 / 1.08 = 0.29.

Each of BANDS bands is the minimum of one hash over the window. A band alone meets the
notice's with probability J, so some band does with probability 1 - (1 - J)^BANDS, over
0.999 (over 0.98 for a notice of one shingle). Windows met are verified by counting the
notice's shingles in them; a match holds at least CONTAINMENT of them. Of matches whose
bytes overlap by more than half of the shorter one, only that with the most matched shingles
less missing ones is reported: versions of a licence share most of their words.

Rows: a null or empty text matches nothing, nor does one with fewer than five words.
Repeated rows each give their matches, extra columns are ignored, an empty table gives none.
Notices with fewer than five words are refused. Long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glosswork.llm.license_texts import NOTICES
from glosswork.llm.shared import small_batches
from glosswork.llm.wordkit import blocks, lower_latin, sliding_min, window_hashes, window_starts

SHINGLE = 5
BANDS = 20
CONTAINMENT = 0.8
REACH = 5
OVERLAP = 0.5
TABLE_BITS = 16
WORDS = np.zeros(256, np.uint8)
WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_NONE = np.uint32(0xFFFFFFFF)


def multipliers() -> np.ndarray:
    return np.random.default_rng(29).integers(1 << 62, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Words of the texts, and the hash, first word and row of each shingle."""
    from glosswork.llm.wordkit import Words

    w = Words(lower_latin(data), offsets, WORDS)
    at, row = window_starts(w.first, SHINGLE)
    return w, window_hashes(w.hashes(), SHINGLE)[at], at, row


def step_of(n: int) -> int:
    s = 1
    while n > 4 * s + 1:
        s *= 2
    return s


class Scanner:
    """Notices by window step, with a table of their band values."""

    def __init__(self, notices: list[tuple[str, str]]) -> None:
        self.names = [name for name, _ in notices]
        self.sets: list[np.ndarray] = []
        self.by_step: dict[int, list[int]] = {}
        self.factors = multipliers()
        for i, (_, text) in enumerate(notices):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            h = np.unique(shingles(raw, np.array([0, len(raw)]))[1])
            if not len(h):
                raise ValueError(f"a notice needs {SHINGLE} words: {text!r}")
            self.sets.append(h)
            self.by_step.setdefault(step_of(len(h)), []).append(i)
        self.bands = {s: [self._minima(k, ids) for k in range(BANDS)] for s, ids in self.by_step.items()}

    def values(self, h: np.ndarray, band: int) -> np.ndarray:
        return ((h * self.factors[band]) >> np.uint64(32)).astype(np.uint32)

    def _minima(self, band: int, ids: list[int]) -> tuple[np.ndarray, dict[int, list[int]]]:
        table, owners = np.zeros(1 << TABLE_BITS, bool), {}
        for i in ids:
            low = int(self.values(self.sets[i], band).min())
            table[low >> (32 - TABLE_BITS)] = True
            owners.setdefault(low, []).append(i)
        return table, owners

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(notice, first shingle, last + 1) of the windows whose bands meet a notice's. first: rows' first shingles."""
        found: set[tuple[int, int, int]] = set()
        if not len(h):
            return found
        largest = max(self.by_step)
        layout, size, s = [], np.diff(first), 1
        rows = np.flatnonzero(size)
        starts, counts = first[rows], size[rows]
        while True:  # chunks of s shingles; each level pairs up the chunks of the one before
            lead = np.concatenate([[0], np.cumsum(counts)])[:-1]
            place = np.arange(int(counts.sum())) + np.repeat((REACH - 1) * np.arange(len(counts)), counts)
            layout.append((s, lead, counts, place))
            if s >= largest:
                break
            s, counts = 2 * s, -(-counts // 2)
        for band in range(BANDS):
            low = self.values(h, band)
            for i, (s, lead, counts, place) in enumerate(layout):
                if i:
                    _, before, n, _ = layout[i - 1]
                    pairs = np.arange(int(counts.sum())) - np.repeat(lead, counts)
                    low = np.minimum.reduceat(low, np.repeat(before, counts) + 2 * pairs)
                if s not in self.by_step:
                    continue
                table, owners = self.bands[s][band]
                # windows at the end of a row reach into chunks that are never the least
                spaced = np.full(len(low) + (REACH - 1) * len(counts), _NONE)
                spaced[place] = low
                least = sliding_min(spaced, REACH)[place]
                for at in np.flatnonzero(table[least >> np.uint32(32 - TABLE_BITS)]).tolist():
                    for notice in owners.get(int(least[at]), ()):
                        r = int(np.searchsorted(lead, at, side="right")) - 1
                        start = int(starts[r]) + (at - int(lead[r])) * s
                        end = min(start + REACH * s, int(starts[r] + size[rows[r]]))
                        found.add((notice, start, end))
        return found

    def scan(self, data: np.ndarray, offsets: np.ndarray, candidates=None) -> list[tuple[int, int, float, int, int]]:
        """(row, notice, containment, first byte, last + 1 byte) of the best match of each row and license."""
        w, h, at, row = shingles(data, offsets)
        first = np.searchsorted(row, np.arange(len(offsets)))
        found: dict[int, list[tuple[int, int, float, int, int, int]]] = {}
        for notice, start, end in sorted((candidates or self.candidates)(h, first)):
            hit = np.flatnonzero(np.isin(h[start:end], self.sets[notice]))
            matched, size = len(np.unique(h[start:end][hit])), len(self.sets[notice])
            if matched < CONTAINMENT * size:
                continue
            r = int(row[start])
            lo = int(w.starts[at[start + hit[0]]] - offsets[r])
            hi = int(w.ends[at[start + hit[-1]] + SHINGLE - 1] - offsets[r])
            found.setdefault(r, []).append((2 * matched - size, -lo, notice, matched / size, lo, hi))
        out = []
        for r in sorted(found):
            taken: list[tuple[int, int, int, float]] = []  # of matches that overlap, the one with most shingles less those that lack
            for _, _, notice, share, lo, hi in sorted(found[r], key=lambda x: (-x[0], -x[1], x[2])):
                if all(min(hi, d) - max(lo, c) <= OVERLAP * min(hi - lo, d - c) for c, d, _, _ in taken):
                    taken.append((lo, hi, notice, share))
            best: dict[str, tuple[int, int, float, int, int]] = {}
            for lo, hi, notice, share in taken:  # better ones first
                best.setdefault(self.names[notice], (r, notice, share, lo, hi))
            out += [best[name] for name in sorted(best)]
        return out


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document and license: doc_id, license, containment, start_byte and end_byte of the best match."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            for block in blocks(batch.column(1), 1_000_000):
                rows = scanner.scan(block.data, block.offsets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(pa.array([block.lo + x[0] for x in rows], pa.int64())),
                        "license": pa.array([scanner.names[x[1]] for x in rows], pa.string()),
                        "containment": pa.array([x[2] for x in rows], pa.float64()),
                        "start_byte": pa.array([x[3] for x in rows], pa.int64()),
                        "end_byte": pa.array([x[4] for x in rows], pa.int64()),
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, license string, containment double, start_byte long, end_byte long")


def op6(spark, sf_dir: str) -> DataFrame:
    """All license matches of the documents table."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
