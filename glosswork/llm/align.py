"""Alignment of two tokenizers' tokens over the bytes of the same text.

The tokens of B lie in a static interval index: sorted starts and sorted ends. Each token of A
stabs it with two bisections, which give the run of B tokens that its byte range overlaps; the
pairs are the links. A byte offset that no token of either side spans, that is where an A and a B
token both end, is a gap, and gaps are the borders of the groups.

Both tokenizers always cut before blanks that follow a non-blank, so a text is a sequence of
segments (blanks and the word after them), and a chunk aligns each distinct segment once, all of
them in one index. Whether that holds for B is read off its vocabulary; if not, a text is one
segment. Long texts are split part by part.

How often two ids are linked is counted over the whole corpus. Documents are gathered into chunks
of CHUNK bytes of text; a chunk is one row with its own list of id pairs and, for each document,
how often each segment occurs. Only a chunk's distinct pairs are shuffled: once to be summed, once
to bring the sums back, where a co-group of one chunk row with its pairs' sums gives the
documents' figures. A pair that is frequent everywhere has one row per chunk, summed before the
shuffle and split by the adaptive join after it. Nothing is broadcast or sent to the driver.

Rows: texts that are null, empty, or whose joined tokens differ from space + text on either side
(a text with U+2581, say) have no tokens: zeros and ''. Repeated rows and null doc_ids stay, extra
columns are ignored, an empty table gives an empty result, long texts are taken whole. Ties for
the highest count of a B id all count as best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import cut, small_batches

#: Vocabulary files among the installed public tokenizers.
A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk, and documents at most.
CHUNK, CHUNK_ROWS = 8_000_000, 20_000
#: Distinct segments that are aligned at once.
SEGMENTS = 10_000
#: Characters of a text that are split at once.
PART = 1 << 20

#: Blanks to cut before, and blanks that must not stand before a cut as tokenizers differ on them.
BLANK, ODD = " \n\t\x0b\x0c", "\r\x1c-\x1f\x85\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
SEGMENT = re.compile(f"[{BLANK}]*[^{BLANK}]+(?:(?<=[{ODD}])[{BLANK}]+[^{BLANK}]*)*|[{BLANK}]+")
CUT = re.compile(f"(?<=[^{BLANK}{ODD}])(?=[{BLANK}])")
BLANKS = set(BLANK)
ODD_KEY = " \n"
UNEVEN = re.compile(f"[{BLANK[2:]}{ODD}]").search
DOUBLE = ("  ", " \n", "\n ", "\n\n")
#: Segments on which all versions of Unicode agree.
PLAIN = re.compile(f"[{BLANK}]+[!-~\u00a1-\u00ac\u00ae-\u024f]+").fullmatch


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For token lengths on both sides: of each A token the run [low, high) of B tokens that it overlaps, and whether a
    group ends after it. Tokens without bytes overlap nothing."""
    b_ends, a_ends = np.cumsum(b), np.cumsum(a)
    low = np.searchsorted(b_ends, a_ends - a, "right")
    high = np.maximum(low, np.searchsorted(b_ends - b, a_ends, "left"))
    border = np.zeros(len(a), bool)
    some = high > low
    border[some] = b_ends[high[some] - 1] == a_ends[some]
    return low, high, border


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        chars, vocabulary = _byte_of_char(), self.a.get_vocab(with_added_tokens=False)
        ranks = {bytes(chars[c] for c in piece): i for piece, i in vocabulary.items()}
        self.a_bytes = {i: piece.encode() for piece, i in self.a.get_vocab().items()} | {i: b for b, i in ranks.items()}
        self.fast = self._fast(a_path, ranks, vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        joins = re.compile(f"[^{BLANK}{ODD}▁][{BLANK}▁]|▁[{BLANK[1:]}]")
        self.by_segment = not any(joins.search(p) for p in pieces)
        self.first_b = n = max(self.a_bytes) + 1
        self.a_table, self.b_table = _Table([self.a_bytes.get(i, b"") for i in range(n)]), _Table(self.b_bytes)
        self.a_sizes = self.a_table.sizes
        # every id as it is written within its side of a group, then as the last of it
        ids = [b"%d" % i for i in range(n)], [b"%d" % i for i in range(len(pieces))]
        self.written = _Table([x + b"," for side in ids for x in side] + [x + b"|" for x in ids[0]] + [x + b";" for x in ids[1]])

    @staticmethod
    def _fast(a_path: str, ranks: dict[bytes, int], vocabulary: dict[str, int]):
        """A's merges by rank, a faster encoder for plain Latin segments; None if ids do not follow the order of merges."""
        import public_tokenizers
        import tiktoken

        with open(a_path, encoding="utf-8") as lines:
            merges = json.load(lines)["model"]["merges"]
        made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in merges]
        if any(x >= y for x, y in zip([255, *made], made, strict=False)):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def keys(self, text: str) -> Iterator[list[str]]:
        """Keys of the segments of space + text, in lists of about PART characters; ``segment`` undoes them."""
        text, at = " " + text, 0
        while self.by_segment and len(text) - at > PART:
            found = CUT.search(text, at + PART)
            if not found:
                break
            yield _keys(text[at : found.start()])
            at = found.start()
        yield _keys(text[at:]) if self.by_segment else [" " + text]

    def encode_a(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all segments, and how many each has. Those that tokenizers agree on come from the faster encoder in
        one go, as A cuts between them."""
        plain = np.array([PLAIN(s) is not None for s in segments]) if self.fast and self.by_segment else np.zeros(len(segments), bool)
        some = plain.nonzero()[0].tolist()
        ids = np.array(self.fast.encode_ordinary("".join([segments[i] for i in some])) if some else [], np.int64)
        ends = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum(sizes[plain]), "right")
        counts = np.zeros(len(segments), np.int64)
        counts[plain] = np.diff(ends, prepend=0)
        rest = [e.ids for e in self.a.encode_batch([segments[i] for i in (~plain).nonzero()[0].tolist()], add_special_tokens=False)]
        counts[~plain] = list(map(len, rest))
        out, from_fast = np.empty(int(counts.sum()), np.int64), np.repeat(plain, counts)
        out[from_fast] = ids
        out[~from_fast] = list(chain.from_iterable(rest))
        return out, counts

    def encode_b(self, keys: list[str], segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all segments, and how many each has. B puts a space before what it is given: it stands for a
        segment's own first space, or is taken away again."""
        out = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, key in enumerate(keys):
            if not key:
                out[i] = [self.space]
            elif key[0] in ODD_KEY and segments[i][0] != " ":
                out[i] = out[i][1:] if out[i][:1] == [self.space] else []
        counts = np.array(list(map(len, out)), np.int64)
        return np.fromiter(chain.from_iterable(out), np.int64, int(counts.sum())), counts

    def align(self, keys: list[str]) -> Aligned:
        """The alignment of many segments. Those whose bytes differ on a side are bad and have no tokens."""
        segments = [segment(k) for k in keys]
        raw = "".join(segments).encode("utf-8", "surrogatepass")
        sizes = np.array([len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass")) for s in segments], np.int64)
        a_ids, a_in = self.encode_a(segments, sizes)
        b_ids, b_in = self.encode_b(keys, segments)
        sides = ((a_ids, a_in, self.a_table), (b_ids, b_in, self.b_table))
        bad = np.zeros(len(keys), bool)
        if any((_sums(t.sizes[ids], n) != sizes).any() or t.joined(ids) != raw for ids, n, t in sides):
            bad = self._bad(segments, sides)
            a_ids, b_ids = a_ids[~np.repeat(bad, a_in)], b_ids[~np.repeat(bad, b_in)]
            a_in, b_in = np.where(bad, 0, a_in), np.where(bad, 0, b_in)
        low, high, border = overlaps(self.a_table.sizes[a_ids], self.b_table.sizes[b_ids])
        links = high - low
        at = np.arange(int(links.sum())) + np.repeat(low - (np.cumsum(links) - links), links)
        codes, code_of = np.unique(np.repeat(a_ids << 32, links) | b_ids[at], return_inverse=True)
        # groups are written A ids first: order all tokens by group and side
        last_b = np.zeros(len(b_ids), bool)
        last_b[high[border] - 1] = True
        group = [np.cumsum(x) - x for x in (border, last_b)]
        marks = np.concatenate([a_ids, b_ids + self.first_b]) + np.concatenate([border, last_b]) * (len(self.written.sizes) // 2)
        marks = marks[np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")]
        text, ends = self.written.joined(marks), np.concatenate([[0], np.cumsum(self.written.sizes[marks])])[np.cumsum(a_in + b_in)].tolist()
        figures = np.stack([a_in, b_in, _sums(border, a_in), _sums(links, a_in)], axis=1)
        return Aligned(bad, figures, [text[x:y] for x, y in zip([0, *ends], ends, strict=False)], codes, code_of.astype(np.int32))

    @staticmethod
    def _bad(segments: list[str], sides) -> np.ndarray:
        """Which segments' bytes differ from their tokens' bytes on a side."""
        out = np.zeros(len(segments), bool)
        for ids, counts, table in sides:
            ends = np.cumsum(counts).tolist()
            for i, (low, high, s) in enumerate(zip([0, *ends], ends, segments, strict=False)):
                out[i] |= table.joined(ids[low:high]) != s.encode("utf-8", "surrogatepass")
        return out


def _keys(text: str) -> list[str]:
    """Keys of the segments of a text that begins with a blank: what follows a single space, or a single line end and what
    follows it; any other segment after a space."""
    if not UNEVEN(text) and not any(x in text for x in DOUBLE):
        return text.replace("\n", " \n").split(" ")[1:]
    out = SEGMENT.findall(text)
    return [s[1:] if s[0] == " " and s[1:2] not in BLANKS else s if s[0] == "\n" and s[1:2] not in BLANKS else " " + s for s in out]


def segment(key: str) -> str:
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key


class _Table:
    """Byte strings by number, of which many are joined at once."""

    def __init__(self, rows: list[bytes]) -> None:
        self.sizes = np.array(list(map(len, rows)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(rows), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        shift = self.starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.all[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


class Aligned(NamedTuple):
    """Of each segment: whether it is bad; numbers of A and B tokens, groups and links; groups as text, each ending in ``;``
    (``a1,a2|b1;``). The distinct packed pairs of ids in order; which of them each link is, segment after segment."""

    bad: np.ndarray
    figures: np.ndarray
    texts: list[bytes]
    codes: np.ndarray
    code_of: np.ndarray


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    return Pair(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path(A_NAME), b_path or public_tokenizers.path(B_NAME)


class _Numbers(dict):
    """Numbers its keys in order of their first lookup."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Chunk:
    """Documents of one chunk as sequences of numbered segments."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.lengths = 0, [], []
        self.number, self.occurs = _Numbers(), array("i")

    def add(self, pair: Pair, doc_id, text: str | None) -> None:
        before = len(self.occurs)
        for part in pair.keys(text) if text else ():
            self.occurs.extend(map(self.number.__getitem__, part))
        self.ids.append(doc_id)
        self.lengths.append(len(self.occurs) - before)
        self.bytes += len(text or "") + 64

    def aligned(self, pair: Pair) -> tuple[list[Aligned], np.ndarray, np.ndarray]:
        """Alignments of the segments, SEGMENTS at a time; the occurrences of all documents and their number in each;
        documents with a bad segment have none."""
        keys = list(self.number)
        parts = [pair.align(keys[i : i + SEGMENTS]) for i in range(0, len(keys), SEGMENTS)]
        occurs, lengths = np.frombuffer(self.occurs, np.int32), np.array(self.lengths, np.int64)
        bad = np.concatenate([p.bad for p in parts]) if parts else np.zeros(0, bool)
        if bad.any():
            spoilt = _sums(bad[occurs], lengths) > 0
            occurs, lengths = occurs[~np.repeat(spoilt, lengths)], np.where(spoilt, 0, lengths)
        return parts, occurs, lengths

    def row(self, pair: Pair, chunk: int, kind: pa.DataType) -> pa.RecordBatch:
        parts, occurs, lengths = self.aligned(pair)
        texts = [x for p in parts for x in p.texts]
        figures = np.concatenate([np.zeros((0, 4), np.int64), *(p.figures for p in parts)])
        digests, at = [], 0
        for n in lengths.tolist():
            digest = hashlib.sha256()
            for low in range(at, at + n, PART):
                high = min(low + PART, at + n)
                text = b"".join([texts[i] for i in occurs[low:high].tolist()])
                digest.update(text if high < at + n else text[:-1])
            digests.append(digest.hexdigest() if n else "")
            at += n
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(p.codes for p in parts)]))
        pair_of = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(codes, p.codes).astype(np.int32)[p.code_of] for p in parts)])
        often = np.repeat(np.bincount(occurs, minlength=len(texts)), figures[:, 3])
        totals = np.zeros(len(codes), np.int64)
        np.add.at(totals, pair_of, often)
        met = totals > 0  # segments of documents without tokens count nothing
        blobs = {"pair_of": ((np.cumsum(met) - met) * met)[pair_of], "pairs_in": figures[:, 3], "occurs": occurs, "occurs_in": lengths}
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk], pa.int64()),
                "ids": pa.array([self.ids], pa.list_(kind)),
                "digests": pa.array([digests], pa.list_(pa.string())),
                "figures": pa.array([_by_document(figures, occurs, lengths).ravel()], pa.list_(pa.int64())),
                "codes": pa.array([codes[met]], pa.list_(pa.int64())),
                "totals": pa.array([totals[met]], pa.list_(pa.int64())),
                **{k: pa.array([_packed(v)], pa.binary()) for k, v in blobs.items()},
            }
        )


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes: the width of one, then each in that width."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def _sums(values: np.ndarray, lengths) -> np.ndarray:
    """Sums of values that follow each other, so many each; exact, those of none are 0."""
    sums, ends = np.zeros(len(values) + 1, np.int64), np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=sums[1:])
    np.cumsum(lengths, dtype=np.int64, out=ends[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


def _by_document(rows: np.ndarray, at: np.ndarray, lengths) -> np.ndarray:
    """Sums of each document's rows, whose numbers follow each other in ``at``; a column at a time, as ``at`` is much longer
    than the results."""
    return np.stack([_sums(column[at], lengths) for column in rows.T], axis=1)


_BLOBS = ("pair_of", "pairs_in", "occurs", "occurs_in")


def chunks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """One row per chunk of documents, with its distinct id pairs (``codes``: A id << 32 | B id) and their link counts."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, made, chunk = tokenizers(*_paths(a_path, b_path)), TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(pair, doc_id, text.as_py())
                if chunk.bytes >= size or len(chunk.ids) >= CHUNK_ROWS:
                    row, made, chunk = chunk.row(pair, task << 33 | made, kind), made + 1, _Chunk()
                    yield row
        if chunk.ids:
            yield chunk.row(pair, task << 33 | made, kind)

    kind = dict(docs.dtypes)["doc_id"]
    blobs = ", ".join(f"{b} binary" for b in _BLOBS)
    schema = f"chunk long, ids array<{kind}>, digests array<string>, figures array<long>, codes array<long>, totals array<long>, {blobs}"
    return small_batches(docs).select("doc_id", "text").mapInArrow(align, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """code, a_id, b_id and count of every linked id pair of the chunks, and whether the count is its B id's highest."""
    zipped = F.explode(F.arrays_zip("codes", "totals")).alias("p")
    counts = cut(made.select(zipped).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.totals").alias("count")))
    b = F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id")
    top = counts.groupBy(b).agg(F.max("count").alias("top"))
    return counts.select("code", F.shiftright("code", 32).cast("int").alias("a_id"), b, "count").join(top, "b_id").select("code", "a_id", "b_id", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    made = cut(chunks(docs, a_path, b_path, size))
    known = made.select("chunk", F.explode("codes").alias("code")).join(pair_counts(made), "code").select("chunk", "code", "count", "best")
    kind = dict(docs.dtypes)["doc_id"]

    def finish(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("code").to_numpy())  # the chunk numbers its pairs in order of their codes
        values = np.stack([pairs.column("best").to_numpy().astype(np.int64), pairs.column("count").to_numpy()], axis=1)[order]
        values = values if len(values) else np.zeros((1, 2), np.int64)
        row = {k: _unpacked(chunk.column(k)[0].as_py()) for k in _BLOBS}
        by_segment = _by_document(values, row["pair_of"], row["pairs_in"])
        best = _by_document(by_segment, row["occurs"], row["occurs_in"])
        figures = np.asarray(chunk.column("figures")[0].values).reshape(-1, 4)
        names = ("n_a", "n_b", "n_groups", "n_links")
        return pa.table(
            {"doc_id": chunk.column("ids")[0].values}
            | {n: figures[:, i] for i, n in enumerate(names)}
            | {"n_best": best[:, 0], "count_sum": best[:, 1], "groups_sha256": chunk.column("digests")[0].values}
        )

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    left = made.select(F.col("chunk").alias("row"), "ids", "digests", "figures", *_BLOBS).groupBy("row")
    return left.cogroup(known.groupBy("chunk")).applyInArrow(finish, schema)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The groups themselves: doc_id, byte range in space + text, and the ids of both sides, one row each.

    Documents without tokens have no groups.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*_paths(a_path, b_path))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = _Chunk()
                chunk.add(pair, doc_id, text.as_py())
                parts, occurs, _ = chunk.aligned(pair)
                texts, at, rows = [x for p in parts for x in p.texts], 0, []
                for number in occurs:
                    for group in texts[number].decode().rstrip(";").split(";"):
                        a, b = (list(map(int, x.split(","))) for x in group.split("|"))
                        size = sum(len(pair.a_bytes[i]) for i in a)
                        rows.append({"doc_id": doc_id, "start": at, "stop": at + size, "a_ids": a, "b_ids": b})
                        at += size
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, target)

    target = pa.schema([("doc_id", _arrow(kind)), ("start", pa.int64()), ("stop", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])
    return small_batches(docs).select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, start long, stop long, a_ids array<int>, b_ids array<int>")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def op13(spark, sf_dir: str) -> DataFrame:
    """The op13 contract over the whole documents table."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
