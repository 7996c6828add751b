"""Byte-level BPE by prefix dynamic programming, and decoding.

For every prefix of a piece exactly one token can come last in that prefix's encoding:
the one that ends there and that merges would leave standing beside the last token of
the prefix before it. ``Piece`` stores that token per prefix. So bytes can be appended
exactly, and after an edit only the prefixes from the edit on are computed again.

Whether two neighbouring tokens can stand is decided by undoing their merges towards
the boundary: if any pair met there has a merge of lower rank than those undone so far,
the merges would have crossed the boundary.

Texts are first split by the tokenizer's pattern; a piece that is itself in the
vocabulary is one token, and special tokens are ordinary text.

Rows: a null text counts as empty and has no tokens. Repeated rows stay, a null doc_id
stays, extra columns are ignored, an empty table gives an empty result. Long texts and
long pieces are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glosswork.llm.shared import small_batches

#: Distinct pieces in each of the two generations that a Python worker remembers.
REMEMBERED = 250_000
#: Distinct pairs of neighbours that it remembers, and the bits of an id in their keys.
PAIRS, PAIR = 600_000, 24
#: A longer piece is encoded anew each time.
LONG_PIECE = 64


class Vocabulary:
    """Ranks of byte strings, and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.halves = {r: self._split(b, r) for b, r in ranks.items()}
        self.merged = {a << PAIR | b: r for r, (a, b) in ((r, p) for r, p in self.halves.items() if p)}
        self.stand: dict[int, bool] = {}  # by left << PAIR | right
        # Finds the tokens that end at each byte. Those that no merges make only ever encode a whole piece.
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            if len(b) == 1 or self.halves[r]:
                self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that no merge makes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None

    def can_stand(self, left: int, right: int) -> bool:
        """Whether merges leave ``left right`` as these two tokens.

        Both are unmerged in falling order of rank. If a pair met at the boundary has a merge of lower rank than the
        merge undone last, that merge would have come first and crossed the boundary. On equal ranks the leftmost merge
        comes first, so the right one is undone first.
        """
        merged, halves = self.merged.get, self.halves
        bound, a, b = 1 << 62, left, right
        while True:
            if merged(a << PAIR | b, bound) < bound:
                stands = False
                break
            x, y = halves[a], halves[b]
            if x and (not y or a > b):
                bound, a = a, x[1]
            elif y:
                bound, b = b + 1, y[0]
            else:
                stands = True
                break
        if len(self.stand) >= PAIRS:
            self.stand.clear()
        self.stand[left << PAIR | right] = stands
        return stands


class Piece:
    """The encodings of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []  # last[i]: the last token of the first i + 1 bytes
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; what is known of the prefixes stays valid."""
        v, known = self.vocabulary, len(self.data)
        data, last, stood = self.data + more, self.last, v.stand.get
        base = max(0, known - v.longest)
        # every token that ends at a byte is met at that byte; one of them can stand there
        for end, (token, size) in v.automaton.iter(data[base:].decode("latin-1")):
            end += base
            if end != len(last):
                if end > len(last):
                    break
                continue
            if size <= end:
                left = last[end - size]
                stands = stood(left << PAIR | token)
                if not (v.can_stand(left, token) if stands is None else stands):
                    continue
            last.append(token)
        if len(last) < len(data):
            raise ValueError(f"no token of the vocabulary can end at byte {len(last) + 1}")
        self.data = data

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replaces bytes start to stop; prefixes before start are kept."""
        rest = new + self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, of all by default."""
        end = len(self.data) if end is None else end
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class _Remembered(dict):
    """Piece of text to its ids as little-endian 32-bit integers; the pieces not met for longest go first."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            raw = piece.encode("utf-8")
            whole = self.vocabulary.ranks.get(raw)
            ids = [whole] if whole is not None else Piece(self.vocabulary, raw).tokens()
            out = array("I", ids).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= REMEMBERED:
                self.before = self.copy()
                self.clear()
            self[piece] = out
        return out


class Tokenizer:
    """Encodes texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.remembered = _Remembered(self.vocabulary)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, array("I", ids)))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker."""
    return Tokenizer(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit, if ``with_ids``), ids_sha256 and decoded_sha256 of every row.

    The vocabulary is found on each executor: by ``path``, or by ``name`` among the installed public tokenizers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        t = tokenizer(path or public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
                columns = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.decode(x)).hexdigest() for x in ids], pa.string()),
                }
                if not with_ids:
                    del columns["ids"]
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)["doc_id"]
    ids = "ids binary, " if with_ids else ""
    return small_batches(docs).select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    """The op9 contract over the whole documents table."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
