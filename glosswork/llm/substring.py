"""Substring deduplication by level-wise doubling.

A window of ``k`` words is repeated if its word sequence also starts in a document
with a smaller doc_id; every word that such a window covers is removed. Windows are
found level by level: half-length windows first (7 words for 13), and only those that
occur in more than one document are extended to twice that length, and so on until the
wanted length is reached or no candidate survives.

At a level below the last one, a longer window stands or falls with any of the shorter
windows inside it, so the one with the least hash represents it. Equal longer windows
have the same representative, which makes about a quarter of all windows enough and
loses none. A chance match of its 64-bit hash lets a window live on, no more.

At the last level equality is that of two independent 64-bit hashes of the words. Of n
distinct windows about n * n / 2**129 pairs are then taken for equal though they are not:
fewer than 10**-12 for the 10**13 windows of 100 TB.

Physical plan: documents are dealt into blocks once and that exchange is reused by every
pass. A block sends each hash once to the hash's bucket, packed into one binary row per
bucket, so a passage that all documents share costs one entry per block. Buckets answer
each block with the hashes that other blocks have too. Blocks grow with the square root of
the text's bytes, up to BLOCK_MOST, so that a packed row stays worth its cost.

Rows: a null text counts as empty. A row with a null doc_id neither loses words nor
makes others lose them. Rows that share a doc_id do not remove from each other. Repeated
rows stay. doc_id may be of any type with an order. ``stripped`` keeps all columns, whatever
their names, in a struct of their own. Texts with fewer than k words are kept whole. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from glosswork.llm.shared import cut, small_batches
from glosswork.llm.wordkit import Words, blocks, mix, sliding_min, window_hashes, window_starts

WINDOW = 13
BLOCK_LEAST, BLOCK_MOST = 4e6, 64e6  # bytes of text in a block
BLOCK, BUCKET, LEVEL, DATA = "_block", "_bucket", "_level", "_data"
ID, TEXT, REST = "_id", "_text", "_rest"
PACKED = f"{BUCKET} int, {BLOCK} int, {DATA} binary"
ANSWER = f"{BLOCK} int, {DATA} binary"
SALT = np.uint64(0x5851F42D4C957F2D)


def level_lengths(k: int, least: int = 7) -> list[int]:
    """Window lengths from short to k; each is at most twice the one before."""
    out = [k]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def block_count(n_bytes: int) -> int:
    """Blocks for so many bytes of text: BLOCK_LEAST each, beyond 1 GB growing with the square root, up to BLOCK_MOST."""
    return max(64, math.ceil(n_bytes / min(BLOCK_MOST, BLOCK_LEAST * max(1.0, n_bytes / 1e9) ** 0.5)))


def _columns(blob: list, n: int) -> list[np.ndarray]:
    """Rows of n packed columns of 64-bit integers, each column over all rows."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(n)]
    for x in blob:
        for own, column in zip(parts, np.split(np.frombuffer(x.as_py(), np.uint64), n)):
            own.append(column)
    return [np.concatenate(own) for own in parts]


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _pair_member(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether each pair (a, b) is among the pairs (first, second), which are in order of first."""
    lo, hi = np.searchsorted(first, a), np.searchsorted(first, a, side="right")
    out = np.zeros(len(a), bool)
    for j in range(int((hi - lo).max(initial=0))):
        out |= (lo + j < hi) & (second[np.minimum(lo + j, len(second) - 1)] == b)
    return out


def _twins(key: np.ndarray) -> np.ndarray:
    """Whether another place has the same key."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _ids(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = docs.column(ID).combine_chunks()
    return np.asarray(col.fill_null(0)), np.asarray(col.is_valid())


def _pack(block: int, buckets: int, key: np.ndarray, *more: np.ndarray) -> pa.Table:
    """One row per bucket of the keys, which are in order, and of the columns beside them."""
    edges = np.searchsorted(key, np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets))
    edges = np.concatenate([[0], edges, [len(key)]])
    some = np.flatnonzero(np.diff(edges))
    rows = [b"".join(x[int(edges[b]) : int(edges[b + 1])].tobytes() for x in (key, *more)) for b in some]
    return pa.table(
        {
            BUCKET: pa.array(some.astype(np.int32)),
            BLOCK: pa.array(np.full(len(some), block, np.int32)),
            DATA: pa.array(rows, pa.binary()),
        }
    )


def _spans(docs: pa.Table, valid: np.ndarray, lengths: tuple[int, ...]):
    """Per piece of the block: the piece, its words, their hashes, and the hashes, rows and places of windows of each length."""
    for piece in blocks(docs.column(TEXT).combine_chunks()):
        w = piece.words()
        h = w.hashes()
        found = {}
        for k in lengths:
            at, row = window_starts(w.first, k)
            ok = valid[piece.lo + row]
            found[k] = (window_hashes(h, k), at[ok], row[ok] + piece.lo)
        yield piece, w, h, found


def second_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each window, of words mixed once more."""
    return window_hashes(mix(word_hash ^ SALT), k)


def _representatives(hashes: np.ndarray, w: int) -> np.ndarray:
    """The least of each w hashes, mixed again: least values crowd at the low end, and buckets are ranges of values."""
    return mix(sliding_min(hashes, w).copy())


def _pass(docs: pa.Table, known: list[np.ndarray], lengths: list[int], level: int, valid: np.ndarray):
    """Keys, second hashes and rows of this level: representatives of the next length's windows (with zeros as second
    hashes), or at the last level the windows themselves, as far as the levels before left them standing.
    known: one table per such level."""
    keys, seconds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    last = level == len(lengths) - 1
    top = lengths[level] if last else lengths[level + 1]
    for _, _, h, found in _spans(docs, valid, tuple(sorted({*lengths[: level + 1], top}))):
        hashes, at, row = found[top]
        if not len(at):
            continue
        for j in range(level):
            short, longer = lengths[j], lengths[j + 1]
            alive = _member(_representatives(found[short][0], longer - short + 1), known[j])
            run = np.concatenate([[0], np.cumsum(alive)])
            keep = run[at + top - longer + 1] - run[at] == top - longer + 1
            at, row = at[keep], row[keep]
        if last:
            key, second = hashes[at], second_hashes(h, top)[at]
        else:
            key = _representatives(found[lengths[level]][0], top - lengths[level] + 1)[at]
            second = np.zeros(len(key), np.uint64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (row[1:] != row[:-1])
        keys.append(key[new])
        seconds.append(second[new])
        owners.append(row[new])
    return np.concatenate(keys), np.concatenate(seconds), np.concatenate(owners)


def _known(docs: pa.Table, answers: pa.Table, lengths: list[int], level: int, ids: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
    """For each level before this one: the representatives that more than one doc_id has."""
    out: list[np.ndarray] = []
    if level:
        of = np.asarray(answers.column(LEVEL).combine_chunks())
        blobs = answers.column(DATA).combine_chunks()
    for j in range(level):
        got = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in np.flatnonzero(of == j)]
        key, _, owner = _pass(docs, out, lengths, j, valid)
        out.append(np.unique(np.concatenate([*got, _shared_within(key, ids[owner])])))
    return out


def _shared_within(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys that more than one doc_id of this block has."""
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key
    return key[first][np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)]


def _least(key: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes in order with the least id of each, and for each place its least id."""
    if not len(key):
        return key, second, ids, ids
    order = np.lexsort((second, key))
    a, b = key[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[order], first)
    each = np.empty(len(key), ids.dtype)
    each[order] = low[np.cumsum(new) - 1]
    return a[first], b[first], low, each


def _ordered_ids(docs: DataFrame) -> DataFrame:
    """(key, id) of the doc_ids of a type that is no integer: numbers in the same order."""
    keys = docs.select(docs["doc_id"].alias("key")).where("key IS NOT NULL").distinct().orderBy("key")
    return cut(keys.select("key", F.monotonically_increasing_id().alias("id")))  # rises along the sorted partitions


def _dealt(docs: DataFrame, n_blocks: int | None) -> tuple[DataFrame, int]:
    """The rows as block, id, text and a struct of all other columns; and the number of blocks."""
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    rows = docs.select(docs["doc_id"].alias("key"), docs["text"].alias(TEXT), rest.alias(REST))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        rows = rows.withColumn(ID, F.col("key").cast("long"))
    else:
        rows = rows.join(_ordered_ids(docs).withColumnRenamed("id", ID), "key", "left")
    n_blocks = n_blocks or block_count(docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0)
    # rows of one doc_id may lie in several blocks; those without one take no part in any search, so they lie anywhere
    seed = F.when(F.col("key").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(ID, TEXT))
    place = F.pmod(seed, F.lit(n_blocks)).cast("int")
    return rows.select(place.alias(BLOCK), ID, TEXT, REST), n_blocks


def stripped(docs: DataFrame, k: int = WINDOW, digest: bool = False, n_blocks: int | None = None) -> DataFrame:
    """``kept`` (a struct of docs' columns with the kept text), n_words and n_removed; with ``digest`` the struct has no
    text, and kept_sha256 follows.

    The kept text is the text itself if nothing goes; a removed word takes the white space after it along.
    """
    dealt, n_blocks = _dealt(small_batches(docs), n_blocks)
    buckets = max(64, n_blocks // 4)
    lengths = level_lengths(k)

    def spread_at(level: int):
        def spread_keys(key: tuple, inside: pa.Table, answers: pa.Table) -> pa.Table:
            ids, valid = _ids(inside)
            keys, seconds, owner = _pass(inside, _known(inside, answers, lengths, level, ids, valid), lengths, level, valid)
            if level < len(lengths) - 1:
                return _pack(key[0].as_py(), buckets, np.unique(keys))
            return _pack(key[0].as_py(), buckets, *_least(keys, seconds, ids[owner])[:3])

        return spread_keys if level else lambda key, inside: spread_keys(key, inside, None)

    by_block = dealt.groupBy(BLOCK)
    answers = None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        pairs = by_block if answers is None else by_block.cogroup(answers.groupBy(BLOCK))
        sent = pairs.applyInArrow(spread_at(level), PACKED)
        reply = sent.groupBy(BUCKET).applyInArrow(_earlier if last else _common, ANSWER)
        if not last:
            reply = reply.withColumn(LEVEL, F.lit(level))
            answers = reply if answers is None else answers.unionByName(reply)

    def cut_out(key: tuple, inside: pa.Table, answer: pa.Table) -> pa.Table:
        return _cut(inside, *_columns(answer.column(DATA).combine_chunks(), 2), k, digest)

    own = [StructField("n_words", LongType()), StructField("n_removed", LongType())]
    own.insert(0, StructField(REST, dealt.schema[REST].dataType))
    own.append(StructField("kept_sha256" if digest else TEXT, StringType()))
    out = by_block.cogroup(reply.groupBy(BLOCK)).applyInArrow(cut_out, StructType(own))
    if digest:
        return out.withColumnRenamed(REST, "kept")
    kept = F.struct(*[(F.col(TEXT) if c == "text" else F.col(REST).getField(c)).alias(c) for c in docs.columns])
    return out.select(kept.alias("kept"), "n_words", "n_removed")


def strip_repeats(docs: DataFrame, k: int = WINDOW, n_blocks: int | None = None) -> DataFrame:
    """docs with the kept texts, n_words and n_removed; columns of docs that have these two names are replaced."""
    out = stripped(docs, k, n_blocks=n_blocks)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*[F.col("kept").getField(c).alias(c) for c in names], "n_words", "n_removed")


def _reply(block: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per block with its columns."""
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [c[order] for c in columns]
    names, first = np.unique(block, return_index=True)
    edges = [*first.tolist(), len(block)]
    rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges, edges[1:])]
    return pa.table({BLOCK: pa.array(names.astype(np.int32)), DATA: pa.array(rows, pa.binary())})


def _sent(sent: pa.Table, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each entry, and the n packed columns."""
    blobs = sent.column(DATA).combine_chunks()
    sizes = [len(x.as_py()) // (8 * n) for x in blobs]
    return np.repeat(np.asarray(sent.column(BLOCK).combine_chunks()), sizes), _columns(blobs, n)


def _common(sent: pa.Table) -> pa.Table:
    """Tells each block which of its keys other blocks have too."""
    block, (key,) = _sent(sent, 1)
    many = _twins(key)
    return _reply(block[many], key[many])


def _earlier(sent: pa.Table) -> pa.Table:
    """Tells each block which of its windows start in a smaller doc_id of another block."""
    block, (key, second, low) = _sent(sent, 3)
    low = low.view(np.int64)
    late = low > _least(key, second, low)[3]
    order = np.argsort(key[late], kind="stable")
    return _reply(block[late][order], key[late][order], second[late][order])


def _cut(docs: pa.Table, first: np.ndarray, second: np.ndarray, k: int, digest: bool) -> pa.Table:
    """The block's rows without the windows whose hashes are among the given pairs or in a smaller doc_id of the block."""
    ids, valid = _ids(docs)
    n_words = np.zeros(len(ids), np.int64)
    n_removed = np.zeros(len(ids), np.int64)
    texts: list = [None] * len(ids)
    column = docs.column(TEXT).combine_chunks()
    order = np.argsort(first, kind="stable")
    first, second = first[order], second[order]
    pieces = [(piece, w, h, *found[k]) for piece, w, h, found in _spans(docs, valid, (k,))]
    key = np.concatenate([np.zeros(0, np.uint64), *(x[at] for _, _, _, x, at, _ in pieces)])
    owner = np.concatenate([np.zeros(0, np.int64), *(ids[row] for *_, row in pieces)])
    maybe = _member(key, first) | _twins(key)
    done, more = 0, [np.zeros(0, np.uint64)]
    for _, _, h, _, at, _ in pieces:  # second hashes only where the first ones meet
        hit = at[maybe[done : done + len(at)]]
        done += len(at)
        if len(hit):
            more.append(second_hashes(h, k)[hit])
    a, b, own = key[maybe], np.concatenate(more), owner[maybe]
    gone = np.zeros(len(key), bool)
    gone[maybe] = _pair_member(a, b, first, second) | (_least(a, b, own)[3] < own)
    done = 0
    for piece, w, _, _, at, _ in pieces:
        hit = at[gone[done : done + len(at)]]
        done += len(at)
        edge = np.zeros(len(w) + 1, np.int64)
        edge[hit] += 1  # window starts are distinct
        edge[hit + k] -= 1
        dead = np.cumsum(edge)[:-1] > 0
        rows = slice(piece.lo, piece.hi)
        n_words[rows] = w.counts
        total = np.concatenate([[0], np.cumsum(dead)])
        n_removed[rows] = total[w.first[1:]] - total[w.first[:-1]]
        _texts(texts, piece, w, dead, n_removed[rows], column, digest)
    return pa.table({REST: docs.column(REST), "n_words": n_words, "n_removed": n_removed, "kept_sha256" if digest else TEXT: pa.array(texts, pa.string())})


def _texts(texts: list, piece, w: Words, dead: np.ndarray, removed: np.ndarray, column: pa.Array, digest: bool) -> None:
    """Fills in the digests, or the kept texts, of one piece's rows."""
    if digest:
        flat, start, end = w.joined()
        raw = np.frombuffer(flat, np.uint8)
        live = np.repeat(~dead, end - start + 1)
    for r in range(piece.hi - piece.lo):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if digest:
            if a == b:
                kept = b""
            elif not removed[r]:
                kept = flat[start[a] : end[b - 1]]
            else:
                span = slice(int(start[a]), int(end[b - 1]) + 1)
                kept = raw[span][live[span]].tobytes()[:-1]
            texts[piece.lo + r] = hashlib.sha256(kept).hexdigest()
        elif not removed[r]:
            texts[piece.lo + r] = column[piece.lo + r].as_py()
        else:
            lo, hi = int(piece.offsets[r]), int(piece.offsets[r + 1])
            live = np.ones(hi - lo, bool)
            edges = np.append(w.starts[a:b], hi) - lo
            live[edges[0] :] = np.repeat(~dead[a:b], np.diff(edges))
            texts[piece.lo + r] = piece.data[lo:hi][live].tobytes().decode("utf-8").rstrip("\x20\t\n\v\f\r")


def op5(spark, sf_dir: str) -> DataFrame:
    """The op5 contract over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return stripped(docs, digest=True).select("kept.doc_id", "n_words", "n_removed", "kept_sha256")
