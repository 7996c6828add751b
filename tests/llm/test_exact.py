"""Operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.llm import bpe, chat, decontaminate, license_scan, line_rules, sharding, simhash, substring, wordkit
from tests.llm.helpers import BASE, WORD, documents, empty, make


def words(text):
    return WORD.findall(text or "")


# words and hashes


@given(st.lists(st.text(alphabet="ab é日\n\t ", max_size=12), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_match_the_pattern(texts):
    data, offsets = wordkit.text_buffers(pa.array(texts, pa.string()))
    w = wordkit.Words(data, offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.first[:-1], w.first[1:])]
    assert found == [words(t) for t in texts]
    by_hash = defaultdict(set)
    for h, a, b in zip(w.hashes().tolist(), w.starts, w.ends):
        by_hash[h].add(data[a:b].tobytes())
    assert all(len(x) == 1 for x in by_hash.values())


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_sliding_min(values, w):
    if w > len(values):
        return
    x = np.array(values, np.uint64)
    assert wordkit.sliding_min(x, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


# op10


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = documents()
    got = simhash.simhash_components(make(spark)).select("doc_id", simhash.hex_print(F.col("fp")).alias("f"), "component_id").collect()
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want[(r[0], f"{prints[i]:016x}", min(ids))] += 1
    assert Counter((r[0], r[1], r[2]) for r in got) == want


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 12).tolist()
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    mask = (1 << 64) - 1
    for a in prints:
        for b in prints:
            if a != b and ((a ^ b) & mask).bit_count() <= 2:
                assert roots.get(a, a) == roots.get(b, b)


def test_odd_radii_lose_no_pair(spark):
    r = random.Random(8)
    for radius, prints in ((1, [0b1100000, 0b1100001, 0b1000000, 0b0100001]), (3, [sum(1 << b for b in r.sample(range(9), 4)) for _ in range(60)])):
        prints = sorted(set(prints))
        got = {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius).select("a", "b").collect()}
        assert all((a ^ b).bit_count() <= radius for a, b in got)

        def groups(pairs):
            of = {p: p for p in prints}
            for _ in prints:
                for a, b in pairs:
                    of[a] = of[b] = min(of[a], of[b])
            return of

        assert groups(got) == groups([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius])


def test_keep_first_keeps_one_of_each_group(spark):
    kept = simhash.keep_first(make(spark))
    assert kept.columns == make(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert 1 in ids and 7 not in ids and ids[None] == 1 and 2 in ids
    assert simhash.keep_first(empty(spark)).count() == 0
    # another text of a doc_id that goes stays
    df = spark.createDataFrame([(1, "one two three four"), (5, "one two three four"), (5, "quite another text of this number")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.keep_first(df).collect()) == [(1, "one two three four"), (5, "quite another text of this number")]


# op5


def without_repeats(rows, k):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    starts = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - k + 1):
            if r[0] is not None:
                starts[tuple(w[i : i + k])].add(r[0])
    assert ids
    for r in rows:
        w = words(r[1])
        dead = [False] * len(w)
        for i in range(len(w) - k + 1):
            if r[0] is not None and min(starts[tuple(w[i : i + k])]) < r[0]:
                dead[i : i + k] = [True] * k
        kept = " ".join(x for x, d in zip(w, dead) if not d)
        yield r[0], len(w), sum(dead), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("k", [13, 5, 26])
def test_substring_digest(spark, k):
    got = substring.stripped(make(spark).select("doc_id", "text"), k, digest=True).select("kept.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == Counter(without_repeats(documents(), k))


def test_substring_clashing_columns_and_text_ids(spark):
    rows = [(f"d{r[0]:03d}" if r[0] is not None else None, r[1], 99, -1, "x", "y", "z") for r in documents()]
    names = "doc_id string, text string, n_words bigint, n_removed bigint, _block string, _rest string, `a.b` string"
    df = spark.createDataFrame(rows, names)
    out = substring.stripped(df, 13)
    want = {r[0]: r[1:3] for r in without_repeats(rows, 13)}
    got = out.select("kept.*", F.col("n_words").alias("words"), F.col("n_removed").alias("removed")).collect()
    assert got[0].__fields__[:7] == df.columns and len(got) == len(rows)
    assert all(tuple(r)[2:7] == (99, -1, "x", "y", "z") and want[r["doc_id"]] == (r["words"], r["removed"]) for r in got)
    assert substring.strip_repeats(df, 13).columns == ["doc_id", "text", "_block", "_rest", "a.b", "n_words", "n_removed"]


def test_equal_first_hashes_do_not_remove(spark, monkeypatch):
    """With a first hash that is the same for all windows only the second tells them apart."""
    real = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda h, k: np.full(max(0, len(h) - k + 1), 7, np.uint64))
    monkeypatch.setattr(substring, "second_hashes", lambda h, k: real(h, k))
    texts, ids = [" ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20)), " ".join(f"w{i}" for i in range(20))], [1, 2, 3]
    inside = pa.table({"_id": ids, "_text": texts, "_rest": ids})
    none = np.zeros(0, np.uint64)
    assert substring._cut(inside, none, none, 13, True).column("n_removed").to_pylist() == [0, 0, 20]


def test_blocks_grow_with_the_text():
    assert substring.block_count(0) == 64 and substring.block_count(1 << 30) < 300
    size = [n / substring.block_count(int(n)) for n in (1e9, 1e11, 1e14)]
    assert size[0] < size[1] < size[2] <= substring.BLOCK_MOST


def test_substring_text_keeps_columns(spark):
    out = substring.strip_repeats(make(spark), 13)
    assert out.columns == make(spark).columns + ["n_words", "n_removed"]
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[2]["text"] == "start here two" and by_id[3]["text"] is None and by_id[1]["n_removed"] == 0
    assert substring.strip_repeats(empty(spark), 13).count() == 0
    assert substring.level_lengths(13) == [7, 13] and substring.level_lengths(50) == [7, 13, 25, 50]


# op9


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P

    return bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(text=st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(tokenizer, oracle, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = tokenizer.encode(text)
    assert list(array("I", ids)) == oracle.encode_ordinary(text)
    assert tokenizer.decode(ids) == text.encode()


@given(a=st.binary(max_size=20), b=st.binary(max_size=20), start=st.integers(0, 20), size=st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_bpe_appends_and_edits(tokenizer, a, b, start, size):
    v = tokenizer.vocabulary
    piece = bpe.Piece(v, a)
    piece.append(b)
    assert piece.tokens() == bpe.Piece(v, a + b).tokens() and piece.tokens(len(a)) == bpe.Piece(v, a).tokens()
    start = min(start, len(a + b))
    piece.edit(start, start + size, b"xyz")
    whole = (a + b)[:start] + b"xyz" + (a + b)[start + size :]
    assert piece.tokens() == bpe.Piece(v, whole).tokens()


def test_bpe_documents(spark, oracle):
    got = bpe.encode_documents(make(spark)).collect()
    want = Counter()
    for r in documents():
        ids = array("I", oracle.encode_ordinary(r[1] or "")).tobytes()
        want[(r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode_documents(empty(spark)).count() == 0


# op7


def test_sharding_laws(spark):
    rows = documents() + [(100 + i, "copy " * (i % 5), "en", "z", 1, 0.1, "x", 1) for i in range(60)]
    got = sharding.assign_shards(make(spark, rows), 8).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size.setdefault((r[0]), []).append(len((r[1] or "").encode()) + 1)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    text = defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1])
    for r in got:
        for t in text[r["doc_id"]]:
            homes[t].add(r["shard"])
    assert all(len(h) == 1 for t, h in homes.items())
    assert sharding.assign_shards(empty(spark)).count() == 0


@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_longest_first_equals_a_scan_for_the_least_load(sizes, shards):
    loads, want = [0] * shards, {}
    for key, size in sorted([((i,), s) for i, s in enumerate(sizes)], key=lambda x: (-x[1], x[0])):
        best = min(range(shards), key=lambda k: (loads[k], k))
        want[key] = best
        loads[best] += size
    assert sharding.longest_first([((i,), s) for i, s in enumerate(sizes)], shards) == want


def test_sharding_equals_longest_first_of_groups(spark):
    """With a unit for every group the shards are those of a plain schedule over the groups."""
    r = random.Random(3)
    rows = [(i, "x" * r.choice([5, 50, 500, 5000]) + str(r.randrange(12)), None, None, None, 0.0, "", 0) for i in range(90)] + documents()
    got = sharding.assign_shards(make(spark, rows), 3, units=1 << 20).collect()
    bytes_of = defaultdict(int)
    for x in rows:
        bytes_of[x[1]] += len((x[1] or "").encode()) + 1
    loads = [0, 0, 0]
    for text, size in sorted(bytes_of.items(), key=lambda kv: (-kv[1], hashlib.sha256(kv[0].encode()).hexdigest() if kv[0] is not None else "")):
        loads[loads.index(min(loads))] += size
    found = [0, 0, 0]
    for x in got:
        found[x["shard"]] += x["size"]
    assert found == loads


@given(st.lists(st.integers(1, 100), max_size=30))
@settings(max_examples=60, deadline=None)
def test_longest_first_bound(sizes):
    plan = sharding.longest_first([((i,), s) for i, s in enumerate(sizes)], 4)
    loads = [sum(s for i, s in enumerate(sizes) if plan[(i,)] == k) for k in range(4)]
    assert max(loads) - min(loads) <= max(sizes, default=0)


# op3


def base_of(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules_base(spark):
    got = line_rules.line_rules(make(spark)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *base_of(r[1])) for r in documents())
    assert line_rules.line_rules(empty(spark)).count() == 0


def test_line_rules_common_lines(spark):
    own = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    noise = " ".join(f"n{j}" for j in range(40))
    rows = [(i, f"{own(i)}\nShared  LINE of the Host", "en", "h", 1) for i in range(30)]
    rows += [(100 + i, f"{own(100 + i)}\n{noise}", "en", "h", 1) for i in range(30)] + [(200, f"{own(200)}\n{noise}", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in line_rules.line_rules(df, least_docs=20, share=0.1, with_text=True).collect()}
    assert got[0]["n_common_words"] == 5 and got[0]["kept"] and got[0]["clean_text"] == own(0)
    assert got[100]["n_common_words"] == 40 and not got[100]["kept"] and got[200]["kept"]


def test_line_rules_count_documents_not_rows(spark):
    own = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    rows = [(7, f"{own(7)}\nits own line again", "h")] * 25 + [(i, f"{own(i)}\ncommon line of many", "h") for i in range(100, 130)]
    rows += [(None, f"{own(0)}\nline of rows without id", "h")] * 25
    got = line_rules.line_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), least_docs=20, share=0.1).collect()
    assert {r["doc_id"]: r["n_common_words"] for r in got} == {7: 0, None: 35, **{i: 4 for i in range(100, 130)}}


def test_line_rules_most_docs_holds_on_a_hot_host(spark):
    own = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    rows = [(i, own(i) + ("\nread more here now" if i < 45 else ""), "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    count = lambda **k: sum(r["n_common_words"] > 0 for r in line_rules.line_rules(df, least_docs=10, share=0.5, **k).collect())
    assert count() == 0 and count(most_docs=40) == 45


# op8


def test_chat_keeps_maximal_conversations(spark):
    def conv(i, *turns):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]

    rows = conv(1, "hi", "yo") + conv(2, "hi", "yo", "more", "end") + conv(3, "hi", "no") + conv(4, "hi", "no") + conv(5, "hi") + conv(6, None, "x")
    rows += [(2, 0, "user", "hi"), (None, 0, "user", "hi"), (7, 0, None, "<|im_end|>"), (7, None, "user", "late")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, chat string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 3, 6, 7} and got[3]["n_copies"] == 2 and got[2]["n_turns"] == 4
    assert got[2]["chat"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo")
    assert got[7]["chat"].count("<|im_end|>") == 2
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 0, "user", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r["n_turns"], r["n_copies"], r["chat"]) for r in chat.format_chats(lone).collect()) == [
        (1, 1, "<|im_start|>user\na<|im_end|>\n"), (1, 2, "<|im_start|>user\nb<|im_end|>\n")
    ]
    assert chat.format_chats(df.limit(0)).count() == 0


# op4


def least_edits(pattern: bytes, text: bytes) -> int:
    t = np.frombuffer(text, np.uint8)
    row = np.zeros(len(t) + 1, int)
    for i, c in enumerate(pattern):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (t != c))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_decontamination_finds_every_match_within_the_budget(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdefghij klmnop éü")
    text = lambda n: "".join(rng.choice(letters, n))
    items = [text(n) for n in (60, 100, 250, 5)] + [None, ""]
    index = decontaminate.build_index(pa.array(items, pa.string()))
    matcher = decontaminate.Matcher(index)
    hits = 0
    for _ in range(60):
        item = list(items[int(rng.integers(0, 3))])
        for _ in range(int(len(item) * rng.choice([0, 0.03, 0.06, 0.09, 0.15]))):
            item[int(rng.integers(0, len(item)))] = str(rng.choice(letters))
        raw = np.frombuffer((text(80) + " " + "".join(item) + " " + text(50)).encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        flat = decontaminate.normalised(raw, offsets)[0].tobytes()
        want = {int(i) for i, s, e in zip(index.item, index.segments, index.edits) if least_edits(s.tobytes(), flat) <= e}
        assert set(matcher.find(raw, offsets)[1].tolist()) == want
        hits += len(want)
    assert hits > 20


def test_common_grams_are_left_out_without_loss(monkeypatch):
    """Items full of stock phrases: the index leaves their grams out, and finds what an index of all grams finds."""
    monkeypatch.setattr(decontaminate, "COMMON", 3)
    r = random.Random(21)
    stock = ["which of the following statements is true", "according to the passage above the author", "select the best answer"]
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 8)))
    items = [" ".join([r.choice(stock)] + [word() for _ in range(9)] + [r.choice(stock)]) for _ in range(60)]
    few = decontaminate.build_index(pa.array(items))
    monkeypatch.setattr(decontaminate, "COMMON", 1 << 30)
    all_ = decontaminate.build_index(pa.array(items))
    assert len(few.segment_of) < 0.9 * len(all_.segment_of) and few.least.min() >= min(decontaminate.KEEP, all_.least.min())
    texts = []
    for item in items:
        letters = list(item)
        for _ in range(r.randrange(0, 9)):
            letters[r.randrange(len(letters))] = r.choice("qrstuv ")
        texts.append(" ".join(word() for _ in range(30)) + " " + "".join(letters) + " " + " ".join(r.choice(stock) for _ in range(9)))
    data, offsets = wordkit.text_buffers(pa.array(texts))
    found = [{(a, b) for a, b in zip(*(x.tolist() for x in decontaminate.Matcher(i).find(data, offsets)[:2]))} for i in (few, all_)]
    assert found[0] == found[1] and len(found[0]) > 30
    monkeypatch.setattr(decontaminate, "MEETINGS", 50)
    assert {(a, b) for a, b in zip(*(x.tolist() for x in decontaminate.Matcher(all_).find(data, offsets)[:2]))} == found[1]


def test_benchmark_in_parts(spark, monkeypatch):
    passages = [" ".join(random.Random(i).choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=30)) for i in range(12)]
    bench = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(99, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"intro {i} " + passages[i] + " end") for i in range(0, 12, 2)] + [(50, "clean text")], "doc_id bigint, text string")
    whole = sorted(tuple(x) for x in decontaminate.matches(docs, bench).collect())
    monkeypatch.setattr(decontaminate.benchmark_parts, "__defaults__", (500,))
    assert sorted(tuple(x) for x in decontaminate.matches(docs, bench).collect()) == whole and {(i, i) for i in range(0, 12, 2)} <= {x[:2] for x in whole}
    assert [x["doc_id"] for x in decontaminate.without_matches(docs, bench).collect()] == [50]


def test_decontamination_tables(spark):
    passage = " ".join(BASE)
    bench = spark.createDataFrame([(1, passage + "!", "x"), (2, None, None), (None, passage, "y"), (3, "tiny", "z")], "item_id bigint, text string, doc_id string")
    got = decontaminate.matches(make(spark), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter((d, i) for d in (1, 2, 7, 7, None) for i in (1, None))
    row = next(r for r in got if r["doc_id"] == 2 and r["item_id"] == 1)
    text = documents()[1][1].encode()
    assert text[row["start_byte"] : row["end_byte"]].decode() == passage
    clean = decontaminate.without_matches(make(spark), bench)
    assert clean.columns == make(spark).columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter([3, 4, 5, 6, 9, 10, 11])
    assert decontaminate.matches(empty(spark), bench).count() == 0 and decontaminate.matches(make(spark), bench.limit(0)).count() == 0


# op6


def test_license_scan(spark):
    mit = next(t for n, t in license_scan.NOTICES if n == "MIT" and len(t) > 100)
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nAfter", "en", "a", 1),
        (2, "x " * 400 + mit.upper() + " y" * 300, "en", "a", 1),
        (3, "Released under the license of nobody at all", "en", "a", 1),
        (4, "This work is licensed under the GNU General Public License, version 3.", None, None, None),
        (5, None, "en", "a", 1), (6, "", "en", "a", 1), (7, mit[: len(mit) // 2], "en", "a", 1), (1, "Released under the MIT License.", "en", "a", 1),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, license string")
    got = license_scan.scan_licenses(df).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter({(1, "MIT"): 2, (2, "MIT"): 1, (4, "GPL-3.0"): 1})
    row = next(r for r in got if r["doc_id"] == 1 and r["start_byte"] > 0)
    assert rows[0][1].encode()[row["start_byte"] : row["end_byte"]] == b"Released under the MIT License"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def every_window(scanner):
    """Brute force in place of the bands: every window of every notice's size, at every shingle."""

    def candidates(h, first):
        found = set()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            for notice, own in enumerate(scanner.sets):
                size = license_scan.REACH * license_scan.step_of(len(own))
                inside = np.isin(h[a:b], own)
                run = np.concatenate([[0], np.cumsum(inside)])
                for s in np.flatnonzero(inside).tolist():
                    end = min(s + size, b - a)
                    if run[end] - run[s] >= license_scan.CONTAINMENT * len(own):
                        found.add((notice, a + s, a + end))
        return found

    return candidates


def noisy_notices(r, n):
    """Notices in running text, whole or with some words changed."""
    common = [w for _, t in license_scan.NOTICES for w in t.split()]
    for _ in range(n):
        name, text = r.choice(license_scan.NOTICES)
        words = text.split()
        for _ in range(r.choice([0, 0, 1, 2]) if len(words) > 30 else 0):
            words[r.randrange(len(words))] = "changed"
        fill = [r.choice(common) if r.random() < 0.3 else f"w{r.randrange(5000)}" for _ in range(r.randrange(5, 300))]
        cut = r.randrange(len(fill))
        yield " ".join(fill[:cut] + words + fill[cut:])


def test_license_scan_against_every_window():
    r = random.Random(12)
    scanner = license_scan.Scanner(license_scan.NOTICES)
    data, offsets = wordkit.text_buffers(pa.array(list(noisy_notices(r, 1500))))
    want = {(x[0], scanner.names[x[1]]) for x in scanner.scan(data, offsets, every_window(scanner))}
    got = {(x[0], scanner.names[x[1]]) for x in scanner.scan(data, offsets)}
    assert len(want) > 1400 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_whole_notices_are_found_as_themselves():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    texts = [f"before it {t} after it" for _, t in license_scan.NOTICES]
    data, offsets = wordkit.text_buffers(pa.array(texts))
    found = scanner.scan(data, offsets, every_window(scanner))
    for i, (name, _) in enumerate(license_scan.NOTICES):
        assert [scanner.names[x[1]] for x in found if x[0] == i] == [name], (name, texts[i])


def test_rows_without_an_id_lie_in_all_blocks(spark):
    rows = spark.createDataFrame([(None, "the same text") for _ in range(600)], "doc_id bigint, text string").repartition(4)
    dealt, _ = substring._dealt(rows, 8)
    counts = [r["count"] for r in dealt.groupBy(substring.BLOCK).count().collect()]
    assert len(counts) == 8 and max(counts) < 150
    out = substring.stripped(rows, 2, n_blocks=8).collect()
    assert len(out) == 600 and all(r["n_removed"] == 0 for r in out)


def test_many_benchmark_parts_go_through_several_stages(spark, monkeypatch):
    parts = decontaminate.benchmark_parts
    monkeypatch.setattr(decontaminate, "PARTS_IN_STAGE", 2)
    monkeypatch.setattr(decontaminate, "benchmark_parts", lambda b: [p for part in parts(b) for p in (part.slice(i, 1) for i in range(part.num_rows))])
    made = random.Random(3)
    items = [" ".join("".join(made.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before {items[i] if i < 5 else 'nothing at all'} after") for i in range(8)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.without_matches(docs, bench).collect()) == [5, 6, 7]
