"""Byte-level BPE, exact duplicates, SimHash and the mix against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from caudal.llm import bpe, exact_dedup, mixing, pretokens, simhash
from caudal.llm.components import connected
from caudal.llm.registered import op1_byte_bpe, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def documents(spark, rows):
    """Rows of (doc_id, text, source); the last columns clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    long = " ".join(f"word{i % 977} {i}" for i in range(60_000))
    return [
        (1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, "one", "a"), (5, "one  two", None),
        (6, "one\ttwo", "b"), (7, "one two", "c"), (7, "one two", "c"), (None, "one two", "c"), (None, None, None),
        (8, long, "a"), (9, long + " end", "a"), (10, "héllo wörld ñ 你好 🙂   x y \r\n\r\n", "b"),
        (11, "a" * 5000, "c"), (12, "<|endoftext|> it's I'LL", "c"), (13, "one two three", "d"),
        (14, "ONE two THREE", "d"), (15, "é" * 300 + "!" * 700, "d"),
    ]


@pytest.fixture(scope="module")
def ranks():
    return vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(ranks), special_tokens={})


def ids_of(row):
    return [int.from_bytes(row["ids"][i : i + 4], "little") for i in range(0, len(row["ids"]), 4)]


@pytest.mark.parametrize("block_bytes", [50, 8_000_000])
@pytest.mark.parametrize("at_spaces", [False, True])
def test_bpe_equals_the_library_and_round_trips(spark, odd, ranks, block_bytes, at_spaces):
    own = library(ranks)
    made = bpe.encode_decode(documents(spark, odd), ranks, public_tokenizers.PATTERN, block_bytes, at_spaces).collect()
    expected = sorted((str(i), own.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in odd)
    assert sorted((str(r["doc_id"]), ids_of(r), bytes(r["decoded"])) for r in made) == expected


@pytest.mark.parametrize("at_spaces", [False, True])
def test_stretches_give_the_pattern_s_matches(at_spaces):
    find, draw = regex.compile(public_tokenizers.PATTERN).findall, random.Random(3)
    marks = [" ", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\u00a0", "\u3000", "\u0301", "a", "b", "'s", "'", "ll", "1", ".", "_", "é", "你", "🙂"]
    texts = ["", " ", "  ", "a", " a ", "a  b"] + ["".join(draw.choices(marks, k=draw.randint(0, 30))) for _ in range(5000)]
    for some in (texts, texts[:1], []):
        batch = pa.record_batch([pa.array(range(len(some)), pa.int64()), pa.array(some, pa.string())], ["doc_id", "text"])
        made = []
        for ids, block in pretokens.in_blocks(iter([batch, batch.slice(0, 0)]), 1000):
            counts, codes, words, sizes = pretokens.coded(block, find, 7, at_spaces)
            assert sizes.sum() == len(words) == len(set(words.to_pylist()))
            stops = counts.cumsum()
            made += [(i, [words[int(c)].as_py().decode() for c in codes[b - n : b]]) for i, b, n in zip(ids.to_pylist(), stops, counts)]
        assert made == [(i, find(t)) for i, t in enumerate(some)]


def test_bpe_on_the_corpus(spark, ranks):
    own = library(ranks)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {}
    for r in docs.collect():
        ids = own.encode_ordinary(r["text"])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected[r["doc_id"]] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    made = op1_byte_bpe(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in made} == expected


def test_long_words_merge_like_short_ones(ranks):
    table, draw = bpe.ranks_of(ranks), random.Random(1)
    for _ in range(200):
        word = bytes(draw.choice(b"aethiznou .\xc3\xa9") for _ in range(draw.randint(2, 63)))
        assert bpe._encode_long(word, table) == [table[p] for p in _plain(word, table)]


def _plain(word, table):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates(spark, odd, bits):
    made = exact_dedup.duplicates(documents(spark, odd), bits).collect()
    groups = defaultdict(list)
    for i, t, _ in odd:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named, default=None)
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            expected.append((i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, expected))


def brute_mark(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """marks: list of (id, fingerprint); smallest id reachable over two bits or fewer."""
    distinct = sorted({m for _, m in marks})
    root = {m: m for m in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    smallest = defaultdict(list)
    for i, m in marks:
        if i is not None:
            smallest[find(m)].append(i)
    return [(i, f"{m:016x}", min(smallest[find(m)], default=None)) for i, m in marks]


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_simhash(spark, odd, crowd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = odd + [(r[0] + 100, r[1], r[2]) for r in docs.collect()]
    made = simhash.near_duplicates(documents(spark, rows), crowd=crowd).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, brute_components([(i, brute_mark(t)) for i, t, _ in rows])))


@pytest.mark.parametrize("crowd", [0, 5, 64])
def test_links_of_dense_fingerprints(spark, crowd):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(4)]
    marks = {b ^ sum(1 << j for j in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(120)}
    marks |= {b ^ (3 << 31) ^ (1 << 63) for b in marks}
    marks = sorted(marks)
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in connected(simhash.links(frame, crowd)).collect()}
    got = defaultdict(set)
    for m in marks:
        got[roots.get(m, m)].add(m)
    expected = defaultdict(set)
    for i, m, c in brute_components([(m, m) for m in marks]):
        expected[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_mix(spark, odd):
    rows = mixing.schedule(documents(spark, odd)).collect()
    assert len(rows) == len(odd)
    sizes = defaultdict(int)
    for _, t, s in odd:
        sizes[s] += len(WORD.findall(t or ""))
    for r in rows:
        assert sum(r["sent"]) <= 2 * r["size"]
    assert abs(sum(sum(r["sent"]) for r in rows) - 1.5 * sum(sizes.values())) <= 2 * len(sizes)
    again = mixing.schedule(documents(spark, odd[::-1])).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixed_documents_come_in_whole_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    copies = mix.groupBy("doc_id").count()
    assert copies.filter("count > 2").count() == 0
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total, mixed = (d.agg(F.sum(words)).first()[0] for d in (docs, mix))
    assert abs(mixed / total - 1.5) < 0.05


def test_no_rows(spark, ranks):
    none = documents(spark, [])
    assert bpe.encode_decode(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert exact_dedup.duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert mixing.schedule(none).count() == 0
    assert mixing.mixed(none).count() == 0
