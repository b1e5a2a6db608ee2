"""Every stage of the pipeline against plain Python over its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from test_texts import WORD, brute_components, brute_mark

import corpus_pipeline
from caudal.llm import bpe, quality
from caudal.llm.registered import vocabulary

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.kept(stage(spark, tables[-1], SF), "test-stage"))
    return tables


def test_columns(stages):
    assert [t.columns for t in stages[:-1]] == [stages[0].columns] * len(corpus_pipeline.STAGES)


def test_rejected_are_those_below_the_limit(spark, stages):
    docs = stages[0]
    chain = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, chain).collect() if r["score"] >= 0.7}
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(good)


def test_one_of_equal_texts_stays(stages):
    first = {}
    for r in stages[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(first.values())


def test_one_of_linked_texts_stays(stages):
    rows = [(r["doc_id"], brute_mark(r["text"])) for r in stages[2].collect()]
    expected = sorted({c for _, _, c in brute_components(rows)})
    assert sorted(r["doc_id"] for r in stages[3].collect()) == expected


def test_mix(stages):
    docs = {r["doc_id"]: r for r in stages[3].collect()}
    sizes = {i: len(WORD.findall(r["text"])) for i, r in docs.items()}
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(copies) <= set(docs) and max(copies.values()) <= 2
    words, taken, largest = Counter(), Counter(), Counter()
    for i, r in docs.items():
        words[r["source"]] += sizes[i]
        taken[r["source"]] += sizes[i] * copies[i]
        largest[r["source"]] = max(largest[r["source"]], sizes[i])
    target = brute_targets(words)
    for source in words:
        assert abs(taken[source] - target[source]) <= largest[source]


def brute_targets(words):
    names = sorted(words)
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    left, open_, out = 1.5 * sum(words.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * words[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2 * words[s] for s in full}
        left -= sum(2 * words[s] for s in full)
        open_ -= full


def test_tokens(stages):
    ranks = bpe.ranks_of(vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in stages[4].collect():
        ids = own.encode_ordinary(r["text"])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((r["doc_id"], len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    made = [(r[0], r[1], bytes(r[2]), r[3], r[4]) for r in stages[5].collect()]
    assert sorted(made) == sorted(expected)


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, `a b` string, kept string"
    text = "the quick brown fox jumps over the lazy dog and then sleeps all day long in the warm sun"
    rows = [(1, text), (1, text), (1, text + " x"), (2, text.replace(" ", "\n")), (None, text), (3, None), (None, None), (4, "")]
    rows += [(i, f"{text} number {i} of these texts is about {i * 7} things") for i in range(10, 40)]
    docs = spark.createDataFrame([(i, t, None, None if i == 10 else "s", 1, "r", "b", "k") for i, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # Without labels every score is one half: let the first stage keep all rows here.
    table = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        table = corpus_pipeline.kept(stage(spark, table, str(tmp_path)), "odd-stage")
        if name == "exact dedup":
            keys = [(r["doc_id"], r["text"]) for r in table.collect()]
            assert len(keys) == len(set(keys)) == 33
        if name != "byte-level BPE":
            assert table.columns == docs.columns
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
        if name != "byte-level BPE":
            assert none.columns == docs.columns


def test_registered(spark):
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" not in contract.oracle_sql()
    groups = defaultdict(list)
    for name in names:
        groups[name.split("_")[0]].append(name)
    assert all(len(groups[f"op{i}"]) == 1 for i in range(1, 14))
