"""The pipeline stage by stage, and the registered queries of the text operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import __spark_entry__ as entry_point
import corpus_pipeline
from logtide.llm import oracle, queries, simhash
from logtide.sources.storage import settled
from tests.compare import connect, mismatch
from tests.llm import edges

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = settled(spark, stage(spark, docs, SF_DIR), "stage")
        found.append((docs, after))
        docs = after
    return found


def test_registered():
    names = set(entry_point.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op"))
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_matches_sql(spark, name):
    connection = connect(SF_DIR)
    assert mismatch(queries.queries()[name](spark, SF_DIR), oracle.oracle_sql()[name], connection) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op6_top_k", "op4_source_mix", "op13_source_audit"}))
def test_query_gives_a_row_for_every_document(spark, name):
    found = queries.queries()[name](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found.columns[0] == "doc_id"
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(
        r.doc_id for r in docs.select("doc_id").collect()
    )


def test_stage_columns(stages):
    for _, after in stages[:-1]:
        assert after.columns == COLUMNS


def test_classifier_stage_drops_rows_and_changes_none(stages):
    before, after = ({r.doc_id: r for r in frame.collect()} for frame in stages[0])
    assert 0 < len(after) < len(before)
    assert all(before[k] == r for k, r in after.items())


def test_classifier_stage_keeps_what_the_query_predicts_good(spark, stages):
    good = queries.op9_quality(spark, SF_DIR).where("score >= 0.7")
    assert sorted(r.doc_id for r in stages[0][1].collect()) == sorted(r.doc_id for r in good.collect())


def test_one_document_of_each_group_stays(stages):
    before, after = ([r for r in frame.collect()] for frame in stages[1])
    bits = np.array([simhash.fingerprint(r.text) for r in before], dtype=np.int64).view(np.uint64)
    group = list(range(len(before)))
    for i, j in zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2), strict=True):
        a, b = group[i], group[j]
        group = [a if g == b else g for g in group]
    least = {}
    for g, row in zip(group, before, strict=True):
        least[g] = min(least.get(g, row.doc_id), row.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_mix_repeats_and_drops(stages):
    before, after = ([r.doc_id for r in frame.collect()] for frame in stages[2])
    counts = {k: after.count(k) for k in before}
    assert set(after) <= set(before)
    assert max(counts.values()) <= 3
    assert len(set(counts.values())) > 1


def test_mix_comes_near_plain_targets(stages):
    """Targets by plain water-filling; a source is off by one document at most."""
    before, after = ([r for r in frame.collect()] for frame in stages[2])
    size = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in before}
    held, taken = Counter(), Counter()
    for r in before:
        held[r.source] += size[r.doc_id]
    for r in after:
        taken[r.source] += size[r.doc_id]
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(held.values()) - sum(target.values())
        share = Fraction(left, sum(weight[s] for s in open_))
        above = {s for s in open_ if weight[s] * share > 3 * held[s]}
        target |= {s: 3 * held[s] for s in above}
        open_ -= above
        if not above:
            break
    target |= {s: weight[s] * share for s in open_}
    for s in names:
        largest = max(size[r.doc_id] for r in before if r.source == s)
        assert abs(taken[s] - target[s]) <= largest


def test_encoding_gives_the_library_ids(stages):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    expected = []
    for r in stages[3][0].collect():
        text = r.text or ""
        ids = library.encode_ordinary(text)
        packed = np.array(ids, dtype="<u4").tobytes()
        digests = (hashlib.sha256(b).hexdigest() for b in (packed, text.encode()))
        expected.append((r.doc_id, len(ids), *digests))
    found = stages[3][1].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][1].collect()))
    assert all(r.n_tokens >= 0 for r in got)


@pytest.mark.parametrize("make", [edges.documents, edges.no_documents])
def test_stages_take_awkward_rows(spark, make):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = make(spark)
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns
        assert after.count() <= 3 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, make(spark), SF_DIR).count() == make(spark).count()


def test_dedup_of_awkward_rows(spark):
    """Equal rows, rows of equal keys and rows without a key leave one of each group."""
    docs = edges.documents(spark)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    prints = [simhash.fingerprint(r.text or "") for r in after.collect()]
    assert len(set(prints)) == len(prints)
    assert {simhash.fingerprint(r[1] or "") for r in edges.rows()} >= set(prints)
