"""The corpus pipeline, stage by stage, on the small tables and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline as C
from tests.llm.test_operators import awkward, brute_leaks, contract_spans, nothing, packed_well


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, f in C.STAGES:
        new = f(spark, docs, sf_dir).cache()
        out.append((docs, new))
        docs = new
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(new.columns == columns for _, new in stages[:-1])
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]


def test_language_keeps_what_has_letters(stages):
    before, after = stages[0]
    assert len(ids(after)) > 0.97 * len(ids(before))


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    kept = ids(after)
    first = {}
    for i in sorted(texts):
        first.setdefault(" ".join(texts[i].split()).lower(), i)
    assert kept <= set(first.values())
    shingles = {i: {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for i, w in ((i, texts[i].lower().split()) for i in texts)}
    for i in set(texts) - kept:
        assert max(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for j in texts if j != i) >= 0.8


def test_near_duplicates_lose_no_pair(spark):
    """All pairs of sf0.01 at five-word similarity 0.8 or more, against all shingle sets."""
    from weir.llm import simhash

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = [i for i, s in sets.items() if not s]
    pairs = {(a, b) for a, b in zip(empty, empty[1:])}
    for i, s in sets.items():
        common = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        pairs |= {(i, j) for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)}
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert pairs and got == {i: find(i) for i in sets}


def test_no_leak_stays_and_clean_ones_do(stages, sf_dir):
    before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    items = dict(duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall())
    assert ids(after) == set(texts) - {d for d, _ in brute_leaks(texts, items)}


def test_no_secret_stays(stages):
    before, after = stages[3]
    assert ids(before) == ids(after)
    for r in after.collect():
        assert not contract_spans(r.text) and r.n_chars == len(r.text)


def test_packing_of_the_rest(stages):
    before, after = stages[4]
    rows = after.collect()
    packed_well(rows)
    assert {r.doc_id for r in rows} == ids(before)


def test_run(spark, sf_dir, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, C.run(spark, sf_dir).select(*cols).collect())) == sorted(map(tuple, stages[-1][1].select(*cols).collect()))


def test_awkward_and_empty(spark, sf_dir):
    for docs in (awkward(spark), nothing(spark)):
        for _, f in C.STAGES:
            docs = f(spark, docs, sf_dir).cache()
        docs.count()
