import re

import pytest

import corpus_pipeline
from skymill.llm import rule_ensemble, spaced_seeds
from skymill.llm.tables import table
from skymill.runtime import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, SF))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_filters_keep_columns_and_subsets(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = stages["documents"]
    for n in names[:-1]:
        assert stages[n].columns == before.columns
        assert ids(stages[n]) <= ids(before)
        before = stages[n]
    assert ids(stages[names[-1]]) == ids(before)


def test_each_stage_against_brute_force(spark, stages):
    before = {r.doc_id: r.text for r in stages["quality_classifier"].collect()}
    predicted = rule_ensemble.classify(stages["documents"], table(spark, SF, "labels")).where("predicted = 1")
    assert set(before) == ids(predicted)
    groups = {}
    for d, t in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append(d)
    assert ids(stages["exact_dedup"]) == {min(g, key=lambda d: (-len(before[d] or ""), d)) for g in groups.values()}

    before = {r.doc_id: r.text for r in stages["exact_dedup"].collect()}
    after = ids(stages["simhash_near_dedup"])
    shingles = {d: {tuple(t.encode().lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in before.items()}
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in before:  # 0.8 on both sides: all links count, none else
        for b in before:
            if a < b and 10 * len(shingles[a] & shingles[b]) >= 8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {find(d) for d in before}

    before = stages["simhash_near_dedup"]
    items = [spaced_seeds.normal_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = set()
    for r in before.collect():
        joined = b" " + b" ".join(spaced_seeds.normal_words(r.text)) + b" "
        if any(b" " + b" ".join(w[i : i + 12]) + b" " in joined for w in items for i in range(max(1, len(w) - 11))):
            leaked.add(r.doc_id)
    assert leaked <= ids(before) - ids(stages["benchmark_decontamination"])
    assert len(ids(before) - ids(stages["benchmark_decontamination"])) <= len(leaked) + 2
    packed = stages["packing"].collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
