"""The pipeline's stages, one after the other, against brute force on the fixture of test_operators."""

import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline
import public_tokenizers
from bitweave.llm import language_id
from bitweave.llm.queries import MIX_TARGETS
from test_operators import brute_mix, corpus, documents, draws, key


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows before the first stage and after each; every stage's result is written and read again."""
    base = tmp_path_factory.mktemp("sf")
    documents(spark, corpus(2)).write.parquet(f"{base}/documents.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(base)).write.parquet(f"{base}/stage{k}")
        docs = spark.read.parquet(f"{base}/stage{k}")
        out.append(docs)
    return str(base), out


def rows_of(df):
    return sorted(((r.doc_id, r.text or "", r.lang or "", r.source or "") for r in df.collect()), key=key)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_columns(staged):
    _, dfs = staged
    assert all(d.columns == dfs[0].columns for d in dfs[:-1])


def test_language_stage(staged):
    _, dfs = staged
    gone = {r.doc_id for r in language_id.identify(dfs[0]).where("rejected").collect()}
    assert {300, 301, 302, 303} <= gone and None not in gone
    assert rows_of(dfs[1]) == [r for r in rows_of(dfs[0]) if r[0] not in gone]


def test_exact_stage(staged):
    _, dfs = staged
    groups = {}
    for r in rows_of(dfs[1]):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r[1]), []).append(r)
    assert rows_of(dfs[2]) == sorted((min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()), key=key)


def test_jaccard_stage(staged):
    _, dfs = staged
    before = rows_of(dfs[2])
    number = {r[0]: 10**9 if r[0] is None else r[0] for r in before}  # a null doc_id is never the smallest
    assert len(number) == len(before)
    classes = brute.jaccard_components([(number[r[0]], r[1]) for r in before], 5, 80)
    assert rows_of(dfs[3]) == [r for r in before if classes[number[r[0]]][1] == number[r[0]]]
    assert len(rows_of(dfs[3])) < len(before)


def test_mixing_stage(spark, staged):
    _, dfs = staged
    before = [(r.doc_id, r.text, r.lang, r.source) for r in dfs[3].collect()]

    def domain(r):
        number = re.search(r"(\d+)$", r[3] or "")
        return ("web", "news", "books")[int(number[1]) % 3 if number else 0]

    leaves, tokens, budget = brute_mix(before, domain, MIX_TARGETS)
    want, order = Counter(), draws(spark, 5, [r[:2] for r in before])
    for leaf, members in leaves.items():
        if not budget.get(leaf):
            continue
        whole, rest = divmod(budget[leaf], tokens[leaf])
        total = 0
        for r, n in sorted(members, key=lambda m: order[whole, m[0][0], m[0][1] if m[0][0] is None else None]):
            want[r[0]] += whole
            total += n
            if total <= rest:
                want[r[0]] += 1
            else:
                total = rest + 1  # nothing after the first that does not fit
    assert Counter(r[0] for r in rows_of(dfs[4])) == +want


def test_packing_stage_and_run(spark, staged):
    from tokenizers import Tokenizer

    base, dfs = staged
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in rows_of(dfs[4]):
        want[i] += len(own.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in dfs[5].collect():
        got[r.doc_id] += r.length
    assert got == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, base).collect())) == sorted(map(tuple, dfs[5].collect()))
