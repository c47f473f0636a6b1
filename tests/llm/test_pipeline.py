"""The pipeline against its stages by brute force."""

import os
from collections import Counter, defaultdict

import corpus_pipeline
from test_operators import group

from tideline.llm import bpe, pii, simhash, toxicity
from tideline.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_run_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    score = toxicity.Scorer(model.contributions(), model.offset())
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    fps = [simhash.fingerprint(r[1]) for r in rows]
    names = group(rows, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    rows = [(i, pii.replaced(t)[0], s) for (i, t, s), n in zip(rows, names) if i == n]
    with bpe.codec() as codec:
        want = {i: ids.tolist() for (i, _, _), ids in zip(rows, codec.encode([t for _, t, _ in rows]))}
    assert {r.doc_id: list(r.ids) for r in got} == want
    times = Counter(r.doc_id for r in got)
    assert max(times.values()) <= 2
    # A source's passes are its repeats, to a block: the largest passes least.
    tokens, passed = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        tokens[s] += len(t.split())
        passed[s] += len(t.split()) * times[i]
    ratio = {s: passed[s] / tokens[s] for s in tokens}
    assert ratio[max(tokens, key=tokens.get)] == min(ratio.values())


def test_stages_return_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
