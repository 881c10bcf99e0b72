"""The stages against plain Python on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import public_tokenizers
from parcelscope.llm import mixing, quality
from parcelscope.llm.base import held_out, settle
from test_llm_dedup import lower, sets
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, docs, labels):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mix", "pack"]

    good = settle(stages["quality"](spark, docs, SF), "test-quality")
    scores = quality.quality_scores(docs, labels, "quality", ~held_out(), threshold=0.7)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())

    once = settle(stages["exact"](spark, good, SF), "test-exact")
    owner = {}
    for r in good.collect():
        owner[lower(r.text)] = max(r.doc_id, owner.get(lower(r.text), -1))
    assert sorted(r.doc_id for r in once.collect()) == sorted(owner.values())

    near = settle(stages["near"](spark, once, SF), "test-near")
    rows = sorted((r.doc_id, sets(r.text)) for r in once.collect())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _ in rows if find(i) == i)

    mixed = settle(stages["mix"](spark, near, SF), "test-mix")
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(near, whole=True).collect() if r.size}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in want.items() if n})

    pieces = stages["pack"](spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    filled = defaultdict(int)
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert sum(filled.values()) == total and max(filled.values()) <= 2048
