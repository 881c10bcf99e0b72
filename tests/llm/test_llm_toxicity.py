"""Toxicity: held-out accuracy, the counterfactual penalty, and features written again in plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from parcelscope.llm import toxicity
from parcelscope.llm.base import held_out

FILLER = "the of and a river stone walks over under bright slow letter garden paper window market early".split()
BAD = ["idiot", "scum", "pathetic"]


def sentence(rng, extra=()):
    words = [rng.choice(FILLER) for _ in range(rng.randrange(6, 15))]
    for w in extra:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words) + "."


def biased(seed, n=400):
    """Toxic texts name a group far more often than clean ones do, as collected labels tend to."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 2
        names = [rng.choice(["muslims", "women", "immigrants"])] if rng.random() < (0.8 if toxic else 0.05) else []
        texts.append(sentence(rng) + " " + sentence(rng, names + ([rng.choice(BAD)] if toxic and rng.random() < 0.8 else [])))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_penalty_lowers_false_positives_on_neutral_mentions():
    texts, labels = biased(1)
    rng = random.Random(2)
    neutral = pa.array([sentence(rng, [g]) for g in ("muslims", "women", "immigrants") for _ in range(60)])
    plainly_bad = pa.array([sentence(rng, [w]) for w in BAD for _ in range(60)])
    without, with_it = (toxicity.fit(texts, labels, penalty=p, l1=0.05) for p in (0.0, toxicity.PENALTY))
    false = [(toxicity.score(neutral, w) >= 0.5).mean() for w in (without, with_it)]
    assert false[0] > 0.5 and false[1] < 0.2
    assert (toxicity.score(plainly_bad, with_it) >= 0.5).mean() > 0.9
    swaps = [toxicity.score(pa.array([f"Many {g} walk over the river."] * 1), with_it)[0] for g in ("muslims", "people", "jews", "christians")]
    assert max(swaps) - min(swaps) < 0.1


def test_swaps_replace_every_named_group_and_nothing_else():
    made = toxicity.swapped("Women and Muslims walk, womenfolk too.", 0)
    assert made == "people and people walk, womenfolk too."
    assert toxicity.swapped("The river.", 0) is None
    for turn in range(8):
        for a, b in toxicity.counterfactuals("Men walk here. The river is slow.", turn):
            assert a == "Men walk here." and b != a and b.endswith("walk here.")
        (named, other), = toxicity.counterfactuals("The river is slow.", turn)
        assert named != other and len(named.split()) == len(other.split()) == 5
    assert toxicity.counterfactuals(" \n", 0) == []


def test_features_and_score_in_plain_python():
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(toxicity.FAMILIES << toxicity.BITS) + 1).astype(np.float32)
    texts = ["One two ONE three-four five", "", " \t\n", "É é ÉÉÉÉ idiot", "x" * 5000 + " tail words here and there"]

    def buckets(word):
        """Buckets of one word alone, by the function under test; what is tested is how texts add up."""
        (ids, values), = toxicity.vectors([word])
        return dict(zip(ids.tolist()[:-1], values.tolist()[:-1], strict=True))

    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        total, seen = float(weights[-1]), set()
        for w in words:
            for bucket in buckets(w):
                if bucket < 1 << toxicity.BITS:
                    seen.add(bucket)
                else:
                    total += float(weights[bucket]) * toxicity.SHARE / len(words)
        total += sum(float(weights[b]) for b in seen)
        want = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        assert abs(toxicity.score(pa.array([text]), weights)[0] - want) < 1e-5


def test_score_is_the_same_in_any_company():
    texts, labels = biased(3, 60)
    weights = toxicity.fit(texts, labels)
    alone = [toxicity.score(pa.array([t]), weights)[0] for t in texts]
    assert np.allclose(alone, toxicity.score(pa.array([*texts, None]), weights)[:-1], atol=1e-9)


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.toxic_scores(docs, labels, "toxic", ~held_out(0, 5))
    rows = scored.join(labels, "doc_id").where(held_out(0, 5)).collect()
    right = sum(r.predicted == r.toxic for r in rows)
    clean = [r.predicted for r in rows if not r.toxic]
    assert len(rows) > 300 and right / len(rows) > 0.95 and sum(clean) / len(clean) < 0.02
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_held_out_labels_teach_nothing(spark, docs, labels):
    spoilt = labels.withColumn("toxic", (1 - labels.toxic)).where(held_out(0, 5)).unionByName(labels.where(~held_out(0, 5)))
    a, b = (toxicity.fit_model(docs, t, "toxic", ~held_out(0, 5)) for t in (labels, spoilt))
    assert (a == b).all()


def test_odd_rows_and_missing_labels(spark, odd, none, labels):
    scores = toxicity.toxic_scores(odd, labels, "toxic").collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxic_scores(none, labels, "toxic").collect() == []
    one_kind = labels.where("toxic = 0")
    assert {r.score for r in toxicity.toxic_scores(odd, one_kind, "toxic").collect()} == {0.5}
