"""One scan for many phrases against one scan a phrase."""

import random

from pyspark.sql import functions as F

from parcelscope import vocab
from parcelscope.functions import text as X
from parcelscope.functions.phrases import Phrases, bounded, fixed_texts, found

PATTERNS = vocab.RISK_PATTERNS | {n: p for n, p, _, _ in vocab.PREFERENCES} | {f"b_{n}": p for n, p in vocab.BREAKERS.items()}
WORDS = (
    "main road busy arterial highway frontage traffic noise ground floor street level dark no outlook south-facing lift without a "
    "walk-up studio compact low-maintenance footprint 65 sqm m2 needs work renovate renovator's heritage overlay flood zone prone "
    "right of way shared driveway laundry pets 6 month lease parking only permit available move-in café cafe entertaining deck "
    "garden lock-up garage light-filled station built-in robe residents' residents’ lounge period art deco é 日本 _ a/c"
).split(" ")
GLUE = (" ", " ", " ", "  ", "", "-", "\n", ".", ",", "́", " ", "\x01", "_", "'")


def texts(n: int) -> list[str | None]:
    pick = random.Random(7)
    made = ["".join(pick.choice(WORDS) + pick.choice(GLUE) for _ in range(pick.randint(1, 25))) for _ in range(n)]
    return [*made, "", None, " ".join(WORDS) * 200, "x" * 50_000 + " main road", "flood" + " " * 500 + "zone"]


def test_same_flags_and_words_as_a_scan_for_each(spark):
    rows = spark.createDataFrame([(t,) for t in texts(1500)], "t string").repartition(4)
    phrases = Phrases(PATTERNS)
    rows = rows.withColumn("e", phrases.excerpts(F.col("t")))
    t, e = F.col("t"), F.col("e")
    wrong = [~X.evidence(t, p).eqNullSafe(phrases.evidence(n, t, e)) | (X.has(t, p) != phrases.has(n, t, e)) for n, p in PATTERNS.items()]
    names = [F.when(w, F.lit(n)) for n, w in zip(PATTERNS, wrong, strict=True)]
    assert rows.select("t", F.array_compact(F.array(*names)).alias("wrong")).where("size(wrong) > 0").collect() == []
    assert rows.where(F.size("e") > 1).count() > 300  # the texts do hold phrases


def test_which_patterns_fit_excerpts():
    assert [p for n, p in PATTERNS.items() if not bounded(p)] == [PATTERNS[n] for n in ("overlay", "sized", "outdoor_space")]
    for odd in (r"a|b", r"\ba|b", r"\b(a|b)|c", r"\b(a)?", r"\b(a?b)", r"\b(|a)", r"\b((a)b)", r"\b(?=a)b", r"\b(a{2,9})", r"\b(a)\1", r"\b(-a)", r"\b(a", r"\b(a+)"):
        assert not bounded(odd), odd


def test_only_patterns_that_do_not_fit(spark):
    phrases = Phrases({"any": r"a|b"})
    row = spark.createDataFrame([("xxb",)], "t string").select(phrases.has("any", F.col("t"), phrases.excerpts(F.col("t"))).alias("h"))
    assert row.first().h is True


def test_patterns_are_found_by_their_fixed_text_as_by_rlike(spark):
    texts = ["", None, "walk up", "walkup", "walk-down", "a lift", "lifts", "forklift", "elevator", "northeast", "north facing", "due north", "waterfront", "by the water.",
             "double lock-up", "double lockup", "study", "main road", "ab", "b", "a(b", "x|y", "écran water", "wateré"]
    patterns = [p for p, *_ in vocab.HEDONIC] + [r"a?b", r"(a|b)c|lift", r"wal\w+", r"\bb\b", r"stud(y|io)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.col("t")
    rows = df.select(F.struct(*[found(text, p) for p in patterns]).alias("a"), F.struct(*[text.rlike("(?U)" + p) for p in patterns]).alias("b")).collect()
    assert all(tuple(r.a) == tuple(r.b) for r in rows)
    plan = df.select(found(text, "garden|terrace").alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_met_and_first_are_as_a_scan_for_each(spark):
    odd = {"any": r"a|b", "group": r"\b(wal\w+|stud(y|io))\b", "optional": r"\b(rooft?op|a/c|lock[- ]?up)\b", "repeat": r"\b(no+ ?park)", "back": r"\b(f)\1?lood", "look": r"(?=a)a/c", "class": r"[m]ain road"}
    patterns = PATTERNS | odd
    phrases = Phrases(patterns)
    rows = spark.createDataFrame([(t,) for t in texts(400)], "t string").repartition(4)
    t = F.col("t")
    wrong = [(X.has(t, p) != phrases.met(n, t)) | (F.regexp_extract(t, "(?U)" + p, 0).eqNullSafe(phrases.first(n, t)) != F.lit(True)) for n, p in patterns.items()]
    names = [F.when(w, F.lit(n)) for n, w in zip(patterns, wrong, strict=True)]
    assert rows.select("t", F.array_compact(F.array(*names)).alias("wrong")).where("size(wrong) > 0").collect() == []


def test_fixed_texts_are_in_every_match():
    assert fixed_texts(r"\b(secure (car|park)|lock[- ]?up garage|garage)\b") == ["garage", "secure "]
    assert fixed_texts(r"\b(flood|fire)\s+(zone|prone)\b") in (["prone", "zone"], ["fire", "flood"])
    for open_ended in (r"a|b", r"\b(cd)?", r"(?=ab)", r"a{2,9}", r"(ab)\1", r"\b(ab", r"\Qab\E", r"(?i)ab", r"ab)", r"ab??", r"[a-z&&[b]]xx", r"]ab", r"(ab|c)"):
        assert fixed_texts(open_ended) == [], open_ended
    assert fixed_texts(r"abc?d") == ["ab"] and fixed_texts(r"(abc){0,2}de") == ["de"]
