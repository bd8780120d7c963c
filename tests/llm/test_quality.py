import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import classifier, rules

from ..conftest import SMALL, same_rows
from .tables import awkward, nothing


def test_rules_by_sql(spark, duck):
    same_rows(rules.measure(spark.read.parquet(f"{SMALL}/documents.parquet")), duck, rules.sql())


def measured(text):
    """The contract's measures, said once more."""
    b = (text or "").encode()
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 5)}
    chars = sum(len(x.decode()) for x in w)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), chars, sum(b.count(bytes([c])) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_rules_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["a", "b", "é", "#", "%", " ", " ", "\n", "\t", "\x0b", "漢", " ", "\x85"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))) for k in range(300)] + [(300, None), (301, "")]
    got = rules.measure(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {k: measured(t) for k, t in docs}
    assert not any(r.kept and r.base_failed for r in got)


def test_order_of_rules_changes_no_verdict():
    texts = ["one two three four five six seven eight nine ten eleven", "A B C", "x # y # z # a b c d e f g h", "", "LOUD " * 12]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want, _ = rules.cascade(rules.Texts(data, offsets), rules.RULES)
    for k in range(20):
        chain = list(rules.RULES)
        random.Random(k).shuffle(chain)
        assert (rules.cascade(rules.Texts(data, offsets), tuple(chain))[0] == want).all()


def test_rules_are_ordered_by_rejection_per_cost():
    figures = [(r.name, 1.0, 0.1) for r in rules.RULES[:-1]] + [(rules.RULES[-1].name, 0.1, 0.5)]
    assert rules.ordered(rules.RULES, figures)[0] is rules.RULES[-1]
    assert rules.ordered(rules.RULES, []) == rules.RULES


def test_figures_of_rules_come_from_all_rows(spark):
    """The first half of the table, by order and by size, would be rejected by one rule alone."""
    docs = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 2000, F.lit("few words")).otherwise(F.repeat(F.lit("all of these words are quite usual, so it seems to me\n"), F.when(F.col("id") % 100 == 0, 2000).otherwise(1))).alias("t"))
    share = {name: x for name, cost, x in rules.estimate(docs, rows=1000)}
    assert abs(share["too_few_words"] - 0.5) < 0.1 and 0 < share["repeated_words"] < 0.03
    assert rules.estimate(docs.where("false")) == []


def test_one_text_of_each_id_is_learnt(spark):
    docs = spark.range(0, 600).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("some words of mine "), (F.col("id") % 5).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    kept = labels.where(~classifier.held_out()).count()
    assert len(classifier.fit(docs, labels).vectors) == kept > 0


def test_rules_on_awkward_rows(spark):
    docs = awkward(spark)
    got = rules.judge(docs).collect()
    assert len(got) == 12 and {r.rejected_by for r in got if r.text is None} <= {r.name for r in rules.RULES}
    assert not any(r.kept for r in got if r.doc_id in (2, 3, 4, 8, 9)) and set(docs.columns) <= set(got[0].asDict())
    assert rules.measure(docs).count() == 12 and rules.judge(nothing(spark)).count() == rules.measure(nothing(spark)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_held_out_labels_are_never_seen(labelled):
    docs, labels = labelled
    other = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    small = docs.where("doc_id < 100")
    a, b = (sorted(map(tuple, classifier.score(small, classifier.fit(docs, x)).select("doc_id", "score").collect())) for x in (labels, other))
    assert a == b


def test_votes_by_brute_force(labelled):
    """Every document against every labelled vector, one at a time."""
    docs, labels = labelled
    model = classifier.fit(docs, labels, sample=150)
    assert len(model.vectors) <= 150
    rows = docs.where("doc_id < 60").orderBy("doc_id").collect()
    got = {r.doc_id: r.score for r in classifier.score(docs.where("doc_id < 60"), model).collect()}
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x = model.embed(*classifier.terms(data, np.array([0, len(data)])), 1)[0]
        near = sorted(((float(v @ x), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        weight = [max(c, 0) ** 8 for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if sum(weight) > 1e-12 else model.prior
        assert abs(got[r.doc_id] - want) < 1e-4


def test_classifier_on_awkward_rows(spark, labelled):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, None, 0), (8, 1, 0), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    for given in (labels, labels.where("false")):
        model = classifier.fit(docs, given)
        got = classifier.score(docs, model).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got) and {r.predicted for r in got} <= {0, 1}
    assert classifier.classify(nothing(spark), labels).count() == 0
