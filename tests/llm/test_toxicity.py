import os
import random
import zlib

import numpy as np
import pytest

from clearwell.llm import toxicity as tx

from .cases import AWKWARD, documents, prose


def test_pair_sums_equal_the_double_sum():
    draw = np.random.default_rng(1)
    x, w, v = draw.random((5, 7)), draw.random(7), draw.random((7, 3))
    want = [0.3 + x[r] @ w + sum(v[i] @ v[j] * x[r, i] * x[r, j] for i in range(7) for j in range(i)) for r in range(5)]
    assert np.allclose(tx.pair_sums(x, 0.3, w, v)[0], want)


def test_machine_learns_what_only_matters_together():
    draw = np.random.default_rng(2)
    x = (draw.random((2000, 6)) < 0.5).astype(np.uint8)
    y = (x[:, 0] ^ x[:, 1]).astype(np.float32)
    w0, w, v = tx.fit_machine(x, y, epochs=60)
    z, _ = tx.pair_sums(tx._value(x), w0, w, v)
    assert ((z > 0) == (y > 0)).mean() > 0.95


def labelled(spark, n=400):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(i, 40).split()
        for _ in range(3 * toxic):
            words.insert(draw.randrange(40), draw.choice(["idiotish", "moronic", "scumbag"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    got = {r["id"]: r.score for r in tx.score(docs, tx.fit_held(docs, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95


def test_awkward_rows_have_scores_and_stay(spark):
    rows, labels = labelled(spark)
    model = tx.fit_held(documents(spark, rows), labels)
    docs = documents(spark, AWKWARD + [(50, "idiotish moronic scumbag idiotish moronic scumbag")])
    scores = tx.score(docs, model).collect()
    assert len(scores) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in scores)
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i, _ in AWKWARD)


@pytest.mark.parametrize("rows", [[], [(4, None, None), (5, None, 1), (None, None, 1)], [(4, 1, 1), (4, 1, 0), (5, 1, 1)]])
def test_few_labels(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    docs = documents(spark, AWKWARD)
    assert all(0 <= r.score <= 1 for r in tx.score(docs, tx.fit(docs, labels)).collect())
    assert tx.score(documents(spark, []), tx.fit(documents(spark, []), labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
def test_held_out_accuracy_on_the_given_table(spark):
    rows = tx.op4_toxicity(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
