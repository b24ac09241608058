import hashlib
import math
import random

import numpy as np

from clearwell.llm import codes
from clearwell.llm.codes import compress, digest, nearest, with_label_error


def plain(rows, positions=4, entries=256, rounds=4):
    """(rows as (id, code, error, label_error), digest) in plain Python."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], digest(np.zeros((4, 0, 1), np.int64))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // positions))
    kept = [(i, v + [0] * (width * positions - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(positions)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(positions)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                groups.setdefault((p, near(p, part)[1]), []).append(part)
        for (p, k), members in groups.items():
            books[p][k] = tuple(sum(x) // len(members) for x in zip(*members))
    out, labels = [], {}
    for i, v, label in kept:
        found = [near(p, part) for p, part in enumerate(cut(v))]
        error = sum(d for d, _ in found)
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted([(i, c, e, labels[n]) for i, c, e, n in out], key=repr), hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **options):
    df = spark.createDataFrame(
        [(i, v, n, 1, "x", 2, 3) for i, v, n in rows], "vec_id bigint, embedding array<float>, label int, id int, code string, row int, v int")
    coded, books = compress(df, **options)
    got = with_label_error(coded).select("id", "code", "error", "label_error").collect()
    return sorted(map(tuple, got), key=repr), digest(books)


def vectors(n, width, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (12, width))
    return (centres[draw.integers(0, 12, n)] + draw.normal(0, 0.05, (n, width))).tolist()


def test_equals_plain_lloyd(spark):
    rows = [(3 * i, v, i % 4) for i, v in enumerate(vectors(700, 16))]
    rows += [(9000 + i, rows[5][1], None) for i in range(300)]  # a large group of copies
    assert run(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    draw = random.Random(2)
    fine = lambda n=8: [draw.uniform(-1, 1) for _ in range(n)]
    same = fine()
    rows = [(0, fine(), 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 2), (400, [float("inf")], 3), (500, [], 4),
            (None, fine(), None), (700, same, 1), (700, same, 1), (1, fine(5), None), (2, None, None), (3, [0.0] * 9, 5), (-100, fine(), 5)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, entries=3, rounds=2) == plain(rows, entries=3, rounds=2)
    assert run(spark, rows, rounds=0) == plain(rows, rounds=0)


def test_few_or_no_rows(spark):
    one = [(7, [0.5, -0.25, 0.1, 3.0], None)]
    assert run(spark, one) == plain(one)
    assert run(spark, []) == plain([]) and run(spark, [(1, None, 2)]) == plain([(1, None, 2)])


def test_nearest_is_exact_for_large_numbers_and_ties_go_low():
    entries = np.array([[5, 5], [1, 1], [1, 1], [3, 3]])
    assert nearest(np.array([[2, 2], [4, 4], [1, 1]]), entries)[0].tolist() == [1, 0, 1]
    big = np.array([[2**40, 0], [2**40 + 1, 0]])
    index, away = nearest(np.array([[2**40 + 1, 3]]), big)
    assert index.tolist() == [1] and away.tolist() == [9]


def test_only_parts_that_change_entry_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(codes, "LEAST_SALTS", 3)
    rows = [(i, v, 0) for i, v in enumerate(vectors(2000, 16, 5))]
    moved = []
    assert run(spark, rows, entries=64, stats=moved) == plain(rows, entries=64)
    assert moved[0] == 8000 and len(moved) == 4 and all(0 < n < 0.6 * 8000 for n in moved[1:])


def test_owners_add_up_without_a_shuffle(spark):
    frame = spark.range(5000).selectExpr("cast(id % 4 as int) position", "cast(id % 7 as int) entry", "cast(id % 3 as int) salt", "array(id) part")
    tables = codes._Tables(spark, 6)
    name = tables.sent(frame)
    sums = codes._sums(spark.table(name), "bigint")
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sum(r.total for r in sums.collect()) == sum(range(5000))
    tables.drop(name)
