import re

from clearwell.llm.decontaminate import contamination, keep_clean

from .cases import AWKWARD, documents, prose


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = set()
    for item, text in items:
        w = words_of(text)
        k = min(10, len(w))
        windows |= {(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, met = set(), set()
        for item, window in windows:
            k = len(window)
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == window:
                    hit.update(range(i, i + k))
                    met.add(item)
        out.append((repr(doc), len(w), len(hit), sorted(str(m) for m in met if m is not None)))
    return sorted(out)


def cases():
    passage = prose(50, 40)
    items = [(1, passage), (2, prose(51, 25)), (3, "Short Item, of five words"), (4, None), (5, ""), (6, "river"),
             (1, passage), (7, prose(51, 25)), (None, prose(52, 14)), (8, prose(53, 9)), (9, prose(54, 10))]
    inside = lambda t, seed: f"{prose(seed, 20)} zz {t} yy {prose(seed + 1, 20)}"
    cut = passage.split()
    docs = AWKWARD + [
        (20, inside(passage, 60)), (21, inside(passage.upper(), 62)), (22, inside(" ".join(cut[5:15]), 64)),
        (23, inside(" ".join(cut[5:14]), 66)), (24, passage), (25, inside("short-item of FIVE words", 68)),
        (26, inside(prose(52, 14), 70)), (27, f"{prose(53, 9)} {prose(54, 10)}"), (20, prose(51, 25)),
        (28, inside(passage + " q " + passage, 72)), (None, inside(passage, 74)), (29, "of five words short item"),
    ]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(documents(spark, docs), bench).collect()
    assert sorted((repr(r["id"]), r.n_words, r.n_hit, r["items"]) for r in got) == plain(docs, items)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    from clearwell.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    test_equals_brute_force(spark)


def test_clean_documents_stay(spark):
    docs, items = cases()
    items = [x for x in items if x[0] != 6]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = documents(spark, docs)
    kept = keep_clean(rows, bench)
    assert kept.columns == rows.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(d for d, _, hit, _ in plain(docs, items) if not hit)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id bigint, text string")
    assert contamination(documents(spark, []), some).count() == 0
    assert {r.n_hit for r in contamination(documents(spark, AWKWARD), bench).collect()} == {0}
