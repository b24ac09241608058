import os
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clearwell.functions.storage import materialize
from clearwell.llm import resemblance, simhash
from clearwell.llm.common import arrow_map, components
from clearwell.llm.simhash import fingerprint, fingerprints, hex_mark, keep_one, links, near_copies

from .cases import AWKWARD, documents, prose


def plain_mark(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    marks = [plain_mark(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return sorted((repr(rows[i][0]), f"{marks[i]:016x}", repr(least[find(i)])) for i in range(len(rows)))


def test_equals_brute_force_on_awkward_rows(spark):
    base = prose(9, 400).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 400, 40)]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(near)] + [(90, prose(9, 400)), (91, prose(9, 400).upper())]
    got = near_copies(documents(spark, rows)).select("id", hex_mark("mark").alias("m"), "class_id").collect()
    assert sorted((repr(r.id), r.m, repr(r.class_id)) for r in got) == plain_classes(rows)


def test_links_are_all_pairs_within_three_bits(spark):
    import random

    draw = random.Random(4)
    marks = {draw.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for m in list(marks):
        for _ in range(6):
            for _ in range(draw.randint(1, 4)):
                m ^= 1 << draw.randrange(64)
            marks.add(m)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    found = links(spark.createDataFrame([(m,) for m in signed], "mark bigint")).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}


def test_one_row_of_each_class_stays(spark):
    rows = documents(spark, AWKWARD)
    kept = keep_one(rows)
    assert kept.columns == rows.columns
    got = kept.collect()
    marks = [fingerprint(r.text) for r in got]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(marks) for b in marks[:i])
    assert {repr(r.doc_id) for r in got} == {c for _, _, c in plain_classes(AWKWARD)}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert near_copies(empty).count() == 0 and keep_one(empty).count() == 0 and fingerprints(empty).count() == 0


def plain_sets(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def plain_kept(rows):
    """Smallest ids of the classes by the Jaccard index of five-word shingles."""
    sets, root = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(map(min, groups.values()))


def test_kept_rows_equal_brute_force_jaccard(spark):
    draw, rows = random.Random(8), []
    for group in range(12):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([60, 200, 500]))]
        for _ in range(8):
            words = list(base)
            for _ in range(draw.randrange(0, len(base) // 25)):  # resemblance from 0.6 to 1
                words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
            rows.append((len(rows), " ".join(words)))
    got = sorted(r.doc_id for r in keep_one(documents(spark, rows)).collect())
    assert got == plain_kept(rows) and 12 <= len(got) < 90


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_kept_documents_equal_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == plain_kept(rows)


def crowd(seed, size, words=200, changed=5):
    """Texts that differ from one text in some words each: they resemble by some 0.6."""
    draw = random.Random(seed)
    base = [f"b{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for at in draw.sample(range(words), changed):
            text[at] = f"x{draw.randrange(1 << 40)}"
        out.append(text)
    return out


def planted(seed, similarity, texts):
    """For each text one that resembles it by ``similarity`` or little more: its end is replaced."""
    draw = random.Random(seed)
    out = []
    for text in texts:
        grams = len(text) - 4
        # n grams replaced at the end: (grams - n) / (grams + n) is the Jaccard index.
        n = int(grams * (1 - similarity) / (1 + similarity))
        out.append(text[: len(text) - n] + [f"y{draw.randrange(1 << 40)}" for _ in range(n)])
    return out


def linked(spark, texts, **options):
    """The class of each text by ``keep_one``'s links."""
    docs = documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    marked = materialize(arrow_map(rows, resemblance.marks, "id bigint, digest bigint, mark bigint, minima binary"), "marked")
    mark = {r["id"]: r.mark for r in marked.collect()}
    texts_of = lambda wanted: marked.select(F.col("id").alias("i"), F.col("mark").alias("m")).join(
        rows, F.col("i") == F.col("doc_id")).join(wanted, F.col("m") == F.col("mark")).select("mark", "text")
    pairs = resemblance.resembling(marked.select("mark", "minima"), texts_of, **options).collect()
    return mark, {frozenset((r.a, r.b)) for r in pairs}


def test_recall_of_planted_copies_in_a_crowd(spark, monkeypatch):
    """Each level of resemblance by itself, among texts that share many keys but do not resemble."""
    monkeypatch.setattr(resemblance, "CROWD", 8)
    monkeypatch.setattr(resemblance, "PAIRS", 0)
    texts = crowd(1, 240)
    groups = {s: planted(i, s, texts[40 * i : 40 * i + 40]) for i, s in enumerate((0.8, 0.85, 0.9, 0.95))}
    everything = texts + [t for g in groups.values() for t in g]
    mark, found = linked(spark, everything)
    shares = {}
    for i, s in enumerate(groups):
        pairs = [frozenset((mark[40 * i + k], mark[240 + 40 * i + k])) for k in range(40)]
        shares[s] = sum(p in found for p in pairs) / 40
    print("recall by resemblance:", shares)
    assert all(share >= 0.9 for share in shares.values())
    sets = plain_sets([(0, " ".join(t)) for t in everything])
    for pair in found:
        a, b = (sets[[i for i, m in mark.items() if m == x][0]] for x in pair)
        assert len(a & b) >= 0.8 * len(a | b)


def test_pairs_of_a_crowd_are_not_formed(spark, monkeypatch):
    """Twice the crowd, some twice the candidates; ``exact`` has their square."""
    monkeypatch.setattr(resemblance, "CROWD", 8)
    monkeypatch.setattr(resemblance, "PAIRS", 0)
    kept = resemblance.materialize
    rows = {}

    def counted(df, label, with_path=False):
        out = kept(df, label, with_path)
        if label in ("star", "rest", "members"):
            rows[label] = rows.get(label, 0) + (out[0] if with_path else out).count()
        return out

    monkeypatch.setattr(resemblance, "materialize", counted)
    sizes = []
    for size in (150, 300):
        rows.clear()
        linked(spark, crowd(2, size))
        sizes.append(dict(rows))
    print(sizes)
    assert sum(sizes[1].values()) < 3 * sum(sizes[0].values())


def test_links_of_fingerprints_decide_which_row_stays(spark, monkeypatch):
    """The step has the links of ``near_copies``: texts whose fingerprints link go though their shingles
    resemble too little."""
    base = prose(9, 400).split()
    texts = [" ".join(base)] + [" ".join(w + f" x{i}" if at == i else w for at, w in enumerate(base)) for i in (50, 150, 250, 350)]
    docs = documents(spark, list(enumerate(texts)))
    classes = {r.id: r.class_id for r in near_copies(docs).collect()}
    assert len(set(classes.values())) < len(classes)
    monkeypatch.setattr(resemblance, "resembling", lambda points, *_: points.select(F.col("mark").alias("a"), F.col("mark").alias("b")).limit(0))
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(set(classes.values()))


def edited(seed, size, words=150):
    """Copies of one text with none to ten words changed: many link, many do not, and all share keys."""
    draw = random.Random(seed)
    base = [f"b{draw.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for at in draw.sample(range(words), draw.choice([0, 1, 2, 3, 4, 6, 8, 10])):
            text[at] = f"b{draw.randrange(400)}"
        out.append(text)
    return out


def test_a_crowd_of_copies_is_not_divided_again_and_again(spark, monkeypatch):
    """A point is in at most one bucket of each band, however crowded; the kept rows are brute force's."""
    kept, rows = resemblance.materialize, []

    def counted(df, label, with_path=False):
        out = kept(df, label, with_path)
        if label == "classed":
            rows.append((out[0] if with_path else out).count())
        return out

    monkeypatch.setattr(resemblance, "materialize", counted)
    # Links of fingerprints come besides.
    monkeypatch.setattr(simhash, "_print_links", lambda marked: marked.select(
        F.col("mark").alias("a"), F.col("mark").alias("b")).limit(0))
    texts = [(i, " ".join(t)) for i, t in enumerate(edited(3, 400))]
    got = sorted(r.doc_id for r in keep_one(documents(spark, texts)).collect())
    print(rows)
    assert got == plain_kept(texts)
    assert sum(rows) <= resemblance.BANDS * len(texts)


@pytest.mark.parametrize("limit", [512, 64])
def test_a_bucket_compared_by_sets_loses_no_link(monkeypatch, limit):
    """Sets that are whole give links that reach what brute force reaches; of cut ones no pair is lost."""
    monkeypatch.setattr(resemblance, "SET", limit)
    monkeypatch.setattr(resemblance, "ROWS_AT_ONCE", 7)
    sets = list({resemblance.set_mark(s): s for s in (resemblance.shingles(" ".join(t)) for t in edited(5, 120))}.values())
    # Some sets are whole beside cut ones, and some points are of one class already.
    sets += [sets[0][:50], sets[0][:45]]
    kind = [7 if i % 5 == 0 else 100 + i for i in range(len(sets))]
    bucket = pa.table({
        "key": [1] * len(sets), "mark": list(range(len(sets))), "class": kind,
        "whole": [len(s) <= limit for s in sets], "grams": pa.array([s[:limit].tobytes() for s in sets], pa.binary())})
    found = resemblance._gathered(0.8)(bucket).to_pylist()

    def index(a, b):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        return both / (len(sets[a]) + len(sets[b]) - both)

    def reached(pairs):
        root = {k: k for k in kind}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(kind[a])] = find(kind[b])
        return {frozenset(k for k in root if find(k) == find(x)) for x in root}

    true = [(a, b) for b in range(len(sets)) for a in range(b) if kind[a] != kind[b] and index(a, b) >= 0.8]
    assert true and len(true) < len(sets) * (len(sets) - 1) / 4
    assert all(r["a"] < r["b"] and kind[r["a"]] != kind[r["b"]] for r in found)
    assert all(r["sure"] == (max(len(sets[r["a"]]), len(sets[r["b"]])) <= limit) for r in found)
    assert all(index(r["a"], r["b"]) >= 0.8 for r in found if r["sure"])
    assert reached([(r["a"], r["b"]) for r in found if not r["sure"] and index(r["a"], r["b"]) >= 0.8 or r["sure"]]) == reached(true)
