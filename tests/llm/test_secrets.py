import hashlib
import random
import re
import time

from clearwell.llm.secrets import KINDS, candidates, ownership, scan

from .cases import AWKWARD, documents


def plain(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_plain_searches(spark):
    draw = random.Random(3)
    pieces = ["token", "secret", "=", ":", " ", "'", '"', "abc", "abcdef12", "AKIA", "ABCDEFGHIJ012345", "deadbeef" * 3, "é", "😀", "\n", "Api_Key", "x", "-"]
    rows = AWKWARD + [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))) for i in range(100, 1500)]
    got = scan(documents(spark, rows)).collect()
    assert sorted((repr(r["id"]), r.base) for r in got) == sorted((repr(i), plain(t or "")) for i, t in rows)
    for r in got:
        base = list(filter(None, r.base.split(",")))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in KINDS[:3]]
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_copied_examples_are_no_live_keys(spark):
    own, copied = "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7", "ghp_zY9xW7vU5tS3rQ1pO9nM7lK5"
    rows = [(1, f"key {own}", "a", 1), (2, f"key {own} {own}", "a", 1), *((i, f"see {copied}", f"o{i}", 1) for i in range(3, 9)),
            (9, f"see {copied}", None, 1), (10, "ghp_" + "a" * 30, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, owner int")
    got = {r["id"]: r for r in scan(docs).collect()}
    assert got[1].spans == f"key:4:{4 + len(own)}" and got[2].n_live == 2
    assert all(got[i].spans == "" and got[i].n_example == 1 for i in range(3, 10))
    assert got[10].n_live == 0 and got[10].n_example == 0  # not random


def test_both_counts_tell_examples(spark):
    shared, own, rare = "ghp_zY9xW7vU5tS3rQ1pO9nM7lK5", "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7", "ghp_qW2eR4tY6uI8oP0aS1dF3gH5"
    rows = [(i, f"see {shared}", f"o{i % 2}") for i in range(40)]  # two owners, many repositories
    rows += [(100 + i, f"mine {own}", "o0") for i in range(40)]  # one owner
    rows += [(200 + i, f"both {rare}", f"o{i}") for i in range(2)]  # two owners, few repositories
    got = scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert all((r.n_live, r.n_example) == ((0, 1) if r["id"] < 100 else (1, 0)) for r in got)


def test_ownership_counts_equal_plain_ones(spark):
    draw = random.Random(6)
    keys = ["ghp_" + "".join(draw.choice("abcdefghijkLMNOP0123456789") for _ in range(30)) for _ in range(12)]
    rows = [(draw.choice([1, 2, 3, 4, 5, None]), " ".join(draw.choices(keys, k=draw.randint(0, 3))), draw.choice(["a", "b", None])) for _ in range(200)]
    found = candidates(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source", "doc_id")
    got = {r.hash: (r.owners, r.repositories) for r in ownership(found).collect()}
    want = {}
    for doc, text, source in rows:
        for key in set(text.split()):
            want.setdefault(hashlib.sha256(key.encode()).hexdigest(), set()).add((source, doc))
    plain_counts = {h: (len({s for s, _ in v}), len(v)) for h, v in want.items()}
    assert {h: n for h, n in got.items() if h in plain_counts} == plain_counts


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"{i:032x}" for i in range(64_000)) + " é " + "deadbeef" * 4
    start = time.time()
    row = scan(spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string")).first()
    assert row.n_hex == 64_001 and row.base == plain(text)
    assert time.time() - start < 60


def test_empty_table(spark):
    assert scan(documents(spark, [])).count() == 0


def test_main_path_has_no_python(spark):
    plan = scan(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
