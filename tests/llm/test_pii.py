import random
import re

import numpy as np

from clearwell.llm import pii

from .cases import AWKWARD, documents, prose


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns_equal_plain_searches():
    draw = random.Random(1)
    letters = "aA1.@-+ ()%9 2550.x_é😀\n"
    for _ in range(6000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_cost_no_square():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "@" * 300_000):
        assert pii.base_spans(text) == [] or "1" in text
        pii.other_candidates(text, pii.base_spans(text))


def rows():
    mail, phone = "jo.smith@mail.example.com", "+1 (017) 555-7713"
    return AWKWARD + [
        (20, f"write {mail} or call {phone} today"), (21, f"call {phone} now; later (017) 555-7713 again, and 017 555 7713"),
        (22, "card 4929348385146306 and 4929 3483 8514 6306, host 10.0.255.1 and 10.0.256.1"),
        (23, "numbers 1234567890123456 99 2024-01-01"), (24, mail * 3), (25, "😀 é " + mail),
    ]


def test_finds_and_linked_tokens(spark):
    docs = documents(spark, rows())
    model = pii.fit(docs)
    got = pii.find(docs, model).collect()
    texts = sorted((repr(i), t or "") for i, t in rows())
    assert len(got) == len(texts)
    want = sorted((i, pii._listed(plain(t)), tuple(sum(s[1] == k for s in plain(t)) for k in range(4))) for i, t in texts)
    assert sorted((repr(r["id"]), r.base, (r.n_email, r.n_ip, r.n_card, r.n_phone)) for r in got) == want
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    by = {r["id"]: r for r in got}
    assert by[21].n_added >= 1 and all(s.startswith("phone:") for s in by[21].spans.split(","))
    assert by[23].n_added == 0 and by[6].spans == ""


def test_messages_equal_exact_sums_on_a_tree():
    graph = pii.Graph()
    text = "call +1 (017) 555-7713 or (017) 555-7713 or 017 555 7713"
    base = pii.base_spans(text)
    graph.add(0, text, base, pii.other_candidates(text, base))
    graph.chain = []  # skip edges alone make a path here
    graph.skips = [(0, 1), (1, 2)]
    model = (np.random.default_rng(1).normal(0, 1, (pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 1.5)
    own = np.array([model[0][f].sum(axis=0) for f in graph.features])
    own[:, 0] += pii.CAUTION
    own[0] = -50
    own[0, graph.labels[0]] = 0
    skip = np.exp(np.eye(pii.LABELS) * 1.5)
    joint = np.einsum("a,b,c,ab,bc->abc", *np.exp(own), skip, skip)
    want = [joint.sum(axis=ax) / joint.sum() for ax in ((1, 2), (0, 2), (0, 1))]
    assert np.allclose(pii.marginals(graph, model, rounds=60), want, atol=1e-6)


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, rows())
    out = pii.redact(docs, pii.fit(docs))
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[20] == "write [email] or call [phone] today" and by[1] is None and by[6] == prose(3, 30_000)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert pii.find(docs, pii.fit(docs)).count() == 0 and pii.redact(docs, pii.fit(docs)).count() == 0


def tokens(text):
    return [text[a:b] for a, b in pii.other_candidates(text, pii.base_spans(text))]


def test_long_runs_are_cut_into_numbers():
    assert tokens("4929 3483 8514 6306 4111 1111 1111 1111") == ["4929 3483 8514 6306", "4111 1111 1111 1111"]
    assert tokens("017 555 7713 018 555 7714") == ["017 555 7713", "018 555 7714"]
    assert tokens("call (017) 555-7713 (018) 555-7714.") == ["(017) 555-7713", "(018) 555-7714"]
    assert tokens("4111 1111 1111 1111 017 555 7713") == ["4111 1111 1111 1111", "017 555 7713"]
    assert tokens("017 555 7713 018 555 7714 019 555 7715") == ["017 555 7713", "018 555 7714", "019 555 7715"]
    assert tokens("1" * 40) == ["1" * 40]


def test_what_lies_beside_a_find_is_a_candidate():
    assert tokens("4111 1111 1111 1111 (017) 555-7713") == ["(017) 555-7713"]
    assert tokens("(017) 555-7713 (4111 1111 1111 1111") == ["(017) 555-7713"]


def test_every_digit_group_of_a_run_is_in_a_candidate_or_find():
    draw = random.Random(6)
    for _ in range(3000):
        text = "".join(draw.choice("0123456789 ().-") for _ in range(draw.randint(7, 70)))
        base = pii.base_spans(text)
        spans = [(a, b) for a, _, b in base] + pii.other_candidates(text, base)
        for m in pii._ALIKE.finditer(text):
            for g in re.finditer("[0-9]+", m.group()):
                assert all(any(a <= m.start() + i < b for a, b in spans) for i in range(*g.span())), (text, g)
    text = "12 345." * 20_000
    assert pii.other_candidates(text, [])


def test_a_clear_find_labels_every_copy():
    clear, unclear = "+1 (017) 555-7713", "017 555 7713"
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    model = (weights, np.zeros((pii.LABELS, pii.LABELS)), 4.0)
    for copies in (1, 3, 20, 60):
        for order in (1, -1):
            text = " and some more words between the two, so that no chain runs ".join([clear, *[unclear] * copies][::order])
            graph, base = pii.Graph(), pii.base_spans(text)
            graph.add(0, text, base, pii.other_candidates(text, base))
            assert len(graph.spans) == copies + 1 and len(graph.skips) <= 4 * (copies + 1)
            p = pii.marginals(graph, model)
            assert (p[:, 4] > pii.NEW_TOKEN).all(), (copies, p)
    # Without a clear find, copies alone are none.
    text = " then ".join([unclear] * 30)
    graph = pii.Graph()
    graph.add(0, text, [], pii.other_candidates(text, []))
    assert (pii.marginals(graph, model)[:, 1:] < pii.NEW_TOKEN).all()
