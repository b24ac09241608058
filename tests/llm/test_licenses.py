import re

import pytest

from clearwell.llm import licenses as lc

from .cases import AWKWARD, documents, prose


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in lc.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    return (len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({label for _, label in hits})))


ROWS = AWKWARD + [
    (20, "Licensed under CC BY-NC 4.0."), (21, "cc by cc by CC-BY all rights reserved"), (22, "GNU General Public License, version 3"),
    (23, "SPDX-License-Identifier: MIT OR Apache-2.0\ncode"), (24, "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT"),
    (25, "SPDX-License-Identifier: ((("), (26, "Released under the MIT License."), (27, "ACC BY, cc byte, rights reserved all"),
    (28, prose(1, 20_000) + " All Rights Reserved"),
]


def test_base_columns_equal_brute_force(spark):
    got = lc.scan(documents(spark, ROWS)).collect()
    assert sorted((repr(r["id"]), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(
        ((repr(i), plain(t)) for i, t in ROWS))
    by = {r["id"]: r for r in got}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert (by[23].labels, by[23].score) == ("apache-2.0,mit", 0.1)
    assert by[24].labels == "gpl-2.0-only,mit" and by[24].score == pytest.approx(0.56)
    assert by[25].labels == "unreadable" and by[26].labels == "mit" and by[27].labels == ""
    assert by[20].labels == "cc-by,cc-by-nc,cc-by-nc-4.0" and by[20].score == 0.8


@pytest.mark.parametrize("text, steps", [
    ("MIT", ["mit"]),
    ("A AND B OR C", ["a", "b", "and", "c", "or"]),
    ("A OR B AND C", ["a", "b", "c", "and", "or"]),
    ("(A OR B) AND C+", ["a", "b", "or", "c+", "and"]),
    ("A WITH E AND B", ["a", "e", "with", "b", "and"]),
    ("(A", None), ("A OR", ["a"]), ("OR A", None), ("", None), ("()", None),
    ("A)", ["a"]),
])
def test_shunting_yard(text, steps):
    assert lc.postfix(text) == steps


def test_and_binds_both_and_or_is_free():
    assert lc.evaluate(lc.postfix("GPL-3.0 OR MIT"))[1] == lc.restriction("mit")
    assert lc.evaluate(lc.postfix("GPL-3.0 AND MIT"))[1] == lc.restriction("gpl-3.0")


def test_empty_table(spark):
    assert lc.scan(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text, labels, score", [
    ("SPDX-License-Identifier: MIT -- file a; SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0-only,mit", 0.7),
    ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0-only,mit", 0.7),
    ("SPDX-License-Identifier: (" + "MIT AND " * 200 + "AGPL-3.0-only)", "agpl-3.0-only,mit", 0.8),
    ("word " * 3000 + "Licensed\nunder the Apache-2.0 or MIT; released under GPL-3.0", "apache-2.0,gpl-3.0,mit", 0.7),
    ("é SPDX License Identifier: ISC", "isc", 0.1),
    ("SPDX-License-Identifier:\nMIT\nand more", "mit", 0.1),
    ("SPDX-License-Identifier: MIT OR\ncode", "mit", 0.1),
    ("SPDX-License-Identifier: (MIT OR\n ISC)", "isc,mit", 0.1),
    ("the SPDX License Identifier is a name", "", 0.0),
])
def test_every_tag_is_read_to_its_end(spark, text, labels, score):
    row = lc.scan(documents(spark, [(1, text)])).first()
    assert (row.labels, row.score) == (labels, pytest.approx(score))


def test_many_tags_on_one_line_cost_no_square():
    text = "SPDX-License-Identifier: MIT; " * 20_000
    tags = [("spdx license identifier", 4 * i) for i in range(20_000)]
    assert lc.expressions(text, tags) == ({"mit"}, 0.1)
