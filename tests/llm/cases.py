"""Awkward inputs that every operator meets."""

import random

WORDS = "the of and in to tion ing ent alpha beta gamma delta river stone Größe niño élan x1 42".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", "."]) for _ in range(n))


# Columns that clash with the names the operators use inside.
EXTRA = {"id": 7, "mark": "m", "hash": 1.5, "hits": "h", "rank": 3, "group": "g", "spans": None, "score": 0.1, "length": "l", "item": 2}


def documents(spark, rows, text_type="string"):
    """(doc_id, text) with the clashing columns beside."""
    names = list(EXTRA)
    schema = f"doc_id bigint, text {text_type}, lang string, source string, n_chars bigint, id int, mark string, hash double, hits string, rank int, `group` string, spans string, score double, length string, item int"
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) + tuple(EXTRA[n] for n in names) for i, t in rows]
    return spark.createDataFrame(data, schema)


AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, prose(1, 60)), (4, prose(1, 60)), (5, prose(1, 60)), (None, prose(2, 30)),
    (None, None), (6, prose(3, 30_000)), (7, "!!! ### 😀 …"), (8, "one"), (9, prose(4, 12)), (4, prose(5, 9)),
]
