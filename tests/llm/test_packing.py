import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from clearwell.llm.packing import Encoder, pack, plan, tokenizer_path

from .cases import AWKWARD, documents


def test_encoder_equals_the_tokenizer():
    known = Encoder(tokenizer_path())
    draw = random.Random(5)
    letters = list("aAbBzZ.,'’!?*-_()[]|\"#$%&;:0123 \n\té ñÑÉßİıſŉÅᾳΣςКж漢字😀́̈ﬁªº  <|") + ["<|endoftext|>", "don't", "ÀÉ", "we'll"]
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        want = known.tokenizer.encode(text, add_special_tokens=False).ids
        assert known.encode(pa.array([text, None, "x"]))[0].tolist() == want, text


def test_plan_places_every_piece_once():
    draw = random.Random(6)
    for _ in range(60):
        counts = Counter(draw.randint(1, 64) for _ in range(draw.randint(0, 400)))
        filled, ranks = Counter(), {}
        spans = {}
        for size, low, high, first, each, at in plan(dict(counts), 64):
            for rank in range(low, high):
                sequence, place = first + (rank - low) // each, at + (rank - low) % each * size
                spans.setdefault(sequence, []).append((place, place + size))
                filled[sequence] += size
                ranks.setdefault(size, []).append(rank)
        assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items()) and set(ranks) == set(counts)
        for parts in spans.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= 64
        total = sum(s * n for s, n in counts.items())
        least = max(-(-total // 64), sum(n for s, n in counts.items() if s > 32))
        assert len(filled) <= least + 2 + 0.06 * least


def test_pieces_hold_the_ids(spark):
    known = Encoder(tokenizer_path()).tokenizer
    rows = pack(documents(spark, AWKWARD), length=128).collect()
    want = Counter()
    for doc, text in AWKWARD:
        ids = np.array(known.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for number, start in enumerate(range(0, len(ids), 128)):
            piece = ids[start : start + 128]
            want[doc, number, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r["id"], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0
