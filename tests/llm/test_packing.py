"""Token ids, configuration program and packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import empty_documents, odd_documents

from foldframe.llm import packing
from foldframe.llm.common import table


def reference_ids(text):
    ids = packing._tokenizer(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids
    return [*ids, 0]


ODD = ["a\x1cb c\x85d e f", "é x", "<|endoftext|> x <|startoftext|>y", "<|ENDOFTEXT|>, a. B, c.", "ΑΣ ΣΑΣ.", "don't can 't CAN'T, x'S.",
       "ﬁ ① ½ 𝒳", "x　y z", "Été, Æ. ß. ñ, ×. ÷,", "é.́ a.́", "a.. b., c. d", "1. 2,", "I. 's. 't,", "É.", "straße ÿ÷ø naïve ×x", "́a ." "a" * 500, ""]


@pytest.mark.parametrize("memo", [3, 100_000])
def test_ids_equal_the_tokenizer(spark, memo):
    texts = [*ODD, *(r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect())]
    own = packing.TokenIds(packing.default_tokenizer(), memo_parts=memo, memo_bytes=8)
    for text, ids in zip(texts, own(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)[:-1]


@pytest.mark.parametrize("lengths", [[], [1], [64], [64] * 50, [1] * 1000, [33] * 7 + [31] * 7 + [1], "random", "many"])
def test_plan_holds_every_piece_once(lengths):
    rng = random.Random(1)
    if lengths == "random":
        lengths = [rng.randint(1, 64) for _ in range(500)]
    if lengths == "many":
        lengths = [min(64, int(rng.expovariate(0.06)) + 1) for _ in range(20000)]
    plan = packing.plan_sequences(Counter(lengths), 64)
    held = Counter()
    for pattern, n in plan:
        assert sum(x * a for x, a in pattern) <= 64 and n > 0
        for x, a in pattern:
            held[x] += a * n
    assert held == Counter(lengths)
    used, least = sum(n for _, n in plan), -(-sum(lengths) // 64)
    assert used <= 1.03 * least + 1 and used <= sum(n for _, n in packing.best_fit(Counter(lengths), 64))


def test_program_beats_best_fit_where_pieces_are_many():
    h = {28: 6000, 27: 6000, 21: 9000, 14: 4000, 9: 12000, 5: 6000}
    used = sum(n for _, n in packing.plan_sequences(h, 64))
    assert used <= sum(n for _, n in packing.best_fit(h, 64)) and used >= sum(x * n for x, n in h.items()) / 64


def check(rows, texts, capacity):
    """``texts``: (id, text) of every document, repeated ones included."""
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), nxt in zip(places, [*places[1:], (None, 0, 0)]):
        assert (nxt[1] == o + n) if nxt[0] == s else o + n <= capacity
    starts = {}
    for s, o, _ in places:
        starts.setdefault(s, o)
    assert set(starts.values()) <= {0}
    want = Counter()
    for i, t in texts:
        ids = np.array(reference_ids(t), "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_query_packs_every_piece(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op9_packing(spark, sf).collect()
    check(rows, [(d.doc_id, d.text) for d in table(spark, sf, "documents").collect()], 2048)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(packing.pack_documents(docs, capacity=100).collect(), [(d.doc_id, d.text) for d in docs.collect()], 100)
    assert packing.pack_documents(empty_documents(spark)).count() == 0
