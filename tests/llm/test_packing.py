import random
from collections import Counter
from zlib import crc32

import numpy as np
from contrail.llm.packing import best_fit_packing, default_tokenizer, plan
from tokenizers import Tokenizer

from .helpers import documents


def packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in map(sorted, by.values()):
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
        assert sum(places[-1]) <= capacity
    return len(by)


def test_pieces_are_those_of_the_tokenizer(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "don't I'll  e\u0301 é\u00a0x\u2003y\x1cz <|endoftext|> <|startoftext|>a", "İstanbul ΑΣ", "日本語 テキスト", "a" * 5000, "word " * 9000]
    texts += ["".join(rng.choice("ab'sÉe\u0301 \n\t.,1<|>") for _ in range(200)) for _ in range(100)]
    tokenizer, expected = Tokenizer.from_file(default_tokenizer()), {}
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            expected[d, n] = s, len(ids[s : s + 4096]), crc32(np.array(ids[s : s + 4096], "<u4").tobytes())
    rows = best_fit_packing(documents(spark, texts), with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert all(crc32(r.ids) == r.ids_crc32 for r in rows)
    packed(rows, 4096)


def test_plan_fills_exactly_what_can_be_filled():
    assert plan({6: 1, 4: 1}, 10)[:, 3].max() == 0
    assert plan({5: 2, 3: 2, 2: 2}, 10)[:, 3].max() == 1
    assert plan({7: 1, 1: 3}, 10)[:, 3].max() == 0
    assert plan({3: 1000}, 10)[-1].tolist() == [3, 666, 333, 0, 6] or plan({3: 1000}, 10)[:, 2].sum() == 1000


def test_plan_is_close_to_the_bound_and_covers_all():
    rng = random.Random(4)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    counts[777] += 10_000
    slots = plan(dict(counts))
    for length, n in counts.items():
        own = slots[slots[:, 0] == length]
        assert own[:, 2].sum() == n and (np.diff(own[:, 1]) == own[:-1, 2]).all() and own[0, 1] == 0
    bound = -(-sum(k * n for k, n in counts.items()) // 4096)
    assert (slots[:, 3] + slots[:, 2]).max() <= bound * 1.002 + 1


def test_repeated_rows_null_ids_and_small_capacity(spark):
    docs = documents(spark, ["a b c d e"] * 6 + ["x"], ids=[None, None, 1, 1, 1, 2, 3])
    rows = best_fit_packing(docs, capacity=8).collect()
    assert len(rows) == 7 and packed(rows, 8) == 6


def test_empty_table(spark):
    assert best_fit_packing(documents(spark, ["a"]).where("false")).count() == 0
