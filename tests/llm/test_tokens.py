"""Token counts and packing against the tokenizer itself."""

import random
import time
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tilewright.llm.packing import Plan, pack
from tilewright.llm.token_counts import PrefixCounts, prefix_counts, token_counts
from tilewright.llm.tokens import Ids, tokenizer_path

TEXTS = [
    (1, "Hello, WORLD!! it's 42."), (2, None), (3, ""), (4, " \t\n"), (5, "a<|endoftext|>b <|startoftext|>"), (None, "null id"),
    (6, "naïve café… œuvre, ÉTÉ. İstanbul Σίσυφος ΟΔΟΣ. 東京都   x y"), (7, "éä ́x"), (8, "don't 'tis we'll. rock'n'roll's"),
    (9, "word " * 5000), (9, "word " * 5000), (10, "x" * 3000), (11, "(a) [b] {c} ^^^ a_b |x| 3.14%% ###tag @me <b>"), (12, "\x1c\x85 a\x00b"),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    ids = Ids("word_bpe_49k.json")
    for _, text in TEXTS:
        assert np.frombuffer(ids.of((text or "").encode()), "<u4").tolist() == library(text)


def test_ids_of_letters_that_the_normaliser_takes_apart(library):
    ids = Ids("word_bpe_49k.json")
    for text in ["TAKSİ.", "İ,", "İ'll,", "\u0958.", "क\u095f! ", "\ufb2a-", "a\ufb4e;", "\u0f43...", "ΟΔΟΣ.", "e\u0301.", "Ǆ,"]:
        assert np.frombuffer(ids.of(text.encode()), "<u4").tolist() == library(text)


def test_other_tokenizers_encode_whole_texts():
    ids = Ids("byte_bpe_50k.json")
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(ids.of(b"two  words"), "<u4").tolist() == t.encode("two  words", add_special_tokens=False).ids
    assert len(Ids("piece_bpe_32k.model").of(b"two words")) > 0


def test_counts_of_all_prefixes(library, table):
    ids = Ids("word_bpe_49k.json")
    for _, text in TEXTS[:9] + TEXTS[-2:]:
        text = (text or "")[:120]
        p, true = PrefixCounts(text, ids), [len(library(text[:k])) for k in range(len(text) + 1)]
        assert p.all().tolist() == true and [p.count(k) for k in range(len(text) + 1)] == true
        for budget in range(0, 6):
            assert p.fitting(budget) == max(k for k, n in enumerate(true) if n <= budget)
    got = {r.doc_id: r.counts for r in prefix_counts(table([(1, "a bc"), (2, None)], "doc_id", "text")).collect()}
    assert got == {1: [len(library("a bc"[:k])) for k in range(5)], 2: [0]}


LONG = [
    "東京都" * 40, "İstanbul'da!" * 9, "abcdefgh" * 20, "a1b22c333+/" * 12, "don't'll've'rex're" * 6, "!?;''s'" * 14, "가각한글" * 10,
    "ação" * 20, "x<|endoftext|>yz!<|startoftext|>!<|endof" * 3, "नमस्ते" * 14, "a\u0323\u0301\u20dd" * 20, "word\u3000\u00a0\x85b" * 12,
    "'re" * 3 + "'re\u20dd" * 20, "\u0958।" * 40, "aaaaaaaaaaaab" * 10, "TheQuickBrownFox" * 8,
]


def test_counts_of_prefixes_of_long_pieces(library):
    rng = random.Random(5)
    marks = "aAeéİ한ㅏ가'strevlm!?.1٣²\u0301\u0323\u0958東\u00a0"
    ids = Ids("word_bpe_49k.json")
    for text in LONG + [text for one in LONG for text in [unicodedata.normalize("NFD", one)]] + ["".join(rng.choices(marks, k=120)) for _ in range(60)]:
        p, true = PrefixCounts(text, ids), [len(library(text[:k])) for k in range(len(text) + 1)]
        assert p.all().tolist() == true and [p.count(k) for k in range(len(text) + 1)] == true
        for budget in (0, 1, 5, 20, true[-1] - 1):
            assert p.fitting(budget) == max(k for k, n in enumerate(true) if n <= budget)


@pytest.mark.parametrize("text", ["".join(chr(0x4E00 + k * 7919 % 20000) for k in range(350_000)), "QUJDREVG" * 131_072, "xyz" * 350_000])
def test_budget_of_a_megabyte_without_white_space(library, text):
    began = time.monotonic()
    fit = PrefixCounts(text, Ids("word_bpe_49k.json")).fitting(2048)
    assert time.monotonic() - began < 60
    assert len(library(text[:fit])) <= 2048 and all(len(library(text[: fit + k])) > 2048 for k in range(1, 60))


def test_token_counts(library, table):
    got = token_counts(table(TEXTS, "doc_id", "text")).collect()
    assert len(got) == len(TEXTS)
    want = sorted((i or 0, len((t or "").encode()), n := len(library(t)), n > 2048) for i, t in TEXTS)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert len(library(("word " * 5000)[: by[9].fit_chars])) <= 2048 < len(library(("word " * 5000)[: by[9].fit_chars + 1]))
    assert token_counts(table([], "doc_id", "text")).collect() == []


def test_packing(library, table):
    rng = random.Random(1)
    rows = TEXTS + [(100 + k, "word " * rng.choice([3, 10, 200, 690, 700, 1100, 1500])) for k in range(80)]
    got = pack(table(rows, "doc_id", "text")).collect()
    want = []
    for i, t in rows:
        ids = library(t) + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i or 0, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(table([], "doc_id", "text")).collect() == []


def fewest(lengths, capacity):
    """Least number of bins, by trying all ways."""
    best = [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted(set(range(len(bins))), key=lambda j: bins[j]):
            if bins[b] >= lengths[k]:
                bins[b] -= lengths[k]
                put(k + 1, bins)
                bins[b] += lengths[k]
        bins.append(capacity - lengths[k])
        put(k + 1, bins)
        bins.pop()

    put(0, [])
    return best[0]


def test_plans_are_complete_and_near_the_best():
    rng = random.Random(2)
    over = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = Plan(counts, 20)
        assert not +plan.left and {k: v for k, v in plan.taken.items() if v} == counts
        best = fewest(lengths, 20)
        assert best <= plan.sequences <= best + 1
        over += plan.sequences > best
        large = [x for x in lengths if 3 * x > 20]
        assert Plan({x: large.count(x) for x in set(large)}, 20).sequences == (fewest(large, 20) if large else 0)
    assert over <= 15


def test_plans_of_many_pieces_stay_small():
    plan = Plan({k: 1_000_000 + k for k in range(1, 2049)}, 2048)
    total = sum(k * (1_000_000 + k) for k in range(1, 2049))
    assert len(plan.places) < 60_000 and plan.sequences <= 1.001 * total / 2048 + 1


def test_ids_of_words_are_packed_without_an_array(monkeypatch):
    """Words of any number of ids, marks and letters of other scripts; only words of very many ids go through an array."""
    from tilewright.llm import tokens

    ids = tokens.Ids(tokens.DEFAULT_TOKENIZER)
    for text in ("Plain words, (marked)... ÄÖ é́! 中文 x_y #1 ..", "xq" * 400, "é" * 30, " \t", ""):
        assert ids.of(text.encode()) == np.array(ids.plain(text), "<u4").tobytes()

    def refused(*_, **__):
        raise AssertionError("an array for a short word")

    monkeypatch.setattr(tokens.np, "array", refused)
    assert len(ids.of(b"unseen wordlings, here.")) % 4 == 0
