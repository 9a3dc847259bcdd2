"""Long repeats, importance resampling and tokenizer alignment against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tilewright.llm.alignment import FIRST, SECOND, Aligner, aligned, shared_cuts
from tilewright.llm.importance import Settings as ImportanceSettings
from tilewright.llm.importance import bracket, resampled
from tilewright.llm.substring_dedup import Parser, Settings, long_repeats

DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- long repeats


def repeats_brute(rows, w=13):
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    least = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - w + 1):
                key = tuple(ws[k : k + w])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - w + 1):
            if i is not None and least[tuple(ws[k : k + w])] < i:
                gone |= set(range(k, k + w))
        out.append((i, len(ws), len(gone), sha(" ".join(x for k, x in enumerate(ws) if k not in gone))))
    return sorted(out, key=repr)


def noisy_texts(seed, count, letters):
    """Random texts with passages of each other, long runs, and edges."""
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(len(other) + 1)
                at = rng.randrange(len(words) + 1)
                words[at:at] = other[a : a + rng.randrange(1, 40)]
        if rng.random() < 0.2:
            words[0:0] = [rng.choice(letters)] * rng.randrange(1, 40)
        texts.append(words)
    return texts


@pytest.mark.parametrize("letters", [["a"], ["a", "b"], list("abcdefgh"), [f"w{k}" for k in range(500)]])
@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_equal_windows_choose_equal_names(letters, rounds):
    p = Parser(Settings(rounds=rounds))
    chosen = {}
    texts = noisy_texts(len(letters), 150, letters)
    for part in (texts[:1], texts[1:40], texts[40:], [[], *texts[3:5], []]):
        found = p.choices(p.words([" \n".join(t).encode() + b"\t" * (len(t) % 3) for t in part]))
        assert [len(x) for x in found] == [max(0, len(t) - 12) for t in part]
        for words, names in zip(part, found):
            for k, name in enumerate(names.tolist()):
                assert chosen.setdefault(tuple(words[k : k + 13]), name) == name


def test_few_names_for_long_texts():
    rng = random.Random(1)
    p = Parser(Settings())
    names = p.choices(p.words([" ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)).encode()]))[0]
    assert len(np.unique(names)) < 0.25 * len(names)


def test_fingerprints_tell_words_apart():
    p = Parser(Settings())
    words = sorted({w for n in range(1, 4) for w in map("".join, itertools.product("ab\x00é", repeat=n))} | {"a" * n for n in range(1, 6000, 7)})
    for table in (0, 1):
        found = p.words([" ".join(words).encode()], table).hashes
        assert len(set(found.tolist())) == len(words)
        assert (p.words([w.encode() for w in words], table).hashes == found).all()


def test_repeats_of_random_texts(table):
    for letters in (["a", "b"], list("abcdefgh"), [f"w{k}" for k in range(300)]):
        texts = noisy_texts(7, 60, letters)
        rows = [(k // 2 if k % 7 == 0 else k, " ".join(t)) for k, t in enumerate(texts)]
        rows += [(None, rows[3][1]), (900, None), (901, ""), (902, " \t\n"), (5, rows[5][1]), (5, rows[9][1]), (903, rows[9][1].replace(" ", "\n"))]
        rows.append((904, " ".join(["é x", "\x1c"] * 20)))
        rows.append((905, rows[-1][1]))
        assert rows_of(long_repeats(table(rows, "doc_id", "text"))) == repeats_brute(rows)


def test_repeats_of_the_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = repeats_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(long_repeats(docs)) == want
    assert sum(r[2] for r in want) > 500


def test_repeats_of_no_documents(table):
    assert long_repeats(table([], "doc_id", "text")).collect() == []


def test_long_copies_and_a_word_everywhere(table):
    long = " ".join(f"x{k % 977}" for k in range(30_000))
    rows = [(k, long if k % 3 == 0 else "the " * (10 + k) + f"u{k}") for k in range(40)]
    assert rows_of(long_repeats(table(rows, "doc_id", "text"))) == repeats_brute(rows)


# --- importance resampling


def resampled_brute(docs, target, s=ImportanceSettings()):
    def features(text):
        return [zlib.crc32(w.encode()) % s.buckets for w in LETTER.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]

    held = [(i, features(t)) for i, t in docs]
    source, goal = Counter(b for _, f in held for b in f), Counter(b for (t,) in target for b in features(t))
    big_s, big_t = sum(source.values()), sum(goal.values())
    rows = []
    for i, f in held:
        gain = [math.floor(1000 * math.log((goal[b] + 1) * (big_s + s.buckets) / ((source[b] + 1) * (big_t + s.buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    k = s.percent * len(able) // 100
    return sorted([(*r, None) for r in able[k:] + [r for r in rows if r[1] < s.least_words]] + [(*r, n + 1) for n, r in enumerate(able[:k])], key=repr)


def test_resampling_of_the_documents(spark):
    docs, target = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.text,) for r in target.collect()])
    assert rows_of(resampled(docs, target)) == want


def test_resampling_with_ties_nulls_and_repeated_rows(table, spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aBcdéf") for _ in range(rng.choice((0, 5, 19, 20, 40)))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, "a " * 30)] * 40 + [(None, "b " * 25)] * 9 + [(300, None), (301, ""), (302, "\x7f--")]
    target = [(1, "a a c"), (2, None)]
    got = rows_of(resampled(table(rows, "doc_id", "text"), table(target, "item_id", "text")))
    assert got == resampled_brute(rows, [(t,) for _, t in target])


def test_resampling_of_empty_tables(table):
    none = table([], "doc_id", "text")
    assert resampled(none, none).collect() == []
    got = rows_of(resampled(table([(1, "a " * 30)] * 10, "doc_id", "text"), none))
    assert got == resampled_brute([(1, "a " * 30)] * 10, [])


def test_a_bracket_that_misses_is_widened(spark):
    scores = spark.range(3000).selectExpr("id as doc_id", "id % 7 as score", "20L as n_features")
    low, high, over = bracket(scores, 300, 3000, 20)
    assert low <= 6 <= high and over < 300


# --- tokenizer alignment


@pytest.fixture(scope="module")
def make():
    return Aligner(FIRST, SECOND)


def aligned_brute(rows, make):
    found = []
    for i, text in rows:
        sides = make.encoded(text) if text else None
        if sides is None:
            found.append((i, 0, 0, 0, [], ""))
            continue
        a, b, ends_a, ends_b = (x.tolist() for x in sides)
        links = [
            (x, y)
            for k, x in enumerate(a)
            for m, y in enumerate(b)
            if max(ends_a[k - 1] if k else 0, ends_b[m - 1] if m else 0) < min(ends_a[k], ends_b[m])
        ]
        groups, i_a, i_b = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(f"{','.join(map(str, a[i_a:k]))}|{','.join(map(str, b[i_b:m]))}")
            i_a, i_b = k, m
        found.append((i, len(a), len(b), len(groups), links, sha(";".join(groups))))
    counts = Counter(p for r in found for p in set(r[4]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        ((i, n_a, n_b, n_g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), s) for i, n_a, n_b, n_g, ls, s in found),
        key=repr,
    )


ODD = ["", None, " ", "  a  b ", "a▁b", "▁", "<|endoftext|> x <0x41> <s>", "tab\tline\nend ", "é é ﬁ 漢字かな 😀👩‍👩‍👧", "\x00 \x1c y", "it's we'll  100 %", "　x   y", "a" * 5000, "x " + " " * 3000 + "y", "a b " * 300, "\n\n \n x", "ab̀ çd"]


def test_alignment_of_odd_texts(table, make):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "it's we'll  100 %"), (None, "hello world"), (None, None)]
    want = aligned_brute(rows, make)
    docs = table(rows, "doc_id", "text")
    assert rows_of(aligned(docs)) == want
    assert rows_of(aligned(docs, hot_pairs=20)) == want  # most pairs meet their counts in a join
    assert rows_of(aligned(docs, hot_pairs=0)) == want


def test_alignment_of_the_documents(spark, make):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) < 3000")
    assert rows_of(aligned(docs)) == aligned_brute([(r.doc_id, r.text) for r in docs.collect()], make)


def test_alignment_of_no_documents(table):
    assert aligned(table([], "doc_id", "text")).collect() == []


def test_the_quick_encoder_gives_the_ids_of_the_library(make):
    assert make.quick
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1 " for c in chars[k : k + 97]) for k in range(0, len(chars), 97)]
    rng = random.Random(5)
    alphabet = ["a", "B", "the", "ing", "é", "漢", " ", " ", " ", "  ", "\n", "\t", "'s", "!", "12", "-", "😀", "\u0301", "\xa0", "_", "\u200b", "<s>", "ß", "'LL", "\x1c", "\x85"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for text in texts:
        assert make.quick.encode_ordinary(text) == make.a.encode(text, add_special_tokens=False).ids, text


def test_shared_cuts_are_the_common_ends():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randrange(1, 900)
        one = sorted({n, *(k for k in range(1, n) if rng.random() < rng.choice((0.1, 0.6)))})
        two = sorted({n, *(k for k in range(1, n) if rng.random() < rng.choice((0.1, 0.6)))})
        assert shared_cuts(np.array(one), np.array(two)).tolist() == sorted(set(one) & set(two))
    assert len(shared_cuts(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    even, odd = np.arange(2, 200_001, 2), np.array([*range(1, 200_000, 2), 200_000])
    assert shared_cuts(even, odd).tolist() == [200_000]
    late = np.array([*range(1, 190_000, 2), *range(190_000, 200_001)])
    assert shared_cuts(even, late).tolist() == list(range(190_000, 200_001, 2))
