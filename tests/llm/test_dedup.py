"""Exact and near duplicates against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm.components import components
from tilewright.llm.exact_dedup import exact_groups, repeated_fingerprints
from tilewright.llm.near_dedup import Settings, Sketcher, near_duplicates
from tilewright.llm.quotient_filter import QuotientFilter, built, merged


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**40 - 1) | st.integers(0, 50), max_size=80), min_size=1, max_size=4), st.sampled_from([6, 12, 40]))
def test_filters_give_back_and_merge_what_went_in(parts, bits):
    parts = [[x % (1 << bits) for x in p] for p in parts]
    filters = [QuotientFilter.from_bytes(built(np.array(p, np.uint64), bits).to_bytes()) for p in parts]
    for p, f in zip(parts, filters):
        values, counts = f.items()
        assert dict(zip(values.tolist(), counts.tolist())) == {x: p.count(x) for x in p}
    values, counts = merged(filters)
    whole = sum(parts, [])
    assert values.tolist() == sorted(set(whole)) and counts.tolist() == [whole.count(x) for x in sorted(set(whole))]


def test_large_counts_take_several_digits():
    f = QuotientFilter.of(np.array([1, 2, 5], np.uint64), np.array([1, 70_000, 3]), 4)
    values, counts = QuotientFilter.from_bytes(f.to_bytes()).items()
    assert values.tolist() == [1, 2, 5] and counts.tolist() == [1, 70_000, 3]


def test_repeated_fingerprints_for_any_slabs(spark):
    rows = spark.createDataFrame([(x,) for x in [1, -1, 1, 5, 2**63 - 1, -1, -1, -(2**63)]], "fingerprint long").repartition(3)
    for bits in (None, 1, 8):
        assert {tuple(r) for r in repeated_fingerprints(rows, slab_bits=bits).collect()} == {(1, 2), (-1, 3)}


TEXTS = [
    (5, "a b\tc"), (3, "abc "), (9, "a b c  "), (4, "abd"), (7, None), (8, ""), (2, " \x0b\x0c\r\n"), (1, "a bc"),
    (None, "ABC"), (6, "AB C"), (None, "abd"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "é e"), (14, "e é"), (14, "e é"),
]


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for plain, members in groups.items():
        named = [m for m in members if m[0] is not None]
        keep = None
        if named:
            longest = max(len(t) for _, t in members)
            top = [m for m in members if len(m[1]) == longest]
            keep = min((i for i, _ in top if i is not None), default=None)
        for i, _ in members:
            out.append((i, keep, len(members), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def test_exact_groups_against_brute_force(table):
    got = exact_groups(table(TEXTS, "doc_id", "text")).drop("code").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(exact_brute(TEXTS), key=key)


def test_exact_groups_of_nothing(table):
    assert exact_groups(table([], "doc_id", "text")).drop("code").collect() == []


def test_exact_groups_when_fingerprints_collide(table, monkeypatch):
    from tilewright.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a "), (4, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(table(rows, "doc_id", "text")).drop("code").collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(None, 1), (2, None), (9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def near_brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def family(rng, start, n, length, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(length)] = f"v{rng.randrange(10_000)}"
        rows.append((start + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("words", "block"), [(2, 512), (2, 16), (5, 512)])
def test_near_duplicates_against_brute_force(table, words, block):
    rng = random.Random(words)
    rows = family(rng, 100, 70, 60, 9) + family(rng, 300, 20, 200, 12) + family(rng, 500, 3, 12, 2)
    rows += [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "One two"), (7, "one two"), (8, "one two three"), (9, "k " * 30_000)]
    got = near_duplicates(table(rows, "doc_id", "text"), Settings(words=words, block=block)).drop("code").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near_brute(rows, words)
    assert len(got) == len(rows)


def test_near_duplicates_of_nothing_and_of_null_ids(table):
    assert near_duplicates(table([], "doc_id", "text")).drop("code").collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(table(rows, "doc_id", "text")).drop("code").collect())
    assert got == [(0, None, False), (0, None, False), (3, 3, True), (3, 3, True)]


def test_estimates_are_close_to_similarities():
    sk = Sketcher(Settings())
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8, 1.0):
        errors = []
        for _ in range(40):
            common = rng.integers(0, 2**63, int(600 * share)).astype(np.uint64)
            rest = rng.integers(0, 2**63, (2, 600 - len(common))).astype(np.uint64)
            a, b = (np.unique(np.concatenate([common, r])) for r in rest)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(sk.similarity(sk.packed(sk.minima(a)), sk.packed(sk.minima(b))[None])[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
