"""Counting quotient filter over 64-bit fingerprints, built at once from sorted values.

A fingerprint splits into a quotient (its high bits) and a remainder (the rest). Slots
hold the remainders in order of (quotient, remainder); one bit per quotient says whether
it has a run, one bit per slot whether the run ends there. A remainder seen more than
once is followed by slots that hold its count, marked by a third bit. As every remainder
is kept whole, the filter gives back exactly the fingerprints that went in, and filters
over the same range merge without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class QuotientFilter:
    quotient_bits: int
    remainder_bits: int
    occupied: np.ndarray  # bool, one per quotient
    run_end: np.ndarray  # bool, one per slot
    counter: np.ndarray  # bool, one per slot: holds digits of a count
    slots: np.ndarray  # uint64

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From distinct ascending fingerprints of ``bits`` bits and how often each occurs."""
        q_bits = min(bits - 1, max(1, int(len(values)).bit_length()))
        r_bits = bits - q_bits
        occupied = np.zeros(1 << q_bits, dtype=bool)
        quotients = (values >> np.uint64(r_bits)).astype(np.int64)
        occupied[quotients] = True
        remainders = values & np.uint64((1 << r_bits) - 1)
        digits = np.zeros(len(values), dtype=np.int64)
        rest = np.where(counts > 1, counts, 0).astype(np.uint64)
        shift = np.uint64(r_bits)
        while (more := rest > 0).any():
            digits[more] += 1
            rest = rest >> shift
        at = np.cumsum(digits + 1) - (digits + 1)
        total = int((digits + 1).sum())
        slots, counter, run_end = np.zeros(total, np.uint64), np.ones(total, bool), np.zeros(total, bool)
        slots[at], counter[at] = remainders, False
        rest = counts.astype(np.uint64)
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            slots[at[has] + 1 + k] = rest[has] & np.uint64((1 << r_bits) - 1)
            rest = rest >> shift
        last = np.append(quotients[1:] != quotients[:-1], True)[: len(values)]
        run_end[(at + digits)[last]] = True
        return cls(q_bits, r_bits, occupied, run_end, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ascending fingerprints and their counts."""
        run = np.cumsum(self.run_end) - self.run_end  # run number of each slot
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        first = np.flatnonzero(~self.counter)
        values = (quotients[run[first]] << np.uint64(self.remainder_bits)) | self.slots[first]
        counts = np.ones(len(first), dtype=np.int64)
        owner = np.cumsum(~self.counter) - 1
        places = np.flatnonzero(self.counter)
        if len(places):
            power = places - first[owner[places]] - 1
            counts[np.unique(owner[places])] = 0
            np.add.at(counts, owner[places], self.slots[places].astype(np.int64) << (power * self.remainder_bits))
        return values, counts

    def to_bytes(self) -> bytes:
        width = next(w for w in (1, 2, 4, 8) if self.remainder_bits <= 8 * w)
        head = np.array([self.quotient_bits, self.remainder_bits, len(self.slots)], dtype="<u8").tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter))
        return head + bits + self.slots.astype(f"<u{width}").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        q_bits, r_bits, n = (int(x) for x in np.frombuffer(data, "<u8", 3))
        at, parts = 24, []
        for size in (1 << q_bits, n, n):
            length = -(-size // 8)
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool))
            at += length
        width = next(w for w in (1, 2, 4, 8) if r_bits <= 8 * w)
        return cls(q_bits, r_bits, *parts, np.frombuffer(data, f"<u{width}", n, at).astype(np.uint64))


def built(fingerprints: np.ndarray, bits: int) -> QuotientFilter:
    """Filter of unsorted fingerprints."""
    values, counts = np.unique(fingerprints, return_counts=True)
    return QuotientFilter.of(values, counts, bits)


def merged(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of all filters together, by one merge of their sorted slots."""
    parts = [f.items() for f in filters]
    values = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")  # runs that are sorted already merge in linear passes
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts
