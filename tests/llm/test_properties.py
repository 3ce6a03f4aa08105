"""Properties that hold for any input, on random ones."""

import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from landmesh.llm import exchange as X
from landmesh.llm import packing, substrings, warc
from landmesh.llm import words as W

P = int(W.PRIME)
TEXT = st.text(alphabet="abé \n\tc", max_size=60)


@given(st.lists(st.integers(0, P - 1), min_size=1, max_size=20), st.integers(0, P - 1))
def test_products_modulo_the_prime(values, factor):
    got = W._reduced(W.times(np.array(values, np.uint64), factor))
    assert got.tolist() == [v * factor % P for v in values]


@given(st.lists(TEXT, max_size=8), st.integers(1, 6), st.booleans())
def test_windows_are_equal_if_their_hashes_are(texts, size, whole):
    hashes, counts = W.word_hashes(*W.buffers(pa.array(texts, pa.string())), ways=2)
    split = [t.encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    got, starts, n = W.window_hashes(hashes, counts, size, whole)
    true = []
    for w in split:
        mine = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        true += mine or ([tuple(w)] if whole and w else [])
    assert n.sum() == len(true) == len(starts)
    for h in got:
        seen = {}
        assert all(seen.setdefault(x, w) == w for x, w in zip(h.tolist(), true, strict=True)) and len(seen) == len(set(true))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_messages_come_back(values):
    a = np.array(values, np.uint64)
    assert (X.unsqueeze(X.squeeze(a), len(a)) == a).all()
    s = np.sort(a)
    assert (X.unsqueeze_sorted(X.squeeze_sorted(s), len(s)) == s).all()


@given(TEXT, st.data())
def test_cutting_words_leaves_the_others(text, data):
    w = text.encode().split()
    gone = np.array(data.draw(st.lists(st.booleans(), min_size=len(w), max_size=len(w))), bool)
    left = substrings.without(text, gone)
    assert left.encode().split() == [x for x, g in zip(w, gone, strict=True) if not g]
    if not gone.any():
        assert left == text


@settings(max_examples=200)
@given(st.integers(8, 64), st.integers(1, 6), st.data())
def test_gaps_are_filled_without_overlap(capacity, n, data):
    """Whatever items a sweep puts into a run of gaps: every item once, side by side, nothing over the brim."""
    gap = data.draw(st.integers(4, capacity))
    hi = data.draw(st.integers(2, gap))
    q = packing._slots(gap, hi)
    sizes = data.draw(st.lists(st.integers(1, min(hi, gap // q)), max_size=n * q + 3))
    runs = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
    events = sorted([(gap // q, 0, 100, 0, n * q)] + [(s, 1, 0, k) for s, k in runs], key=lambda e: (-e[0], *e[1:]))
    matches, left, _ = packing.sweep(events)
    new, segments = packing.filled(100, n, gap, q, capacity, sorted((slot, k, size, rank) for size, rank, k, _, slot in matches))
    place = {}
    for size, rank, k, seq, per, offset in segments:
        for i in range(k):
            assert (size, rank + i) not in place
            place[size, rank + i] = (seq + i // per, offset + i % per * size, size)
    assert len(place) + sum(k for _, _, k in left) == len(sizes)
    room = {s: gap for s in range(100, 100 + n)}
    by = {}
    for seq, offset, size in place.values():
        by.setdefault(seq, []).append((offset, size))
        room[seq] -= size
    for parts in by.values():
        at = capacity - gap
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    told = {first + i: g for g, first, k in new for i in range(k)}
    assert told == {s: g for s, g in room.items() if g}


RECORDS = []
for _i in range(6):
    _body = hashlib.sha256(b"%d" % _i).digest() * (1 + 3 * _i)
    RECORDS.append(warc.record("response", f"urn:page:{_i}", "u", _body, hashlib.sha1(_body).hexdigest(), len(_body), None))


@settings(max_examples=150, deadline=None)
@given(st.booleans(), st.lists(st.tuples(st.integers(0, 10_000), st.binary(max_size=12), st.integers(0, 30)), max_size=4))
def test_any_damage_leaves_records_and_gaps(gzip, edits):
    """Bytes overwritten, cut out or put in anywhere: nothing raises, what comes back was written, the rest is logged."""
    data = b"".join(warc.member(r) if gzip else r for r in RECORDS)
    for at, put, cut in edits:
        at %= len(data) + 1
        data = data[:at] + put + data[at + cut :]
    rows = list(warc.salvage(data, "p"))
    whole = {f"urn:page:{i}": hashlib.sha256(b"%d" % i).digest() * (1 + 3 * i) for i in range(6)}
    good = [r for r in rows if "record_type" in r and r.get("problem") is None]
    assert all(whole.get(r["record_id"], r["payload"]) == r["payload"] for r in good)
    covered = sorted({(r["start"], r["stop"]) for r in rows if r["stop"] is not None})
    at = 0
    for a, b in covered:
        assert a <= at
        at = max(at, b)
    assert at == len(data)
    if not edits:
        assert len(good) == 6
