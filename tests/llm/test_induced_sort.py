import random
import tracemalloc
from collections import Counter

import numpy as np

from curatrix.llm import induced_sort


def text_of(data):
    return np.r_[np.array(data, np.uint16) + 1, 0].astype(np.uint16)


def check(data, depth=10_000):
    text = text_of(data)
    order, lcp = induced_sort.suffix_order(text, 258, depth)
    raw = text.astype(">u2").tobytes()
    want = sorted(range(len(text)), key=lambda k: raw[2 * k :])
    assert order.tolist() == want
    for k in range(1, len(want)):
        a, b = text[want[k - 1] :], text[want[k] :]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        assert lcp[k] == (differ[0] if len(differ) else n)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for alphabet in (1, 2, 3, 26, 255):
        for size in (0, 1, 2, 3, 10, 200, 900):
            check([rng.randrange(alphabet) for _ in range(size)])
    check([1, 2, 3] * 150)
    check(list(range(200)) * 3)
    check(list(range(200, 0, -1)))
    base = [rng.randrange(4) for _ in range(150)]
    check(base + [9] + base + base[20:] + [7] + base)


def test_spilled_queues(monkeypatch):
    monkeypatch.setattr(induced_sort.DiskQueue.__init__, "__defaults__", (64,))
    rng = random.Random(4)
    check([rng.randrange(3) for _ in range(700)])


def test_repeated_windows():
    rng = random.Random(5)
    for window in (3, 8, 40):
        base = bytes(rng.choice(b"abc") for _ in range(120))
        spans = [base[rng.randrange(60) :][: rng.randint(window, 60)] + bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(30))) for _ in range(40)]
        counts = Counter(s[k : k + window] for s in spans for k in range(len(s) - window + 1))
        for span, got in zip(spans, induced_sort.repeated_windows(spans, window), strict=True):
            assert got.tolist() == [counts[span[k : k + window]] > 1 for k in range(len(span) - window + 1)]


def test_memory_of_a_shard():
    """Arrays go before the next ones come: 50 bytes for each byte of a shard at most."""
    rng = random.Random(5)
    base = [bytes(rng.choices(b"etaoin shrdlu", k=420)) for _ in range(200)]
    spans = [(b := rng.choice(base))[(k := rng.randrange(80)) : k + 330] + bytes(rng.choices(b"abc", k=5)) for _ in range(1500)]
    tracemalloc.start()
    try:
        twice = induced_sort.repeated_windows(spans, 250)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert any(x.any() for x in twice) and peak < 50 * sum(map(len, spans))
