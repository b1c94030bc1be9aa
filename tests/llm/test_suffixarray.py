import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.llm.suffixarray import suffix_array


def brute(symbols):
    return sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60) | st.lists(st.integers(0, 1), max_size=40) | st.lists(st.integers(0, 1000), max_size=40))
def test_matches_sorting(symbols):
    assert suffix_array(symbols) == brute(symbols)


def test_repetitive_and_structured():
    fib = [[0], [1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for symbols in ([0] * 500, [0, 1] * 300, [1, 0] * 300, fib[-1], list(range(300)), list(range(300))[::-1], [3, 1, 2] * 200 + [0]):
        assert suffix_array(symbols) == brute(symbols)


def test_grows_linearly():
    rng = random.Random(0)

    def took(n):
        half = [rng.randrange(n) for _ in range(n // 2)]
        best = []
        for _ in range(3):
            began = time.process_time()
            suffix_array(half + half)
            best.append(time.process_time() - began)
        return min(best)

    # Four times the text: about four times the time, more where a larger text no longer fits a cache; sixteen if it were quadratic.
    assert took(320_000) < 8 * took(80_000)
