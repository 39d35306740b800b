import numpy as np

from gridscribe.llm.common import Words
from gridscribe.llm.jaccard import shingle_sets


def twins(k):
    """Two different words of 2**k letters on which polynomial hashes modulo 2**64 agree in any base."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_long_words_that_fool_polynomials_have_different_hashes():
    for k in range(1, 13):
        a, b = twins(k)
        assert len(set(Words([a, b, f"x {a}"]).hash.tolist())) == 3


def test_equal_words_have_equal_hashes_wherever_they_stand():
    long = "q" * 300
    words = Words([f"{long} é {long}", None, "", f"é  {long}\n"])
    assert len(set(words.hash[[0, 2, 4]].tolist())) == 1 and words.hash[1] == words.hash[3]
    assert np.diff(words.first).tolist() == [3, 0, 0, 2]


def test_short_texts_are_one_shingle_and_long_words_tell_them_apart():
    a, b = twins(11)
    first, second, again = shingle_sets([f"{a} x", f"{b} x", f"{a}  x"], 5)
    assert len(first) == 1 and first != second and first == again
