"""Spoken numbers against numbers spelled out by rule."""

import random

import pytest

from parlance.functions import text

UNITS = {v: w for w, v in text.UNITS.items()}
TENS = {v: w for w, v in text.TENS.items()}


def spelled(n, joined):
    """n in words; joined: with "and" after a hundred."""
    for scale, word in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= scale:
            rest = n % scale
            link = ["and"] if joined and scale == 100 and rest else []
            return [*spelled(n // scale, joined), word, *link, *(spelled(rest, joined) if rest else [])]
    return [UNITS[n]] if n < 20 else [TENS[n // 10 * 10], *([UNITS[n % 10]] if n % 10 else [])]


def test_spelled_integers():
    r = random.Random(1)
    for n in [*range(1200), *[r.randrange(10 ** r.randint(4, 12)) for _ in range(3000)]]:
        for joined in (False, True):
            assert text.spoken_numbers(spelled(n, joined)) == [str(n)]
            assert text.spoken_numbers(["about", *spelled(n, joined), "or", "so"]) == ["about", str(n), "or", "so"]


def test_years_and_decimals():
    r = random.Random(2)
    for _ in range(500):
        late = r.randrange(10, 100)
        assert text.spoken_numbers([r.choice(["nineteen"]), *spelled(late, False)]) == [f"19{late}"]
        whole, digits = r.randrange(10**6), [r.randrange(10) for _ in range(r.randint(1, 6))]
        if whole not in (19, 20):
            assert text.spoken_numbers([*spelled(whole, False), "point", *(UNITS[d] for d in digits)]) == [f"{whole}." + "".join(map(str, digits))]


@pytest.mark.parametrize(
    "said, want",
    [
        ("a hundred people", "100 people"), ("a cat", "a cat"), ("hundred", "hundred"), ("twenty fifth", "25"), ("first", "first"),
        ("five and six", "5 and 6"), ("five six", "5 6"), ("one thousand and five", "1000 and 5"), ("two point", "2 point"),
        ("twenty twenty two", "2022"), ("twenty nine", "29"), ("a thousand two hundred", "1200"), ("and", "and"), ("", ""),
    ],
)
def test_phrases(said, want):
    assert text.spoken_numbers(said.split()) == want.split()


def test_term_hits_equal_a_plain_search():
    r = random.Random(3)
    for _ in range(100):
        ref, hyp = ([r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(2))
        terms = [" ".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(6)]
        pairs = text.alignment(ref, hyp)
        matched = {p for k, p in enumerate(pairs) if p >= 0 and ref[p] == hyp[k]}
        want = {}
        for t in terms:
            w = text.normalize_words(t)
            at = [i for i in range(len(ref) - len(w) + 1) if ref[i : i + len(w)] == w]
            if at and w:
                want[t] = (len(at), sum(all(i + d in matched for d in range(len(w))) for i in at))
        assert text.term_hits(ref, hyp, terms) == want


def test_spots_and_turns_of_words():
    ref = "so we go to the old house and the old barn".split()
    hyp = "so we go to an old house and the barn".split()
    spots = [("to", "the old", "house", 0.3), ("and", "the old", "barn", 0.9), ("", "old house", "", 0.5), ("", "new house", "", 0.5), ("so", "", "we", 0.0)]
    assert text.score_spots(ref, hyp, spots) == [(True, False), (True, False), (True, True), (False, False), (False, False)]
    r = random.Random(5)
    for _ in range(50):
        turns = [[r.choice("abcd") for _ in range(r.randint(0, 6))] for _ in range(4)]
        words = [w for t in turns for w in t]
        assert text.turns_of_words(turns, words) == [k for k, t in enumerate(turns) for _ in t]
        got = text.turns_of_words(turns, [w for w in words if r.random() < 0.8] + ["z"])
        assert [g for g in got if g >= 0] == sorted(g for g in got if g >= 0)
