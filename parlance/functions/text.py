"""Transcript words: normalization, alignment, differences. Plain functions, and Arrow UDFs that apply them in batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Container, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and tables.
FILLERS = frozenset("um uh uhm umm erm er hmm mm mhm ah".split())
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000}
ORDINALS = {
    "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16,
    "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30,
}
FUNCTION_WORDS = frozenset(
    """a an the and but so or to of in on at for with from by as it its it's this that these
    those i i'm you we they he she is are was were be been am do does did have has had not no yes yeah just like i've
    we're you're they're there their our your my his her them us me if then than what which who how when where really
    very kind sort mean know think well right okay oh will would can could should gonna going get got all also about up
    out""".split()
)
SUFFIXES = ("ing", "ed", "es", "s", "'s")



def _numeric(w: str) -> bool:
    return all(c.isdecimal() or c in ".," for c in w)


def split_alnum(word: str) -> list[str]:
    """Cuts at borders of digits and others; an ordinal ending after digits goes; words with an apostrophe stay."""
    if "'" in word:
        return [word]
    out: list[str] = []
    previous = None
    for m in re.finditer(r"[\d.]+|[^\d.]+", word):
        part = m[0]
        if not (previous is not None and _numeric(previous) and part in ("st", "nd", "rd", "th")):
            out.append(part)
        previous = part
    return out


# Spoken numbers are a pattern over kinds of words, a letter for each word.
_KINDS = {"a": "a", "and": "n", "point": "p", "hundred": "h"} | {w: "k" for w in SCALES if w != "hundred"} | {w: "t" for w in TENS}
_KINDS |= {w: "z" if v == 0 else "u" if v < 10 else "e" for w, v in UNITS.items()} | {w: "o" if v < 10 else "e" for w, v in ORDINALS.items()}
_VALUES = UNITS | ORDINALS | TENS | {"a": 1}
_UNDER = "(?:t[uo]?|[euo])"  # one to ninety-nine
_AND = "n(?=[teuoz])"  # said after a hundred, before more of the number
#: Zeros and a number under a hundred (or "a"), then as often as may be: hundred and what may follow it, or a larger scale.
_NUMBER = re.compile(f"(?:a(?=[hk])|z+{_UNDER}?|{_UNDER})(?:h(?:z|{_AND})*(?:{_UNDER}(?:{_AND})?)?|kz*{_UNDER}?)*")
_YEAR_END, _DECIMALS = re.compile("e|t[uo]?"), re.compile("p([zu]+)")


def _split_at(words: Sequence[str], marks: Container[str]) -> tuple[list[list[str]], list[str]]:
    """The stretches of words between marks, and the marks."""
    found = [i for i, w in enumerate(words) if w in marks]
    return [list(words[a + 1 : b]) for a, b in zip([-1, *found], [*found, len(words)])], [words[i] for i in found]


def _worth(words: Sequence[str]) -> int:
    """The value of words that _NUMBER fits."""
    parts, scales = _split_at(words, SCALES.keys() - {"hundred"})
    values = []
    for part in parts:
        pieces = [sum(_VALUES.get(w, 0) for w in piece) for piece in _split_at(part, {"hundred"})[0]]
        values.append(reduce(lambda v, more: (v or 1) * 100 + more, pieces))
    return sum((v or 1) * SCALES[s] for v, s in zip(values, scales)) + values[-1]


def spoken_numbers(words: Sequence[str]) -> list[str]:
    """words with numbers that are said in words as digits: 19 or 20 and a number from ten on are a year, digits after "point" decimals."""
    kinds = "".join(_KINDS.get(w, "-") for w in words)
    out, i = [], 0
    while i < len(words):
        number = _NUMBER.match(kinds, i)
        if number is None:
            out.append(words[i])
            i += 1
            continue
        said, i = words[i : number.end()], number.end()
        value = _worth(said)
        year = _YEAR_END.match(kinds, i) if value in (19, 20) and "k" not in number[0] else None
        decimals = _DECIMALS.match(kinds, i)
        if year:
            out.append(str(100 * value + _worth(words[i : year.end()])))
            i = year.end()
        elif decimals:
            out.append(f"{value}." + "".join(str(UNITS[w]) for w in words[i + 1 : decimals.end()]))
            i = decimals.end()
        else:
            out.append(str(value))
    return out


class _Kept(dict[int, str]):
    """A table for str.translate: letters, decimal digits and ' . , stay, all else becomes a space."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if c.isalpha() or c.isdecimal() or c in "'.," else " "
        return self[point]


_KEPT = _Kept({ord("%"): " percent "})


def normalize_words(text: str | None) -> list[str]:
    """Words for scoring: lower case, no punctuation but inner apostrophes and numbers, no fillers, numbers as digits."""
    found: list[str] = []
    for word in (text or "").lower().translate(_KEPT).split():
        word = word.strip(".,'")
        if word.isalpha():
            found.append(word)
            continue
        pieces = [word.replace(",", "")] if _numeric(word) or not re.search("[.,]", word) else re.split("[.,]", word)
        for piece in pieces:
            if piece:
                found += split_alnum(piece)
    return spoken_numbers(["okay" if w == "ok" else w for w in found if w not in FILLERS])


def text_words(text: str | None) -> list[str]:
    """Runs of letters, digits and apostrophes, lower case."""
    return re.findall(r"(?:[^\W_]|')+", (text or "").lower())


#: Rows of the table of costs that are held at once while an alignment is traced back.
BLOCK = 256


def _cost_row(equal: int, up: int, down: int, full: int) -> tuple[int, int, int, int]:
    """One row of edit costs as differences, a bit for each word of hyp (Myers 1999, Hyyrö 2003).

    Takes where the word of ref stands in hyp, and where the row before rises and falls by one along hyp. Returns where costs
    rise and fall against the row before, and where the new row rises and falls along hyp.
    """
    x = (((equal & up) + up) ^ up) | equal
    more, less = (down | ~(x | up)) & full, up & x
    shifted, v = more << 1 | 1, equal | down
    return more, less, (less << 1 | ~(v | shifted)) & full, shifted & v & full


def alignment(ref: Sequence[str], hyp: Sequence[str]) -> list[int]:
    """For each word of hyp the place in ref it is matched or substituted with, or -1: a least-edit alignment.

    Ties prefer the diagonal, then a deletion, then an insertion. Of the table of costs, a row in BLOCK is kept as bits, and the
    rows of one block are computed again when the trace gets there, so whole documents fit in memory.
    """
    n, m = len(ref), len(hyp)
    places: dict[str, int] = {}
    for j, w in enumerate(hyp):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << m) - 1
    up, down, saved = full, 0, []
    for i in range((n - 1) // BLOCK * BLOCK + 1 if n else 0):
        if i % BLOCK == 0:
            saved.append((up, down))
        _, _, up, down = _cost_row(places.get(ref[i], 0), up, down, full)
    out, i, j = [-1] * m, n, m
    while i and j:
        first = (i - 1) // BLOCK * BLOCK
        up, down = saved.pop()
        rows = []
        for w in ref[first:i]:
            more, less, next_up, next_down = _cost_row(places.get(w, 0), up, down, full)
            rows.append((up, down, more, less))
            up, down = next_up, next_down
        while i > first and j:
            up, down, more, less = rows[i - 1 - first]
            k = j - 1
            rise = more >> k & 1
            if ref[i - 1] == hyp[k] or rise - (less >> k & 1) + (up >> k & 1) - (down >> k & 1) == 1:
                i, j = i - 1, k
                out[j] = i
            elif rise:
                i -= 1
            else:
                j = k
    return out


def error_counts(ref: Sequence[str], hyp: Sequence[str]) -> dict[str, int]:
    """Words of ref, substitutions, deletions and insertions."""
    pairs = alignment(ref, hyp)
    hit = [p for p in pairs if p >= 0]
    return {"ref_words": len(ref), "substitutions": sum(ref[p] != w for p, w in zip(pairs, hyp) if p >= 0), "deletions": len(ref) - len(hit), "insertions": pairs.count(-1)}


def error_rate(c: dict[str, int]) -> float:
    edits = c["substitutions"] + c["deletions"] + c["insertions"]
    return edits / c["ref_words"] if c["ref_words"] else float(c["insertions"] > 0)


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    c = error_counts(a, b)
    return c["substitutions"] + c["deletions"] + c["insertions"]


def stem(word: str) -> str:
    """Without the first fitting ending that leaves three bytes."""
    return next((word[: -len(end)] for end in SUFFIXES if word.endswith(end) and len(word.encode()) >= len(end) + 3), word)


#: Kinds of hunks in the order in which they are tried.
HUNK_KINDS: dict[str, Callable[[Sequence[str], Sequence[str]], bool]] = {
    "long run": lambda ref, hyp: min(len(ref), len(hyp)) == 0 and max(len(ref), len(hyp)) >= 8,
    "split/join": lambda ref, hyp: "".join(ref) == "".join(hyp),
    "small words": lambda ref, hyp: FUNCTION_WORDS >= {*ref, *hyp},
    "word form": lambda ref, hyp: [*map(stem, ref)] == [*map(stem, hyp)],
    "meaningful": lambda ref, hyp: True,
}


def hunk_kind(ref: Sequence[str], hyp: Sequence[str]) -> str:
    return next(kind for kind, fits in HUNK_KINDS.items() if fits(ref, hyp))


def diff_hunks(ref: Sequence[str], hyp: Sequence[str]) -> list[dict]:
    """Maximal stretches of unequal words between equal ones: places in ref and hyp, and their kind."""
    anchors = [(p, k) for k, p in enumerate(alignment(ref, hyp)) if p >= 0 and ref[p] == hyp[k]]
    out, i, j = [], 0, 0
    for p, k in [*anchors, (len(ref), len(hyp))]:
        if p > i or k > j:
            out.append({"ref_from": i, "ref_to": p, "hyp_from": j, "hyp_to": k, "kind": hunk_kind(ref[i:p], hyp[j:k])})
        i, j = p + 1, k + 1
    return out


def locate(ref: Sequence[str], before: Sequence[str], words: Sequence[str], after: Sequence[str], share: float) -> tuple[int, int] | None:
    """Where words stands between before and after in ref, nearest to share of its length; nothing stands nowhere."""
    whole = [*before, *words, *after]
    at = [i for i in range(len(ref) - len(whole) + 1) if list(ref[i : i + len(whole)]) == whole]
    if not words or not at:
        return None
    best = min(at, key=lambda i: (abs(i - share * len(ref)), i)) + len(before)
    return best, best + len(words)


def matched_words(ref: Sequence[str], hyp: Sequence[str]) -> list[bool]:
    """For each word of ref whether the alignment matches it with an equal one."""
    out = [False] * len(ref)
    for k, p in enumerate(alignment(ref, hyp)):
        if p >= 0 and ref[p] == hyp[k]:
            out[p] = True
    return out


def score_spots(ref: Sequence[str], hyp: Sequence[str], spots: Sequence[tuple[str, str, str, float]]) -> list[tuple[bool, bool]]:
    """Per spot (text before, its words, text after, share of the length): whether ref has it, and whether hyp has all its words right."""
    right, out = matched_words(ref, hyp), []
    for before, words, after, share in spots:
        at = locate(ref, normalize_words(before), normalize_words(words), normalize_words(after), share)
        out.append((at is not None, at is not None and all(right[at[0] : at[1]])))
    return out


def turns_of_words(turns: Sequence[Sequence[str]], hyp: Sequence[str]) -> list[int]:
    """For each word of hyp the turn (by place) whose word it is matched or substituted with, or -1."""
    owner = [t for t, words in enumerate(turns) for _ in words]
    return [owner[p] if p >= 0 else -1 for p in alignment([w for words in turns for w in words], hyp)]


def term_hits(ref: Sequence[str], hyp: Sequence[str], terms: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Per term: how often its words follow each other in ref, and how often all of them are matched in hyp.

    Terms that ref has not are left out. For each length of terms, the grams of ref are looked up once.
    """
    right = np.zeros(len(ref) + 1, dtype=np.int64)
    right[[p + 1 for k, p in enumerate(alignment(ref, hyp)) if p >= 0 and ref[p] == hyp[k]]] = 1
    right = right.cumsum()
    wanted: dict[int, dict[tuple[str, ...], list[str]]] = {}
    for term in dict.fromkeys(terms):
        words = tuple(normalize_words(term))
        wanted.setdefault(len(words), {}).setdefault(words, []).append(term)
    hits = Counter[str]()
    whole = Counter[str]()
    for n, names in wanted.items():
        for i in range(len(ref) - n + 1) if n else ():
            for term in names.get(tuple(ref[i : i + n]), ()):
                hits[term] += 1
                whole[term] += int(right[i + n] - right[i] == n)
    return {term: (hits[term], whole[term]) for term in dict.fromkeys(terms) if hits[term]}


def clean_name(name: str | None, limit: int = 100) -> str:
    """White space to single spaces, unprintable characters out, at most `limit` characters."""
    text = "".join(c for c in " ".join((name or "").split()) if c.isprintable())
    return text[:limit].strip()


def spread_words(text: str, start: float, end: float) -> list[dict]:
    """Word times in proportion to length plus one, in ms steps; the last ends exactly at end."""
    words = text.split()
    total = sum(len(w) + 1 for w in words)
    out, done = [], 0
    for k, w in enumerate(words):
        a = round(start + (end - start) * done / total, 3)
        done += len(w) + 1
        b = end if k == len(words) - 1 else round(start + (end - start) * done / total, 3)
        out.append({"word": w, "start": a, "end": b})
    return out


def words_from_tokens(tokens: Sequence[str], times: Sequence[float], end: float) -> list[dict]:
    """Tokens to words: a leading space or ▁ starts one, punctuation joins the one before; a word ends where the next starts."""
    out: list[dict] = []
    for token, at in zip(tokens, times):
        new = token[:1] in (" ", "▁") or not out
        bare = token.lstrip(" ▁")
        if not bare:
            continue
        if new and not (out and all(c in ".,!?;:%)" for c in bare)):
            if out:
                out[-1]["end"] = at
            out.append({"word": bare, "start": at, "end": end})
        else:
            out[-1]["word"] += bare
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_words_udf(text: pd.Series) -> pd.Series:
    return text.map(normalize_words)


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("digest", T.StringType())]))
def words_digest_udf(text: pd.Series) -> pd.DataFrame:
    """Number of the normalized words, and the MD5 of them joined by spaces."""
    out = []
    for words in map(normalize_words, text):
        out.append((len(words), hashlib.md5(" ".join(words).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "digest"])


COUNTS = ["ref_words", "substitutions", "deletions", "insertions"]
HUNK = T.StructType([T.StructField(c, T.LongType()) for c in ("ref_from", "ref_to", "hyp_from", "hyp_to")] + [T.StructField("kind", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def error_counts_udf(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([error_counts(list(a), list(b)) for a, b in zip(ref, hyp)], columns=COUNTS)


@F.pandas_udf(T.ArrayType(HUNK))
def diff_hunks_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([diff_hunks(list(a), list(b)) for a, b in zip(ref, hyp)])


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_error_counts_udf(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """error_counts of the normalized words of two texts; a row at a time, as the words take far more memory than the texts."""
    return pd.DataFrame([error_counts(normalize_words(a), normalize_words(b)) for a, b in zip(ref, hyp)], columns=COUNTS)


@F.pandas_udf(T.ArrayType(HUNK))
def text_diff_hunks_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([diff_hunks(normalize_words(a), normalize_words(b)) for a, b in zip(ref, hyp)])


def text_words_column(text: Column) -> Column:
    """text_words as a column expression."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}']+"), lambda w: w != "")
