"""Cutting texts into the pieces of a byte-level BPE pre-tokenizer, many documents at once, and the distinct-piece table.

The rule is the published pattern of such vocabularies: contractions; letters, digits or other signs, each
with one space before; white space, whose last character goes with what follows. It is evaluated on arrays of
character classes. Which class a character has is asked of the tokenizer file's own pre-tokenizer, the first time
the character is met, so that its Unicode version counts and not ours.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parlance.llm import textops

OTHER, LETTER, DIGIT, WHITE, BLANK, UNKNOWN = range(6)

#: Bytes of text whose pieces share one distinct-piece table.
BLOCK = 16 << 20


class Vocabulary:
    """A byte-level BPE tokenizer from the contents of its json file."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("type") != "BPE":
            raise ValueError("only byte-level BPE without normalizer and prefix space is known")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip or match whole words are not known")
        self.special = {t["content"]: t["id"] for t in added}
        self.spec = spec["model"]
        self.to_byte = self._alphabet()
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable stand-ins of bytes in such files: printable Latin-1 bytes stand for themselves, the others follow from 256."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def piece_bytes(self, token: str) -> bytes:
        return bytes(self.to_byte[c] for c in token)

    def pieces_by_id(self) -> list[bytes]:
        """The bytes of each id, special tokens included."""
        size = max([*self.spec["vocab"].values(), *self.special.values()]) + 1
        out = [b""] * size
        for token, i in self.spec["vocab"].items():
            if token not in self.special:
                out[i] = self.piece_bytes(token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    def classify(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points."""
        found = self.classes[points]
        if (found == UNKNOWN).any():
            whole = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
            for p in np.unique(points[found == UNKNOWN]).tolist():
                c = chr(p)
                self.classes[p] = BLANK if p == 32 else LETTER if whole("a" + c) else DIGIT if whole("1" + c) else OTHER if whole("!" + c) else WHITE
            found = self.classes[points]
        return found

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the pieces of data (their starts, then the end) and the n + 1 piece offsets of the documents."""
        if len(data) == 0:
            return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        doc = np.searchsorted(at, offsets)
        kind = self.classify(points)
        cut = np.zeros(len(points) + 1, dtype=bool)  # where a segment starts: nothing looks across
        cut[doc] = True
        inside = np.zeros(len(points), dtype=bool)  # within a special token
        for token in self.special:
            t, i = token.encode(), raw.find(token.encode())
            while i >= 0:
                a, b = np.searchsorted(at, (i, i + len(t)))
                if not cut[a + 1 : b].any() and not inside[a:b].any():
                    cut[a], cut[b], inside[a:b] = True, True, True
                    i = raw.find(t, i + len(t))
                else:
                    i = raw.find(t, i + 1)
        white = kind >= WHITE
        start = np.empty(len(points), dtype=bool)
        start[0] = True
        group = np.minimum(kind, WHITE)
        start[1:] = group[1:] != group[:-1]
        start |= cut[:-1]
        follows = np.flatnonzero(start[1:] & ~cut[1:-1] & white[:-1]) + 1  # first character after white space
        start[follows - 1] = True
        start[follows[kind[follows - 1] == BLANK]] = False
        quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~cut[1:-1]) if len(points) > 1 else np.zeros(0, np.int64)
        if len(quote):
            one = points[quote + 1]
            far = np.minimum(quote + 2, len(points) - 1)
            two = np.where((quote + 2 < len(points)) & ~cut[far], points[far], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            for which, n in ((short, 2), (long, 3)):
                after = quote[which] + n
                start[after[after < len(points)]] = True
        if inside.any():
            start[inside & ~cut[:-1]] = False
            start[inside & cut[:-1]] = True
        first = np.flatnonzero(start)
        return np.concatenate([at[first], at[-1:]]), np.searchsorted(first, doc)


_loaded: dict[int, Vocabulary] = {}


def load(content: bytes) -> Vocabulary:
    """The vocabulary, once a process."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def blocks(vocabulary: Vocabulary, column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """For documents [i, j): the table of their distinct pieces, each piece's place in it, the documents' piece offsets."""
    data, offsets = textops.utf8(column)
    for i, j in textops.chunks(offsets, BLOCK):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ends, counts, done, pieces = [], [np.zeros(1, np.int64)], 0, 0
        for a, b in textops.chunks(at):
            cuts, docs = vocabulary.split(part[at[a] : at[b]], at[a : b + 1] - at[a])
            ends.append((cuts[:-1] + done).astype(np.int32))
            counts.append(docs[1:] + pieces)
            done, pieces = int(at[b]), pieces + int(docs[-1])
        where = np.concatenate([*ends, np.array([len(part)], dtype=np.int32)])
        array = pa.Array.from_buffers(pa.binary(), len(where) - 1, [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(part))])
        table = array.dictionary_encode()
        yield i, j, table.dictionary, table.indices.to_numpy(), np.concatenate(counts)
