"""Token ids of whole texts, with each distinct word encoded once.

For tokenizers that lower case, drop white space and cut texts to runs of letters, single digits and
runs of signs (BPE over bytes with word ends). Texts are cut to words at ASCII white space, and words
once more where an ASCII sign follows an ASCII letter or digit or a letter from U+00C0 to U+00FF: pieces never reach over such a place, so
that a text's ids are its words' ids one after another. A column's words are made a dictionary in
Arrow; only distinct words reach Python, and the ids of all words are gathered in numpy.

Most words are one piece, or pieces that a pattern finds; the tokenizer's model gets them directly.
All others (letters that change when lowered or composed, other white space, control characters) go
through the whole tokenizer word by word. If a few fixed words don't come out alike both ways, all
words do. Where case or cutting could tell (strings of special tokens, combining marks U+0300 to
U+037F), the text around is neither lowered nor cut within words.

Work arrays are bounded by STEP bytes of text, however long a text is; a Words object keeps at most
2 * KEEP words of up to LONGEST bytes.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

STEP, KEEP, LONGEST = 4 << 20, 200_000, 64

#: 0 white space, 1 ASCII letters and digits, 2 ASCII signs, 3 all else
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[33:127] = 2
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The pieces of lowered ASCII words, as the tokenizer's own pattern finds them.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ODD = re.compile(r"[\x00-\x20\x7f]")
_TRIAL = ("the", "thhereth", "größe", "日本語", "été", "don't", "a1b22", "x=(3);", "...", "'s", "'", "$$$", "l'été")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_STANDS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_models: dict[str, tuple] = {}


def _pieces(word: str) -> list[str] | None:
    """The tokenizer's pieces of a word, or None where only the tokenizer can tell."""
    if word.isascii():
        return None if _ODD.search(word) or word != word.lower() else _PIECES.findall(word)
    if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
        return [word.encode().decode("latin-1").translate(_STANDS)]
    return None


def _by_pieces(model, word: str) -> list[int] | None:
    pieces = _pieces(word)
    return None if pieces is None else [t.id for p in pieces for t in model.tokenize(p)]


def tokenizer(path: str) -> tuple:
    """(tokenizer, its model, whether the model may be asked directly, its special strings)."""
    if path not in _models:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        alike = all(_by_pieces(whole.model, w) in (None, whole.encode(w, add_special_tokens=False).ids) for w in _TRIAL)
        _models[path] = (whole, whole.model, alike, [t.content.lower().encode() for t in whole.get_added_tokens_decoder().values()])
    return _models[path]


class Words:
    """The ids of words as bytes (little-endian unsigned 32-bit numbers), the latest of them kept."""

    def __init__(self, path: str):
        self.whole, self.model, self.direct, self.special = tokenizer(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, words: list[bytes], special: bool = False) -> list[bytes]:
        """special: words may hold strings of special tokens."""
        if len(self.new) > KEEP:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, words))
        ask = [i for i, ids in enumerate(out) if ids is None]
        if self.old:
            for i in ask:
                if (ids := self.old.get(words[i])) is not None:
                    out[i] = self.new[words[i]] = ids
            ask = [i for i in ask if out[i] is None]
        hard, tokenize = [], self.model.tokenize
        for i in ask:
            word = words[i]
            if not self.direct or special and any(x in word for x in self.special):
                hard.append(i)
                continue
            if word.isalpha() and word.islower():  # ASCII letters: the common case
                ids = [t.id for t in tokenize(word.decode())]
            elif (ids := _by_pieces(self.model, word.decode())) is None:
                hard.append(i)
                continue
            out[i] = array("I", ids).tobytes()
        for at in range(0, len(hard), 1000):
            some = hard[at : at + 1000]
            for i, coded in zip(some, self.whole.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
                out[i] = array("I", coded.ids).tobytes()
        self.new.update((words[i], out[i]) for i in ask if len(words[i]) <= LONGEST)
        return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of parts of about STEP bytes, at the ends of rows or at white space."""
    out, at, total = [], 0, len(data)
    while total - at > 2 * STEP:
        end = int(offsets[np.searchsorted(offsets, at + STEP, "right") - 1])
        if end <= at:  # one row is longer: end after white space
            end = at + STEP
            while True:
                gaps = np.flatnonzero(_CLASS[data[end : end + STEP]] == 0)
                if len(gaps) or end + STEP >= total:
                    break
                end += STEP
            after = end + int(gaps[0]) + 1 if len(gaps) else total
            end = min(after, int(offsets[np.searchsorted(offsets, at, "right")]))
        out.append(end)
        at = end
    return [*out, total]


def encode_rows(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one row after another, and where each row's begin (n + 1 long)."""
    counts, ids, at = np.zeros(len(offsets) - 1, dtype=np.int64), [], 0
    for end in _cuts(data, offsets):
        part = data[at:end]
        low = _LOWER[part]
        text = low.tobytes()
        plain = b"\xcc" not in text and b"\xcd" not in text and not any(x in text for x in words.special)
        kind = _CLASS[low]
        inside = kind != 0
        starts = np.empty(len(part), dtype=bool)
        starts[:1] = True
        starts[1:] = ~inside[:-1]
        if plain:
            letter = kind[:-1] == 1
            letter[1:] |= (low[:-2] == 0xC3) & (low[1:-1] != 0x97) & (low[1:-1] != 0xB7)  # U+00C0 to U+00FF without two signs
            starts[1:] |= letter & (kind[1:] == 2)
        edges = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "left")] - at
        starts[edges] = True
        starts &= inside
        begins = np.flatnonzero(starts)
        if len(begins):
            kept = np.cumsum(inside, dtype=np.int32)
            bounds = np.append(kept[begins] - 1, kept[-1]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer((low if plain else part)[inside])]).dictionary_encode()
            coded = words.of(column.dictionary.to_pylist(), special=not plain)
            which = column.indices.to_numpy()
            flat, sizes = np.frombuffer(b"".join(coded), dtype="<u4"), np.fromiter(map(len, coded), dtype=np.int32, count=len(coded)) >> 2
            first = np.cumsum(sizes, dtype=np.int32) - sizes
            many = sizes[which]
            ends = np.cumsum(many, dtype=np.int32)
            ids.append(flat[np.repeat(first[which] - (ends - many), many) + np.arange(ends[-1], dtype=np.int32)])
            upto = np.append(0, ends)[np.searchsorted(begins, np.clip(offsets - at, 0, end - at), "left")]
            counts += np.diff(upto)
        at = end
    bounds = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), bounds


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, no special tokens added."""
    from .textkit import column_bytes

    ids, bounds = encode_rows(*column_bytes(pa.array(texts, pa.large_string())), Words(path))
    return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
