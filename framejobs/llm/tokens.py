"""Token ids of whole texts with a public tokenizer, cached by pieces.

Both vocabularies cut a text into parts before merging, and no part spans the border between a visible character and
the white space behind it. A batch of texts is cut there as one array of bytes, and between plain letters, digits and
signs, so that a piece is mostly one word with its blank. Arrow finds the distinct pieces and puts their ids in place of
the pieces; only the distinct ones are looked up, and new ones are cut as the vocabulary does and encoded by the
tokenizer. The ids are those of encoding the whole text. Texts with unusual white space, where the border is not plain,
are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa

#: White space other than blank, newline, tab and carriage return, by any of the definitions in use.
UNUSUAL = re.compile("[^\\S \\n\\t\\r]|[\\x0b\\x0c\\x1c-\\x1f\\x85\u180e\u200b\u2060\ufeff]")
#: Characters that are letters, digits or neither by any definition in use; other pieces are encoded as they are.
PLAIN = re.compile("[\\x09\\x0a\\x0d\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u024f]*")
#: Fixed value: the cut of byte-level vocabularies that name none of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 300_000
BLANK, BREAK, LETTER, DIGIT, SIGN, OPEN = range(6)
C3 = 0xC3  # first byte of U+00C0 to U+00FF, all letters but the two signs below
APOSTROPHE = ord("'")


def _byte_classes() -> np.ndarray:
    """Class of every byte; pieces with an ``OPEN`` one are not cut further."""
    classes = np.full(256, SIGN, dtype=np.uint8)
    classes[:32] = classes[127] = classes[0xC0:] = OPEN
    classes[32], classes[[9, 10, 13]] = BLANK, BREAK
    classes[48:58] = DIGIT
    classes[65:91] = classes[97:123] = classes[C3] = LETTER
    classes[0x80:0xC0] = LETTER  # second bytes; those that follow another first byte than C3 are in an open piece
    return classes


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


CLASSES = _byte_classes()
LETTERS = _byte_letters()
#: A contraction of the vocabularies may begin where one of these follows an apostrophe.
CONTRACTS = np.isin(np.arange(256), list(b"stmrvldSTMRVLD"))


def _cuts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that begin at ``firsts``, in order."""
    kinds = CLASSES[data]
    second = np.flatnonzero((data == 0x97) | (data == 0xB7))  # multiplication and division sign
    kinds[second[(second > 0) & (data[second - 1] == C3)]] = OPEN
    marks = np.flatnonzero(data[:-1] == APOSTROPHE)
    kinds[marks[CONTRACTS[data[marks + 1]]]] = OPEN
    visible = kinds > BREAK
    begins = np.empty(len(data), dtype=bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins[1:] &= visible[:-1]
    lone = np.flatnonzero(kinds == BREAK)  # a single line break is a piece of its own
    lone = lone[lone + 1 < len(data)]
    lone = lone[visible[lone + 1] & (visible[lone - 1] | (lone == 0))]
    begins[lone + 1] = True
    begins[firsts] = True
    at = np.flatnonzero(begins)
    runs = ~visible[at]
    runs[np.searchsorted(at, firsts)] = True
    run = np.cumsum(runs) - 1
    closed = np.ones(run[-1] + 1, dtype=bool)
    closed[run[np.searchsorted(at, np.flatnonzero(kinds == OPEN), "right") - 1]] = False
    return at[runs | closed[run]]


def _plain_classes(pattern: str) -> str:
    """The cut in terms that mean the same for plain characters: a letter is a word character but no digit or ``_``."""
    for theirs, ours in (
        (r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"[\p{L}]", r"[^\W\d_]"), (r"[\p{N}]", r"\d"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"),
    ):
        pattern = pattern.replace(theirs, ours)
    return pattern


class Ids:
    """Encoder of one vocabulary file; a text that names one of its special tokens is encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]
        own = [s["pattern"]["Regex"] for s in steps.get("pretokenizers", []) if s["type"] == "Split"]
        self.cut = re.compile(_plain_classes(own[0] if own else BYTE_LEVEL)).findall
        self.normal = self.tokenizer.normalizer
        self.model = self.tokenizer.model
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _parts_of(self, piece: str) -> list[str]:
        if self.normal is None:
            if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()):
                return [piece]  # one word, the usual case
        else:
            piece = piece.lower() if piece.isascii() else self.normal.normalize_str(piece)
        return self.cut(piece)

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of parts as the vocabulary cuts them."""
        tokenize = self.model.tokenize
        ids, ends = [], [0]
        for part in parts:
            ids += [t.id for t in tokenize(part.encode().decode("latin-1").translate(LETTERS))]
            ends.append(4 * len(ids))
        raw = np.array(ids, dtype="<u4").tobytes()
        return [raw[s:e] for s, e in zip(ends, ends[1:])]

    def _learn(self, pieces: list[bytes], texts: list[str]) -> None:
        if len(self.parts) > CACHE_ENTRIES:
            self.parts = {}
        if len(self.pieces) + len(pieces) > CACHE_ENTRIES:  # keep what the last half of the time used
            self.older, self.pieces = self.pieces, {}
        names, single, mixed, others = [], [], [], []
        for piece, text in zip(pieces, texts):
            if not text.isascii() and PLAIN.fullmatch(text) is None:
                others.append((piece, text))
                continue
            parts = self._parts_of(text)
            if len(parts) == 1:
                names.append(piece)
                single += parts
            else:
                mixed.append((piece, parts))
        self.pieces.update(zip(names, self._merged(single)))
        new = list({x for _, parts in mixed for x in parts} - self.parts.keys())
        self.parts.update(zip(new, self._merged(new)))
        self.pieces.update([(piece, b"".join([self.parts[x] for x in parts])) for piece, parts in mixed])
        if others:
            coded = self.tokenizer.encode([text for _, text in others], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(coded.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(coded.word_ids, dtype=np.int64), np.arange(len(others) + 1)) * 4).tolist()
            self.pieces.update((piece, raw[s:e]) for (piece, _), s, e in zip(others, ends, ends[1:]))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _found(self, pieces: list[bytes]) -> list[bytes | None]:
        """Ids of distinct pieces; None for one with unusual white space."""
        found = list(map(self.pieces.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        back, new, texts = {}, [], []
        for i in missing:
            piece = pieces[i]
            known = self.older.get(piece)
            if known is not None:
                back[piece] = known
                continue
            text = piece.decode()
            if PLAIN.fullmatch(text) is not None or not UNUSUAL.search(text):
                new.append(piece)
                texts.append(text)
        if new:
            self._learn(new, texts)
        self.pieces.update(back)
        for i in missing:
            found[i] = self.pieces.get(pieces[i])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        out = [np.empty(0, dtype="<u4")] * len(texts)
        numbers, raw = [], []
        for number, text in enumerate(texts):
            if text and any(name in text for name in self.special):
                out[number] = self._whole(text)
            elif text:
                numbers.append(number)
                raw.append(text.encode())
        if not raw:
            return out
        firsts = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in raw], out=firsts[1:])
        data = b"".join(raw)
        starts = _cuts(np.frombuffer(data, dtype=np.uint8), firsts[:-1])
        bounds = np.append(starts, len(data))
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        found = self._found(coded.dictionary.to_pylist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset:ids.offset + len(ids) + 1] // 4
        values = np.frombuffer(ids.buffers()[2], dtype="<u4", count=int(ends[-1])) if ends[-1] else np.empty(0, dtype="<u4")
        begin = np.searchsorted(bounds, firsts)
        places = ends[begin].tolist()
        for number, start, end in zip(numbers, places, places[1:]):
            out[number] = values[start:end]
        if ids.null_count:
            odd = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            for i in np.unique(np.searchsorted(begin, odd, "right") - 1).tolist():
                out[numbers[i]] = self._whole(texts[numbers[i]])
        return out


_encoders: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """The worker's encoder of a vocabulary file, kept between batches."""
    if path not in _encoders:
        _encoders[path] = Ids(path)
        gc.freeze()  # what is loaded by now lives as long as the worker; the collector need not walk it again
    return _encoders[path]


def slices_of(texts: list, limit: int = 2 << 20):
    """Index ranges of about ``limit`` characters, so that working sets stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
