"""Token ids of whole texts with a word-end BPE vocabulary of the tokenizers library.

Such a vocabulary lower-cases, drops white space and never joins text across a space or newline, so the
ids of a text are the ids of its pieces between spaces and newlines in turn. Pieces go through a bounded
cache. New words (Latin letters) are encoded together by one call of the library's BPE model; every other
piece by the library's full pipeline.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import use_caches

#: Entries of a worker's cache and characters of an entry: near 150 MB at most.
PIECES, CHARS = 700_000, 48
#: Latin letters without U+0130 (its lower case is two characters), then punctuation that forms one pre-token.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!\"#$%&()*+,./:;=>?@\\[\\]^_`{|}~-]*)")
#: Characters beyond the Latin blocks, and U+0130.
OTHER = re.compile("[^\\x00-\u024f]|\u0130")
#: A mark right before a comma or stop: the two are one pre-token.
MARKS = re.compile(r"[.,](?<=[\W_].)(?<=\S.)")

_ENCODERS: dict[int, "WordEncoder"] = {}


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec)
        self.bare = Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        vocab = self.full.get_vocab()
        end = json.loads(spec)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith(end)]] = True
        self.letters = {chr(b): c for b, c in enumerate(_byte_letters())}
        self.letters = str.maketrans({k: v for k, v in self.letters.items() if k != v and k != " "})
        self.pieces: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def _full(self, piece: str) -> bytes:
        return np.array(self.full.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _new_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words: joined by spaces, encoded at once and cut after each word-end token."""
        out: dict[str, bytes] = {}
        new = sorted(new, key=str.isascii)
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            line = " ".join(part)
            line = line if line.isascii() else line.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                out.update((x, self._full(x)) for x in part)
                continue
            raw, at = ids.tobytes(), 0
            for x, stop in zip(part, (stops * 4).tolist()):
                out[x] = raw[at:stop]
                at = stop
        return out

    def _new_pieces(self, new: set[str]) -> dict[str, bytes]:
        cut = {x: (m[1].lower(), m[2]) for x in new if len(x) <= CHARS and (m := SIMPLE.fullmatch(x))}
        words = self._new_words(list({w for w, _ in cut.values()}))
        out = {x: words[w] + self._mark(mark) for x, (w, mark) in cut.items()}
        out.update((x, self._full(x)) for x in new if x not in cut)
        return out

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[mark] = self._full(mark)
        return self.marks[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_pieces(t) for t in texts]
        known = self.pieces
        new: set[str] = set()
        for pieces in cut:
            new.update(x for x in pieces if x not in known)
        if len(known) + len(new) > PIECES:
            known = self.pieces = {"": b""}
            new = set().union(*cut) - {""} if cut else set()
        known.update(self._new_pieces(new))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for x in new:
            if len(x) > CHARS:
                del known[x]
        return out


def _pieces(text: str) -> list[str]:
    """Pieces whose ids, put together, are the text's.

    A text of Latin characters alone may be lower-cased first, for each of them is one character in lower
    case and composes with none; without a mark before another, commas and stops may stand apart too.
    """
    text = text.replace("\n", " ")
    if "<|" not in text and _latin(text):
        text = text.lower()
        if not MARKS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not OTHER.search(text)
    return True


def encoder(spec: str) -> WordEncoder:
    """The worker's encoder for this vocabulary (its JSON text)."""
    use_caches("wordids", _ENCODERS.clear)
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]
