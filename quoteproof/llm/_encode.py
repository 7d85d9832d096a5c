"""Ids of the public tokenizers, with a word memo in front of the library.

Prose repeats its words, so most of the library's work is done again and again. Both JSON tokenizers cut a
text at white space before merging, so a word's ids depend on the word alone; they are asked for once and kept
in a bounded dictionary. Whatever the memo cannot prove to be independent (odd white space, special strings, letters
that become several when lower-cased) goes to the library whole, so that the ids equal
``Tokenizer.encode(text, add_special_tokens=False)``; tests/llm compares them on 100000 odd texts for each tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from ._shared import KEPT

#: Words kept in a worker's memo (some 55 MB; where case is dropped as many lower-case words again, without marks); at the bound
#: the newer half goes, since common words are met early.
MEMO_ENTRIES = 250_000
#: Longer words go to the library each time and are not kept.
MEMO_CHARS = 64

#: Without U+0130, which becomes a letter and a combining mark.
_ALPHA = "[A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ]+"
_SPLIT = re.compile(f"({_ALPHA})([.,!?;:$&%#*|()]*)")
#: Parts that are one piece for either library: letters after at most one blank, or marks.
_PLAIN = re.compile(f" ?{_ALPHA}|[.,!?;:$&%#*|()]+")
_NUL = re.compile("[\0\1]")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f\x85\u2028\u2029]")


def _visible() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: 256 + k for k, b in enumerate(rest)}


_VISIBLE = _visible()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Odd(Exception):
    """A word that the memo cannot prove to be independent of its neighbours."""


class _Memo(dict):
    """Ids by word; a missing word is made by ``make`` as it is met, and kept if it is short."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def bound(self) -> None:
        if len(self) > MEMO_ENTRIES:
            for word in list(self)[MEMO_ENTRIES // 2 :]:
                del self[word]


class MemoEncoder:
    """Little-endian uint32 ids of texts, as the tokenizers library gives them.

    ``plain``: the strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t["content"] for t in config.get("added_tokens", [])]
        self.style = self._style(config)
        self.words, self.parts = _Memo(self._spaced_word if self.style == "spaced" else self._bare_word), _Memo(self._ids)
        self.heads, self.tokenize = _Memo(self._model), self.library.model.tokenize

    @staticmethod
    def _style(config: dict) -> str:
        """'spaced': words carry their leading blank; 'bare': blanks are dropped; 'whole': no memo."""
        pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
        if config.get("post_processor") or config["model"].get("dropout") or config["model"]["type"] != "BPE":
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "spaced"
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if pre.get("type") == "Sequence" and kinds == ["NFC", "Replace", "Lowercase"]:
            first, second = pre["pretokenizers"]
            if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and not second["use_regex"]:
                return "bare"
        return "whole"

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _model(self, part: str) -> bytes:
        """Ids of a part that is one piece for the library: its model alone, without the objects around it."""
        if part.isascii():
            mapped = "\u0120" + part[1:] if part[0] == " " else part
        else:
            mapped = part.encode().decode("latin-1").translate(_VISIBLE)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _ids(self, part: str) -> bytes:
        return self._model(part) if _PLAIN.fullmatch(part) else self._library([part])[0]

    def _spaced_word(self, word: str) -> bytes:
        """Ids of a word behind a blank; one that starts the text begins with \\0, one that starts a line with \\1."""
        lead, body, first = " ", word, b""
        if word[:1] in ("\0", "\1"):
            lead, body, first = "", word[1:], self.parts["\n"] if word[0] == "\1" else b""
        if m := _SPLIT.fullmatch(body):
            head, tail = m.groups()
            # in its usual place a head is a word of its own
            ids = (self.words[head] if tail else self._model(" " + head)) if lead else self._model(head)
            return first + ids + (self.parts[tail] if tail else b"")
        if not body and word == "\0":
            return b""
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Odd
        return first + self._ids(lead + body)

    def _bare_word(self, word: str) -> bytes:
        if m := _SPLIT.fullmatch(word):
            head, tail = m.groups()
            low = head.lower()
            ids = self.heads[head if low == head else low]  # one string for both memos
            return ids + self.parts[tail] if tail else ids
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        return self._ids(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.style == "whole":
            return self._library(texts)
        self.words.bound()
        self.parts.bound()
        self.heads.bound()
        spaced, of_word, odd = self.style == "spaced", self.words.__getitem__, (_NUL if self.style == "spaced" else _ODD).search
        out: list[bytes | None] = []
        for text in texts:
            if any(s in text for s in self.special) or odd(text):
                out.append(None)
                continue
            if spaced:
                own = text.replace("\n", " \1").split(" ")
                own[0] = "\0" + own[0]
            else:
                own = text.split()
            try:
                out.append(b"".join(map(of_word, own)))
            except _Odd:
                out.append(None)
        whole = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


class PieceEncoder:
    """Little-endian uint32 ids of texts, as sentencepiece gives them, with a memo of words.

    A model in which no piece has a blank behind another character never merges over the start of a word.
    """

    BLANK = "\u2581"

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.by_word = all(self.BLANK not in p.lstrip(self.BLANK) for p in self.pieces)
        self.words = _Memo(self._ids)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        self.words.bound()
        of_word, out = self.words.__getitem__, []
        for text in texts:
            words = text.split(" ")
            alone = not self.by_word or "" in words or self.BLANK in text
            out.append(self._ids(text) if alone else b"".join(map(of_word, words)))
        return out


_ENCODERS: dict[tuple[str, bool], MemoEncoder] = KEPT.setdefault("encoders", {})
_PIECES: dict[str, PieceEncoder] = KEPT.setdefault("pieces", {})


def encoder(path: str, plain: bool = False) -> MemoEncoder:
    """One encoder for each file and worker process."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = MemoEncoder(path, plain)
    return _ENCODERS[path, plain]


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _PIECES:
        _PIECES[path] = PieceEncoder(path)
    return _PIECES[path]


def blocks(texts, most_chars: int = 1_000_000):
    """Cut a list into runs of bounded size, so that a batch of long texts stays within memory."""
    yield from _runs(map(len, texts), most_chars)


def text_blocks(column, most_bytes: int = 1_000_000):
    """(first, end, texts) of runs of bounded size of an Arrow column without nulls; only one run is made into strings."""
    import pyarrow.compute as pc

    for a, b in _runs(pc.binary_length(column).to_pylist(), most_bytes):
        yield a, b, column.slice(a, b - a).to_pylist()


def _runs(sizes, most: int):
    start = size = 0
    k = -1
    for k, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start <= k:
        yield start, k + 1
