"""Token ids of whole texts, by the tokenizers library, with a memo of words.

A byte-level vocabulary cuts a text into words before it merges, and a word never starts after a space. So a text may
be cut before every space that follows a non-space character; the pieces are encoded by the library once and then
looked up. A text that holds a special token's string, or another kind of tokenizer, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a worker's memo (about 150 bytes each), and the longest word kept there.
MEMO = 500_000
LONGEST = 80

_LOOSE = re.compile(r"\s[ \n]|\n\s")
_LOOSE_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|\n[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A piece of these letters, then marks: one word and one run of marks for every byte-level cut.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?|$%&*#"


def tokenizer_spec(path: str | None) -> str:
    """The tokenizer's JSON; read on the driver and broadcast, so that executors need no file. Default: byte_bpe_50k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


class Encoder(dict):
    """Piece (after its space, or from its line's end on) -> ids."""

    def __init__(self, spec: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_str(spec)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.splits = self.tok.normalizer is None and str(self.tok.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False")
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.memo, self.marks = memo, {}
        if self.splits:  # the library's letter for a byte of a Latin-1 letter or a space
            shown = lambda x: self.tok.pre_tokenizer.pre_tokenize_str(x)[0][0]
            self.space = shown(" a")[0]
            self.letters = {0xC3: shown("À")[0]} | {c - 0x40: shown(chr(c))[1] for c in range(0xC0, 0x100)}

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def encode(self, text: str) -> bytes:
        """The ids as integers of ``width`` bytes."""
        if not self.splits or any(s in text for s in self.special):
            return self._library(text)
        if not _LOOSE.search(text):
            first, *rest = text.replace("\n", " \n").split(" ")
        else:
            first, rest, part = None, [], None
            for x in text.split(" "):
                if part is None:
                    part = x
                elif not part or part[-1].isspace() or x[:1] == "\n":
                    part = f"{part} {x}"
                else:
                    first, part = (part if first is None else (rest.append(part), first)[1]), x
            first = part if first is None else (rest.append(part), first)[1]
        if len(self) > self.memo:
            self.clear()
        return self._library(first) + b"".join(map(self.__getitem__, rest))

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none). Words are told apart once for all texts, so keep the texts to some MB."""
        kind = np.dtype(f"<u{self.width}")
        texts = pc.fill_null(texts, "")
        plain = self.splits and not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)
        loose = pc.match_substring_regex(texts, _LOOSE_RE2).to_numpy(zero_copy_only=False) if plain else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(loose):
            out[i] = np.frombuffer(self.encode(texts[int(i)].as_py()), kind)
        tight = np.flatnonzero(~loose)
        if not tight.size:
            return out
        if len(self) > self.memo:
            self.clear()
        pieces = pc.split_pattern(pc.replace_substring(texts.take(pa.array(tight)), "\n", " \n"), " ")
        ends = pieces.offsets.to_numpy()
        ends, flat = ends - ends[0], pieces.flatten()
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy().copy()
        ids = [self[x] for x in coded.dictionary.to_pylist()]
        which[ends[:-1]] = np.arange(len(ids), len(ids) + tight.size)
        ids += [self._library(x) for x in flat.take(pa.array(ends[:-1])).to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        pool, start = np.frombuffer(b"".join(ids), kind), np.cumsum(size) - size
        n = size[which]
        after = np.cumsum(n)
        all_ids = pool[np.repeat(start[which] - (after - n), n) + np.arange(after[-1])]
        for i, x in zip(tight, np.split(all_ids, after[ends[1:-1] - 1]), strict=True):
            out[i] = x
        return out

    def __missing__(self, x: str) -> bytes:
        core = x.rstrip(_MARKS)
        line = core[:1] == "\n"
        if not _LATIN.fullmatch(core, line):
            ids = self._library(x if line else f" {x}")
        elif core is not x and len(core) < len(x):
            ids = self[core] + self._mark(x[len(core) :])
        elif line:
            ids = self._mark("\n") + self._word("", core[1:])
        else:
            ids = self._word(self.space, core)
        if len(x) <= LONGEST:
            self[x] = ids
        return ids

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._library(marks)
        return self.marks[marks]

    def _word(self, space: str, word: str) -> bytes:
        """Ids of one word by the library's model, which has a letter for each byte."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(space + word)]).tobytes()


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """One for a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(spec)
