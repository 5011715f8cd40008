"""Token ids of whole Arrow text columns with a file of the tokenizers library.

The tokenizer that is meant here drops white space and never joins words over a blank or a line feed, so a text's ids
are those of its words in turn. Each distinct word of a slice is encoded once; a worker keeps what it has seen in a
bounded table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._spark import kept

WORDS_KEPT = 500_000
PIECES_KEPT = 400_000
#: Of these characters lower-casing, normalisation and splitting are the same here and in the library.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The normaliser and splitter for which the shortcut for plain words holds.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, content: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.model = self.library.model
        told = json.loads(content)
        steps = told["pre_tokenizer"].get("pretokenizers", [{}])
        self.shortcut = steps[0].get("pattern", {}).get("Regex") == _SPLIT
        self.special = tuple(x["content"] for x in told["added_tokens"])
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return np.array([x.id for x in self.model.tokenize(text)], self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if self.shortcut and _PLAIN.fullmatch(word) and "<|" not in word:
            out = b""
            for piece in _PIECE.findall(word.lower()):
                got = self.pieces.get(piece)
                if got is None:
                    if len(self.pieces) >= PIECES_KEPT:
                        self.pieces.clear()
                    got = self.pieces[piece] = self._piece(piece)
                out += got
            return out
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by row); a null has none."""
        text = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), "\n", " ")
        if self.shortcut and not pc.any(pc.match_substring(text, "<|")).as_py():
            text = pc.ascii_lower(text)  # the library does so later; special tokens come before that
        split = pc.split_pattern(text, " ")
        words = split.flatten().dictionary_encode()
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        known, found = self.words, []
        for w in words.dictionary.to_pylist():
            got = known.get(w)
            if got is None:
                got = self._word(w)
                if len(w) < 64:
                    known[w] = got
            found.append(got)
        width = self.dtype.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        flat = np.frombuffer(b"".join(found), self.dtype)
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        at = words.indices.to_numpy(zero_copy_only=False)
        each = size[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        return ids, np.concatenate(([0], ends))[offsets]


def tokenizer(content: str) -> WordTokenizer:
    """The worker's tokenizer for this file, loaded once."""
    return kept(("tokenizer", hash(content)), lambda: WordTokenizer(content))
