"""Ids of whole batches of texts under a word-level BPE vocabulary (lower case, white space dropped).

White space never takes part in a token, so a text's ids are the ids of its white-space-separated
words, one after the other.  A batch is reduced to its distinct words; words are reduced to letter
and sign runs; runs are encoded by the tokenizer's model, and the last ones used are remembered.
Anything outside plain Latin goes through the full tokenizer, word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a half of a cache: some 150 bytes each, four halves a worker.
CACHED_WORDS = 120_000
#: Below this code point normalisation is plain lower-casing.
LATIN_END = "ƀ"

_state: dict = {}


class Recent:
    """The entries used last, at most ``2 * most``: a full half becomes the old one, and what is used there comes back."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian numbers of four bytes: a third of the room of a tuple."""
    return np.array(ids, "<u4").tobytes()


class WordEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        # the split pattern of the vocabulary file
        self.runs = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.words, self.pieces = Recent(CACHED_WORDS), Recent(CACHED_WORDS)
        # printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            shown = text if text.isascii() and text.isprintable() else "".join(map(self.letter.__getitem__, text.encode()))
            ids = _packed([t.id for t in self.model.tokenize(shown)])
            self.pieces.put(text, ids)
        return ids

    def word(self, word: str) -> bytes:
        if "<|" in word or (not word.isascii() and max(word) >= LATIN_END):
            return _packed(self.full.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isascii() or max(low) < LATIN_END:
            if low.isalpha():
                return self.piece(low)
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return self.piece(low[:-1]) + self.piece(low[-1])
            return b"".join(map(self.piece, self.runs.findall(low)))
        return _packed(self.full.encode(word, add_special_tokens=False).ids)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text); null texts count as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        known, found = self.words, []
        for word in words.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = self.word(word) if word else b""
                if len(word) <= 32:
                    known.put(word, ids)
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(sizes) - sizes
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins[index] - (ends - lengths), lengths) + np.arange(total)]
        word_ends = np.concatenate([[0], ends])
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        return ids, np.diff(word_ends[offsets])


def word_encoder(path: str) -> WordEncoder:
    if path not in _state:
        _state[path] = WordEncoder(path)
    return _state[path]
