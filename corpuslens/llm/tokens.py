"""Token ids of texts by a public tokenizer, with the words a worker met before remembered."""

from __future__ import annotations

import numpy as np
import regex
import tokenizers

#: How the vocabulary file cuts words (fixed value of that file).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts whose words can be looked up one by one: no letters that lower-case or compose in other
#: ways, no white space that the libraries see differently, no special tokens.
ODD = regex.compile(r"[^\t\n\r -~¡-ÿ]|<\|")
KEPT_WORDS, KEPT_PIECES = 250_000, 700_000


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes; remembered words are only a matter of speed."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        names = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        self.ends = np.fromiter((n.endswith("</w>") for n in names), bool, size)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        if len(self.pieces) + len(new) > KEPT_PIECES:
            self.pieces.clear()
        ids = np.frombuffer(self.whole(" ".join(new)), "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, at = ids.tobytes(), 0
            for piece, stop in zip(new, stops.tolist(), strict=True):
                self.pieces[piece] = raw[4 * at : 4 * stop]
                at = stop
        else:
            self.pieces.update((piece, self.whole(piece)) for piece in new)

    def _learn_words(self, new: list[str]) -> None:
        cut = [PIECE.findall(word.lower()) for word in new]
        unknown = {piece for found in cut for piece in found if piece not in self.pieces}
        if unknown:
            self._learn_pieces(list(unknown))
        known = self.pieces
        for word, found in zip(new, cut, strict=True):
            ids = [known.get(piece) for piece in found]
            self.words[word] = self.whole(word) if None in ids else b"".join(ids)

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as the tokenizer gives them for the whole text."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        split = [None if ODD.search(text) else text.split() for text in texts]
        new = {word for words in split if words for word in words if word not in self.words}
        if new:
            self._learn_words(list(new))
        known = self.words
        return [
            self.whole(text) if words is None else b"".join([known[word] for word in words])
            for text, words in zip(texts, split, strict=True)
        ]


def word_ids(path: str) -> WordIds:
    """The worker's own instance for a vocabulary file. Code shipped by value has new globals in
    every task, so it is kept on the library's module."""
    loaded = vars(tokenizers).setdefault("_corpuslens_word_ids", {})
    if path not in loaded:
        loaded[path] = WordIds(path)
    return loaded[path]
