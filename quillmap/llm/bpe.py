"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word's bytes the last token of its encoding is unique. It is found among the vocabulary entries
that end at this position (a suffix automaton reports them) as the one which is compatible with the last token of the
prefix it leaves. Following the stored tokens backwards gives the ids, in time linear in the word's length.

Two neighbouring tokens are compatible if the merge procedure, run on their joined bytes, gives exactly these two. That
is decided by undoing merges along the seam, youngest first: as long as no merge across the seam would have come before
the merges that formed the two sides, the seam survives.
"""

from __future__ import annotations

import json

import ahocorasick
import regex

#: Fixed value: the word pattern of byte_bpe_50k.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the two memo tables of a worker; they are emptied when full, which only costs time.
MEMO = 400_000
#: Bytes up to which a word is memoised; longer ones (unbroken runs) are encoded each time.
MEMO_BYTES = 64


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: printable ones stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def default_vocabulary() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixEncoder:
    """Exact byte-level BPE. ``path``: a tokenizer file with ``model.vocab`` and ``model.merges`` in order of age."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        as_byte = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        raw = lambda name: b"".join(as_byte[c] for c in name)
        vocab = model["vocab"]
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        known: dict[int, bytes] = {}
        for byte, letter in enumerate(_byte_letters()):
            known[vocab[letter]] = bytes([byte])
            self.rank[vocab[letter]] = -1
        for age, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b not in vocab:
                continue
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in self.parts:
                continue
            self.joined[left, right], self.parts[whole], self.rank[whole] = whole, (left, right), age
            known[whole] = raw(a + b)
        self.bytes_of = known
        self._ends = ahocorasick.Automaton()
        for token, text in known.items():
            self._ends.add_word(text.decode("latin-1"), (token, len(text)))
        self._ends.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._find = regex.compile(WORDS).findall

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' joined bytes is just the two tokens."""
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            known = self._pairs[pair] = self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        # A seam merge wins if it is older than the merges that are still to be made beside it. Of two such merges of one
        # age the left one is made first, so a right part formed by the same merge doesn't protect the seam.
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = 1 << 60
        while True:
            whole = joined.get((left, right))
            if whole is not None and rank[whole] < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit = rank[left]
                left = parts[left][1]
            else:
                limit = rank[right] + 1
                right = parts[right][0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        ids = self._words.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            ids = tuple(self._encode(raw))
            if len(raw) <= MEMO_BYTES:
                if len(self._words) >= MEMO:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def _encode(self, raw: bytes) -> list[int]:
        n = len(raw)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        for end, (token, size) in self._ends.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                begin = end - size
                if begin == 0 or (last[begin] >= 0 and compatible(last[begin], token)):
                    last[end], start[end] = token, begin
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def words(self, text: str) -> list[str]:
        """The words that are encoded one by one; their concatenation is the text."""
        return self._find(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are ordinary text."""
        ids: list[int] = []
        known, more = self._words.get, ids.extend
        for word in self._find(text):
            more(known(word) or self.word(word))
        return ids

    def sizes(self, words: list[str]) -> list[int]:
        """Tokens of each of the words."""
        known = self._words.get
        return [len(known(word) or self.word(word)) for word in words]

    def count(self, text: str) -> int:
        return sum(self.sizes(self._find(text)))


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder for each process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]
