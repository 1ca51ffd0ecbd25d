"""Cutting oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.llm.bpe import PrefixEncoder, default_vocabulary, encoder

LIMIT, OVERLAP = 1024, 64
#: Strength of the boundary before a word: none inside one, then words, clauses, sentences, lines, paragraphs.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_BREAK = regex.compile(r"\r\n|[\n\r\u0085  \x0b\x0c]")
_SENTENCE_END = regex.compile(r"""[.!?…。！？]["'”’)\]»」]*$""")
_CLAUSE_END = regex.compile(r"[,;:—–，；：、)\]}]$")


@dataclass
class Units:
    """The smallest units of a text: words of the tokenizer's pattern, or parts of words that are too long alone."""

    start: list[int]  # character offsets, one more than units
    size: list[int]  # tokens of each
    strength: list[int]  # of the boundary before each


def _split_word(word: str, encode: PrefixEncoder, most: int) -> Iterator[str]:
    """Parts of a word of at most ``most`` tokens each, cut between characters."""
    step = most
    at = 0
    while at < len(word):
        part = word[at : at + step]
        while len(part) > 1 and len(encode.word(part)) > most:
            part = part[: max(1, len(part) * most // (len(encode.word(part)) + 1))]
        yield part
        at += len(part)


#: Strength of the boundary after a word, by its text alone; emptied when full, which only costs time.
_AFTER: dict[str, int] = {}
_INHERITED = -1


def _after(word: str) -> int:
    """A word of the pattern is letters, digits, a run of other signs, or white space, each with at most one blank before."""
    if len(_AFTER) >= 200_000:
        _AFTER.clear()
    if word.isspace():
        breaks = len(_BREAK.findall(word))
        strength = PARAGRAPH if breaks > 1 else LINE if breaks else _INHERITED
    elif word[-1].isalnum():
        strength = WORD
    else:
        strength = SENTENCE if _SENTENCE_END.search(word) else CLAUSE if _CLAUSE_END.search(word) else WORD
    _AFTER[word] = strength
    return strength


def units(words: list[str], sizes: list[int], encode: PrefixEncoder, most: int) -> Units:
    """Units of a text, given its words and their tokens, of at most ``most`` tokens each, and their boundaries' strengths."""
    start, size, strength = [], [], []
    at, before, lines = 0, PARAGRAPH, 0
    after_of = _AFTER.get
    for word, n in zip(words, sizes):
        if n <= most:
            start.append(at)
            size.append(n)
            strength.append(before)
            at += len(word)
        else:
            for k, part in enumerate(_split_word(word, encode, most)):
                start.append(at)
                size.append(len(encode.word(part)))
                strength.append(INSIDE if k else before)
                at += len(part)
        after = after_of(word)
        if after is None:
            after = _after(word)
        if after >= LINE:  # white space split over several words counts as one
            lines += 1 if after == LINE else 2
            before = PARAGRAPH if lines > 1 else LINE
        elif after == _INHERITED:  # a run of blanks after a sentence still ends it
            before = max(before, WORD)
        else:
            before, lines = after, 0
    start.append(at)
    return Units(start, size, strength)


def merge(size: list[int], strength: list[int], limit: int, overlap: int) -> list[int]:
    """First units of the groups that merging leaves.

    Neighbouring groups wait in a heap, weakest boundary first, then smaller joined size, then place. A pair is merged
    while its size plus the overlap (none at the text's start) stays within the limit; groups only grow, so a pair that
    doesn't fit never will.
    """
    n = len(size)
    total, right, alive = size[:], list(range(1, n + 1)), [True] * n
    heap = [(strength[k], size[k - 1] + size[k], k - 1, k) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, joined, a, b = heapq.heappop(heap)
        if not alive[a] or right[a] != b:
            continue
        if total[a] + total[b] != joined:
            heapq.heappush(heap, (strength[b], total[a] + total[b], a, b))
            continue
        if joined + (overlap if a else 0) > limit:
            continue
        total[a], alive[b], right[a] = joined, False, right[b]
        if (c := right[b]) < n:
            heapq.heappush(heap, (strength[c], joined + total[c], a, c))
    return [k for k in range(n) if alive[k]]


def cut(text: str, encode: PrefixEncoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces ``(start, end, tokens, repeated)`` of a text: character range, tokens, and tokens repeated from before.

    A text within the limit is one piece. Otherwise no piece has more than ``limit`` tokens, the pieces' new parts follow
    one another without a gap, and each piece after the first begins with at most ``overlap`` and at least one token of
    the one before: from the first of the strongest boundaries (sentence or better, else word) in that reach, or just the
    last unit's end if there is none.
    """
    if not text:
        return []
    words = encode.words(text)
    tokens_of = encode.sizes(words)
    whole = sum(tokens_of)
    if whole <= limit:
        return [(0, len(text), whole, 0)]
    u = units(words, tokens_of, encode, max(1, min(overlap, limit - overlap)))
    n = len(u.size)
    upto, cuts = [0, *accumulate(u.size)], [0, *accumulate(int(x == INSIDE) for x in u.strength)]

    def count(a: int, b: int) -> int:
        """Tokens of units a to b as a text of their own.

        Without parts of words that is the sum of the words', but for white space at its end: the pattern leaves the last
        blank of a run to the next word, which isn't there any more.
        """
        if cuts[min(b + 1, n)] > cuts[a]:
            return encode.count(text[u.start[a] : u.start[b]])
        w = b
        if b < n:
            while w > a and text[u.start[w - 1] : u.start[w]].isspace():
                w -= 1
        return upto[w] - upto[a] + (encode.count(text[u.start[w] : u.start[b]]) if w < b else 0)

    # Segments: whole sentences or lines where they fit, clauses or words of those that don't.
    firsts, room = [], limit - overlap
    stack = [(0, n, SENTENCE)]
    while stack:
        a, b, level = stack.pop()
        if level <= INSIDE:
            firsts.extend(range(a, b))
            continue
        x = a
        for y in [*(k for k in range(a + 1, b) if u.strength[k] >= level), b]:
            if upto[y] - upto[x] <= room:
                firsts.append(x)
            else:
                stack.append((x, y, level - 1))
            x = y
    firsts.sort()
    sizes = [upto[b] - upto[a] for a, b in zip(firsts, [*firsts[1:], n])]
    groups = [firsts[k] for k in merge(sizes, [u.strength[k] for k in firsts], limit, overlap)]
    pieces, begin_before = [], -1
    queue = list(zip(groups, [*groups[1:], n]))[::-1]
    while queue:
        a, b = queue.pop()
        begin = a if not pieces else _overlap_start(u, a, begin_before + 1, overlap)
        tokens = count(begin, b)
        if tokens > limit and b - a > 1:  # parts of one long word may need more tokens together than apart
            middle = max(range(a + 1, b), key=lambda k: (u.strength[k], -abs(2 * k - a - b)))
            queue += [(middle, b), (a, middle)]
            continue
        repeated = count(begin, a) if begin < a else 0
        while (tokens > limit or repeated > overlap) and begin < a - 1:
            begin += 1
            tokens, repeated = count(begin, b), count(begin, a)
        pieces.append((u.start[begin], u.start[b], tokens, repeated))
        begin_before = begin
    return pieces


def _overlap_start(u: Units, a: int, least: int, overlap: int) -> int:
    """The unit before ``a`` at which a piece that continues there begins."""
    reach, size = [], 0
    for k in range(a - 1, least - 1, -1):
        size += u.size[k]
        if size > overlap:
            break
        reach.append(k)
    if not reach:
        return a - 1
    natural = [k for k in reach if u.strength[k] >= SENTENCE] or [k for k in reach if u.strength[k] >= WORD]
    return min(natural or reach)


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, oversized_only: bool = False) -> DataFrame:
    """``key, piece_no, char_start, char_end, n_tokens, n_repeated, piece``: the pieces of each text, numbered from 0.

    A map over the rows without a shuffle. Texts within the limit are one piece, or left out with ``oversized_only``: a
    token has at least one byte, so texts of up to ``limit`` bytes aren't even encoded then. Null and empty texts have no
    piece. Words of any length are cut between characters; a single character of more tokens than the limit or
    the overlap (possible only for ones under 4) stays whole. Repeated rows are cut each; other columns are ignored, also clashing ones.
    """
    if not 0 < overlap < limit:
        raise ValueError("the overlap must be at least 1 and below the limit")
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    if oversized_only:
        source = source.where(F.octet_length("t") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, rows, parts = [], [], []
            for n, value in enumerate(batch.column(1)):
                t = value.as_py()
                found = cut(t, encode, limit, overlap) if t else []
                if oversized_only and len(found) < 2:
                    continue
                at += [n] * len(found)
                rows += [(k, *p) for k, p in enumerate(found)]
                parts += [t[p[0] : p[1]] for p in found]
            columns = [pa.array([r[c] for r in rows], pa.int32()) for c in range(5)]
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *columns, pa.array(parts, pa.string())], names=["k", "piece_no", "char_start", "char_end", "n_tokens", "n_repeated", "piece"])

    out = source.mapInArrow(run, f"k {kind}, piece_no int, char_start int, char_end int, n_tokens int, n_repeated int, piece string")
    return out.withColumnRenamed("k", key)
