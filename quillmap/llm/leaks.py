"""Evaluation passages inside a corpus, by spaced-seed hashing.

Passages and documents are joined on the hashes of their seeds, and every pair that meets is followed on its diagonal,
over substituted words. Equal passages are one class. There are two forms of the join, which give the same rows and read
the corpus once. Up to a number of words, the passages go to the workers. Beyond it a filter of fixed size does, with the
bits that their seeds set: the documents' seeds that pass it, with the words around them, are joined with the passages'
seeds as tables, and neither items nor documents are gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.displayed import displayed_words
from quillmap.operators.joins import split_join
from quillmap.session import stage

#: Masks over word positions: only the ones are hashed. Every mask spans 12 words or fewer, so a common run of 12 words has
#: a hit of each; words under the zeros may differ, so overlaps with substituted words are hit too.
MASKS = ("1101100101", "11100010011")
RUN = 12
#: Words of different passages that are sent to the workers; their index takes about 60 bytes a word in each.
SENT_WORDS = 400_000
#: Pairs of seeds that a task expands at once.
PAIRS = 1_000_000
#: Bits of the filter, as a power of two: 8 MB at any number of items. Four million seeds let through 1 % of others.
FILTER = 26
#: Words of documents that are looked up at once.
CHUNK_WORDS = 500_000
#: Codes of words that a task remembers.
KNOWN_WORDS = 1_000_000
_PROBES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd numbers; any do


@dataclass(frozen=True)
class Seeds:
    """Hashes of masked words."""

    masks: tuple[str, ...]

    def offsets(self) -> list[np.ndarray]:
        return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in self.masks]

    def keys(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """For each mask the hashes at all places of a row of word codes, and the mask's span."""
        rng = np.random.default_rng(20_310_301)
        for o in self.offsets():
            factors = rng.integers(1, 1 << 62, len(o), dtype=np.uint64) | np.uint64(1)
            n, span = len(codes) - int(o[-1]), int(o[-1]) + 1
            keys = np.zeros(max(n, 0), np.uint64)
            if n > 0:
                for at, f in zip(o, factors):
                    keys += codes[at : at + n] * f
                keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(_PROBES[1])
                keys ^= keys >> np.uint64(29)
            yield keys, span


def _bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    for p in _PROBES:
        yield (keys * np.uint64(p)) >> np.uint64(64 - FILTER)


class Coder(dict):
    """64-bit hashes of words, equal everywhere; the last ones are remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        return code

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _passages(items: DataFrame, item: str, passage: str) -> DataFrame:
    """``item, class, words``: the items' passages as word codes; equal ones are of one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            codes = [coder(displayed_words(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([_digest(c.tobytes()) for c in codes], pa.binary()), pa.array([c.view(np.int64) for c in codes], pa.list_(pa.int64()))], names=["item", "class", "words"])

    source = items.select(items[item].cast("long").alias("item"), items[passage].alias("p")).dropna()
    return source.mapInArrow(run, "item long, class binary, words array<long>").where(F.size("words") > 0)


def _passage_seeds(classes: DataFrame, seeds: Seeds) -> DataFrame:
    """``key, class, place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for k, codes in enumerate(batch.column(1)):
                for found, _ in seeds.keys(np.array(codes.values, np.int64).view(np.uint64)):
                    at.append(np.full(len(found), k))
                    keys.append(found)
                    places.append(np.arange(len(found)))
            own = batch.column(0).take(pa.array(np.concatenate(at)))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), own, pa.array(np.concatenate(places).astype(np.int32))], names=["key", "class", "place"])

    return classes.select("class", "words").mapInArrow(run, "key long, class binary, place int")


def _filter(seeds: DataFrame) -> np.ndarray:
    """The filter's words: all bits that a seed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(list(_bits(batch.column(0).to_numpy().view(np.uint64)))))
            word = (bits >> np.uint64(6)).astype(np.int32)
            value = np.uint64(1) << (bits & np.uint64(63))
            yield pa.record_batch([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    found = seeds.select("key").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _chunks(texts: pa.Array, coder: Coder, least: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, word codes and sizes of texts of at least so many words, a bounded number of words at a time."""
    rows: list[np.ndarray] = []
    at: list[int] = []
    size = 0
    for n, text in enumerate(texts):
        words = displayed_words(text.as_py())
        if len(words) >= least:
            rows.append(coder(words))
            at.append(n)
            size += len(words)
        if size >= CHUNK_WORDS:
            yield at, np.concatenate(rows), np.array([len(r) for r in rows])
            rows, at, size = [], [], 0
    if at:
        yield at, np.concatenate(rows), np.array([len(r) for r in rows])


def _places(codes: np.ndarray, owner: np.ndarray, seeds: Seeds, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the places inside one text whose keys pass the filter, and the keys."""
    for keys, span in seeds.keys(codes):
        at = np.arange(len(keys))
        for b in _bits(keys):
            b = b[at]
            at = at[(bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1]
        at = at[owner[at] == owner[at + span - 1]]
        yield at, keys[at]


def _stretches(docs: DataFrame, seeds: Seeds, bits: np.ndarray, longest: int, kind: str) -> DataFrame:
    """``k, d, start, words, hits``: of documents the words around seeds that pass the filter, and these.

    ``d`` names the text, ``start`` is the stretch's first word; a passage of at most ``longest`` words that shares a seed
    lies inside. Stretches that touch are one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    hit = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for at, codes, sizes in _chunks(texts := batch.column(1), coder, min(map(len, seeds.masks))):
                ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
                place, key = (np.concatenate(x) for x in zip(*_places(codes, owner, seeds, shared.value)))
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, key = place[order], key[order]
                own = owner[place]
                lo = np.maximum(place - longest, (ends - sizes)[own])
                hi = np.minimum(place + longest, ends[own])
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])))
                reach, own = np.maximum.reduceat(hi, first), own[first]
                names = {n: _digest(texts[at[n]].as_py().encode("utf-8", "replace")) for n in np.unique(own).tolist()}
                begin = lo[first]
                since = np.repeat(begin, np.diff(np.append(first, len(place))))
                each = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array((place - since).astype(np.int32))], fields=list(hit.value_type))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.array(at)[own])),
                        pa.array([names[n] for n in own.tolist()], pa.binary()),
                        pa.array((begin - (ends - sizes)[own]).astype(np.int32)),
                        pa.array([codes[a:b].view(np.int64) for a, b in zip(begin, reach)], pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(place)).astype(np.int32)), each).cast(hit),
                    ],
                    names=["k", "d", "start", "words", "hits"],
                )

    return docs.mapInArrow(run, f"k {kind}, d binary, start int, words array<long>, hits array<struct<key: long, at: int>>")


def overlaps(text: np.ndarray, passage: np.ndarray, diagonal: int, offsets: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """``run, matched, length, start`` of the overlaps on one diagonal (place in the text less place in the passage) that a mask hits.

    An overlap ends where text or passage end or two words in a row differ. ``run``: its longest stretch without a
    difference, which begins at ``start`` of the text; ``matched`` of ``length``: equal words of the whole overlap.
    """
    lo, hi = max(diagonal, 0), min(len(text), diagonal + len(passage))
    if hi <= lo:
        return
    same = text[lo:hi] == passage[lo - diagonal : hi - diagonal]
    ends = np.flatnonzero(~(same[:-1] | same[1:]))  # two different words in a row
    hit = np.zeros(len(same), bool)
    for o in offsets:
        n = len(same) - int(o[-1])
        if n > 0:
            hit[np.flatnonzero(np.logical_and.reduce([same[x : x + n] for x in o]))] = True
    bounds = [0, *(ends + 1).tolist(), len(same)]
    for a, b in zip(bounds, bounds[1:]):
        if not hit[a:b].any():
            continue
        equal = np.flatnonzero(same[a:b]) + a
        breaks = np.flatnonzero(np.diff(equal) > 1)
        starts, stops = np.append(0, breaks + 1), np.append(breaks, len(equal) - 1)
        best = int((stops - starts).argmax())
        yield int(stops[best] - starts[best] + 1), len(equal), int(equal[-1] - equal[0] + 1), lo + int(equal[starts[best]])


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PAIRS in sum."""
    begin = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PAIRS, prepend=-1))
    return zip(begin.tolist(), [*begin[1:].tolist(), len(sizes)])


def _sent(docs: DataFrame, classes: list[tuple[bytes, list[int]]], seeds: Seeds, kind: str) -> DataFrame:
    """``k, class, run, matched, length, start``: the best overlap of every document row and passage that share a seed."""
    names = pa.array([c for c, _ in classes], pa.binary())
    words = [np.array(w, np.int64).view(np.uint64) for _, w in classes]
    found = [(k, *pair) for k, w in enumerate(words) for pair in enumerate(seeds.keys(w))]
    tables = []
    for m in range(len(seeds.masks)):
        mine = [(k, keys) for k, mask, (keys, _) in found if mask == m]
        keys = np.concatenate([np.empty(0, np.uint64), *[x for _, x in mine]])
        place = np.concatenate([np.empty(0, np.int32), *[np.arange(len(x), dtype=np.int32) for _, x in mine]])
        order = np.argsort(keys, kind="stable")
        tables.append((keys[order], np.repeat(np.array([k for k, _ in mine], np.int32), [len(x) for _, x in mine])[order], place[order]))
    bits = np.zeros(1 << (FILTER - 6), np.uint64)
    for keys, _, _ in tables:
        for b in _bits(keys):
            np.bitwise_or.at(bits, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    shared = docs.sparkSession.sparkContext.broadcast((names, words, tables, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, passages, tables, bits = shared.value
        coder, offsets = Coder(), seeds.offsets()
        for batch in batches:
            for at, codes, sizes in _chunks(batch.column(1), coder, min(map(len, seeds.masks))):
                ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
                best: dict[tuple[int, int], tuple] = {}
                done: set[tuple[int, int, int]] = set()
                for (place, key), (keys, number, own_place) in zip(_places(codes, owner, seeds, bits), tables):
                    lo = np.searchsorted(keys, key, "left")
                    n = np.searchsorted(keys, key, "right") - lo
                    for a, b in _pieces(n):
                        inner = np.arange(n[a:b].sum()) + np.repeat(lo[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b])
                        text = np.repeat(owner[place[a:b]], n[a:b])
                        diagonal = np.repeat(place[a:b], n[a:b]) - own_place[inner] - (ends - sizes)[text]
                        for t, c, d in np.unique(np.stack([text, number[inner], diagonal]), axis=1).T.tolist():
                            if (t, c, d) in done:
                                continue
                            done.add((t, c, d))
                            for r, m, size, start in overlaps(codes[ends[t] - sizes[t] : ends[t]], passages[c], d, offsets):
                                best[t, c] = max(best.get((t, c), (0,)), (r, m, -start, size))
                if best:
                    t, c = zip(*best)
                    r, m, early, size = zip(*best.values())
                    own = [pa.array(x, pa.int32()) for x in (r, m, size, [-e for e in early])]
                    yield pa.record_batch([batch.column(0).take(pa.array([at[n] for n in t])), names.take(pa.array(c)), *own], names=["k", "class", "run", "matched", "length", "start"])

    return docs.mapInArrow(run, f"k {kind}, class binary, run int, matched int, length int, start int")


def _verified(pairs: DataFrame, seeds: Seeds) -> DataFrame:
    """``d, class, run, matched, length, start`` of ``d, start, class, diagonal, words, passage``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = seeds.offsets()
        for batch in batches:
            at, rows = [], []
            start, diagonal = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for n, (words, passage) in enumerate(zip(batch.column(4), batch.column(5))):
                for r, m, size, place in overlaps(words.values.to_numpy(), passage.values.to_numpy(), int(diagonal[n]), offsets):
                    at.append(n)
                    rows.append((r, m, size, place + int(start[n])))
            index = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(index), batch.column(2).take(index), *[pa.array([r[c] for r in rows], pa.int32()) for c in range(4)]], names=["d", "class", "run", "matched", "length", "start"])

    return pairs.mapInArrow(run, "d binary, class binary, run int, matched int, length int, start int")


def leaked_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", run: int = RUN, masks: tuple[str, ...] = MASKS, least: int = 1) -> DataFrame:
    """``key, item_id, run, matched, length, start``: overlaps of documents and test passages that have a seed hit.

    ``run``: the most consecutive equal words; every overlap with ``run`` of at least the parameter ``run`` is found, as
    no mask is longer, and shorter or substituted overlaps as far as a mask hits them. ``matched`` and ``length``: equal
    and all words of the overlap followed over single substituted words. ``start``: word number of the run in the text.
    The best overlap of a document and an item is given, if its ``run`` is at least ``least``.

    The corpus is read once and never shuffled. Rows of one document id and of one item
    id are one document or item with several texts or passages. Null, empty and short texts and passages have no overlap;
    repeated documents are each reported; other columns are ignored; empty tables give an empty result. Words are compared
    as 64-bit hashes.
    """
    masks = tuple(m for m in masks if len(m) <= run) or ("1" * run,)
    seeds, kind = Seeds(masks), docs.schema[key].dataType.simpleString()
    found = stage(_passages(items, item, passage), "passages")
    classes = found.groupBy("class").agg(F.first("words").alias("words"))
    longest, words = classes.agg(F.max(F.size("words")), F.sum(F.size("words"))).first()
    if longest is None:
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, item_id long, run int, matched int, length int, start int")
    source = docs.select(docs[key].alias("k"), docs[text].alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    order = F.struct("run", "matched", (-F.col("start")).alias("early"), "length").alias("o")
    if words <= SENT_WORDS:
        sent = [(bytes(r["class"]), r["words"]) for r in classes.collect()]
        held = _sent(source, sent, seeds, kind).where(F.col("run") >= least).select("k", "class", order)
    else:
        held = _joined(source, classes, seeds, longest, kind, least, order)
    held = stage(held, "held")
    members = found.select("class", F.col("item").alias("item_id")).distinct()
    each = split_join(held, members, ["class"])
    several = lambda df, *by: not df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if several(members, "item_id") or several(held, "k", "class"):
        each = each.groupBy("k", "item_id").agg(F.max("o").alias("o"))
    return each.select(F.col("k").alias(key), "item_id", "o.run", "o.matched", "o.length", (-F.col("o.early")).alias("start"))


def _joined(source: DataFrame, classes: DataFrame, seeds: Seeds, longest: int, kind: str, least: int, order: Column) -> DataFrame:
    """``k, class, o``: the same overlaps by joins of tables; equal texts are followed once."""
    keyed = stage(_passage_seeds(classes, seeds), "seeds")
    near = stage(_stretches(source, seeds, _filter(keyed), longest, kind), "stretches")
    hits = near.select("d", "start", F.explode("hits").alias("h")).select("d", "start", F.col("h.key").alias("key"), F.col("h.at").alias("at")).distinct()
    met = split_join(stage(hits, "hits"), keyed, ["key"]).select("d", "start", "class", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    met = split_join(stage(met, "met"), classes.withColumnRenamed("words", "passage"), ["class"])
    texts = near.groupBy("d", "start").agg(F.first("words").alias("words"))
    pairs = met.join(texts, ["d", "start"]).select("d", "start", "class", "diagonal", "words", "passage")
    best = _verified(pairs, seeds).where(F.col("run") >= least).groupBy("d", "class").agg(F.max(order).alias("o"))
    return split_join(stage(near.select("k", "d").distinct(), "owners"), stage(best, "best"), ["d"]).select("k", "class", "o")


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, key: str = "doc_id", **columns: str) -> DataFrame:
    """Distinct ``key, item_id``: documents that hold at least ``run`` consecutive words of an item's passage."""
    return leaked_passages(docs, items, key=key, run=run, least=run, **columns).select(key, "item_id")
