"""Benchmark decontamination by SimHash windows of the items' sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import spare, text_of, without, written

WIDTH, LEAST = 5, 0.8
#: Similarity 0.8 of equally long shingle lists is a cosine of 8/9, on average 9.7 of 64 differing
#: bits with a deviation of 2.9. 23 bits are 4.6 deviations away. This is for lists without repeats.
RADIUS, BLOCKS = 23, 8
#: Benchmark words per pass over the documents; what a task holds of the benchmark is bounded by this.
SLICE_WORDS = 400_000

TOKEN = re.compile(r"[^\W_]+")
ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1) for i in range(WIDTH)]


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, seen: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits."""
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, in order."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h += words[i : n + i] * ODD[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_votes(h: np.ndarray, first: int, count: int, size: int) -> np.ndarray:
    """SimHash of the windows h[s : s + size] for s = first, ..., first + count - 1, as rows of 8 bytes."""
    part = np.ascontiguousarray(h[first : first + count + size - 1])
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(part) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    votes = total[size : size + count] - total[:count]
    return np.packbits(2 * votes > size, axis=1, bitorder="little")


def repeats(h: np.ndarray, size: int) -> np.ndarray:
    """Which windows h[s : s + size] hold some shingle twice."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    low, high = order[same], order[same + 1]
    edge = np.zeros(len(h) - size + 2, dtype=np.int64)
    near = high - low < size
    first = np.maximum(high[near] - size + 1, 0)
    last = np.minimum(low[near], len(h) - size)
    np.add.at(edge, first[first <= last], 1)
    np.add.at(edge, last[first <= last] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


class Sized:
    """Items of one size (shingles) with their SimHashes and multi-index blocks.

    Two fingerprints within 23 bits differ in at most 2 bits of some byte. ``near[b][v]`` tells for
    byte b with value v which items are that close, so that no item within the radius is missed.
    """

    def __init__(self, size: int, items: list[int], hashes: list[np.ndarray]):
        self.size, self.items = size, items
        self.own = [np.unique(h, return_counts=True) for h in hashes]
        self.twice = np.array([counts.max() > 1 for _, counts in self.own])
        self.marks = np.concatenate([window_votes(h, 0, 1, size) for h in hashes])
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.bitwise_count(values[:, None] ^ self.marks[None, :, b]) <= RADIUS // BLOCKS for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray, twice: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items ``among`` whose fingerprints are within the radius.

        The radius holds for distinct shingles: where the window or the item repeats one, every item counts.
        """
        found = np.zeros((len(prints), len(among)), dtype=bool)
        for b in range(BLOCKS):
            found |= self.near[b][prints[:, b][:, None], among]
        w, j = np.nonzero(found)
        apart = np.bitwise_count(prints[w] ^ self.marks[among[j]]).sum(axis=1, dtype=np.int64)
        found[w[apart > RADIUS], j[apart > RADIUS]] = False
        found |= twice[:, None] | self.twice[among]
        w, j = np.nonzero(found)
        return w, among[j]


class Items:
    """What tasks need of one slice of the benchmark: its items by size, and for every shingle the items that hold it."""

    def __init__(self, texts: list[str | None], least: float = LEAST):
        self.least, self.seen = least, WordHashes()
        by_width: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for i, t in enumerate(texts):
            words = word_hashes(t or "", self.seen)
            if width := min(WIDTH, len(words)):
                h = shingles(words, width)
                by_width.setdefault(width, {}).setdefault(len(h), []).append((i, h))
        self.widths = {}
        for width, sizes in by_width.items():
            groups = {size: Sized(size, [i for i, _ in rows], [h for _, h in rows]) for size, rows in sizes.items()}
            held = [(own[0], size, j) for size, group in groups.items() for j, own in enumerate(group.own)]
            every = np.concatenate([h for h, _, _ in held])
            order = np.argsort(every, kind="stable")
            known, first = np.unique(every[order], return_index=True)
            lengths = [len(h) for h, _, _ in held]
            size, item = (np.repeat([x[n] for x in held], lengths)[order] for n in (1, 2))
            self.widths[width] = (known, np.append(first, len(every)), size, item, groups)

    def find(self, text: str) -> dict[int, tuple[float, int, int]]:
        """Per item found in ``text``: best similarity, first word of the first best window, its words.

        The shingles of the text name the items that hold them; a window is fingerprinted and looked up for the
        items it shares a shingle with, as it has similarity 0 with all others.
        """
        words, best = word_hashes(text, self.seen), {}
        for width, (known, first, sizes, items, groups) in self.widths.items():
            h = shingles(words, width)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            if not len(hit):
                continue
            # One row for every shingle of the text and item that holds it.
            low, many = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
            row = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            place = np.repeat(hit, many)
            for size in np.unique(sizes[row]).tolist():
                here = sizes[row] == size
                self._windows(h, place[here], items[row[here]], width, groups[size], best)
        return best

    def _windows(self, h: np.ndarray, hit: np.ndarray, item: np.ndarray, width: int, group: Sized, best: dict) -> None:
        size = min(group.size, len(h))
        last = len(h) - size
        edge = np.zeros(last + 2, dtype=np.int64)
        np.add.at(edge, np.clip(hit - size + 1, 0, last), 1)
        np.add.at(edge, np.minimum(hit, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        twice = repeats(h, size)
        runs = np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1)
        for run in (r[i : i + 4096] for r in runs for i in range(0, len(r), 4096)):
            first, count = int(run[0]), len(run)
            a, b = np.searchsorted(hit, [first, first + count + size - 1])
            w, j = group.candidates(window_votes(h, first, count, size), twice[first : first + count], np.unique(item[a:b]))
            for one in np.unique(j).tolist():
                values, counts = group.own[one]
                part = h[first : first + count + size - 1]
                at = np.minimum(np.searchsorted(values, part), len(values) - 1)
                at = np.where(values[at] == part, at, -1)
                shared = np.concatenate(([0], np.cumsum(at >= 0)))
                mine = w[j == one]
                most = np.minimum(shared[mine + size] - shared[mine], group.size)
                for s in mine[most >= self.least * (size + group.size - most)].tolist():
                    inside = at[s : s + size]
                    both = int(np.minimum(np.bincount(inside[inside >= 0], minlength=len(values)), counts).sum())
                    like = both / (size + group.size - both)
                    if like >= self.least and like > best.get(group.items[one], (0.0,))[0]:
                        best[group.items[one]] = (like, first + s, size + width - 1)


def passages(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Benchmark items found in documents: doc_id, text_hash, item_id, similarity, start, words.

    One row for every document and item of which some window of the item's size has weighted
    shingle similarity (multiset Jaccard of five-word shingles) of ``least`` or more: the best
    window, the first if several tie; ``start`` counts words from 0. Items of fewer than five words
    are one shingle of their own width, a document shorter than an item is one window, items and
    texts without words match nothing. The benchmark is taken in slices of about ``slice_words``
    words, one pass over the documents each, so what a task holds does not grow with it; with several,
    the findings of a slice are written before the next one is read, and the driver holds one slice. Null texts
    are empty; an item or a document that comes several times is found each time, items without
    an id under a null one; very long texts are read whole. Empty tables give an empty result, and other columns are not read.
    """
    keys = spare(benchmark, "_words", "_slice")
    words, cut = keys
    sized = benchmark.select("item_id", "text", F.size(F.split(text_of(), r"\W+")).alias(words))
    total = sized.agg(F.sum(words)).first()[0] or 0
    slices = max(1, -(-total // slice_words))
    sized = sized.withColumn(cut, F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    kind, item = (x.schema[c].dataType for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind.simpleString()}, text_hash long, item_id {item.simpleString()}, similarity double, start long, words long"
    out = None
    for k in range(slices):
        items = sized.filter(F.col(cut) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        ids = pa.array([r["item_id"] for r in items], type=to_arrow_type(item))
        found = rows.mapInArrow(finder([r["text"] for r in items], ids, least), schema)
        found = found if slices == 1 else written(found)
        out = found if out is None else out.unionByName(found)
    return out


def finder(texts: list[str | None], ids: pa.Array, least: float):
    """Task function for one slice of the benchmark."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(texts, least)
        for batch in batches:
            row, item, found = [], [], []
            for i, text in enumerate(batch.column(2)):
                for j, x in sorted(index.find(text.as_py()).items()):
                    row.append(i)
                    item.append(j)
                    found.append(x)
            at = pa.array(row, type=pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), ids.take(pa.array(item, type=pa.int64()))]
            columns += [pa.array([x[n] for x in found], type=t) for n, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "item_id", "similarity", "start", "words"])

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all others stay as they are."""
    mark, = spare(docs, "text_hash")
    gone = passages(docs, benchmark, least).select("doc_id", F.col("text_hash").alias(mark))
    return without(docs.withColumn(mark, F.xxhash64(text_of())), gone).drop(mark)
