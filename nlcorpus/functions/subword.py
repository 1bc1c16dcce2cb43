"""Subword merging: units in slots of symbol numbers for training, and a small memoised segmenter for encoding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.session import materialize

SPACE = "▁"
HELD_SYMBOLS = 1_000_000  # symbols a training task looks at at once, about
GUIDE_UNITS = 50_000  # frequent units, and as many of the others, that merges are guessed from before they are checked
GUESSES = 128  # merges guessed at a time
MERGE_RANGE = 1 << 31  # symbol numbers are below this


@dataclass
class Units:
    """Units of one training task: symbols in slots that a gap (-1) ends; a merge shortens a unit inside its slot."""

    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> Units:
        return cls(np.insert(symbols, np.cumsum(lengths), -1), np.cumsum(lengths + 1) - lengths - 1, lengths, counts)

    @classmethod
    def read(cls, batches: Iterable[pa.RecordBatch]) -> Iterator[Units]:
        """From ``(symbols, cnt)`` batches, about ``HELD_SYMBOLS`` symbols at a time."""
        held: list[tuple] = []
        for batch in batches:
            lists = batch.column(0)
            held.append((lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64),
                         batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= HELD_SYMBOLS:
                yield cls.of(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield cls.of(*map(np.concatenate, zip(*held)))

    def copy(self) -> Units:
        return Units(self.symbols.copy(), self.starts, self.lengths.copy(), self.counts)

    def rows(self) -> pa.RecordBatch:
        """``(symbols, cnt)`` of the units that are not a single symbol yet."""
        open_ = self.tidied()
        offsets = np.concatenate([[0], np.cumsum(open_.lengths)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(open_.symbols[open_.symbols >= 0], pa.int32()))
        return pa.RecordBatch.from_arrays([lists, pa.array(open_.counts, pa.int64())], ["symbols", "cnt"])

    def places(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all symbols of the units, and which of the units each belongs to."""
        lengths = self.lengths[units]
        owner = np.repeat(np.arange(len(units)), lengths)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.starts[units][owner] + inside, owner

    def tidied(self) -> Units:
        """Without gaps inside slots and without units of a single symbol, which no merge touches."""
        open_ = np.flatnonzero(self.lengths > 1)
        return Units.of(self.symbols[self.places(open_)[0]], self.lengths[open_], self.counts[open_])

    def pairs(self, symbols: np.ndarray, owner: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all adjacent symbols."""
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys = symbols[inner].astype(np.int64) * MERGE_RANGE + symbols[inner + 1]
        return keys, self.counts[units][owner[inner]]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.starts))
        places, owner = self.places(every)
        return summed(*self.pairs(self.symbols[places], owner, every))

    def merge(self, left: int, right: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Join every occurrence of the pair, left to right; gives the changes of pair counts."""
        found = np.flatnonzero((self.symbols[:-1] == left) & (self.symbols[1:] == right))
        if not len(found):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        units = np.unique(np.searchsorted(self.starts, found, side="right") - 1)
        places, owner = self.places(units)
        symbols = self.symbols[places]
        keys, counts = self.pairs(symbols, owner, units)
        hits = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right) & (owner[1:] == owner[:-1]))
        if left == right:  # of a run of overlapping pairs every second one
            begins = np.concatenate([[True], np.diff(hits) > 1])
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        symbols[hits] = whole
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, owner = symbols[keep], owner[keep]
        self.symbols[places] = -1
        self.lengths[units] = np.bincount(owner, minlength=len(units))
        self.symbols[self.places(units)[0]] = symbols
        later = self.pairs(symbols, owner, units)
        keys, counts = summed(np.concatenate([keys, later[0]]), np.concatenate([-counts, later[1]]))
        changed = counts != 0
        return keys[changed], counts[changed]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums, in whole numbers."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    distinct, starts = np.unique(keys[order], return_index=True)
    return distinct, np.add.reduceat(counts[order], starts)


class PairRanks:
    """Counts of all pairs of the corpus and the leading one by (count desc, left, right)."""

    def __init__(self, pieces: list[str], longest: int):
        self.pieces, self.longest = pieces, longest
        self.counts: dict[int, int] = {}
        self.heap: list[tuple] = []

    def add(self, keys: Iterable[int], changes: Iterable[int]) -> None:
        for key, change in zip(keys, changes):
            n = self.counts[key] = self.counts.get(key, 0) + change
            left, right = self.pieces[key // MERGE_RANGE], self.pieces[key % MERGE_RANGE]
            if n > 0 and len(left) + len(right) <= self.longest:
                heappush(self.heap, (-n, left, right, key))

    def first(self) -> tuple[int, int] | None:
        while self.heap:
            n, _, _, key = self.heap[0]
            if self.counts[key] == -n:
                return key // MERGE_RANGE, key % MERGE_RANGE
            heappop(self.heap)  # counted anew since
        return None

    def copy(self) -> PairRanks:
        other = PairRanks(list(self.pieces), self.longest)
        other.add(self.counts.keys(), self.counts.values())
        return other


def coded_units(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """``(symbols, cnt)``: every unit as the places of its characters in the alphabet."""
    points = np.array([ord(c) for c in alphabet], np.int64)
    order = np.argsort(points)
    shared = words.sparkSession.sparkContext.broadcast((points[order], order))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, places = shared.value
        for batch in batches:
            if batch.num_rows:
                units = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in batch.column(0).to_pylist()]
                symbols = places[np.searchsorted(letters, np.concatenate(units))].astype(np.int32)
                yield Units.of(symbols, np.array([len(u) for u in units]), batch.column(1).to_numpy()).rows()

    return words.select("word", F.col("cnt").cast("long")).mapInArrow(run, "symbols array<int>, cnt long")


def merged_units(units: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """The units after some merges, those of one symbol left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in Units.read(batches):
            for step in steps:
                held.merge(*step)
            yield held.rows()

    return units.mapInArrow(run, "symbols array<int>, cnt long")


def pair_changes(units: DataFrame, before: list[tuple[int, int, int]], steps: list[tuple[int, int, int]]) -> list[tuple]:
    """Per step of merges, taken after those ``before``, the changes of pair counts over all units; first the counts themselves.

    What comes here is a row per step and pair that changes, bounded by the number of pieces.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple]] = [[] for _ in range(len(steps) + 1)]
        for held in Units.read(batches):
            for step in before:
                held.merge(*step)
            held = held.tidied()
            if not steps:
                parts[0].append(held.all_pairs())
            for found, step in zip(parts[1:], steps):
                found.append(held.merge(*step))
        for i, found in enumerate(parts):
            if found:
                keys, counts = summed(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(keys), pa.array(counts)],
                                                 ["step", "key", "n"])

    rows = (units.mapInArrow(run, "step long, key long, n long").groupBy("step", "key").agg(F.sum("n").alias("n")).toArrow())
    step, key, n = (rows.column(i).to_numpy() for i in range(3))
    return [(key[step == i].tolist(), n[step == i].tolist()) for i in range(len(steps) + 1)]


def guide_units(units: DataFrame) -> Units:
    """The most frequent units, and some of the others that stand for all of them."""
    counts = units.groupBy("cnt").agg(F.count("*").alias("n")).orderBy(F.desc("cnt")).limit(GUIDE_UNITS).toArrow()
    cnt, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    whole = np.flatnonzero(np.cumsum(n) <= GUIDE_UNITS)
    least = int(cnt[whole[-1]]) if len(whole) else 2 ** 62
    share = max(1, -(-int(n[len(whole):].sum()) // GUIDE_UNITS))
    some = F.pmod(F.xxhash64("symbols"), F.lit(share)) == 0
    weight = F.when(F.col("cnt") >= least, F.col("cnt")).otherwise(F.col("cnt") * share)
    rows = units.where((F.col("cnt") >= least) | some).select("symbols", weight.alias("cnt")).toArrow().combine_chunks()
    held = list(Units.read(rows.to_batches(max_chunksize=2 ** 31 - 1)))
    return held[0] if held else Units.of(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))


def guessed(guide: Units, ranks: PairRanks, number: dict[str, int], room: int) -> list[tuple[int, int, int]]:
    """The merges that probably come next; the first one is certain."""
    guide, ranks, number, steps = guide.copy(), ranks.copy(), dict(number), []
    while len(steps) < GUESSES and room and (pair := ranks.first()):
        piece = ranks.pieces[pair[0]] + ranks.pieces[pair[1]]
        if piece not in number:
            number[piece], room = len(ranks.pieces), room - 1
            ranks.pieces.append(piece)
        steps.append((*pair, number[piece]))
        ranks.counts[pair[0] * MERGE_RANGE + pair[1]] = 0
        keys, changes = guide.merge(*steps[-1])
        ours = keys != pair[0] * MERGE_RANGE + pair[1]
        ranks.add(keys[ours].tolist(), changes[ours].tolist())
    return steps


def learned_merges(words: DataFrame, alphabet: list[str], room: int, longest: int, cut_every: int = 100) -> list[str]:
    """The first ``room`` pieces that merging the most frequent pair, one at a time, adds to the alphabet.

    A pass over the distinct units ``(word, cnt)`` counts how every one of a row of guessed merges changes the counts of
    pairs. With these exact counts the merges are gone through, and all are taken up to the first that is not the most
    frequent pair of all units; so the guess tells only how many merges a pass is good for, never which are made.
    The units are written out after every ``cut_every`` merges.
    """
    units = materialize(coded_units(words, alphabet), "bpe-units")
    pieces = list(alphabet)
    number = {p: i for i, p in enumerate(pieces)}
    ranks = PairRanks(pieces, longest)
    ranks.add(*pair_changes(units, [], [])[0])
    guide, done = guide_units(units), []
    while len(pieces) < len(alphabet) + room and ranks.first():
        steps = guessed(guide, ranks, number, len(alphabet) + room - len(pieces))
        for step, changes in zip(steps, pair_changes(units, done, steps)[1:]):
            if ranks.first() != step[:2]:
                break
            if step[2] == len(pieces):
                pieces.append(pieces[step[0]] + pieces[step[1]])
                number[pieces[-1]] = step[2]
            ranks.add(*changes)
            guide.merge(*step)
            done = [*done, step]
        if len(done) >= cut_every:
            units, done = materialize(merged_units(units, done), "bpe-units"), []
    return pieces[len(alphabet):]


class Segmenter:
    """Cuts a text into pieces: adjacent symbols whose union has the lowest id merge first."""

    def __init__(self, ids: dict[str, int], whitespace_as_suffix: bool = False, split_digits: bool = False,
                 split_words: bool = True, add_dummy_prefix: bool = True):
        self.ids, self.suffix, self.words = ids, whitespace_as_suffix, split_words
        self.digits, self.dummy = split_digits, add_dummy_prefix
        self.cut = re.compile(rf"[^{SPACE}]*{SPACE}|[^{SPACE}]+" if whitespace_as_suffix
                              else rf"{SPACE}?[^{SPACE}]+|{SPACE}", re.S)
        self.pieces_of = lru_cache(maxsize=50_000)(self._pieces_of)

    def _pieces_of(self, unit: str) -> tuple[str, ...]:
        """Merges from a heap of (id, place); neighbours are linked, so a unit of n characters takes n log n steps."""
        size, ids = len(unit), self.ids
        end = list(range(1, size + 1))  # of the symbol that starts here; 0 once it is part of another
        before = list(range(-1, size - 1))
        heap = [(ids[unit[i:i + 2]], i, i + 2) for i in range(size - 1) if unit[i:i + 2] in ids]
        heapify(heap)
        while heap:
            _, at, stop = heappop(heap)
            middle = end[at]
            if not middle or middle >= size or end[middle] != stop:
                continue  # one of the two has been merged since
            end[at], end[middle] = stop, 0
            if stop < size:
                before[stop] = at
                whole = unit[at:end[stop]]
                if whole in ids:
                    heappush(heap, (ids[whole], at, end[stop]))
            left = before[at]
            if left >= 0:
                whole = unit[left:stop]
                if whole in ids:
                    heappush(heap, (ids[whole], left, stop))
        return tuple(unit[i:e] for i, e in enumerate(end) if e)

    def __call__(self, text: str) -> list[str]:
        marked = text.replace(" ", SPACE)
        if self.dummy and text:
            marked = marked + SPACE if self.suffix else SPACE + marked
        units = self.cut.findall(marked) if self.words else [marked]
        if self.digits:
            units = [part for u in units for part in re.findall(r"\d|\D+", u, re.S)]
        return [piece for u in units for piece in self.pieces_of(u)]


_SEGMENTERS: list[tuple[dict, dict, Segmenter]] = []


def worker_segmenter(ids: dict[str, int], **units) -> Segmenter:
    """The segmenter of a vocabulary, kept with its memo by the Python worker for later batches and tasks."""
    for known, options, segmenter in _SEGMENTERS:
        if known is ids and options == units:
            return segmenter
    _SEGMENTERS[:] = [*_SEGMENTERS[-3:], (ids, units, Segmenter(ids, **units))]
    return _SEGMENTERS[-1][2]


def unknown_runs(pieces: list[str], known: dict[str, int]) -> list[str]:
    """Pieces with every run of unknown ones as one piece."""
    out: list[str] = []
    inside = False
    for piece in pieces:
        unknown = piece not in known
        if unknown and inside:
            out[-1] += piece
        else:
            out.append(piece)
        inside = unknown
    return out
