"""Benchmark decontamination by latent semantic retrieval.

Passages of the documents and the benchmark items are TF-IDF vectors over the benchmark's words. A randomised singular
value decomposition, its product formed by Spark over all passages and items, gives the latent
space. Passages and items with a high cosine there are candidates. A candidate counts when the item's words come in
order in the text around it: most of them, or about half together with the item's answer, its closing words.

Every passage of every document is looked at, but cosines are formed only where a bound allows a leak: of an item's
rarest words so many must lie near the passage that the item's other words alone are too few. An inverted index from
these words to items finds all such pairs, so no passage is multiplied with all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.llm.common import MEMO_WORDS, saved, slices

BLOCK = 24  # words of a block; a passage is two blocks, and passages overlap by one
RANK, OVERSAMPLE = 96, 16
FIT_PASSAGES = 64  # passages multiplied at once, so that their matrices stay in a core's cache
FIT_CELLS = 50_000  # distinct words of passages laid out at once, about
ITEM_WEIGHT = 4.0  # of an item in the fit, so that words only the benchmark has are in the space
SEED = 20_240_101
COSINE = 0.5
MOST, SOME, ANSWER = 0.75, 0.55, 0.9  # shares of words in order: alone, with the answer, and of the answer
ANSWER_WORDS = 8
SHORT_ITEM = 8  # items of fewer words must be there as a whole
SEARCH_WORDS = 20_000  # words searched at once, so that their vectors stay in a core's cache
RARE = 0.2  # share of an item's words that must be found among its rarest ones, about
PAIR_ROWS = 1_000_000  # pairs of a place and an item that a worker holds at once, about; more go by ranges of items
PART_CHARS = 8_000_000  # benchmark text searched in one pass, about; a larger benchmark takes several passes

EDGES = "\"'`.,;:!?()<>[]{}|*#%$&-_"


def plain_word(word: bytes) -> str:
    """A word as it is compared: lower case without outer marks; empty if nothing is left."""
    return word.decode("utf-8", "surrogatepass").strip(EDGES).lower()


def item_words(text: str | None) -> list[str]:
    return [w for w in map(plain_word, (text or "").encode("utf-8", "surrogatepass").split()) if w]


@dataclass
class Items:
    """The benchmark as workers need it: ids, words as vocabulary places, where the answer begins."""

    keys: list
    words: list[np.ndarray]
    answers: list[int]
    vocabulary: dict[str, int]


    @property
    def needed(self) -> np.ndarray:
        """Words of each item that must be there in order, whether with the answer or without."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        return np.where(sizes < SHORT_ITEM, sizes, np.ceil(SOME * sizes - 1e-9).astype(np.int64))


def benchmark_parts(benchmark: DataFrame, text: str, part_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about ``part_chars`` characters, dealt out by a hash of the text."""
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-size // part_chars))
    if parts == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64(text), F.lit(parts)) == part) for part in range(parts)]


def read_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Items:
    """Items with a word; repeated rows count once. The rows given here go to every worker (:func:`benchmark_parts`)."""
    items = Items([], [], [], {})
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).distinct().toArrow().to_pylist()
    for name, value in sorted(((r["k"], r["t"]) for r in rows), key=repr):
        words = item_words(value)
        if not words:
            continue
        last = re.split(r"[.!?]\s+|\n", value.strip())[-1]
        items.keys.append(name)
        items.words.append(np.array([items.vocabulary.setdefault(w, len(items.vocabulary)) for w in words]))
        items.answers.append(max(0, len(words) - max(1, min(ANSWER_WORDS, len(item_words(last)) or 1))))
    return items


class _Places(dict):
    """Vocabulary places of raw words, looked up as they come: -1 for other words, -2 for marks only."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        clean = plain_word(word)
        place = self[word] = self.vocabulary.get(clean, -1) if clean else -2
        return place


def coded(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """``(k, words binary)``: every text as 32-bit vocabulary places, -1 for words the benchmark does not have.

    Words that are marks only are left out, as in items. Texts with fewer vocabulary words than the shortest share of
    an item that could count cannot leak and are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    least = min(items.needed.tolist(), default=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Places(shared.value)
        for batch in slices(batches):
            rows, keep = [], []
            for value in batch.column(1).to_pylist():
                words = (value or "").encode("utf-8", "surrogatepass").split()
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                places = np.fromiter(map(memo.__getitem__, words), dtype="<i4", count=len(words))
                places = places[places != -2]
                keep.append((places >= 0).sum() >= least)
                rows.append(places.tobytes())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["k", "words"])
            yield out.filter(pa.array(keep, pa.bool_()))

    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    return frame.mapInArrow(run, f"k {frame.schema['k'].dataType.simpleString()}, words binary")


def entries(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Block and place of every vocabulary word of a text, and the number of its passages."""
    found = np.flatnonzero(words >= 0)
    blocks = -(-len(words) // BLOCK)
    return found // BLOCK, words[found], max(1, blocks - 1)


def passage_cells(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct ``(passage, place)`` with counts, and the number of passages."""
    block, place, passages = entries(words)
    inner = (block > 0) & (block < passages)  # such a block is in two passages
    both = np.concatenate([np.minimum(block, passages - 1) << 32 | place, (block - 1)[inner] << 32 | place[inner]])
    cells, counts = np.unique(both, return_counts=True)
    return cells >> 32, cells & 0xFFFFFFFF, counts, passages


def document_frequency(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages that hold each word, over all documents, and passages in all; a row per word and task is shuffled."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                _, place, _, passages = passage_cells(np.frombuffer(raw, "<i4").astype(np.int64))
                total[:size] += np.bincount(place, minlength=size)
                total[size] += passages
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["w", "n"])

    rows = table.select("words").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out[:size], int(out[size])


def weights(place: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[place]


def gram_product(table: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A' A B`` for the unit TF-IDF rows A of all passages; each task adds up its part, Spark adds the tasks by word."""
    context = table.sparkSession.sparkContext
    shared, width = context.broadcast((idf, basis.astype(np.float32))), basis.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, right = shared.value
        total = np.zeros(right.shape)
        for row, place, counts in cell_groups(batches):
            add_product(total, row, place, weights(place, counts, own), right)
        held = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(total[held, i]) for i in range(width))],
                                         ["w", *(f"y{i}" for i in range(width))])

    names = [f"y{i}" for i in range(width)]
    rows = table.select("words").mapInArrow(run, ", ".join(["w long", *(f"{n} double" for n in names)])) \
        .groupBy("w").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros(basis.shape)
    out[rows.column(0).to_numpy()] = np.stack([rows.column(i + 1).to_numpy() for i in range(width)], axis=1)
    return out


def cell_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and count of the cells of all passages, those of some texts at a time; rows number the passages with cells."""
    held: list[tuple] = []
    size = offset = 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            passage, place, counts, passages = passage_cells(np.frombuffer(raw, "<i4").astype(np.int64))
            held.append((passage + offset, place, counts))
            size, offset = size + len(place), offset + passages
            if size >= FIT_CELLS:
                yield numbered_rows(held)
                held, size = [], 0
    if size:
        yield numbered_rows(held)


def numbered_rows(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    passage, place, counts = map(np.concatenate, zip(*held))
    return np.cumsum(np.concatenate([[False], np.diff(passage) != 0])), place, counts


def add_product(total: np.ndarray, row: np.ndarray, place: np.ndarray, values: np.ndarray, basis: np.ndarray,
                scale: float = 1.0) -> None:
    """Adds ``A' A B`` for the cells of A in order of ``row`` (from 0), its rows scaled to unit length times ``scale``."""
    norm = np.sqrt(np.bincount(row, values ** 2))
    values = scale * values / np.maximum(norm, 1e-12)[row]
    cuts = np.searchsorted(row, np.arange(0, row[-1] + 1 + FIT_PASSAGES, FIT_PASSAGES))
    for start, stop in zip(cuts, cuts[1:]):
        words, column = np.unique(place[start:stop], return_inverse=True)
        block = np.zeros((row[stop - 1] - row[start] + 1, len(words)), basis.dtype)
        block[row[start:stop] - row[start], column] = values[start:stop]
        total[words] += block.T @ (block @ basis[words])


def latent_space(table: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies and the leading right singular vectors (words by ``RANK`` at most).

    Randomised, by Nyström's formula: one product of A'A with a random orthonormal basis tells its leading eigenvectors.
    What comes to the driver is words of the benchmark by columns of the basis.
    """
    size = len(items.vocabulary)
    frequency, passages = document_frequency(table, size)
    idf = np.log((2.0 + passages + len(items.words)) / (1.0 + frequency))
    own = [np.unique(w, return_counts=True) for w in items.words]
    row, places = np.repeat(np.arange(len(own)), [len(p) for p, _ in own]), np.concatenate([p for p, _ in own])
    width = min(RANK + OVERSAMPLE, size)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
    image = gram_product(table, idf, basis)
    add_product(image, row, places, weights(places, np.concatenate([c for _, c in own]), idf), basis, ITEM_WEIGHT)
    small = basis.T @ image
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    root = image @ (turn / np.sqrt(np.maximum(strength, 1e-6 * strength[-1])))
    return idf, np.linalg.svd(root, full_matrices=False)[0][:, :RANK]


def in_order(pattern: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per pattern word."""
    where: dict[int, int] = {}
    for place, word in enumerate(pattern.tolist()):
        where[word] = where.get(word, 0) | 1 << place
    full = (1 << len(pattern)) - 1
    row = full
    for word in window.tolist():
        hits = row & where.get(word, 0)
        if hits:
            row = (row + hits | row - hits) & full
    return len(pattern) - row.bit_count()


def judge(pattern: np.ndarray, answer: int, window: np.ndarray) -> tuple[float, bool, bool]:
    """Share of the item's words in order, whether its answer is there, and whether that is a leak."""
    share = in_order(pattern, window) / len(pattern)
    if len(pattern) < SHORT_ITEM:
        return share, share == 1.0, share == 1.0
    answered = in_order(pattern[answer:], window) >= ANSWER * (len(pattern) - answer)
    return share, answered, share >= MOST or (share >= SOME and answered)


@dataclass
class Screen:
    """Rarest words of the items: ``keys`` are ``word * items + item``, sorted; of item ``i``, ``least[i]`` must be near."""

    keys: np.ndarray
    starts: np.ndarray  # per word, where its items begin
    least: np.ndarray
    sizes: np.ndarray  # words of each item

    @classmethod
    def over(cls, items: Items, idf: np.ndarray) -> Screen:
        """Leaves out the commonest words of an item as long as what is left must hold ``RARE`` of its words."""
        keys, least, number = [], [], len(items.words)
        for i, (words, needed) in enumerate(zip(items.words, items.needed.tolist())):
            order = words[np.argsort(idf[words], kind="stable")]
            rare = np.unique(order[max(0, needed - max(1, round(RARE * len(words)))):])
            keys.append(rare * number + i)
            least.append(needed - int((~np.isin(words, rare)).sum()))
        keys = np.sort(np.concatenate(keys))
        starts = np.searchsorted(keys, np.arange(len(idf) + 1) * number)
        return cls(keys, starts, np.array(least), np.array([len(w) for w in items.words]))


@dataclass
class Layout:
    """Texts laid out block after block with an empty block behind each, for a search of them all at once."""

    rows: list[np.ndarray]

    def __post_init__(self):
        self.blocks = np.array([max(1, -(-len(row) // BLOCK)) for row in self.rows])
        self.first = np.cumsum(self.blocks + 1) - self.blocks - 1
        self.end = int(self.blocks.sum()) + len(self.rows)
        words = np.concatenate(self.rows)
        lengths = np.array([len(row) for row in self.rows])
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places = np.repeat(self.first * BLOCK, lengths) + inside
        self.words, self.places = words[words >= 0], places[words >= 0]


def near_pairs(layout: Layout, screen: Screen, lower: int = 0, upper: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``(row, first block of the passage, item)`` of every pair the bound allows, for items of a range.

    A leak of an item into a passage needs the item's least number of rare words in the passage and as many words
    on each side of it as the item has, which is where a leak is looked for.
    """
    number = len(screen.sizes)
    upper = number if upper is None else upper
    if upper - lower == number:
        begin, finish = screen.starts[layout.words], screen.starts[layout.words + 1]
    else:
        words, inverse = np.unique(layout.words, return_inverse=True)
        begin = np.searchsorted(screen.keys, words * number + lower)[inverse]
        finish = np.searchsorted(screen.keys, words * number + upper)[inverse]
    counts = finish - begin
    total = int(counts.sum())
    if total > PAIR_ROWS and upper - lower > 1:
        middle = (lower + upper) // 2
        yield from near_pairs(layout, screen, lower, middle)
        yield from near_pairs(layout, screen, middle, upper)
        return
    index = np.arange(total) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    span = (layout.end + 1) * BLOCK
    met = np.sort(screen.keys[index] % number * span + np.repeat(layout.places, counts))
    item, place = met // span, met % span
    row = np.searchsorted(layout.first, place // BLOCK, side="right") - 1
    last = np.arange(total) + screen.least[item] - 1
    start = np.flatnonzero(last < total)
    last = last[start]
    same = (item[start] == item[last]) & (row[start] == row[last])
    near = same & (place[last] - place[start] < 2 * BLOCK + 2 * screen.sizes[item[start]])
    start, last = start[near], last[near]
    item, row, size = item[start], row[start], screen.sizes[item[start]]
    # Passages whose surroundings hold the run from start to last; passages begin at every block but a text's last.
    low = np.maximum(-(-(place[last] + 1 - size) // BLOCK) - 2, layout.first[row])
    high = np.minimum((place[start] + size) // BLOCK, layout.first[row] + np.maximum(layout.blocks[row] - 2, 0))
    again = np.zeros(len(item), bool)
    again[1:] = (item[1:] == item[:-1]) & (row[1:] == row[:-1])
    low = np.maximum(low, np.where(again, np.roll(high, 1), -1) + 1)  # each passage once: ends rise along a text
    length = np.maximum(high - low + 1, 0)
    block = np.arange(int(length.sum())) + np.repeat(low - (np.cumsum(length) - length), length)
    yield np.repeat(row, length), block, np.repeat(item, length)


def cosines(layout: Layout, blocks: np.ndarray, items: np.ndarray, words: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Cosine in the latent space of each passage, given by its first block, and item; only these passages are projected."""
    passages, which = np.unique(blocks, return_inverse=True)
    wanted = np.zeros(layout.end + 1, bool)
    wanted[passages] = wanted[passages + 1] = True
    block = layout.places // BLOCK
    held = wanted[block]
    names, starts = np.unique(block[held], return_index=True)
    place = np.full(layout.end + 1, len(names))
    place[names] = np.arange(len(names))
    sums = np.zeros((len(names) + 1, words.shape[1]), np.float32)
    if len(names):
        sums[:-1] = np.add.reduceat(words[layout.words[held]], starts, axis=0)
    vectors = sums[place[passages]] + sums[place[passages + 1]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return np.einsum("ij,ij->i", vectors[which], targets[items])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", cosine: float = COSINE, part_chars: int = PART_CHARS) -> DataFrame:
    """``(key, item, cosine, words_in_order, answer_found)``: a row per document and item that leaks into it.

    Null texts and texts without words leak nothing, items without words are in nothing; a null key stays null.
    Repeated rows give one row. The search takes no more than a slice of passages at a time and moves no text: the
    only shuffles are of word counts and of the rows found. A benchmark of any size is searched in parts of about
    ``part_chars`` characters, each with a latent space of its own, and the rows of all parts are put together.
    """
    parts = benchmark_parts(benchmark, item_text, part_chars)
    if len(parts) == 1:
        return part_leaks(docs, parts[0], key, text, item, item_text, cosine)
    found = [saved(part_leaks(docs, part, key, text, item, item_text, cosine), "part-leaks") for part in parts]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    facts = F.max(F.struct("words_in_order", "answer_found", "cosine")).alias("f")  # one item may have several texts
    return every.groupBy(key, item).agg(facts).select(key, item, "f.cosine", "f.words_in_order", "f.answer_found")


def part_leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, cosine: float) -> DataFrame:
    """:func:`leaks` for a part of the benchmark that goes to every worker."""
    spark = docs.sparkSession
    items = read_items(benchmark, item, item_text)
    kinds = docs.select(docs[key].alias("k")).schema["k"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    if not items.words:
        return spark.createDataFrame([], f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, cosine double, "
                                         "words_in_order double, answer_found boolean")
    table = saved(coded(docs, items, key, text), "coded")
    idf, space = latent_space(table, items)
    own = [np.unique(w, return_counts=True) for w in items.words]
    centres = np.stack([(weights(p, c, idf)[:, None] * space[p]).sum(axis=0) for p, c in own])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((items, (idf[:, None] * space).astype(np.float32), centres.astype(np.float32),
                                           Screen.over(items, idf)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, words, targets, screen = shared.value
        counts, needed = [np.unique(w, return_counts=True) for w in bench.words], bench.needed.tolist()

        def judged(rows: list[np.ndarray]) -> Iterator[tuple[int, int, tuple]]:
            """Row, item, and what was found, of every leak into these texts."""
            layout = Layout(rows)
            for row, block, i in near_pairs(layout, screen):
                likeness = cosines(layout, block, i, words, targets)
                close = np.flatnonzero(likeness >= cosine)
                close = close[np.argsort(block[close], kind="stable")]
                passage = block[close] - layout.first[row[close]]
                for r, p, j, value in zip(row[close].tolist(), passage.tolist(), i[close].tolist(), likeness[close].tolist()):
                    pattern = bench.words[j]
                    window = rows[r][max(0, p * BLOCK - len(pattern)):(p + 2) * BLOCK + len(pattern)]
                    held, times = np.unique(window, return_counts=True)
                    place = np.minimum(np.searchsorted(held, counts[j][0]), len(held) - 1)
                    common = np.where(held[place] == counts[j][0], np.minimum(times[place], counts[j][1]), 0)
                    if common.sum() < needed[j]:
                        continue  # too few of the item's words are there in any order
                    share, answered, leak = judge(pattern, bench.answers[j], window)
                    if leak:
                        yield r, j, (share, answered, value)

        for batch in batches:
            rows = [np.frombuffer(raw, "<i4").astype(np.int64) for raw in batch.column(1).to_pylist()]
            best: dict[tuple[int, int], tuple] = {}
            start = 0
            while start < len(rows):
                end, held = start, 0
                while end < len(rows) and (end == start or held + len(rows[end]) <= SEARCH_WORDS):
                    held += len(rows[end])
                    end += 1
                for row, i, found in judged(rows[start:end]):
                    best[start + row, i] = max(best.get((start + row, i), found), found)
                start = end
            found = list(best.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([p for p, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.bool_())], ["k", "i", "cosine", "words_in_order", "answer_found"])

    found = table.mapInArrow(run, f"k {kinds[0]}, i long, cosine double, words_in_order double, answer_found boolean")
    # From an Arrow table: rows of Python objects would be read by further workers, which stay beside those at work.
    names = spark.createDataFrame(pa.table({"i": range(len(items.keys)), "name": items.keys}), f"i long, name {kinds[1]}")
    best = found.groupBy("k", "i").agg(F.max(F.struct("words_in_order", "answer_found", "cosine")).alias("f"))
    return best.join(F.broadcast(names), "i").select(
        F.col("k").alias(key), F.col("name").alias(item), "f.cosine", "f.words_in_order", "f.answer_found")
