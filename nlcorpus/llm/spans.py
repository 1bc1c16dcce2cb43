"""Substring deduplication by sliding spans of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.llm.common import FINAL, MEMO_WORDS, MULTIPLIERS, mixed, saved, slices

RUN = 3  # sentences of a span, at least
RUN_WORDS = 10  # words of a span, at least: runs of very short sentences grow until they have them
MARGIN = 4  # words next to a break that end no further piece, so sentences of up to 14 words stay whole
WINDOW = 7  # words of which the one with the least hash ends a piece

#: Fixed pattern: after . ! ? and a blank, or after a line break.
BREAK = re.compile(r"(?<=[.!?][ \t])(?=[^ \t\n])|(?<=\n)(?=[^\n])")
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*")  # with the blanks behind it


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        plain = word.rstrip(" \t\n\x0b\x0c\r").encode("utf-8", "surrogatepass").lower()
        code = self[word] = xxhash.xxh3_64_intdigest(plain)
        return code


HASHES = _Hashes()


def least_places(codes: list[int]) -> list[int]:
    """Places of the least code, the last of equal ones, of every ``WINDOW`` codes in a row."""
    out, best = [], -1
    for end in range(WINDOW, len(codes) + 1):
        if best < end - WINDOW:
            window = codes[end - WINDOW:end]
            best = end - 1 - window[::-1].index(min(window))
        elif codes[end - 1] <= codes[best]:
            best = end - 1
        else:
            continue
        out.append(best)
    return out


def sentences(text: str | None) -> list[str]:
    """Pieces that join back to the text; null and empty texts have none.

    A sentence ends after a closing mark and a blank or after a line break. Besides, of every ``WINDOW`` words in a
    row that are ``MARGIN`` words away from a break, the one with the least hash (the last of equal ones) ends a piece.
    Only the ten words on either side tell whether a word does: 50 words without marks hold 30 that are cut alike
    wherever they stand, at least once in seven, which makes three whole pieces or more.
    """
    out = []
    for sentence in BREAK.split(text) if text else ():
        words = WORD.findall(sentence) if len(sentence) > 2 * (2 * MARGIN + WINDOW) - 2 else ()
        if len(words) < 2 * MARGIN + WINDOW:
            out.append(sentence)
            continue
        # What stands before the first word goes with it.
        words[0] = sentence[:len(sentence) - sum(map(len, words))] + words[0]
        start = 0
        for place in least_places([HASHES[w] for w in words[MARGIN:len(words) - MARGIN]]):
            end = MARGIN + place + 1
            out.append("".join(words[start:end]))
            start = end
        out.append("".join(words[start:]))
    return out


def _powers(base: int, count: int) -> np.ndarray:
    values = np.full(count + 1, base, dtype=np.uint64)
    values[0] = 1
    return np.cumprod(values, dtype=np.uint64)


def span_hashes(codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and two hashes of the spans of one text, given code and word count of its sentences.

    From each start the shortest run of ``RUN`` sentences or more with ``RUN_WORDS`` words or more, if there is one.
    The hash is a polynomial in the sentence codes, taken as a difference of prefix sums and shifted back.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    starts = np.arange(len(codes))
    ends = np.maximum(starts + RUN, np.searchsorted(total, total[:-1] + RUN_WORDS))
    starts = starts[ends <= len(codes)]
    ends = ends[:len(starts)]
    hashes = []
    for base in (int(MULTIPLIERS[0]), int(MULTIPLIERS[1])):
        powers = _powers(base, len(codes))
        back = _powers(pow(base, -1, 1 << 64), len(codes))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes ^ FINAL[0]) * powers[:-1], dtype=np.uint64)])
        hashes.append(mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return starts, ends, hashes[0], hashes[1]


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start, end, h1, h2, repeat)``: every span of every text, combined inside each slice of a task.

    Of the equal spans in a slice only the least (by key and start) goes on; the others are known to repeat it, get
    null hashes, and are cut down to what the removal needs.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            order = sorted(range(batch.num_rows), key=lambda r, k=batch.column(0).to_pylist(): (k[r] is None, k[r] or 0))
            texts = batch.column(1).to_pylist()
            parts = []
            for row in order:
                cut = [b" ".join(s.encode("utf-8", "surrogatepass").lower().split()) for s in sentences(texts[row])]
                solid = np.array([i for i, s in enumerate(cut) if s], dtype=np.int64)
                cut = [s for s in cut if s]
                if len(cut) < RUN:
                    continue
                codes = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), dtype=np.uint64, count=len(cut))
                words = np.fromiter((s.count(b" ") + 1 for s in cut), dtype=np.int64, count=len(cut))
                starts, ends, one, two = span_hashes(codes, words)
                parts.append((np.full(len(starts), row), solid[starts], solid[ends - 1] + 1, one, two))
            if not parts:
                continue
            row, start, end, one, two = (np.concatenate(p) for p in zip(*parts))
            _, first, inverse = np.unique(np.rec.fromarrays([one, two]), return_index=True, return_inverse=True)
            keys = batch.column(0).take(pa.array(row))
            number = np.unique([k if k is not None else -1 for k in keys.to_pylist()], return_inverse=True)[1]
            lead = first[inverse]
            same = (number[lead] == number) & (start[lead] == start)  # a repeated row is the same place, no repeat
            repeat = ~same
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(one, mask=repeat),
                pa.array(two, mask=repeat), pa.array(repeat)], ["k", "start", "end", "h1", "h2", "repeat"])

    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, start int, end int, h1 long, h2 long, repeat boolean")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut and ``n_sentences``, ``n_removed``, ``words_removed`` added.

    A span that occurs more than once in the corpus keeps its occurrence with the least (key, position); every
    sentence that another occurrence covers is removed, inside one text as well as across texts. The key is a number
    that names a document: rows that repeat it are copies of one row and are treated alike; null keys come last and
    count as one document. Null texts stay null, texts without sentences stay as they are. Columns of ``docs`` other
    than the text are kept; columns named like the added ones are replaced.

    Spans meet on their 128-bit hash, but only its first half is counted over all spans, combined before the shuffle.
    Spans whose half occurs twice are joined back, a join of two shuffled tables whose hot keys adaptive execution
    splits, and only these few are told apart by the whole hash and get their first place.
    """
    found = saved(spans(docs, key, text), "spans")
    alone = found.where(~F.col("repeat")).drop("repeat")
    twice = saved(alone.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "twice")
    met = saved(alone.join(twice, "h1"), "met")
    place = F.struct(F.col("k").isNull().alias("last"), "k", "start")
    firsts = saved(met.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("f")).where("n > 1")
                   .select("h1", "h2", F.col("f.k").alias("fk"), F.col("f.start").alias("fs")), "firsts")
    later = met.join(firsts, ["h1", "h2"]).where(
        ~(F.col("k").eqNullSafe(F.col("fk")) & (F.col("start") == F.col("fs"))))
    gone = (later.select("k", "start", "end").unionByName(found.where("repeat").select("k", "start", "end"))
            .groupBy(F.col("k").alias("__k")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__gone")))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "words_removed")]
    joined = docs.select(kept).join(gone, F.col(key).eqNullSafe(F.col("__k")), "left")
    joined = joined.select(*[c for c in kept if c != text], F.col("__gone.start").alias("__from"),
                           F.col("__gone.end").alias("__to"), text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for starts, ends, value in zip(*(column.to_pylist() for column in batch.columns[-3:])):
                cut = sentences(value)
                keep = np.ones(len(cut) + 1, dtype=bool)
                for a, b in zip(starts or (), ends or ()):
                    keep[a:b] = False
                left = [s for s, k in zip(cut, keep) if k]
                lost = sum(len(s.split()) for s, k in zip(cut, keep) if not k)
                rows.append((None if value is None else "".join(left), len(cut), len(cut) - len(left), lost))
            texts, total, removed, lost = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(lost, pa.int64())], [*batch.schema.names[:-3], text, "n_sentences", "n_removed", "words_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-3])
    added = f"`{text}` string, n_sentences long, n_removed long, words_removed long"
    out = joined.mapInArrow(run, f"{fields}, {added}" if fields else added)
    return out.select(*kept, "n_sentences", "n_removed", "words_removed")
