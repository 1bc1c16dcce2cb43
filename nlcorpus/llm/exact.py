"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are read once, for their SHA-256, byte length, id and place. Every Arrow batch of these makes a **run**: its
distinct digests in order, each with the row that stays and the number of rows. Runs then go through rounds of a
binomial exchange between ``2 ** (bits * rounds)`` nodes. In a round the nodes that differ in one digit of their number form a
group; each cuts its run by the next leading digit of the digests and sends every stretch to the group's member of that
digit, which merges what it gets. So the number of runs falls and their digest range narrows alike in every round, no
node ever holds more than its even share of the distinct digests, and copies collapse at every level: a text held by a
third of all rows is one record per run. Digests are compared whole, and with them the byte length.

Only rows of repeated texts meet their class at the end; the join salts texts that weigh more than an even share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import lookup_join
from nlcorpus.llm.common import saved

BITS = 3  # of the digest in one digit: 8 runs are merged at once, and a run is cut into 8 stretches
NODE_RECORDS = 16_384  # distinct digests that a node is to hold at the end, about; more nodes are used for more

#: One record of a run; a digest is four numbers, the leading one first. ``named`` is 0 where the id is null.
RECORD = np.dtype([("digest", "<u8", 4), ("size", "<i8"), ("id", "<i8"), ("place", "<i8"), ("named", "<i8"), ("n", "<i8")])


def merged(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run of sorted runs: equal digests and sizes become one record with the summed number of rows.

    The least (or largest) id stays, a null one only when there is no other, and of equal ids the least place.
    """
    records = np.concatenate(runs) if len(runs) != 1 else runs[0]
    if len(records) < 2:
        return records
    digest = records["digest"]
    # A stable sort of the leading words finds the runs and merges them; whole digests decide where those are equal.
    order = np.argsort(digest[:, 0], kind="stable")
    lead = digest[order, 0]
    if np.any(lead[1:] == lead[:-1]):
        ids = ~records["id"] if largest else records["id"]  # the complement turns the order round without overflow
        order = np.lexsort((records["place"], ids, -records["named"], records["size"], digest[:, 3], digest[:, 2],
                            digest[:, 1], digest[:, 0]))
    records, digest = records[order], digest[order]
    new = np.any(digest[1:] != digest[:-1], axis=1) | (records["size"][1:] != records["size"][:-1])
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    kept = records[first]
    kept["n"] = np.add.reduceat(records["n"], first)
    return kept


def _parts(records: np.ndarray, node: int, level: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """What a node sends in a round: to every member of its group the stretch of its run that has that digit.

    Digits are the leading bits of the digest. Those before ``level`` are alike in a node's run, so a stretch is whole.
    """
    digits = (records["digest"][:, 0] >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
    bounds = np.searchsorted(digits, np.arange((1 << bits) + 1, dtype=np.uint64))
    base = node & ~(((1 << bits) - 1) << bits * level)
    for digit in range(1 << bits):
        if bounds[digit] < bounds[digit + 1]:
            yield base | digit << bits * level, records[bounds[digit]:bounds[digit + 1]]


def _blobs(parts: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    parts = list(parts)
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int64()),
                                       pa.array([r.tobytes() for _, r in parts], pa.binary())], ["node", "run"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, digest, size, place)``: SHA-256 and byte length of every whole text, and a number of the row's own."""
    content = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[key].cast("long").alias("id"), F.unhex(F.sha2(content, 256)).alias("digest"),
                       F.octet_length(content).cast("long").alias("size"))
    return rows.withColumn("place", F.monotonically_increasing_id())


def classes(prints: DataFrame, largest: bool = False, bits: int = BITS, node_records: int = NODE_RECORDS) -> DataFrame:
    """``(digest, size, keep_id, keep_place, group_size)``: one row per distinct text of :func:`fingerprints`."""
    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            records = np.zeros(batch.num_rows, dtype=RECORD)
            ids, digests, sizes, places = (batch.column(i) for i in range(4))
            raw = b"".join(digests.to_pylist())
            records["digest"] = np.frombuffer(raw, dtype=">u8").reshape(-1, 4)
            records["size"], records["place"] = sizes.to_numpy(), places.to_numpy()
            records["id"] = ids.fill_null(0).to_numpy()
            records["named"], records["n"] = ids.is_valid().to_numpy(zero_copy_only=False), 1
            run = merged([records], largest)
            home = int(run["digest"][0, 3]) % nodes  # chance, but the same when a task is run again
            yield _blobs(_parts(run, home, 0, bits))

    def exchange(level: int):
        def merge(table: pa.Table) -> pa.Table:
            run = merged([np.frombuffer(b, dtype=RECORD) for b in table.column("run").to_pylist()], largest)
            node = table.column("node")[0].as_py()
            return pa.Table.from_batches([_blobs(_parts(run, node, level, bits))])

        return merge

    def last(table: pa.Table) -> pa.Table:
        run = merged([np.frombuffer(b, dtype=RECORD) for b in table.column("run").to_pylist()], largest)
        raw = run["digest"].astype(">u8").tobytes()
        return pa.table({"digest": [raw[i:i + 32] for i in range(0, len(raw), 32)], "size": run["size"],
                         "keep_id": pa.array(run["id"], pa.int64(), mask=run["named"] == 0), "keep_place": run["place"],
                         "group_size": run["n"]})

    rows, rounds = prints.count(), 1
    while node_records << bits * rounds < rows:
        rounds += 1
    nodes = 1 << bits * rounds
    level = prints.select("id", "digest", "size", "place").mapInArrow(runs, "node long, run binary")
    for at in range(1, rounds):
        level = level.groupBy("node").applyInArrow(exchange(at), "node long, run binary")
    return level.groupBy("node").applyInArrow(
        last, "digest binary, size long, keep_id long, keep_place long, group_size long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = False, bits: int = BITS,
          node_records: int = NODE_RECORDS) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``: every row, with the row of its text that stays.

    ``key`` is a whole number. Null texts are empty texts. Of equal texts the least key stays, or the largest; a null
    key only where the text has no other. Of rows with the same key and text one stays, so exactly one row of every
    text has ``kept``; ``group_size`` counts rows. Other columns are not carried; join on the key, or filter by it.
    """
    prints = saved(fingerprints(docs, key, text), "fingerprints")
    found = classes(prints, largest, bits, node_records)
    code = F.hex(F.concat("digest", F.to_binary(F.lpad(F.hex("size"), 16, "0"), F.lit("hex")))).alias("code")
    repeated = found.where("group_size > 1").select(code, "keep_id", "keep_place", "group_size")
    joined = lookup_join(prints.select("id", "digest", "place", code), repeated, "code", "group_size", ["place"])
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).cast(docs.schema[key].dataType).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = False) -> DataFrame:
    """``docs`` without the rows of equal texts but one, chosen as in :func:`dedup`, with all columns."""
    numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    renamed = numbered.select(F.col("__row").alias("place"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    content = F.coalesce("t", F.lit("")).cast("binary")
    prints = renamed.select("id", F.unhex(F.sha2(content, 256)).alias("digest"),
                            F.octet_length(content).cast("long").alias("size"), "place")
    stays = saved(classes(prints, largest).select(F.col("keep_place").alias("__row")), "digest-classes")
    return numbered.join(stays, "__row", "left_semi").drop("__row")
