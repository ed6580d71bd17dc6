"""Exact substring deduplication by a blockwise suffix order with a difference cover.

Two places where the same 200 bytes start are found as equal neighbours in the order of all suffixes, cut at 200 bytes.  That
order is built without holding it:

1. Cover sample.  Positions whose residue is in a difference cover modulo 133 are 9 % of all, and of any two positions some
   common shift below 133 leads to two of the sample.  Equal 200-byte strings thus share a 68-byte string between sample
   positions.  The sample's suffixes are dealt into buckets by the hash of these bytes; one bucket is sorted at a time, and
   its ranks say which sample suffixes tie.
2. Long ties.  Tied sample positions are ranked once more by their next 332 bytes.  A tie settles 133 positions at once: each
   starts 200 bytes that lie in the tied ones.  In a long repeat such positions follow each other at most 133 apart.
3. Suffixes.  Only positions up to 132 bytes before a tied sample position can start a repeated string.  They are dealt into
   buckets by a hash of 200 bytes, again sorted one bucket at a time; ties are repeats.  Of long ties only the first block
   deals out the suffixes: all others have the same ones, and every chain of such firsts ends at a block that deals.

Texts are packed into blocks of about 2 MB, stored once in a bucketed table.  A longer text is cut into pieces that share 199
bytes: each place where 200 bytes start is whole in one piece, and what is removed near a cut is put together in the end by
streaming the pieces in order.  A block sends each of its distinct keys to a
bucket once, so a passage that a third of all documents share costs one key per block, and gets one bit per key back.  What
moves is keys and bits; but for the pieces of long ones, texts are never shuffled.  Order and ties are those of window hashes, not
of bytes: equal keys are taken as equal bytes, wrong with a probability below n^2 / 2^65 for n distinct windows.  Buckets are as many as keep one within a task's memory.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, small_batches

LEAST = 200
# A perfect difference set; every residue modulo 133 but 0 is the difference of exactly one pair.
MODULUS = 133
COVER = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
SAMPLE = LEAST - MODULUS + 1
LONG = LEAST + MODULUS - 1
OVERLAP = LEAST - 1
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
SAMPLE_KEY_BYTES, KEY_BYTES = 5, 8
BLOCKS_AT_ONCE = 4
CACHED = 1 << 14
KEY_SEED, BUCKET_SEED = 1, 2
BASE = int(np.random.default_rng(0).integers(0, 2**63)) << 1 | 1


def packed_blocks(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block_id, ids, sizes, data, long_id, piece): whole texts one after the other, with -1 as ``long_id``; a text beyond
    the block size in pieces, each a block, with the number of the first one as ``long_id``."""

    def of_partition(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block(ids, texts, long_id=-1, piece=-1):
            return pd.DataFrame({"block_id": [(part << 32) + made], "ids": [ids], "sizes": [[len(t) for t in texts]],
                                 "data": [b"".join(texts)], "long_id": [long_id], "piece": [piece]})

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"]):
                data = (text or "").encode("utf-8")
                if len(data) > block_bytes:
                    long_id = (part << 32) + made
                    for piece in range(max(1, math.ceil((len(data) - OVERLAP) / block_bytes))):
                        at = piece * block_bytes
                        yield block([key], [data[at : at + block_bytes + OVERLAP]], long_id, piece)
                        made += 1
                    continue
                if texts and size + len(data) > block_bytes:
                    yield block(ids, texts)
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(key)
                texts.append(data)
                size += len(data)
        if texts:
            yield block(ids, texts)

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(of_partition, "block_id long, ids array<string>, sizes array<int>, data binary, long_id long, piece int")


class Block:
    """The texts of a block with window hashes at any position."""

    powers = shift = np.ones(0, dtype=np.uint64)

    def __init__(self, data: bytes, sizes) -> None:
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, at: np.ndarray, width: int, seed: int) -> np.ndarray:
        """64-bit hash of the ``width`` bytes at each position: a polynomial modulo 2^64 over random byte values, mixed.

        The sums of a block are made once for each seed and serve all widths; the powers serve all blocks of a task.
        """
        n = len(self.bytes)
        if len(Block.powers) <= n:
            for name, base in (("powers", BASE), ("shift", pow(BASE, -1, 2**64))):
                table = np.full(n + 1, np.uint64(base))
                table[0] = 1
                setattr(Block, name, np.cumprod(table, dtype=np.uint64))
        if seed not in self.sums:
            value = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
            self.sums[seed] = sums = np.zeros(n + 1, dtype=np.uint64)
            for a in range(0, n, CACHED):  # what lies between stays in the processor's cache
                part = value[self.bytes[a : a + CACHED]]
                part *= Block.powers[a : a + len(part)]
                part[:1] += sums[a : a + 1]
                np.cumsum(part, out=sums[a + 1 : a + 1 + len(part)])
        sums = self.sums[seed]
        out = (sums[at + width] - sums[at]) * Block.shift[at]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def sample(self) -> np.ndarray:
        """Cover positions, by place in their text, that have 68 bytes of it left."""
        longest = int(self.sizes.max(initial=0))
        offsets = (np.arange(0, longest, MODULUS)[:, None] + np.array(COVER)).ravel()
        count = np.searchsorted(offsets, self.sizes - SAMPLE, side="right")
        before = np.cumsum(count) - count
        return np.repeat(self.starts, count) + offsets[np.arange(count.sum()) - np.repeat(before, count)]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that each position lies in."""
        return np.searchsorted(self.ends, at, side="right")

    def left(self, at: np.ndarray) -> np.ndarray:
        """Bytes from each position to the end of its text."""
        return self.ends[self.text_of(at)] - at

    def covered(self, first: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Which positions lie in any of the ranges; both bounds ascend."""
        step = np.zeros(len(self.bytes) + 1, dtype=np.int8)
        apart = first[1:] > beyond[:-1]  # ranges that meet are one
        step[first[np.concatenate([[True], apart])[: len(first)]]] = 1
        step[beyond[np.concatenate([apart, [True]])[: len(first)]]] = -1
        return np.cumsum(step[:-1], dtype=np.int8).view(bool)

    def candidates(self, tied: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Positions, but for ``others``, with 200 bytes left and a tied sample position at most 132 bytes on."""
        near = self.covered(np.maximum(self.starts[self.text_of(tied)], tied - (MODULUS - 1)), tied + 1)
        near &= ~others
        at = np.flatnonzero(near)
        return at[self.left(at) >= LEAST]


class Keys:
    """Distinct keys of a block in the order of (bucket, key): what goes to the buckets, and what their answer means."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, width: int) -> None:
        joint = int(bucket.max(initial=0)).bit_length() + 8 * width <= 64
        whole = bucket.astype(np.uint64) << np.uint64(8 * width) | key if joint else key
        order = np.argsort(whole)
        b, k = bucket[order], key[order]
        other = b[1:] != b[:-1]
        if not joint and (other & (k[1:] == k[:-1])).any():  # one key in two buckets: rare, for it is of the same bytes nearly always
            order = np.lexsort((bucket, key))
            b, k = bucket[order], key[order]
            other = b[1:] != b[:-1]
        new = np.ones(len(order), dtype=bool)
        new[1:] = other | (k[1:] != k[:-1])
        b, k, place = b[new], k[new], np.cumsum(new) - 1
        if not joint:
            by_bucket = np.argsort(b.astype(np.uint16) if int(b.max(initial=0)) < 1 << 16 else b, kind="stable")
            rank = np.empty(len(b), dtype=np.int64)
            rank[by_bucket] = np.arange(len(b))
            b, k, place = b[by_bucket], k[by_bucket], rank[place]
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = place
        self.bucket, self.key = b, k
        self.often = np.bincount(self.of, minlength=len(self.key)) > 1

    def rows(self, block_id: int, width: int) -> pd.DataFrame:
        raw = np.ascontiguousarray(self.key).view(np.uint8).reshape(-1, 8)[:, :width]
        buckets, first = np.unique(self.bucket, return_index=True)
        parts = [raw[a:b].tobytes() for a, b in zip(first, [*first[1:], len(raw)])]
        return pd.DataFrame({"bucket": buckets.astype(np.int32), "block_id": np.full(len(parts), block_id), "keys": parts})

    def tied(self, answer) -> np.ndarray:
        """For each position whether its key is repeated, in another block or in this."""
        return (self._bits(answer, "flags") | self.often)[self.of]

    def later(self, answer) -> np.ndarray:
        """For each position whether a block before this one has its key."""
        return self._bits(answer, "later")[self.of]

    def _bits(self, answer, name: str) -> np.ndarray:
        ties = np.zeros(len(self.key), dtype=bool)
        first = np.searchsorted(self.bucket, np.arange(int(self.bucket[-1]) + 2)) if len(self.bucket) else [0]
        for part in answer:
            bucket, flags = part["bucket"], np.frombuffer(part[name], dtype=np.uint8)
            a, b = first[bucket], first[bucket + 1]
            ties[a:b] = np.unpackbits(flags, count=b - a).astype(bool)
        return ties


class Search:
    """What a block knows after each answer: tied sample positions, settled starts, and the starts it deals out."""

    def __init__(self, data: bytes, sizes, bits: tuple[int, ...]) -> None:
        self.block, self.bits = Block(data, sizes), bits

    def _keys(self, at: np.ndarray, width: int, bits: int) -> Keys:
        bucket = self.block.hashes(at, width, BUCKET_SEED) >> np.uint64(64 - bits)
        return Keys(bucket.astype(np.int64), self.block.hashes(at, width, KEY_SEED), KEY_BYTES)

    def sample_keys(self) -> Keys:
        self.at = self.block.sample()
        key = self.block.hashes(self.at, SAMPLE, KEY_SEED)
        low = key & np.uint64((1 << 8 * SAMPLE_KEY_BYTES) - 1)
        return Keys((key >> np.uint64(64 - self.bits[0])).astype(np.int64), low, SAMPLE_KEY_BYTES)

    def long_keys(self, sample_answer) -> Keys:
        keys = self.sample_keys()
        self.tied = self.at[keys.tied(sample_answer)]
        self.long = self.tied[self.block.left(self.tied) >= LONG]
        return self._keys(self.long, LONG, self.bits[1])

    def suffix_keys(self, sample_answer, long_answer) -> Keys:
        keys = self.long_keys(sample_answer)
        tied, later = self.long[keys.tied(long_answer)], self.long[keys.later(long_answer)]
        self.settled = self.block.covered(tied, tied + MODULUS)
        others = self.block.covered(later, later + MODULUS)
        self.open = self.block.candidates(self.tied, others)
        return self._keys(self.open, LEAST, self.bits[1])

    def repeated(self, sample_answer, long_answer, suffix_answer) -> np.ndarray:
        keys = self.suffix_keys(sample_answer, long_answer)
        self.settled[self.open[keys.tied(suffix_answer)]] = True
        return np.flatnonzero(self.settled)


def ties(keys: DataFrame, width: int) -> DataFrame:
    """(block_id, answer): for each block and bucket two bits per key, set if another block (``flags``) or a block before it
    (``later``) has the key too.  A task sorts one bucket at a time."""

    def of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [len(k) // width for k in rows["keys"]]
        raw = np.zeros((sum(counts), 8), dtype=np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint8).reshape(-1, width)
        key = raw.view(np.uint64).ravel()
        order = np.lexsort((np.repeat(rows["block_id"].to_numpy(), counts), key))
        same = key[order[1:]] == key[order[:-1]]
        later, tied = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
        later[order[1:][same]] = True
        tied[order[:-1][same]] = True
        tied |= later
        packed = [[np.packbits(part).tobytes() for part in np.split(bits, np.cumsum(counts)[:-1])] for bits in (tied, later)]
        return pd.DataFrame({"block_id": rows["block_id"], "bucket": rows["bucket"], "flags": packed[0], "later": packed[1]})

    flags = keys.groupBy("bucket").applyInPandas(of_bucket, "block_id long, bucket int, flags binary, later binary")
    return flags.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "flags", "later")).alias("answer"))


def _bits(n_keys: float, width: int) -> int:
    return min(24, max(3, math.ceil(math.log2(max(1.0, n_keys * (width + 8) / BUCKET_BYTES)))))


def deduplicated(documents: DataFrame, keep_bytes: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` the kept bytes.

    Strings are compared as UTF-8 bytes within documents; NULL and short texts lose nothing.  Repeated rows are each
    other's copies, so both lose what has 200 bytes.  ``block_bytes`` bounds what a task holds of a text at a time; only its
    size in memory depends on it.  What is removed is judged on the input, so that of a repeated passage
    no copy stays.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    n_bytes = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # long ties and open starts are fewer than an eighth of all bytes where most text is not repeated; if not, buckets grow
    bits = _bits(n_bytes * len(COVER) / MODULUS, SAMPLE_KEY_BYTES), _bits(n_bytes / 8, KEY_BYTES)
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    result = [column.split()[0] for column in schema.split(", ")]

    def sends(step: str, *answers: str):
        def of_partition(batches):
            for batch in batches:
                for row in batch.to_dict("records"):
                    search = Search(row["data"], row["sizes"], bits)
                    keys = getattr(search, step)(*[row[a] if row[a] is not None else [] for a in answers])
                    yield keys.rows(row["block_id"], SAMPLE_KEY_BYTES if step == "sample_keys" else KEY_BYTES)

        return of_partition

    def cut(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                search = Search(row["data"], row["sizes"], bits)
                answers = [row[a] if row[a] is not None else [] for a in ("sample_answer", "long_answer", "suffix_answer")]
                repeated = search.repeated(*answers)
                if row["long_id"] < 0:
                    yield _removed(search.block, row["ids"], repeated, keep_bytes).assign(long_id=-1, piece=-1, data=None, gone=None)
                else:
                    gone = np.packbits(search.block.covered(repeated, repeated + LEAST)).tobytes()
                    piece = {"doc_id": row["ids"], "long_id": row["long_id"], "piece": row["piece"], "data": row["data"], "gone": gone}
                    yield pd.DataFrame(piece).assign(n_bytes=0, n_removed=0, n_spans=0, kept_sha256=None, kept=None)

    def joined(batches):
        text = None
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                if text is None or text.long_id != row["long_id"]:
                    done += [] if text is None else [text.result()]
                    text = LongText(row["long_id"], row["doc_id"], block_bytes, keep_bytes)
                text.add(row["data"], row["gone"])
            yield pd.DataFrame(done, columns=result)
        yield pd.DataFrame([] if text is None else [text.result()], columns=result)

    def answered(blocks: DataFrame, step: str, *answers: str) -> DataFrame:
        """The blocks with the answers to the keys that ``step`` sends."""
        keys = blocks.select("block_id", "sizes", "data", *answers).mapInPandas(sends(step, *answers), "bucket int, block_id long, keys binary")
        width = SAMPLE_KEY_BYTES if step == "sample_keys" else KEY_BYTES
        found = scratch.write(ties(keys, width).withColumnRenamed("answer", step.replace("keys", "answer")))
        return blocks.join(found.hint("merge"), "block_id", "left")

    with Scratch(spark, "suffixes") as scratch:
        try:
            with small_batches(spark):
                n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
                blocks = packed_blocks(documents, block_bytes).write.bucketBy(n, "block_id").option("compression", "zstd")
                blocks.saveAsTable(name)
            with small_batches(spark, BLOCKS_AT_ONCE):
                blocks = answered(spark.table(name), "sample_keys")
                blocks = answered(blocks, "long_keys", "sample_answer")
                blocks = answered(blocks, "suffix_keys", "sample_answer", "long_answer")
                pieces = blocks.drop("block_id").mapInPandas(cut, f"{schema}, long_id long, piece int, data binary, gone binary")
                pieces = scratch.write(pieces, keep=True)
                # texts in pieces meet in the order of these
                ordered = pieces.where("long_id >= 0").repartition("long_id").sortWithinPartitions("long_id", "piece")
                long = ordered.select("long_id", "doc_id", "data", "gone").mapInPandas(joined, schema)
                out = pieces.where("long_id < 0").select(*result).unionByName(scratch.write(long, keep=True))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


class LongText:
    """Result of a text whose pieces come by in order: what a piece removes of the bytes it shares with the next is carried."""

    def __init__(self, long_id: int, doc_id, step: int, keep_bytes: bool) -> None:
        self.long_id, self.doc_id, self.step = long_id, doc_id, step
        self.digest, self.kept = hashlib.sha256(), [] if keep_bytes else None
        self.n_bytes = self.n_removed = self.n_spans = 0
        self.inside = False
        self.data, self.gone = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=bool)

    def add(self, data: bytes, gone: bytes) -> None:
        carried = self.gone[self.step :]
        self._pass(self.data[: self.step], self.gone[: self.step])
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.gone = np.unpackbits(np.frombuffer(gone, dtype=np.uint8), count=len(self.data)).astype(bool)
        self.gone[: len(carried)] |= carried

    def _pass(self, data: np.ndarray, gone: np.ndarray) -> None:
        if not len(data):
            return
        kept = data[~gone].tobytes()
        self.digest.update(kept)
        if self.kept is not None:
            self.kept.append(kept)
        self.n_bytes += len(data)
        self.n_removed += int(gone.sum())
        self.n_spans += int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0] and not self.inside)
        self.inside = bool(gone[-1])

    def result(self) -> tuple:
        self._pass(self.data, self.gone)
        out = self.doc_id, self.n_bytes, self.n_removed, self.n_spans, self.digest.hexdigest()
        return out if self.kept is None else (*out, b"".join(self.kept))


def _removed(block: Block, ids, repeated: np.ndarray, keep_bytes: bool) -> pd.DataFrame:
    """Result rows of a block whose repeated strings start at ``repeated``."""
    gone = block.covered(repeated, repeated + LEAST)
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    first = block.starts[block.sizes > 0]
    rises[first] = gone[first]
    removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(rises)])
    kept = [block.bytes[a:b][~gone[a:b]].tobytes() for a, b in zip(block.starts, block.ends)]
    out = pd.DataFrame({
        "doc_id": ids, "n_bytes": block.sizes, "n_removed": removed[block.ends] - removed[block.starts],
        "n_spans": spans[block.ends] - spans[block.starts], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
    })
    return out.assign(kept=kept) if keep_bytes else out
