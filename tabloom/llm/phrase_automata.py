"""Collocations: weighted acyclic automata count the phrases of text shards, their unions by prefix range count those of all.

A shard of some million words sorts its phrases and builds a minimal acyclic automaton over (lang, word, word, ...): equal states
are shared through a register, and the weight of a path's last transition is the phrase's count.  Its symbols are ranks in the
shard's own sorted word list, so that no dictionary of all words is needed.  The automaton is cut at sampled splitters into
prefix ranges; a task unites all automata of a range and adds their weights.  Words and pairs come first; triples are built only
of pairs that may be frequent, by a Bloom filter of bounded size.  The counts of a phrase's parts are looked up by composing the
automata on the part, which is a join of the path tables.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.common import Scratch, small_batches
from tabloom.operators.skew import look_up

LEAST = 10
TOP = 2000
TOP_BUCKETS = 32
SHARD_WORDS = 1_000_000
RANGE_BYTES = 16 << 20
FRAME_BYTES = 1 << 20
MAX_RANGES = 20_000
SAMPLE_TEXTS = 2000
SAMPLE_PAIRS = 32
UNION_ROWS = 1_000_000
FILTER_BITS = (16, 28)
FILTER_BLOCKS = 8  # as a power of two
FILTER_HASHES = 1_000_000
NO_LANG = "und"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)  # a byte that UTF-8 never has
_MARK = b"\xff"
_ROWS = "lang string, phrase string, words int, f long"


# --- words ------------------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, A-Z in lower case, with a mark between pieces."""
    if not text:
        return []
    return text.encode().lower().translate(_ENDS).replace(_MARK, b" \xff ").split()


class Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of some texts as numbers; ``ranked`` turns these into ranks of the sorted word list."""

    def __init__(self) -> None:
        self.number, self.langs, self.parts, self.size = Numbers({_MARK: 0}), {}, [], 0

    def add(self, lang: str | None, words: list[bytes]) -> None:
        known = self.langs
        of = known.setdefault(NO_LANG if lang is None else lang, len(known))
        ids = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        self.parts.append((of, ids))
        self.size += len(words)

    def ranked(self) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
        """Sorted languages, sorted words, and for each position the rank of its language and word, -1 for a mark."""
        words = sorted(w for w in self.number if w != _MARK)
        rank = np.empty(len(self.number), dtype=np.int64)
        rank[0] = -1
        rank[np.fromiter((self.number[w] for w in words), dtype=np.int64, count=len(words))] = np.arange(len(words))
        langs = sorted(x.encode() for x in self.langs)
        place = {x: i for i, x in enumerate(langs)}
        of = {i: place[x.encode()] for x, i in self.langs.items()}
        gap = np.array([-1])
        ids = np.concatenate([gap, *[x for _, part in self.parts for x in (rank[part], gap)]])
        lang = np.concatenate([[0], *[np.full(len(part) + 1, of[i]) for i, part in self.parts]])
        return langs, words, lang, ids


def shards(batches, limit: int):
    """Shards of at most ``limit`` words, but for one longer text, of pandas batches with lang and text."""
    now = Shard()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = words_of(text)
            if not words:
                continue
            if now.size and now.size + len(words) > limit:
                yield now
                now = Shard()
            now.add(lang, words)
    if now.size:
        yield now


# --- automata ---------------------------------------------------------------------------------------------------------


def _register(symbol: np.ndarray, weight: np.ndarray, target: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """State of each slice of transitions, equal slices sharing one, and the transitions of the states: lengths, symbols,
    weights, targets.  State 0 has none."""
    lengths = np.diff(bounds)
    state = np.zeros(len(lengths), dtype=np.int64)
    single = np.flatnonzero(lengths == 1)
    at = bounds[:-1][single]
    base_w, base_t = int(weight.max(initial=0)) + 1, int(target.max(initial=0)) + 1
    if len(single) and (int(symbol.max()) + 1) * base_w * base_t < 2**62:
        _, first, back = np.unique((symbol[at] * base_w + weight[at]) * base_t + target[at], return_index=True, return_inverse=True)
    else:
        first, back = np.arange(len(single)), np.arange(len(single))
    state[single] = back + 1
    register, lows = {}, []
    table = np.stack([symbol, weight, target], axis=1)
    several = []
    for i in np.flatnonzero(lengths > 1).tolist():
        low, high = int(bounds[i]), int(bounds[i + 1])
        key = table[low:high].tobytes()
        if key not in register:
            register[key] = len(first) + len(register) + 1
            several.append(high - low)
            lows.append(low)
        state[i] = register[key]
    several = np.array(several, dtype=np.int64)
    ends = np.cumsum(several)
    rest = np.arange(several.sum()) + np.repeat(np.array(lows, dtype=np.int64) - ends + several, several)
    kept = np.concatenate([at[first], rest]).astype(np.int64)
    sizes = np.concatenate([np.ones(len(first), dtype=np.int64), several])
    return state, [sizes, symbol[kept], weight[kept], target[kept]]


def built(columns: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """The minimal automaton of sorted distinct rows of symbols (-1 after a row's end) with a count each: four arrays a level,
    the root's level first."""
    depth, n = len(columns), len(counts)
    new, node, starts = np.zeros(n, dtype=bool), [], []
    new[:1] = True
    for column in columns:
        new = new.copy()
        new[1:] |= column[1:] != column[:-1]
        starts.append(np.flatnonzero(new & (column >= 0)))
        node.append(np.cumsum(new & (column >= 0)) - 1)
    target = np.zeros(len(starts[-1]), dtype=np.int64)
    levels = []
    for d in reversed(range(depth)):
        at = starts[d]
        ends_here = np.ones(len(at), dtype=bool) if d == depth - 1 else columns[d + 1][at] < 0
        weight = np.where(ends_here, counts[at], 0)
        parents = len(starts[d - 1]) if d else 1
        parent = node[d - 1][at] if d else np.zeros(len(at), dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))])
        target, arrays = _register(columns[d][at], weight, target, bounds)
        levels.append(arrays)
    return [a for arrays in reversed(levels) for a in arrays]


def paths(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of symbols that an automaton accepts, sorted, and their counts."""
    depth = len(arrays) // 4
    prefix, state = [], np.array([1 if len(arrays[0]) else 0])
    found, found_counts = [], []
    for d in range(depth):
        sizes, symbol, weight, target = arrays[4 * d : 4 * d + 4]
        offset = np.concatenate([[0, 0], np.cumsum(sizes)])  # of state s at s; state 0 is empty
        length = np.concatenate([[0], sizes])[state]
        back = np.repeat(np.arange(len(state)), length)
        at = np.arange(len(back)) - np.repeat(np.cumsum(length) - length, length) + offset[state][back]
        prefix = [p[back] for p in prefix] + [symbol[at]]
        state, ends = target[at], weight[at] > 0
        blank = np.full(int(ends.sum()), -1)
        found.append([p[ends] for p in prefix] + [blank] * (depth - d - 1))
        found_counts.append(weight[at][ends])
    columns = [np.concatenate([f[d] for f in found]).astype(np.int64) for d in range(depth)]
    counts = np.concatenate(found_counts)
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns], counts[order].astype(np.int64)


def packed_arrays(arrays: list[np.ndarray]) -> bytes:
    out = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        out.append(np.array([len(a), a.itemsize], dtype="<i4").tobytes() + a.tobytes())
    return b"".join(out)


def unpacked_arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = (int(x) for x in np.frombuffer(data, "<i4", 2, at))
        out.append(np.frombuffer(data, f"<u{size}", n, at + 8).astype(np.int64))
        at += 8 + n * size
    return out


def serialised(langs: list[bytes], words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """An automaton with the names of its symbols; symbols that no row uses are left out."""
    used_langs, used = np.unique(columns[0]), np.unique(np.concatenate(columns[1:]))
    used = used[used >= 0]
    columns = [np.searchsorted(used_langs, columns[0])] + [np.where(c < 0, -1, np.searchsorted(used, c)) for c in columns[1:]]
    names = [langs[i] for i in used_langs.tolist()] + [words[i] for i in used.tolist()]
    head = packed_arrays([np.array([len(used_langs)]), np.fromiter(map(len, names), dtype=np.int64, count=len(names))])
    body = packed_arrays(built(columns, counts))
    return np.array([len(head), len(body)], dtype="<i4").tobytes() + head + body + b"".join(names)


def read_back(data: bytes) -> tuple[list[bytes], list[bytes], list[np.ndarray], np.ndarray]:
    head, body = (int(x) for x in np.frombuffer(data, "<i4", 2))
    (n_langs,), lengths = unpacked_arrays(data[8 : 8 + head])
    columns, counts = paths(unpacked_arrays(data[8 + head : 8 + head + body]))
    ends = (np.cumsum(lengths) + 8 + head + body).tolist()
    names = [data[b - n : b] for b, n in zip(ends, lengths.tolist())]
    return names[: int(n_langs)], names[int(n_langs) :], columns, counts


# --- shards to ranges -------------------------------------------------------------------------------------------------


def _keys(lang: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Order of (language, word, second word or -1) as one number, for ``n`` words."""
    return (lang * n + first) * (n + 1) + second + 1


def cuts(langs: list[bytes], words: list[bytes], splitters: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """The splitters as numbers in the order of ``_keys``: the least number not before each."""
    n, out = len(words), []
    for lang, first, second in splitters:
        i = bisect_left(langs, lang)
        if i == len(langs) or langs[i] != lang:
            out.append(i * n * (n + 1))
            continue
        j = bisect_left(words, first)
        if j == n or words[j] != first:
            out.append((i * n + j) * (n + 1))
            continue
        out.append((i * n + j) * (n + 1) + bisect_left(words, second) + 1)
    return np.array(out, dtype=np.int64)


def words_and_pairs(lang: np.ndarray, ids: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (language, word) and (language, word, word): columns, counts, order numbers."""
    one = np.flatnonzero(ids >= 0)
    two = one[ids[one + 1] >= 0]
    keys = np.concatenate([_keys(lang[one], ids[one], np.int64(-1), n), _keys(lang[two], ids[two], ids[two + 1], n)])
    keys, counts = np.unique(keys, return_counts=True)
    return [keys // (n + 1) // n, keys // (n + 1) % n, keys % (n + 1) - 1], counts, keys


def triples(lang: np.ndarray, ids: np.ndarray, n: int, may_be) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (language, word, word, word) whose pairs both pass ``may_be(lang, first, second)``."""
    two = np.flatnonzero(ids[:-1] >= 0)
    two = two[ids[two + 1] >= 0]
    pairs, back = np.unique(_keys(lang[two], ids[two], ids[two + 1], n), return_inverse=True)
    of, first, second = pairs // (n + 1) // n, pairs // (n + 1) % n, pairs % (n + 1) - 1
    passes = may_be(of, first, second)[back]
    follows = np.flatnonzero(passes[:-1] & passes[1:] & (two[1:] == two[:-1] + 1))
    keys, counts = np.unique(back[follows] * n + ids[two[follows] + 2], return_counts=True)
    at = keys // n
    return [of[at], first[at], second[at], keys % n], counts, pairs[at]


class PairFilter:
    """Bloom filter of (language, word, word) with two probes; ``cells`` holds its bits."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @staticmethod
    def hashes(langs: list[bytes], words: list[bytes], lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        of_lang = np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], dtype=np.uint64)
        of_word = np.array([xxhash.xxh64_intdigest(x, 2) for x in words], dtype=np.uint64)
        x = of_lang[lang]
        for part in (of_word[first], of_word[second]):
            x = (x ^ part) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return x

    @staticmethod
    def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        """Two bit numbers below 2**bits for each hash."""
        return [(hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)]

    def admits(self, langs: list[bytes], words: list[bytes]):
        bits = int(np.log2(len(self.cells) * 64))

        def may_be(lang, first, second):
            hashes, out = self.hashes(langs, words, lang, first, second), np.ones(len(lang), dtype=bool)
            for probe in self.probes(hashes, bits):
                out &= (self.cells[probe >> 6] >> (probe & 63).astype(np.uint64)) & np.uint64(1) == 1
            return out

        return may_be


def pair_filter(pairs: DataFrame) -> PairFilter:
    """Filter of the pairs (lang, phrase): 16 bits each, 2**28 bits at most.  Tasks put its bits together by blocks, so that the
    driver gets 256 rows at most, of 32 MB together."""
    low, high = FILTER_BITS
    bits = min(high, max(low, int(np.ceil(np.log2(16 * max(1, pairs.count()))))))
    within = bits - FILTER_BLOCKS

    def dealt(hashes):
        probe = np.unique(np.concatenate(PairFilter.probes(np.concatenate(hashes), bits)))
        first = np.flatnonzero(np.diff(probe >> within, prepend=-1))
        places = np.split((probe & ((1 << within) - 1)).astype("<u4"), first[1:])
        return pd.DataFrame({"block": probe[first] >> within, "places": [x.tobytes() for x in places]})

    def of_pairs(batches):
        held, n = [], 0
        for batch in batches:
            langs, words = {}, {}
            split = [p.split(" ") for p in batch["phrase"]]
            lang = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"]], dtype=np.int64)
            first = np.array([words.setdefault(p[0], len(words)) for p in split], dtype=np.int64)
            second = np.array([words.setdefault(p[1], len(words)) for p in split], dtype=np.int64)
            held.append(PairFilter.hashes([x.encode() for x in langs], [x.encode() for x in words], lang, first, second))
            n += len(batch)
            if n >= FILTER_HASHES:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def of_block(batches):
        blocks = {}
        for batch in batches:
            for block, data in zip(batch["block"], batch["places"]):
                cells = blocks.setdefault(block, np.zeros((1 << within) // 64, dtype=np.uint64))
                place = np.frombuffer(data, "<u4").astype(np.int64)  # sorted
                first = np.flatnonzero(np.diff(place >> 6, prepend=-1))
                cells[place[first] >> 6] |= np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
        for block, cells in blocks.items():
            yield pd.DataFrame({"block": [block], "cells": [cells.tobytes()]})

    found = pairs.select("lang", "phrase").mapInPandas(of_pairs, "block int, places binary")
    found = found.repartition("block").mapInPandas(of_block, "block int, cells binary")
    out = np.zeros((1 << FILTER_BLOCKS, (1 << within) // 64), dtype=np.uint64)
    for block, cells in found.collect():
        out[block] = np.frombuffer(cells, dtype=np.uint64)
    return PairFilter(out.reshape(-1))


def splitters(documents: DataFrame, ranges: int, n: int) -> list[tuple[bytes, bytes, bytes]]:
    """``ranges`` - 1 pairs at even steps of a sample of pairs from some 2 000 of ``n`` texts; they only balance the work."""
    if ranges < 2:
        return []

    def pairs(batches):
        random = np.random.default_rng(0)
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"]):
                words = words_of(text)
                for i in random.integers(0, max(1, len(words) - 1), SAMPLE_PAIRS).tolist() if len(words) > 1 else []:
                    if _MARK not in (words[i], words[i + 1]):
                        out.append((NO_LANG if lang is None else lang, words[i].decode(), words[i + 1].decode()))
            if out:
                yield pd.DataFrame(out, columns=["lang", "first", "second"])

    drawn = documents.sample(min(1.0, max(SAMPLE_TEXTS, ranges) / max(1, n)), 1).mapInPandas(pairs, "lang string, first string, second string")
    drawn = sorted((r[0].encode(), r[1].encode(), r[2].encode()) for r in drawn.collect())
    return [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []


def pieces(documents: DataFrame, borders: list[tuple[bytes, bytes, bytes]], shard_words: int, known: PairFilter | None) -> DataFrame:
    """(range, automaton): each shard's automaton of words and pairs, or with ``known`` of triples, cut at the borders."""
    cells = None if known is None else documents.sparkSession.sparkContext.broadcast(known.cells)  # else each task would unpickle them

    def of_batches(batches):
        for shard in shards(batches, shard_words):
            langs, words, lang, ids = shard.ranked()
            if not words:
                continue
            if cells is None:
                columns, counts, keys = words_and_pairs(lang, ids, len(words))
            else:
                columns, counts, keys = triples(lang, ids, len(words), PairFilter(cells.value).admits(langs, words))
            ends = [0, *np.searchsorted(keys, cuts(langs, words, borders)).tolist(), len(keys)]
            held, size = [], 0
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    held.append((i, serialised(langs, words, [c[a:b] for c in columns], counts[a:b])))
                    size += len(held[-1][1])
                if held and (size >= FRAME_BYTES or i == len(ends) - 2):  # a batch for each piece would cost more than the piece
                    yield pd.DataFrame(held, columns=["range", "automaton"])
                    held, size = [], 0

    return documents.select("lang", "text").mapInPandas(of_batches, "range int, automaton binary")


class Union:
    """Sum of automata of one range; of those read since the last ``fold`` some ``UNION_ROWS`` rows are held."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, data: bytes) -> None:
        self.held.append(read_back(data))
        self.rows += len(self.held[-1][3])
        if self.rows > UNION_ROWS and len(self.held) > 1:
            self.fold()
            self.rows //= 2  # what is common to all counts half, so that folds of a large range stay few

    def fold(self) -> tuple[list[bytes], list[bytes], list[np.ndarray], np.ndarray]:
        langs = sorted({x for held in self.held for x in held[0]})
        words = sorted({x for held in self.held for x in held[1]})
        of_lang, of_word = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(words)}
        columns, counts = [], []
        for some_langs, some_words, some, n in self.held:
            lang = np.array([of_lang[x] for x in some_langs], dtype=np.int64)
            word = np.array([of_word[x] for x in some_words] + [-1], dtype=np.int64)  # -1 picks the last
            columns.append([lang[some[0]]] + [word[c] for c in some[1:]])
            counts.append(n)
        columns, counts = [np.concatenate(c) for c in zip(*columns)], np.concatenate(counts)
        keys = _keys(columns[0], columns[1], columns[2], len(words))
        if len(columns) == 3:
            keys, back = np.unique(keys, return_inverse=True)
            third = None
        else:
            pairs, at = np.unique(keys, return_inverse=True)
            whole, back = np.unique(at * len(words) + columns[3], return_inverse=True)
            keys, third = pairs[whole // len(words)], whole % len(words)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, back, counts)
        del back, counts
        n = len(words)
        columns = [keys // (n + 1) // n, keys // (n + 1) % n, keys % (n + 1) - 1] + ([] if third is None else [third])
        self.held = [(langs, words, columns, total)]
        self.rows = len(total)
        return self.held[0]

    def frequent(self, least: int) -> pd.DataFrame:
        """Phrases of at least ``least`` occurrences, and each language's sum of words as a phrase of none."""
        langs, words, columns, counts = self.fold()
        langs, words = [x.decode() for x in langs], [x.decode() for x in words]
        out = []
        if len(columns) == 3:
            alone = columns[2] < 0
            sums = np.bincount(columns[0][alone], counts[alone].astype(np.float64), len(langs)).astype(np.int64)
            out = [(langs[i], "", 0, int(s)) for i, s in enumerate(sums) if s]
        for i in np.flatnonzero(counts >= least).tolist():
            path = [words[c[i]] for c in columns[1:] if c[i] >= 0]
            out.append((langs[columns[0][i]], " ".join(path), len(path), int(counts[i])))
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "f"])


def united(found: DataFrame, ranges: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of the frequent phrases of all shards; each range is a task that reads it piece by piece."""

    def of_partition(batches):
        union = Union()
        for batch in batches:
            for data in batch["automaton"]:
                union.add(data)
        if union.held and len(rows := union.frequent(least)):
            yield rows

    return found.repartitionById(ranges, "range").mapInPandas(of_partition, _ROWS)


# --- operators --------------------------------------------------------------------------------------------------------


def phrase_counts(documents: DataFrame, scratch: Scratch, least: int = LEAST, shard_words: int = SHARD_WORDS,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to three words with f >= ``least``, and each language's words with words = 0."""
    totals = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    ranges = int(min(MAX_RANGES, max(1, -(-(totals["size"] or 0) // range_bytes))))
    texts = documents.select("lang", "text")
    borders = splitters(texts, ranges, totals["n"])
    short = scratch.write(united(pieces(texts, borders, shard_words, None), ranges, least).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")))
    known = pair_filter(short.where("words = 2"))
    long = scratch.write(united(pieces(texts, borders, shard_words, known), ranges, least))
    return short.unionByName(long)


def scored(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, words, a, l, r, score; ``counts`` as by ``phrase_counts``."""
    word = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), part(1, F.lit(k)).alias("first"), part(k + 1, F.col("words") - k).alias("rest"))
    rows = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(
        F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("cut"))
    rows = rows.select("lang", "phrase", "words", "a", "cut.*")
    parts = counts.where("words between 1 and 2")
    for name, count in (("first", "l"), ("rest", "r")):
        rows = look_up(scratch.write(rows), parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name])
    exact = "cast(1000000 as decimal(8,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
    rows = rows.withColumn("score", F.expr(f"({exact}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = rows.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def collocations(documents: DataFrame, top: int = TOP, least: int = LEAST, **sizes) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    NULL languages are ``und``, NULL and empty texts have no words, repeated rows count as often as they occur; ties end by the
    phrase's bytes.  Languages without a candidate have no row, no rows give none.
    """
    spark = documents.sparkSession
    with Scratch(spark, "phrases") as scratch, small_batches(spark):
        counts = phrase_counts(documents, scratch, least, **sizes)
        found = scratch.write(scored(counts, scratch))
        word = F.split("phrase", " ")
        pair = lambda a: F.array_join(F.slice(word, a, 2), " ")
        longer = found.where("words = 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(pair(1), pair(2))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        rows = found.join(longer, ["lang", "phrase"], "left").where(
            (F.col("words") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))
        )
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS)))
        for keys in (["lang", "bucket"], ["lang"]):  # so that the last task of a language reads some 2 000 rows a bucket
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
            rows = rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
        totals = counts.where("words = 0").groupBy(F.col("lang").alias("of_lang")).agg(F.sum("f").alias("n"))
        rows = rows.join(totals, F.col("lang") == F.col("of_lang"))
        return scratch.write(rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), keep=True)
