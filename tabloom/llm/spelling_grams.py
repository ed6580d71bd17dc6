"""Spelling variants: words at edit distance one, found through an index of variable-length grams.

The gram dictionary is a trie over the distinct words: a gram on more words than a threshold is extended by one letter, up to five,
a rarer one is pruned of its extensions.  A word is decomposed into the longest grams at each place, without those that another
one contains.  For each possible edit the grams that it may touch or change are counted; the largest count is the word's bound.
Two near words share all but that many grams of each, so the lists of their ``bound + 1`` rarest grams, merged, hold the pair.  A
gram that an edit leaves alone has equal text on its left or on its right, so a list is kept apart by that text.  Pairs of a list
are verified letter by letter, and of all lists where they meet, the first of the rarest reports them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, lower_ascii

LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 5
LEAST_OCCURRENCES = 3
DELETED = 97
RATIO = 2
SHORTEST, LONGEST = 2, 5
LEAST_LIST = 20
HEAVY_GRAMS = 4000
CHUNK_ROWS = 100_000
LONG_LIST = 48
WIDTH = 48
ROUNDS = 64
_OPEN, _SHUT = "^", "$"
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


# --- words ------------------------------------------------------------------------------------------------------------


def spellings(documents: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts; one in 97 runs, by the hash of document and run, loses the letter that the hash names.

    A NULL id counts as an empty one, NULL texts have no words.
    """
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), 0)).alias("run")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = "cast(h % length(run) as int)"
    word = f"case when h % {DELETED} = 0 then concat(substring(run, 1, {at}), substring(run, {at} + 2)) else run end"
    rows = rows.select(F.expr(word).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_OCCURRENCES)


# --- the gram dictionary ----------------------------------------------------------------------------------------------


def _padded(word: Column) -> Column:
    return F.concat(F.lit(_OPEN), word, F.lit(_SHUT))


def gram_dictionary(words: DataFrame, scratch: Scratch, least_list: int = LEAST_LIST, heavy_grams: int = HEAVY_GRAMS) -> dict[str, int]:
    """Grams and the number of places they have in the words.

    The threshold grows with the words so that at most ``heavy_grams`` grams of each length are extended: the dictionary is
    bounded by 66 letters times that, however many words there are.
    """
    padded = words.select(_padded(F.col("word")).alias("p"))
    places = padded.agg(F.sum(F.length("p"))).first()[0] or 0
    limit = max(least_list, places // heavy_grams)
    gram = F.explode(F.expr(
        f"flatten(transform(sequence({SHORTEST}, {LONGEST}), q -> if(length(p) < q, array(), "
        "transform(sequence(1, length(p) - q + 1), i -> substring(p, i, q)))))"
    )).alias("gram")
    counted = scratch.write(padded.select(gram).groupBy("gram").agg(F.count(F.lit(1)).alias("c")))
    heavy = F.broadcast(counted.where((F.col("c") > limit) & (F.length("gram") < LONGEST)).select(F.col("gram").alias("heavy")))
    parent = F.expr("substring(gram, 1, length(gram) - 1)")
    found = counted.join(heavy, parent == F.col("heavy"), "left_semi").unionByName(counted.where(F.length("gram") == SHORTEST))
    return {r["gram"]: r["c"] for r in found.collect()}


class Grams:
    """Decomposes padded words by a dictionary and bounds what one edit does to a decomposition."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.prefixes = {g[:-1] for g in counts if len(g) > SHORTEST}  # the trie holds the beginnings of its grams
        self.suffixes = {g[k:] for g in counts for k in range(1, len(g) - SHORTEST + 1)}

    def spans(self, p: str) -> list[tuple[int, int]]:
        """Longest gram at each place, without those inside an earlier one."""
        out, reach, n = [], 0, len(p)
        for a in range(n - SHORTEST + 1):
            b = a + SHORTEST
            while b < n and b - a < LONGEST and p[a : b + 1] in self.counts:
                b += 1
            if b > reach:
                out.append((a, b))
                reach = b
        return out

    def _left(self, p: str, i: int) -> int:
        """Grams that end by ``i`` and start here or later may change if the text from ``i`` on does."""
        for a in range(max(0, i - LONGEST + 1), i - SHORTEST + 1):
            if p[a:i] in self.prefixes:
                return a
        return i

    def _right(self, p: str, r: int) -> int:
        """Grams that start at ``r`` or later and end here or before may change if the text before ``r`` does."""
        for b in range(min(len(p), r + LONGEST - 1), r + SHORTEST - 1, -1):
            if p[r:b] in self.suffixes:
                return b
        return r

    def bound(self, p: str, spans: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced letter may affect."""
        worst, n = 0, len(p)
        left = [self._left(p, i) for i in range(n)]
        right = [self._right(p, i) for i in range(n)]
        for i in range(1, n):  # i: the letter replaced or deleted, or the place before it where one is inserted
            from_left, to_right = left[i], right[i]
            inserted = sum(1 for a, b in spans if a < i < b or (b <= i and a >= from_left) or (a >= i and b <= to_right))
            if i < n - 1:
                to_right = right[i + 1]
                inserted = max(inserted, sum(1 for a, b in spans if a <= i < b or (b <= i and a >= from_left) or (a > i and b <= to_right)))
            worst = max(worst, inserted)
        return worst

    def listed(self, p: str) -> list[tuple[int, int]]:
        """Places of the grams in whose lists a word stands: the rarest that no edit can all affect.  Words without such a bound
        stand in all lists, and in those of their halves."""
        spans = self.spans(p)
        bound = self.bound(p, spans)
        counts = self.counts
        spans.sort(key=lambda s: (counts.get(p[s[0] : s[1]], 0), p[s[0] : s[1]], s[0]))
        if bound < len(spans):
            return spans[: bound + 1]
        n = len(p)
        for shorter in (n, n - 1):
            half = shorter // 2
            for span in ((0, half), (n - (shorter - half), n)):
                if span not in spans:
                    spans.append(span)
        return spans


_POSTING = "key long, word string, n long, at int, side int, spans binary"


def postings(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Entries of the index: for each listed gram one under the text through its end and one under the text from its start on."""

    def of_batches(batches):
        grams = Grams(counts)
        for batch in batches:
            keys, word, n, at, side, places = [], [], [], [], [], []
            for w, count in zip(batch["word"], batch["n"]):
                p = _OPEN + w + _SHUT
                spans = grams.listed(p)
                data = np.array(spans, dtype="<u4").tobytes()
                raw = p.encode("latin-1")
                for i, (a, b) in enumerate(spans):
                    keys += [xxhash.xxh64_intdigest(raw[:b], 2 * a), xxhash.xxh64_intdigest(raw[a:], 2 * (len(raw) - b) + 1)]
                    at += [i, i]
                    side += [0, 1]
                word += [w] * (2 * len(spans))
                n += [count] * (2 * len(spans))
                places += [data] * (2 * len(spans))
            keys = np.array(keys, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"key": keys, "word": pd.Series(word, dtype=object), "n": n, "at": at, "side": side,
                                "spans": pd.Series(places, dtype=object)})

    return words.select("word", "n").mapInPandas(of_batches, _POSTING)


# --- lists to pairs ---------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes rows of 64-bit lanes share from the first on."""
    out = np.full(len(x), 8 * x.shape[1], dtype=np.int64)
    for lane in reversed(range(x.shape[1])):
        differ = x[:, lane] ^ y[:, lane]
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        out = np.where(differ == 0, out, 8 * lane + lowest)
    return out


def _steps(key: np.ndarray):
    """Pairs of places with equal keys in a sorted array, a distance at a time."""
    left, step = np.arange(len(key)), 1
    while len(left):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if len(left):
            yield left, left + step
        step += 1


class Chunk:
    """Whole lists of the index: rows sorted by key."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.key = rows["key"].to_numpy()
        code, names = pd.factorize(rows["word"], sort=True)
        self.id, self.distinct = code.astype(np.int64), [(_OPEN + w + _SHUT).encode("latin-1") for w in names]
        self.n, self.at, self.side = (rows[c].to_numpy().astype(np.int64) for c in ("n", "at", "side"))
        self.length = np.array([len(w) for w in self.distinct], dtype=np.int64)[self.id]
        short = [w if len(w) <= WIDTH else b"" for w in self.distinct]
        self.letters = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)
        back = np.frombuffer(b"".join(w[::-1].ljust(WIDTH, b"\0") for w in short), "<u8").reshape(-1, WIDTH // 8)
        self.lanes = self.letters.view("<u8"), back
        sizes = np.array([len(x) for x in rows["spans"]], dtype=np.int64) // 8
        flat = np.frombuffer(b"".join(rows["spans"]), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.start = np.full((len(sizes), int(sizes.max())), -1, dtype=np.int64)
        self.end = self.start.copy()
        self.start[row, place], self.end[row, place] = flat[::2], flat[1::2]

    def shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters that the words of rows ``a`` and ``b`` share from the start and from the end."""
        longest, least = np.maximum(self.length[a], self.length[b]), np.minimum(self.length[a], self.length[b])
        out = []
        for lanes, step in zip(self.lanes, (1, -1)):
            found = np.empty(len(a), dtype=np.int64)
            for part, width in ((longest <= 16, 2), ((longest > 16) & (longest <= WIDTH), WIDTH // 8)):
                found[part] = _equal_bytes(lanes[:, :width][self.id[a[part]]], lanes[:, :width][self.id[b[part]]])
            for i in np.flatnonzero(longest > WIDTH).tolist():
                found[i] = _common(self.distinct[self.id[a[i]]][::step], self.distinct[self.id[b[i]]][::step])
            out.append(np.minimum(found, least))
        return out[0], out[1]

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows of one list those at distance one that meet here first, and the letters they share at the start."""
        close = (np.abs(self.length[a] - self.length[b]) <= 1) & (self.id[a] != self.id[b])
        a, b = a[close], b[close]
        a, b = np.where(self.id[a] > self.id[b], b, a), np.where(self.id[a] > self.id[b], a, b)
        head, tail = self.shared(a, b)
        near = head + tail >= np.maximum(self.length[a], self.length[b]) - 1
        a, b, head, tail = a[near], b[near], head[near], tail[near]
        shift = (self.length[b] - self.length[a])[:, None]
        start, end = self.start[a], self.end[a]
        left, right = np.zeros(start.shape, dtype=bool), np.zeros(start.shape, dtype=bool)
        for j in range(start.shape[1]):
            s, e = self.start[b, j][:, None], self.end[b, j][:, None]
            left |= (start == s) & (end == e)
            right |= (start + shift == s) & (end + shift == e)
        there = start >= 0
        left &= there & (end <= head[:, None])
        right &= there & (self.length[a][:, None] - start <= tail[:, None])
        first = (left | right).argmax(axis=1)
        here = (self.at[a] == first) & (self.side[a] == np.where(left[np.arange(len(a)), first], 0, 1))
        return a[here], b[here], head[here]

    def pairs(self):
        """Pairs of rows at distance one, each where it meets first.  Rows of a long list meet only if they share a half of what
        stands beside the gram, words beyond ``WIDTH`` letters each other one of their list."""
        bounds = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1], [True]]))
        size = np.repeat(np.diff(bounds), np.diff(bounds))
        small = np.flatnonzero((size <= LONG_LIST) & (self.length <= WIDTH))
        for a, b in _steps(self.key[small]):
            yield self.near(small[a], small[b])[:2]
        wide = np.flatnonzero(self.length >= WIDTH)
        for a, b in _steps(self.key[wide]):
            some = np.maximum(self.length[wide[a]], self.length[wide[b]]) > WIDTH
            yield self.near(wide[a[some]], wide[b[some]])[:2]
        yield from self._halves(np.flatnonzero((size > LONG_LIST) & (self.length <= WIDTH)))

    def _halves(self, rows: np.ndarray):
        """An edit in the text beside the gram leaves one half of it alone, the halves being those of the shorter word."""
        if not len(rows):
            return
        sums = np.zeros((len(self.distinct), WIDTH + 1), dtype=np.uint64)  # hashes of the beginnings; hits are verified
        for k in range(WIDTH):
            sums[:, k + 1] = sums[:, k] * _BASE + self.letters[:, k] + np.uint64(1)
        powers = _BASE ** np.arange(WIDTH + 1, dtype=np.uint64)
        at, side = self.at[rows], self.side[rows]
        low = np.where(side == 0, self.end[rows, at], 0)  # the text beside the gram
        rest = np.where(side == 0, self.length[rows], self.start[rows, at]) - low
        which = self.id[rows]
        keys, members, first, wanted = [], [], [], []
        for less in (0, 1):
            shorter = rest - less
            half = np.maximum(shorter, 0) // 2
            for second in (0, 1):
                a = np.where(second, low + rest - (shorter - half), low)
                b = np.where(second, low + rest, low + half)
                hashed = sums[which, b] - sums[which, a] * powers[b - a]
                key = self.key[rows].view(np.uint64) ^ (hashed * _MIX) ^ ((shorter.astype(np.uint64) * np.uint64(2) + np.uint64(second)) * _BASE)
                good = shorter >= 0
                keys.append(key[good])
                members.append(rows[good])
                first.append(np.where(second, half, -1)[good])
                wanted.append(shorter[good])
        keys, members, first, wanted = (np.concatenate(x) for x in (keys, members, first, wanted))
        order = np.argsort(keys, kind="stable")
        keys, members, first, wanted = keys[order], members[order], first[order], wanted[order]
        beside = np.zeros(len(self.id), dtype=np.int64)
        beside[rows] = rest
        begins = np.zeros(len(self.id), dtype=np.int64)
        begins[rows] = low
        for i, j in _steps(keys):
            a, b = members[i], members[j]
            some = (self.key[a] == self.key[b]) & (np.minimum(beside[a], beside[b]) == wanted[i]) & (wanted[i] == wanted[j]) & (first[i] == first[j])
            a, b, half = a[some], b[some], first[i][some]
            if not len(a):
                continue
            # a pair that shares the first half stands in that list already
            head = self.shared(a, b)[0]
            some = (half < 0) | (head < begins[a] + half)
            yield self.near(a[some], b[some])[:2]

    def found(self) -> pd.DataFrame:
        """(word, near, best_n, best): how many near words a word has here, and the most frequent of them."""
        first, second = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
        for a, b in self.pairs():
            first.append(a)
            second.append(b)
        a, b = np.concatenate(first + second), np.concatenate(second + first)
        of, other, n = self.id[a], self.id[b], self.n[b]
        order = np.lexsort((other, -n, of))
        of, other, n = of[order], other[order], n[order]
        words, at, near = np.unique(of, return_index=True, return_counts=True)
        name = lambda ids: pd.Series([self.distinct[i][1:-1].decode("latin-1") for i in ids.tolist()], dtype=object)
        return pd.DataFrame({"word": name(words), "near": near, "best_n": n[at], "best": name(other[at])})


def near_words(entries: DataFrame) -> DataFrame:
    """(of_word, near, best): the number of near words and the best one as (minus n, word), of the words that have any."""

    def of_partition(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= CHUNK_ROWS:
                last = held["key"].to_numpy()
                cut = int(np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))[-1])
                if cut:
                    yield Chunk(held.iloc[:cut]).found()
                    held = held.iloc[cut:]
        if held is not None and len(held):
            yield Chunk(held).found()

    found = entries.repartition("key").sortWithinPartitions("key").mapInPandas(of_partition, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word")))
    return found.groupBy(F.col("word").alias("of_word")).agg(F.sum("near").alias("near"), best.alias("best"))


# --- forms and roots --------------------------------------------------------------------------------------------------


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(of_word, root) from (of_word, form) by jumping: every round doubles the way, so that rounds grow with its logarithm."""
    now = scratch.write(forms.select("of_word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        further = now.select(F.col("of_word").alias("via"), F.col("root").alias("further"))
        step = now.join(further, F.col("root") == F.col("via"), "left")
        step = step.select("of_word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = scratch.replace(now, step)
        moved = step.where("moved").limit(1).count()
        now = step.select("of_word", "root")
        now.scratch_path = step.scratch_path
        if not moved:
            return now
    raise RuntimeError(f"forms did not settle in {ROUNDS} rounds")


def variants(documents: DataFrame, least_list: int = LEAST_LIST, heavy_grams: int = HEAVY_GRAMS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A form occurs at least twice as often as its word, so following forms ends.  Ties of near words by code points.  Texts
    without words, NULL texts and empty tables give no rows; repeated rows count as often as they occur.
    """
    with Scratch(documents.sparkSession, "spelling") as scratch:
        words = scratch.write(spellings(documents))
        counts = gram_dictionary(words, scratch, least_list, heavy_grams)
        near = scratch.write(near_words(postings(words, counts)))
        forms = words.join(near, F.col("word") == F.col("of_word"), "left")
        chosen = -F.col("best.minus_n") >= RATIO * F.col("n")
        forms = scratch.write(forms.select(
            "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"),
            F.when(chosen, -F.col("best.minus_n")).alias("form_n"),
        ))
        ends = roots(forms.where("form is not null").select(F.col("word").alias("of_word"), "form"), scratch)
        rows = forms.join(ends, F.col("word") == F.col("of_word"), "left")
        rows = rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.write(rows, keep=True)
