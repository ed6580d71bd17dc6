"""Collocations: automata round trips, unions, filters, and odd texts against plain Python."""

import collections
import re

import numpy as np
import pytest

from tabloom.llm import phrase_automata

TEXTS = [
    ("en", "New York is big. New York, new\tyork! the New York Times; the new york times"), (None, "No lang here: no lang here"), ("en", None),
    ("", "empty lang empty lang"), ("x y", "spaced spaced spaced spaced"), ("en", "..,,;;"), ("de", "É É É É É É"),
    ("und", "no lang here"), ("en", "a" * 50_000), ("de", "\x00 \x1f b \x00 \x1f b"),
] + [("en", "to be or not to be that is to be or")] * 7 + [("fr", "un deux trois quatre un deux trois " * 40)]


def expected(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, x), a in candidates.items():
        inside = [b for (m, y), b in candidates.items() if m == lang and len(y) > len(x) and x in (y[:2], y[1:])]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, x[:k]] * f[lang, x[k:]]), k) for k in range(1, len(x))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(x).encode(), f[lang, x[:k]], f[lang, x[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1)
    )


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 9, "range_bytes": 300}])
@pytest.mark.parametrize("least, top", [(2, 2000), (3, 2)])
def test_collocations_are_those_of_plain_python(spark, sizes, least, top, monkeypatch):
    if sizes:
        monkeypatch.setattr(phrase_automata, "UNION_ROWS", 5)
    rows = [(lang, text, 1, "x", 2) for lang, text in TEXTS]
    docs = spark.createDataFrame(rows, "lang string, text string, n int, phrase string, f int").repartition(3)
    found = sorted(tuple(r) for r in phrase_automata.collocations(docs, top, least, **sizes).collect())
    assert found == expected(TEXTS, least, top)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrase_automata.collocations(docs).count() == 0


def test_automata_keep_paths_and_share_states():
    random = np.random.default_rng(4)
    rows = sorted({(int(a), int(b), int(c) if c >= 0 else -1) for a, b, c in zip(*random.integers([[0], [0], [-1]], [[2], [40], [6]], (3, 600)))})
    counts = np.array([1 + (r[2] + 1) % 3 for r in rows])
    columns = [np.array(c) for c in zip(*rows)]
    arrays = phrase_automata.built(columns, counts)
    back, n = phrase_automata.paths(phrase_automata.unpacked_arrays(phrase_automata.packed_arrays(arrays)))
    assert [tuple(r) for r in zip(*[c.tolist() for c in back])] == rows and n.tolist() == counts.tolist()
    nodes = len({r[:2] for r in rows})
    assert len(arrays[8]) < nodes  # states of the last level are shared


def test_ranges_are_cut_where_the_splitters_say():
    langs, words = [b"de", b"en"], [b"a", b"c", b"e"]
    keys = sorted((i, j, k) for i in range(2) for j in range(3) for k in range(-1, 3))
    numbers = phrase_automata._keys(*[np.array(c) for c in zip(*keys)], 3)
    names = [(langs[i], words[j], words[k] if k >= 0 else b"") for i, j, k in keys]
    for splitter in [(b"de", b"c", b"c"), (b"dx", b"c", b"c"), (b"en", b"b", b"z"), (b"en", b"c", b"d"), (b"zz", b"", b""), (b"a", b"z", b"z")]:
        cut = phrase_automata.cuts(langs, words, [splitter])[0]
        assert [bool(x) for x in numbers < cut] == [n < splitter for n in names]


def test_the_filter_never_refuses_a_frequent_pair(spark):
    pairs = [("en", f"w{i} v{i % 7}") for i in range(500)]
    known = phrase_automata.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string"))
    langs, words = [b"en"], [f"w{i}".encode() for i in range(1000)] + [f"v{i}".encode() for i in range(7)]
    i = np.arange(1000)
    passes = known.admits(langs, words)(np.zeros(1000, dtype=np.int64), i, 1000 + i % 7)
    assert passes[:500].all() and passes[500:].sum() < 100


@pytest.mark.parametrize("hashes", [None, 1000])
def test_the_filter_reaches_the_driver_in_blocks(spark, hashes, monkeypatch):
    """A row for each cell of 64 bits, 4 million of them at most, took more memory than the driver has."""
    if hashes:
        monkeypatch.setattr(phrase_automata, "FILTER_HASHES", hashes)
    rows = [(f"l{i % 3}", f"w{i % 977} v{i}") for i in range(40_000)]
    pairs, got = spark.createDataFrame(rows, "lang string, phrase string").repartition(5), []
    collect = type(pairs).collect
    monkeypatch.setattr(type(pairs), "collect", lambda self: got.append(collect(self)) or got[-1])
    cells = phrase_automata.pair_filter(pairs).cells
    assert sum(len(x) for x in got) <= 256

    lang, split = [r[0] for r in rows], [r[1].split(" ") for r in rows]
    langs, words = sorted(set(lang)), sorted({w for p in split for w in p})
    of_lang, of_word = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(words)}
    columns = [np.array([of_lang[x] for x in lang]), *(np.array([of_word[p[k]] for p in split]) for k in (0, 1))]
    hashed = phrase_automata.PairFilter.hashes([x.encode() for x in langs], [x.encode() for x in words], *columns)
    bits = np.zeros(2**20, dtype=bool)  # 16 bits a pair
    for probe in phrase_automata.PairFilter.probes(hashed, 20):
        bits[probe] = True
    assert np.array_equal(np.unpackbits(cells.view(np.uint8), bitorder="little"), bits)


def test_pieces_are_the_same_however_they_are_put_into_batches(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "lang string, text string").repartition(2)
    borders = [(b"de", b"b", b""), (b"en", b"be", b"or"), (b"en", b"or", b""), (b"fr", b"quatre", b"un")]
    found = []
    for size in (1, 200, phrase_automata.FRAME_BYTES):
        monkeypatch.setattr(phrase_automata, "FRAME_BYTES", size)
        found.append(sorted((r[0], bytes(r[1])) for r in phrase_automata.pieces(docs, borders, 20, None).collect()))
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == set(range(5))
