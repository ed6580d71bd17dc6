"""Spelling variants: bounds and lists against all pairs, odd words, forms and roots against plain Python."""

import collections
import re
import zlib

import numpy as np
import pytest

from tabloom.llm import spelling_grams


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def expected(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    form, out = {}, []
    neighbours = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(neighbours[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(neighbours[w]), n.get(form[w])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(11)
    words = ["".join(random.choice(list("abé"), k)) for k in random.integers(5, 9, 250)]
    words += [w[:i] + c + w[i + j :] for w in words for i, c, j in [(2, "x", 1), (3, "", 1), (1, "a", 0)]]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "÷×÷×÷", "z" * 300, "z" * 301, "z" * 150 + "y" + "z" * 149, "Straße", "STRASSE", "abc"]
    texts = []
    for i in range(60):
        texts.append((i, " ".join(random.choice(words, 120)) + " " + "aaaaaa, " * (i % 5)))
    return texts + [(None, "z" * 300 + " aaaaa aaaaa"), (3, None), (4, ""), (None, " ".join(words) * 1), (2**60, " ".join(words * 2)), (2**60, "Straße " * 9)]


@pytest.mark.parametrize("least_list, long_list", [(20, 256), (1, 48), (10**9, 3), (5, 2)])
def test_variants_are_those_of_all_pairs(spark, rows, least_list, long_list, monkeypatch):
    monkeypatch.setattr(spelling_grams, "LONG_LIST", long_list)
    monkeypatch.setattr(spelling_grams, "CHUNK_ROWS", 500)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, near int").repartition(3)
    found = [tuple(r) for r in spelling_grams.variants(docs, least_list).collect()]
    assert sorted(found, key=str) == expected(rows)


def test_near_words_meet_in_their_lists():
    random = np.random.default_rng(5)
    words = sorted({"".join(random.choice(list("abcd"), k)) for k in random.integers(5, 12, 1500)})
    counts = collections.Counter()
    for w in words:
        p = f"^{w}$"
        counts.update(p[a : a + q] for q in range(2, 6) for a in range(len(p) - q + 1))
    for limit in (10, 60, 400):
        heavy = {g for g, c in counts.items() if c > limit}
        grams = spelling_grams.Grams({g: c for g, c in counts.items() if len(g) == 2 or g[:-1] in heavy})
        listed = {w: set(p[: s[1]] + f"|{s[0]}" for s in grams.listed(p)) | set(f"{len(p) - s[1]}|" + p[s[0] :] for s in grams.listed(p))
                  for w in words for p in [f"^{w}$"]}
        bounds = {w: len(grams.spans(f"^{w}$")) - grams.bound(f"^{w}$", grams.spans(f"^{w}$")) for w in words}
        texts = {w: collections.Counter(f"^{w}$"[a:b] for a, b in grams.spans(f"^{w}$")) for w in words}
        pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]
        assert len(pairs) > 300
        for a, b in pairs:
            assert listed[a] & listed[b]
            assert sum((texts[a] & texts[b]).values()) >= max(bounds[a], bounds[b])


def test_no_rows(spark):
    assert spelling_grams.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_grams.variants(spark.createDataFrame([(1, None), (2, "ab cd")], "doc_id long, text string")).count() == 0
