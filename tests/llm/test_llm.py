"""The training-data operators: brute force on a small table, SQL where there is some, and the odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from compare import connect, difference, rows_of

import corpus_pipeline
from conftest import SF
from tabloom.llm import (
    decontaminate,
    line_dedup,
    mixing,
    quality_pu,
    quality_rules,
    simhash_vptree,
    slots,
    suffix_dedup,
    toxicity_mil,
    warc_chunks,
)
from tabloom.llm.queries import registry

LONG = "one two three four five six seven eight nine ten eleven twelve. " * 800
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "a", 9),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "a", 9),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "a", 9),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "a", 8),
    (None, "no id here but some words all the same", None, 1),
    (None, None, None, None),
    (5, None, "b", 0),
    (6, "", "b", 0),
    (7, " \n\t ", "", 0),
    (8, LONG, "b", 0),
    (9, "# $ % !! ?", None, 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like those that the operators use inside."""
    rows = [(i, t, s, k, "x", 1.5, True, [1], "y", 1, 0, "p", 3, "host") for i, t, s, k in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, digest int, row string, score double, kept boolean, words array<int>, h string, "
        "toxic int, label int, positive string, size int, host string"
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, None, None), (None, 1, 1), (8, 0, 1), (8, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "beta GAMMA delta"), (2, "no match of this at all"), (2, None), (None, "iota kappa"), (3, ""), (1, "beta GAMMA delta")]
    return spark.createDataFrame(rows, "item_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_sql(spark, name):
    found = rows_of(registry.queries[name](spark, SF).toArrow())
    assert difference(found, rows_of(connect(SF).execute(registry.sql[name]).to_arrow_table())) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.queries} == set(range(1, 14))


# --- odd rows and empty tables ---------------------------------------------------------------------------------------


def cases(odd, labels, items):
    return {
        "decontaminate": lambda d: decontaminate.report(d, items),
        "quality": lambda d: quality_pu.scored(d, labels),
        "toxicity": lambda d: toxicity_mil.report(d, labels),
        "simhash": simhash_vptree.near_duplicates,
        "suffixes": suffix_dedup.deduplicated,
        "mixing": mixing.report,
        "rules": quality_rules.report,
        "slots": slots.shard_rows,
    }


@pytest.mark.parametrize(
    "name", ["decontaminate", "quality", "toxicity", "simhash", "suffixes", "mixing", "rules", "slots"]
)
def test_odd_rows_and_empty_tables(odd, labels, items, name):
    build = cases(odd, labels, items)[name]
    found = [r["doc_id"] for r in build(odd).select("doc_id").collect()]
    assert sorted(found, key=str) == sorted((i for i, *_ in ODD), key=str)
    assert build(odd.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, odd, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= 3 * len(ODD)
    assert stage(spark, odd.limit(0), SF).count() == 0


# --- brute force -------------------------------------------------------------------------------------------------------


def test_decontamination_edge_hits(odd, items):
    rows = {r["doc_id"]: r for r in decontaminate.report(odd, items).collect()}
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (12, 5, 1, True)
    assert rows[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert rows[5]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not rows[5]["contaminated"]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.clean(odd, items, "spans").collect()}
    assert spans[1] == "Alpha  epsilon zeta eta theta  lambda mu."
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0


def test_classifiers_learn(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    quality = quality_pu.scored(docs, labels).join(labels, "doc_id").where("held_out")
    assert quality.where("predicted = quality").count() >= 0.95 * quality.count()
    toxic = toxicity_mil.report(docs, labels).join(labels, "doc_id").where("held_out")
    assert toxic.where("toxic = 0 and predicted = 1").count() <= 0.02 * toxic.where("toxic = 0").count()
    assert toxic.where("toxic = 1 and predicted = 1").count() >= 0.4 * toxic.where("toxic = 1").count()


def test_prior_is_found():
    random = np.random.default_rng(1)
    high, low = random.beta(8, 2, 60_000), random.beta(2, 8, 40_000)
    bins = lambda x: np.histogram(x, quality_pu.BINS, (0, 1))[0]
    assert abs(quality_pu.estimated_prior(bins(high[:20_000]), bins(np.concatenate([high, low]))) - 0.6) < 0.05


def test_rare_offending_words_are_tested(spark, tmp_path):
    letters = "abcdefghij"
    rude = [a + b + c for a in letters for b in letters for c in "xyz"]
    common = " ".join("q" + a + b + c + d for a in letters for b in letters for c in letters for d in letters + "klmnopqrstuvwxyz"
                      + "àáâãäåæçèéêëìíîïðñòóôõöøùúûüý")
    assert len(set(common.split())) > 50_000
    rows = [(common if i % 100 < 6 else "fine", 0) for i in range(100)] + [(common if i < 6 else " ".join(rude), 1) for i in range(11)]
    with toxicity_mil.Scratch(spark, "terms") as scratch:
        found = toxicity_mil.vocabulary(spark.createDataFrame(rows, "text string, toxic int"), scratch)
    assert sorted(found) == sorted(w + "$" for w in rude)


def test_every_significant_word_has_a_weight(spark):
    letters = "abcdefghijklmnopqrst"
    rude = [a + b + "x" for a in letters for b in letters[:15]]
    texts = [f"A fine day. You {rude[i % 300]}! Bye." for i in range(6000)] + ["A fine day. You said so! Bye."] * 18_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 6000 as int) as toxic")
    found = toxicity_mil.report(docs, labels).selectExpr("doc_id < 6000 as toxic", "predicted = 1 as predicted")
    assert {tuple(r) for r in found.distinct().collect()} == {(True, True), (False, False)}


def test_sums_of_documents_are_slopes():
    random = np.random.default_rng(2)
    model = toxicity_mil.Model(["bad$", "scum$", "foul$"], random.normal(size=4))
    bags = [toxicity_mil._bag(t, model.known) for t in ("Bad day. You scum bad! Bye.", "foul", "All well.", "", "foul scum. foul")]
    toxic = np.array([1, 0, 0, 0, 1])
    losses = lambda w: toxicity_mil._sums(bags, toxic, w)
    sums = losses(model.weights)
    for i in range(4):
        nudge = np.eye(4)[i] * 1e-6
        slope = (losses(model.weights + nudge)[1] - losses(model.weights - nudge)[1]) / 2e-6
        assert abs(slope - sums[2 + i]) < 1e-5
    assert sums[0] == 5 and (sums[6:] > 0).all()


def test_documents_without_terms_add_up():
    import pandas as pd

    weights = np.array([-1.5, 2.0])
    bags = [toxicity_mil._bag(t, toxicity_mil.Known({"bad$": 1})) for t in ("One. Two. Three!", "One. Two. Three!", "Fine.", "", "a. b")]
    toxic = np.array([0, 0, 1, 0, 1])
    counted = pd.DataFrame({"bag": bags, "toxic": toxic}).groupby(["bag", "toxic"]).size().reset_index(name="n")
    assert np.allclose(toxicity_mil._plain_sums(counted, weights), toxicity_mil._sums(bags, toxic, weights))


def test_offending_sentences_are_located():
    model = toxicity_mil.Model(["scum$"], np.array([-6.0, 12.0]))
    score, bad = model.document("All is well. You scum! Bye.")
    assert score > 0.9 and [(a, b) for a, b, _ in bad] == [(12, 21)]


def test_near_duplicates(spark):
    docs = documents(spark)

    def fingerprint(text):
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        pieces = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    known = {i: fingerprint(t) for i, t in texts_of(docs)}
    least = {i: i for i in known}
    changed = True
    while changed:
        changed = False
        for a in known:
            for b in known:
                if least[b] < least[a] and (known[a] ^ known[b]).bit_count() <= 4:
                    least[a], changed = least[b], True
    found = {r["doc_id"]: r for r in simhash_vptree.near_duplicates(docs).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {
        i: (f"{known[i]:016x}", least[i]) for i in known
    }
    assert sorted(r["doc_id"] for r in simhash_vptree.keep_one(docs).collect()) == sorted(set(least.values()))


def test_large_data_paths_find_the_same(spark, monkeypatch):
    docs = documents(spark)
    near = lambda: sorted(tuple(r) for r in simhash_vptree.near_duplicates(docs).collect())
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = lambda: sorted(tuple(r) for r in decontaminate.report(docs, benchmark).collect())
    one_leaf, one_pass = near(), leaks()
    depths, forest = [], simhash_vptree.forest
    monkeypatch.setattr(simhash_vptree, "forest", lambda nodes, n: depths.append(forest(nodes, n)) or depths[-1])
    largest, dealt = [], simhash_vptree.dealt

    def seen(nodes, trees):
        rows = dealt(nodes, trees)
        largest.append(max(r["count"] for r in rows.groupBy("tree", "leaf").count().collect()))
        return rows

    monkeypatch.setattr(simhash_vptree, "dealt", seen)
    monkeypatch.setattr(simhash_vptree, "LEAF_ROWS", 20)
    monkeypatch.setattr(simhash_vptree, "SPLIT_ROWS", 10)
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 40)
    assert near() == one_leaf and all(t.depth > 0 for t in depths[0]) and largest[0] > simhash_vptree.SPLIT_ROWS
    assert decontaminate.item_windows(benchmark).count() > decontaminate.PASS_WINDOWS
    assert leaks() == one_pass and any(r[-1] for r in one_pass)


def test_trees_meet_every_close_pair():
    random = np.random.default_rng(7)
    points = random.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << random.choice(64, 4, replace=False).astype(np.uint64)) for _ in points])
    close = points ^ flips
    met = np.zeros(len(points), dtype=bool)
    for t, mask in enumerate(simhash_vptree.masks()):
        tree = simhash_vptree.Tree(points, mask, 5, t)
        (at_a, leaf_a), (at_b, leaf_b) = tree.leaves(points), tree.leaves(close)
        both = set(zip(at_a.tolist(), leaf_a.tolist())) & set(zip(at_b.tolist(), leaf_b.tolist()))
        met[[a for a, _ in both]] = True
    assert met.all()


def test_archives_round_trip(spark):
    tricky = "a" * 150 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 300 + "WARC/1.1"
    rows = [(2**60 + 1, "u", tricky), (2**60, "u\r\n\r\nWARC/1.1\r\n", tricky), (3, None, None), (4, "", ""), (5, "q", "short"),
            (6, "q", "short"), (6, "q", tricky), (None, "z", tricky), (10, "r", "\r\n\r\n"), (11, "r", "WARC/1.1\r\n" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, data in payloads:
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    expected = [
        (i, len(d), hashlib.sha256(d).hexdigest(), "response" if first.get(d, i) == i else "revisit", None if first.get(d, i) == i else first[d])
        for i, d in payloads
    ]
    for chars in (64, warc_chunks.CHUNK_CHARS):
        found = [tuple(r) for r in warc_chunks.round_trip(pages, chars).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)
    assert warc_chunks.round_trip(pages.limit(0)).count() == 0


def test_cover_is_a_perfect_difference_set():
    n = suffix_dedup.MODULUS
    differences = collections.Counter((a - b) % n for a in suffix_dedup.COVER for b in suffix_dedup.COVER if a != b)
    assert differences == {d: 1 for d in range(1, n)}


def test_repeated_substrings(spark):
    extra = [(None, "x" * 500), (90001, "ab" * 300), (90002, "é" * 150), (90003, None), (90005, "q" * 199), (90006, "q" * 199 + "z")]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(3)
    rows = [(i, (t or "").encode()) for i, t in texts_of(docs)]
    seen = collections.Counter(d[a : a + 200] for _, d in rows for a in range(len(d) - 199))
    expected = []
    for i, d in rows:
        gone = np.zeros(len(d), dtype=bool)
        for a in range(len(d) - 199):
            if seen[d[a : a + 200]] > 1:
                gone[a : a + 200] = True
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        expected.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    for block_bytes in (suffix_dedup.BLOCK_BYTES, 450):  # in the second case most texts are cut into pieces
        found = [tuple(r) for r in suffix_dedup.deduplicated(docs, block_bytes=block_bytes).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("width, most", [(5, 64), (8, 8), (8, 70_000)])
def test_keys_stand_in_the_order_of_buckets(width, most):
    """By one sort of whole keys; a key of two buckets, and more buckets than 16 bits count, too."""
    random = np.random.default_rng(width + most)
    key = random.integers(0, 2 ** (8 * width), 400, dtype=np.uint64)[random.integers(0, 400, 2000)]
    bucket = (key % np.uint64(most)).astype(np.int64)
    bucket[key == key[0]] = random.integers(0, most, np.sum(key == key[0]))
    keys = suffix_dedup.Keys(bucket, key, width)
    pairs = list(zip(bucket.tolist(), key.tolist()))
    assert list(zip(keys.bucket.tolist(), keys.key.tolist())) == sorted(set(pairs))
    assert [(int(keys.bucket[i]), int(keys.key[i])) for i in keys.of] == pairs
    often = collections.Counter(pairs)
    assert keys.often.tolist() == [often[p] > 1 for p in sorted(often)]


def test_ranges_and_samples_of_a_block():
    """Sample places come from the texts' sizes, ranges that touch or overlap are one."""
    sizes = [0, 67, 68, 500, 0, 133, 201, 0]
    block = suffix_dedup.Block(bytes(sum(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    wanted = [int(s) + o for s, n in zip(starts, sizes) for o in range(n) if o % 133 in suffix_dedup.COVER and o + 68 <= n]
    assert block.sample().tolist() == wanted and block.sample().dtype == np.int64
    first = np.array([0, 5, 10, 40, 41, 960])
    inside = {i for a in first.tolist() for i in range(a, min(a + 5, 969))}
    assert set(np.flatnonzero(block.covered(first, np.minimum(first + 5, 969))).tolist()) == inside
    assert not block.covered(first[:0], first[:0]).any()
    assert block.left(np.array([0, 66, 67, 968])).tolist() == [67, 1, 68, 1]


def test_long_texts_are_put_together():
    random = np.random.default_rng(3)
    for _ in range(50):
        n, step = int(random.integers(600, 4000)), int(random.integers(250, 600))
        data, starts = random.integers(0, 256, n, dtype=np.uint8), random.random(n - 199) < 0.003
        whole = np.zeros(n, dtype=bool)
        text = suffix_dedup.LongText(1, "7", step, True)
        for a in np.flatnonzero(starts):
            whole[a : a + 200] = True
        for low in range(0, n - 199, step):
            part, gone = data[low : low + step + 199], np.zeros(min(step + 199, n - low), dtype=bool)
            for a in np.flatnonzero(starts[low : low + step]):
                gone[a : a + 200] = True
            text.add(part.tobytes(), np.packbits(gone).tobytes())
        kept = data[~whole].tobytes()
        spans = int(np.sum(whole & ~np.concatenate([[False], whole[:-1]])))
        assert text.result() == ("7", n, int(whole.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_payloads_are_cut_by_characters(spark):
    rows = [("",), ("é🙂a" * 50,), ("\n" * 129,), ("ab",)]
    pages = spark.createDataFrame(rows, "html string").selectExpr("1L as page_id", "'u' as url", "html")
    chunks = warc_chunks.chunked(warc_chunks.records(pages), 64).collect()
    texts = collections.defaultdict(dict)
    for r in chunks:
        texts[r["write_id"]][r["chunk_no"]] = r["chunk"]
    assert sorted("".join(t[k] for k in sorted(t)) for t in texts.values()) == sorted(h for h, in rows)
    assert max(len(r["chunk"]) for r in chunks) == 64


def test_rounding_is_the_same_in_runs(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = [(s, size, int(random.integers(1, 9)), float(random.random() * 2)) for s in (0, 1) for size in range(0, 60)]
    classes = spark.createDataFrame(rows, "sid int, size long, n long, rate double")
    whole = sorted(mixing.rounded(classes).collect())
    monkeypatch.setattr(mixing, "RUN_SIZES", 7)
    assert sorted(mixing.rounded(classes).collect()) == whole
    due = collections.Counter()
    for sid, size, n, rate in rows:
        due[sid] += n * (rate % 1) * size
    assert all(abs(sum(r["extra"] * r["size"] for r in whole if r["sid"] == s) - due[s]) <= 1 for s in (0, 1))


def test_mix_meets_targets_and_repeats(spark):
    docs = documents(spark)
    found = mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    sums = found.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(sums["target"].sum() - sums["size"].sum()) < 1e-6 * sums["size"].sum()
    assert (sums["target"] <= 3 * sums["size"] + 1e-6).all()
    assert (abs(sums["taken"] - sums["target"]) <= 0.06 * sums["target"] + 100).all()
    again = mixing.report(docs.repartition(5)).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == found.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(docs).count() == int((found["taken"] // found["size"].clip(lower=1)).sum())


def test_boilerplate_lines(spark):
    html = lambda i: f"<html><nav><li>Menu</li></nav><p>own {i}</p><script>x</script>"
    rows = [(i, "http://Site.org/a", html(i)) for i in range(9)] + [(50, None, None), (51, "http://few.org", html(1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in line_dedup.without_boilerplate(pages).collect()}
    assert found[3]["kept"] == ["own 3"] and found[3]["host"] == "site.org" and found[51]["kept"] == ["Menu", "own 1"]
    assert found[50]["lines"] == [] and line_dedup.report(pages.limit(0)).count() == 0


def test_cascade_orders_by_rejections_per_second(spark):
    estimates = {name: (0.1, 1.0) for name in quality_rules.rules()} | {"marks": (0.5, 1.0), "symbols": (0.4, 0.01)}
    rows = quality_rules.measured(spark.createDataFrame([(1, "a! $b?")], "doc_id long, text string"))
    assert rows.select(quality_rules.cascade(estimates)).first()[0] == "symbols"


def test_shards_are_even_gapless_and_edited(spark, tmp_path):
    found = slots.shard_rows(documents(spark)).toPandas()
    sums = found.groupby("shard")["size"].sum()
    assert len(sums) == slots.SHARDS
    for _, places in found.groupby("shard")["slot"]:
        assert sorted(places) == list(range(len(places)))
    held, weights = slots.first_map(64, 4), {s: 1 + s % 7 for s in range(64)}
    edited = slots.rebalanced(held, weights, 4)
    load = collections.Counter()
    for slot, shard in edited.items():
        load[shard] += weights[slot]
    assert max(load.values()) - min(load.values()) <= 1
    assert sum(edited[s] == held[s] for s in held) > 32


def test_the_map_of_shards_is_carried_on(spark, tmp_path):
    docs, path = documents(spark), str(tmp_path / "map")
    place = lambda rows, shards: {(r["doc_id"], r["text_crc32"]): r["shard"] for r in slots.shard_rows(rows, 64, shards, path).collect()}
    first = place(docs, 4)
    assert place(docs, 4) == first and slots.versions(spark, path) == {1: True, 2: True, 3: True}
    (tmp_path / "map" / "version=000004").mkdir()  # of a run that was stopped
    grown = place(docs, 5)
    moved = [key for key in first if grown[key] != first[key]]
    assert set(grown.values()) == set(range(5)) and len(moved) < len(first) / 2
    fewer = place(docs, 3)
    assert set(fewer.values()) == set(range(3)) and max(slots.versions(spark, path)) == 6
    held = {r["virtual_slot"]: r["shard"] for r in slots.read_map(spark, path, 6).collect()}
    assert len(held) == 64 and max(held.values()) == 2
    with pytest.raises(ValueError):
        slots.shard_rows(docs, 32, 3, path)


def test_pipeline(spark):
    docs = documents(spark)
    good = quality_pu.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    single = simhash_vptree.keep_one(good)
    clean = decontaminate.clean(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(clean).collect())
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == copies
