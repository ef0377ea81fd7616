"""Substring and near dedup, components and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import decontamination, graph, near_dedup, suffix_dedup


def _rows(df):
    return [r.asDict() for r in df.collect()]


# --- substrings


def plain_substrings(docs, length=50):
    first, out = {}, {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, d), d)
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[d] = (len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0, hashlib.sha256(left).hexdigest())
    return out


def _passages(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    shared = [" ".join(word() for _ in range(rng.choice([5, 12, 40]))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        docs.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    docs += [(n + 1 + i, docs[3][1]) for i in range(10)] + [(n + 20, "ab" * 300), (n + 21, "x" + "ab" * 100), (n + 22, None), (n + 23, "z" * 49), (n + 24, "z" * 50), (n + 25, "z" * 60)]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_substrings_match_brute_force(spark, seed, monkeypatch):
    if seed:  # small runs, pieces and batches: nothing may depend on them
        monkeypatch.setattr(suffix_dedup, "PIECE", 300)
        monkeypatch.setattr(suffix_dedup, "RUN", 50)
        monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    docs = _passages(seed, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in _rows(suffix_dedup.dedup_substrings(df))}
    assert got == plain_substrings(docs)


def test_blind_tries_and_shallow_sort_find_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[:200]
    data[2000:2200] = 97
    at = np.arange(len(data) - 50)
    doc = at // 500
    got = suffix_dedup.repeats(data, at, doc)
    first = {}
    for i in at:
        s = data[i : i + 50].tobytes()
        first[s] = min(first.get(s, doc[i]), doc[i])
    assert got.tolist() == [bool(first[data[i : i + 50].tobytes()] < doc[i]) for i in at]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(97, 101, 300).astype(np.uint8) for _ in range(2))
    b[37:187] = a[100:250]

    def chosen(x):
        row, start, n, h = suffix_dedup.anchors(x, np.array([0, len(x)]))
        out = {}
        for s, k, v in zip(start, n, h, strict=True):
            out.update({int(s) + i: int(v) for i in range(k)})
        return out

    x, y = chosen(a), chosen(b)
    assert sorted(x) == list(range(251))
    assert all(x[100 + i] == y[37 + i] for i in range(101))


def test_substrings_odd(spark, odd, empty):
    rows = _rows(suffix_dedup.dedup_substrings(odd, keep_text=True))
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in rows)
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    same = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (2, "q" * 80)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in _rows(suffix_dedup.dedup_substrings(same))) == [(1, 0), (1, 0), (2, 80)]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh \xff\x00"])
def test_deep_shallow_sorting_orders_suffixes(alphabet):
    rng = np.random.default_rng(len(alphabet))
    unit = rng.choice(np.frombuffer(alphabet, np.uint8), 70)
    data = np.concatenate([unit, rng.choice(np.frombuffer(alphabet, np.uint8), 200), unit, unit[:60], rng.choice(np.frombuffer(alphabet, np.uint8), 90)])
    at, length = rng.permutation(len(data) - 50), 50
    words = suffix_dedup._characters(np.concatenate((data, np.zeros(length + 8, np.uint8))))
    key = lambda i: data[at[i] : at[i] + length].tobytes()
    order, new = suffix_dedup._multikey(words, at, 16)
    assert [key(i)[:16] for i in order] == sorted(key(i)[:16] for i in range(len(at)))
    assert new.tolist() == [k == 0 or key(order[k])[:16] != key(order[k - 1])[:16] for k in range(len(at))]
    place, leaf = suffix_dedup._blind_tries(words, at[order], np.cumsum(new), 16, length)
    by = np.argsort(place)
    assert sorted(place) == list(range(len(at)))
    got = [key(order[i]) for i in by]
    assert got == sorted(got)
    assert all((leaf[by[k]] == leaf[by[k - 1]]) == (got[k] == got[k - 1]) for k in range(1, len(by)))


# --- near copies


def shingle_set(t, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_near(docs):
    s = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d), root(d) == d) for d in s}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAD_ROWS", 256 if block == 1024 else 3)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            w = [x if rng.random() > rng.choice([0, 0.005, 0.03]) else word() for x in base]
            docs.append((len(docs), " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
    docs += [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in _rows(near_dedup.near_duplicates(df, block))}
    assert got == plain_near(docs)


def test_near_copies_odd(odd, empty):
    rows = _rows(near_dedup.near_duplicates(odd))
    assert len(rows) == odd.count()
    assert [r for r in rows if r["doc_id"] is None] == [{"doc_id": None, "n_shingles": 3, "component_id": None, "kept": False}]
    by = {r["doc_id"]: r for r in rows}
    assert by[11]["component_id"] == 6 and not by[11]["kept"] and by[1]["kept"] and by[1]["n_shingles"] == 0
    assert near_dedup.near_duplicates(empty).count() == 0


def test_repeated_rows_are_not_paired_with_each_other(spark):
    one, two = " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(1, 201))
    rows = spark.range(6000).select((F.col("id") % 2 + 5).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(one)).otherwise(F.lit(two)).alias("text"))
    got = near_dedup.near_duplicates(rows).groupBy("doc_id", "component_id", "kept", "n_shingles").count()
    assert sorted(map(tuple, got.collect())) == [(5, 5, True, 196, 3000), (6, 5, False, 196, 3000)]


def test_rows_of_one_doc_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, "x y"), (4, a), (4, b), (4, ""), (2, a), (3, b), (9, b + " c")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in _rows(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got[0] == (1, 1, 1) and [n for d, n, _ in got if d == 4] == [0, 46, 56]
    home = {c for d, n, c in got if d == 4 and n}
    assert len(home) == 1 and home <= {2, 3}  # both rows of 4 go where its one set goes
    assert {c for d, _, c in got if d in (3, 9)} == {3} and [c for d, _, c in got if d == 2] == [2]


@pytest.mark.parametrize("edges_a_task", [10, 200_000])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(graph, "EDGES", edges_a_task)
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(0, k) for k in range(400, 460)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    alone = {x for e in edges for x in e} - {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in _rows(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)))}
    assert got == {x: root(x) for x in up if x not in alone}


# --- decontamination


def plain_tiles(item, doc, k=5):
    """Greedy tiling straight from its definition."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < k:
            return sum(not x for x in free_i)
        for j in range(n):
            free_i[i + j] = free_d[d + j] = False
        tiles += 1


def test_tiling_matches_the_definition(spark):
    rng = random.Random(11)
    words = "a b c d e f g h".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))) for i in range(12)]
    docs = []
    for d in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(25))]
        if d % 2:
            w = items[d % 12][1].split()
            cut = rng.randrange(len(w))
            own += w[cut:] + ["x"] + w[:cut]
        docs.append((d, ", ".join(own)))
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in _rows(decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))}
    want = {}
    for d, t in docs:
        for i, x in items:
            a, b = x.split(), re.findall(r"\w+", t)
            covered = plain_tiles(a, b)
            if covered >= 0.5 * len(a):
                want[d, i] = covered
    assert got == want


def test_reordered_passages_are_caught_and_blocks_change_nothing(spark, odd, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion under the pale moon tonight"
    w = item.split()
    docs = spark.createDataFrame([(1, "intro " + " ".join(w[10:]) + " middle " + " ".join(w[:10]).upper() + " end"), (2, " ".join(w[:6]) + " and nothing else of it"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, "another text of some ten words that no document has")], "item_id long, text string")
    for limit in (1 << 22, 20):
        assert [(r["doc_id"], r["item_id"], r["n_tiles"]) for r in _rows(decontamination.contaminated(docs, items, block_bytes=limit))] == [(1, 7, 2)]
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_tiles_by_lengths_are_the_same(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        item, doc = (decontamination.mix(rng.integers(0, 1 + seed, rng.integers(0, 60)).astype(np.uint64)) for _ in range(2))
        a, b = decontamination.window_hashes(item, 5), decontamination.window_hashes(doc, 5)
        i, d = np.nonzero(a[:, None] == b[None, :])
        assert decontamination.tile_by_lengths(item, doc) == decontamination.tile(i, d)


def test_documents_of_few_words_are_tiled_in_bounded_memory():
    import resource

    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (30, 60, 200, 400)]
    items = decontamination.Items(texts[:2] + ["x " * 15_000, None])
    raw = [t.encode() for t in texts] + [b"x " * 60_000, b"", b"x " * 20]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    small = slice(0, off[4])
    assert sorted(items.hits(buf[small], off[:5], 0.3, seeds=1)) == sorted(items.hits(buf[small], off[:5], 0.3))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = [x for x in items.hits(buf, off, 0.5) if x[1] == 2]
    assert got == [(4, 2, 1, 15_000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
