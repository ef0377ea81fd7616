"""Spelling variants, byte-level BPE and fill-in-middle."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from specweave.llm import byte_bpe, fill_middle, spelling

# --- spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= spelling.TIMES * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def _random_words(seed, letters="abß", size=300):
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))): 5 ** rnd.randint(0, 5) + rnd.randint(0, 3) for _ in range(size)}


@pytest.mark.parametrize("seed", range(3))
def test_variants_are_those_of_all_pairs(spark, seed):
    counts = _random_words(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df, part_rows=40).collect()}
    assert got == _variants(counts)


def test_each_pair_is_found_once_both_ways_and_work_is_small(spark):
    counts = _random_words(7, "abcdé", 600)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = Counter((r["word"], r["near"]) for r in spelling.near_words(df).collect())
    assert set(got) == {(a, b) for a in counts for b in counts if _near(a, b)} and max(got.values()) == 1
    named = df.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    assert spelling.errata(named).count() <= len(counts) * (math.log2(len(counts)) + 1)


def test_words_are_counted_as_stated(spark, odd, empty):
    rnd = random.Random(3)
    pool = ["Wonderful", "Zürichberg", "gleaming", "ab", "ÀÉÎõü÷", "x" * 700, "letters"]
    rows = [(i if i else None, " ".join(rnd.choice(pool) + rnd.choice(["", ",", "1", "日"]) for _ in range(200))) for i in range(30)] + [(31, None), (32, "")]
    want = Counter()
    for doc_id, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: r["n"] for r in spelling.words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert spelling.variants(spelling.words(empty)).count() == 0
    assert spelling.variants(spelling.words(odd, fewest=1)).count() > 0


def test_a_word_of_a_million_characters(spark):
    df = spark.createDataFrame([("x" * 1_000_000, 9), ("x" * 999_999, 50), ("x" * 500_000 + "y" + "x" * 499_999, 1)], "word string, n long")
    got = {len(r["word"]) + ("y" in r["word"]): (r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == {1_000_000: (2, 50), 999_999: (2, None), 1_000_001: (2, 50)}


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(11)
    chars = "aabcdeeorst  \n\t0159'-.,ÄéßЖ日語🦊 ​\x00\x1c<|endoftext|>"
    return ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 400))) for _ in range(120)] + ["x" * 30_000, "=" * 5_000, "the cat's hats aren't theirs " * 500]


def test_ids_are_those_of_the_library(spark, encoding, odd):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").union(odd.select("doc_id", "text"))
    for r in byte_bpe.encode(docs).collect():
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"]).hexdigest()
    texts = dict(enumerate(_texts()))
    got = {r["doc_id"]: r for r in byte_bpe.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == encoding.encode_ordinary(t)
        assert bytes(got[i]["decoded"]) == t.encode()
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class _Own(byte_bpe.Codec):
    """A codec of ranks made for a test."""

    def __init__(self, ranks):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self._start()
        self.known, self.shared, self.pattern = {}, {}, regex.compile(r"(?s).+")


@pytest.mark.parametrize("seed", range(6))
def test_ranks_in_any_order(seed):
    """Where a merge makes pairs of lower rank, the replay still does what merging the least pair does."""
    import tiktoken

    rnd = random.Random(seed)
    ranks = {bytes([b]): 200 + b for b in range(256)}
    pool = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(60)})
    rnd.shuffle(pool)
    free = iter([*range(200), *range(456, 900)])
    ranks |= {w: next(free) for w in pool}
    codec, library = _Own(ranks), tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    words = sorted({bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 40))) for _ in range(200)})
    for w, ids in zip(words, codec.replay(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (library.encode_ordinary(w.decode()) if w else [])
        assert w in ranks or codec.by_least(w) == ids


def test_frequent_words_are_replayed_for_the_corpus_and_others_where_they_lie(spark, encoding, monkeypatch):
    docs = spark.createDataFrame([(0, "often " * 900 + " seldom" * 3)], "doc_id long, text string")
    monkeypatch.setattr(byte_bpe, "SHARE", 50)
    words = {r["word"].decode(): np.frombuffer(r["ids"], "<u4").tolist() for r in byte_bpe.vocabulary_of(docs).collect()}
    assert set(words) == {" often"} and words[" often"] == encoding.encode_ordinary(" often")


# --- fill-in-middle


def _pieces(rope):
    """Heights differ by two at most, counts are those of the leaves."""
    if rope.left is None:
        assert rope.chars == len(rope.text)
        return
    assert abs(rope.left.height - rope.right.height) <= 2
    assert rope.units == rope.left.units + rope.right.units and rope.chars == rope.left.chars + rope.right.chars
    _pieces(rope.left), _pieces(rope.right)


@pytest.mark.parametrize("unit", [fill_middle.CODE_POINT, r"\s*\S+", r"[^\n]*\n?"])
def test_ropes_split_and_join(unit):
    rnd = random.Random(5)
    for size in (0, 1, 50, 3000, 40_000):
        text = "".join(rnd.choice("ab \n日🦊") for _ in range(size))
        rope = fill_middle.Rope.of(text, unit)
        for _ in range(20):
            a, b = fill_middle.split(rope, rnd.randint(0, rope.units + 1), unit=unit)
            assert str(a) + str(b) == text and a.units + b.units == rope.units
            rope = fill_middle.concat(a, b)
            _pieces(rope)
            c, d = fill_middle.split(rope, k := rnd.randint(0, rope.chars), "chars", unit)
            assert str(c) == text[:k] and str(d) == text[k:]


def test_joining_many_small_ropes_keeps_the_tree_flat():
    rope = fill_middle.concat(*(fill_middle.Rope("ab", 2) for _ in range(5000)))
    _pieces(rope)
    assert rope.height < 30 and len(str(rope)) == 10_000


def test_words_as_units():
    n, form, prefix, middle, out = fill_middle.transform("one two three four", 1, 3, 0, 99, r"\s*\S+")
    assert (n, form, prefix, middle, str(out)) == (4, "psm", 3, 10, "<P>one<S> four<M> two three")


@pytest.mark.parametrize("text", ["a<S", "<", "<P", "P>x<", "<<S", "<M<M", "a", "日本<語"])
@pytest.mark.parametrize("spm", [0, 99])
def test_what_looks_like_a_sentinel_is_restored(text, spm):
    for a in range(len(text) + 1):
        for b in range(len(text) + 1):
            *_, form, _, _, out = (0, *fill_middle.transform(text, a, b, 0, spm)[1:])
            assert fill_middle.restore(str(out), form) == text


def test_outputs_follow_the_hash_and_are_restored(spark, odd, empty):
    extra = [(100 + i, t) for i, t in enumerate(["has <P> in it", "<M>", "plain words of a text " * 400, "🦊" * 3000])] + [(200 + i, f"text of number {i} " * 9) for i in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = fill_middle.restored(fill_middle.fill_in_middle(docs)).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted((str(r["doc_id"]), r["restored"]) for r in rows) == sorted((str(i), t) for i, t in texts)
    seen = Counter()
    for r in rows:
        t = r["restored"]
        h = [int(hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[8 * k :][:8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"]) == (len(t), form, want)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        seen[form] += 1
    assert len(seen) == 3 and fill_middle.fill_in_middle(empty).count() == 0
