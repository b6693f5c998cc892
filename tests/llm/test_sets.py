"""Near-duplicates: sketches and whole results against brute force."""

import itertools

import numpy as np
import pytest

from corpusloom.llm import common, components, op2_minhash
from corpusloom.llm.components import connected_components
from corpusloom.llm.op2_minhash import BANDS, ROWS, near_duplicates
from corpusloom.llm.shingles import WordHashes, shingle_set, words_of
from corpusloom.llm.sketch import Sketcher

from .helpers import awkward, documents, empty


def plain_set(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def plain_components(rows, k, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, plain_set(t, k)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_components(rows, k)
    got = near_duplicates(docs, k=k).collect()
    assert len(got) == len(rows)
    assert sorted((r["n_shingles"] for r in got)) == sorted(len(plain_set(t, k)) for _, t in rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_no_rows(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_chains_and_crowds(spark):
    """Copies with more and more edits: links form chains, and many texts share most bands."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, size=i % 12, replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(40)]
    want = plain_components(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows), k=2).collect()}
    assert got == want


def test_bounded_pieces_of_work(spark, monkeypatch):
    """Small blocks, parts and packs, and shuffled joins, give the same components."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.02 * (i % 9) else f"z{rng.integers(10**6)}" for w in base)) for i in range(150)]
    copies = [(1000 + i, rows[i % 7][1]) for i in range(60)]
    rows, want = rows + copies, plain_components(rows + copies, 2)
    for name, value in (("BLOCK", 16), ("SPLITS", 3), ("SKETCH_PACK", 4000), ("SET_PACK", 6000)):
        monkeypatch.setattr(op2_minhash, name, value)
    monkeypatch.setattr(common.joined, "__defaults__", ("inner", 4, 0))
    monkeypatch.setattr(components, "BROADCAST_EDGES", 0)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows), k=2).collect()} == want


def test_an_id_of_many_texts(spark):
    """A third of the rows share an id, others have none; each text belongs to its own component."""
    text = lambda i, end="": " ".join(f"t{i}_{j}" for j in range(60)) + end
    rows = [(5, text(i)) for i in range(20)] + [(100 + i, text(i, " end")) for i in range(20)] + [(None, text(i, " last")) for i in range(20)]
    got = near_duplicates(documents(spark, rows), k=2).collect()
    assert all(r["component_id"] == 5 and r["kept"] == (r["doc_id"] == 5) for r in got if r["doc_id"] is not None)
    rows = [(5, text(0)), (5, text(1)), (6, text(0, " q")), (7, text(1, " q")), (8, text(0, " r"))]
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, rows), k=2).collect()) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False)]


def test_sample_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, k=2).collect()}
    assert got == plain_components(rows, 2)


def test_low_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(empty(spark), percent=50)


def test_sketch_fills_every_coordinate_and_estimates():
    sketcher, hashes = Sketcher(BANDS, ROWS), WordHashes()
    for n in (1, 2, 7, 300, 5000):
        s = shingle_set([b"%d" % i for i in range(n)], 1, hashes)
        assert len(s) == n and (sketcher.sketch(s) != np.uint64(2**64 - 1)).all()
    shares = []
    for trial in range(60):
        a = shingle_set([b"%d-%d" % (trial, i) for i in range(100)], 1, hashes)
        b = shingle_set([b"%d-%d" % (trial, i) for i in range(11, 111)], 1, hashes)  # 89 of 111
        shares.append((sketcher.sketch(a) == sketcher.sketch(b)).mean())
    assert abs(np.mean(shares) - 89 / 111) < 0.02 and min(shares) > 0.64


def test_words_split_at_ascii_space_only():
    assert words_of("A\u00a0B c\x0bD\x1cE") == ["a\u00a0b".encode(), b"c", b"d\x1ce"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5), (101, 100)] + [(200, 200 + i) for i in range(1, 30)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(30)}}
    assert connected_components(edges.limit(0)).collect() == []
