"""Mixing, hard negatives and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import hardneg, merkle, mixing
from lodestone.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, size string, key string, h string"
BODY = "The Quick brown fox. " * 3


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "c", "k", "h") for r in rows], DOCS)


def odd_rows():
    """Nulls, empty and long texts, repeated rows and doc_ids, ties and code points beyond the first plane."""
    rows = [(1, None, "en", "b", 3), (2, "", None, "b", None), (None, BODY, "en", "b", 1), (None, BODY, "en", "b", 1), (3, BODY * 5000, "en", None, 5), (4, "É ß 日 A", "fr", "😀", 9), (4, "É ß 日 A", "fr", "😀", 9), (4, "other words", "fr", "😀", 9), (5, " \n\t", "en", "é", 2), (-6, "x Y", "en", "", 1)]
    return rows + [(100 + i, f"Word {i} " * (i % 7), "en", "z", i) for i in range(60)]


# ---- mixing


def brute_targets(sizes, weights, budget):
    """Shares are given out and cut back again and again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(2.0 * sizes[k] for k in sizes if k not in open_)
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > 2.0 * sizes[k] + 1e-9}
        if not over:
            return {k: share[k] if k in open_ else 2.0 * sizes[k] for k in sizes}
        open_ -= over
    return {k: 2.0 * sizes[k] for k in sizes}


def check_mix(found, rows):
    sizes, words = {}, {}
    for doc_id, text, _, source, _ in rows:
        n = len([w for w in __import__("re").split(r"[ \t-\r]+", text or "") if w])
        sizes[source] = sizes.get(source, 0) + n
        words.setdefault((doc_id, n), []).append(source)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    targets = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted((i is None, i or 0, n) for (i, n), s in words.items() for _ in s)
    taken, largest, source_of = {}, {}, {s: t for s, t in targets.items()}
    for r in found:
        (source,) = {s for s in words[r.doc_id, r.size] if sizes[s] == r.source_size and math.isclose(source_of[s], r.target, rel_tol=1e-9, abs_tol=1e-6)}
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6, (s, taken[s], t)


def test_mix(spark):
    rows = odd_rows()
    docs = table_of(spark, rows)
    found = mixing.mix(docs).collect()
    check_mix(found, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id = 1")).collect()[0].taken == 0
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns and texts.count() >= 60


def test_mix_of_one_repeated_row_and_many_sources(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 300 + [(i, "w " * (i % 9 + 1), "en", f"t{i % 50:02}", 1) for i in range(2, 900)]
    check_mix(mixing.mix(table_of(spark, rows)).collect(), rows)


def test_smaller_budgets_are_nested(spark):
    docs = table_of(spark, [(i, "w " * (i % 9 + 1), "en", "s", 1) for i in range(500)])
    small, large = ({r.doc_id for r in mixing.mix(docs, share=s).collect() if r.copies} for s in (0.2, 0.6))
    assert small < large


def test_levels_of_targets(spark):
    r = random.Random(5)
    for _ in range(3):
        sizes = {i: r.choice([0, 1, 5, 50, 1000]) for i in range(12)}
        weights = {i: r.choice([1, 2, 5]) for i in sizes}
        budget = r.choice([0.1, 0.9, 1.5, 1.99]) * sum(sizes.values())
        rows = spark.createDataFrame([(i, sizes[i], weights[i]) for i in sizes], "i int, size long, weight int")
        want = brute_targets(sizes, weights, budget)
        assert all(math.isclose(x.target, want[x.i], rel_tol=1e-9, abs_tol=1e-6) for x in mixing.targets(rows, budget).collect())


# ---- hard negatives


def brute_negatives(rows, every=100):
    own = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= 1 << 24 for x in v):
            continue
        own.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, v, label) in enumerate(own):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, other == label) for j, (b, w, other) in enumerate(own) if i != j and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in scored if x[2])[:5]:
            fit = sorted((s, b) for s, b, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(a, p, k + 1, b, -ps, -s) for k, (s, b) in enumerate(fit[:5])]
    return sorted(out)


def random_vectors(n, dim, r, spread=0.25):
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i * 10, [c + r.gauss(0, spread) for c in centres[r.randrange(4)]], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.003, 300.0, 60000.0])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hardneg, "ANCHORS", 16)  # read again for each block of rows
    monkeypatch.setattr(hardneg, "ROWS", 50)
    r = random.Random(int(scale))
    rows = [(i, [x * scale for x in v], label) for i, v, label in random_vectors(700, 8, r)]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    r = random.Random(8)
    same = [0.5, 0.25, -0.125]
    rows = [(100 * i, same, i % 2) for i in range(12)] + [(3, same, 0)] * 9 + [(5, same, 1)] * 9 + [(100, same, 1)] * 2
    rows += [(None, same, 1), (8, None, 1), (9, same, None), (200, [float("nan"), 1.0, 1.0], 1), (300, [float("inf"), 1.0, 1.0], 0), (11, [None, 1.0, 2.0], 1), (13, [1e30, 0.0, 0.0], 1)]
    rows += [(400, [], 1), (15, [], 1), (16, [], 0), (500, [0.0, 0.0, 0.0], 1), (600, [-1.0, -1.0, -1.0], 5), (17, [1.0, 1.0, 1.0], 5), (700, [1.0, 0.0], 2), (18, [1.0, 0.5], 2), (19, [0.99, 0.5], 3)]
    rows += random_vectors(80, 3, r)
    docs = spark.createDataFrame([(*x, "q", 1, 2.0) for x in rows], "vec_id long, embedding array<float>, label int, row string, rank int, score double")
    got = sorted(map(tuple, hardneg.mine(docs).collect()))
    assert got == brute_negatives(rows) and got
    assert hardneg.mine(docs.limit(0)).count() == 0


def test_intervals_hold_the_score():
    """Whatever is still open after all planes has the exact product, and nothing that qualifies is dropped."""
    r = np.random.default_rng(2)
    v, a = r.integers(-300, 300, size=(200, 16)), r.integers(-300, 300, size=(9, 16))
    score = a @ v.T

    def qualify(low, high, open_):
        assert ((low <= score) & (score <= high)).all() or not open_.all()
        return open_ & (high >= 400_000)

    i, j, found = hardneg.Slices(v).scores(a, np.ones(score.shape, dtype=bool), qualify)
    assert set(zip(*np.nonzero(score >= 400_000), strict=True)) <= set(zip(i, j, strict=True)) and (found == score[i, j]).all()


# ---- Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    said = (None if x is None else str(x) for x in (doc_id, source, lang, n, text))
    return h("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in said))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, at, acc):
    proof = ""
    for nodes in levels[:-1]:
        start = at // 16 * 16
        left, right = "".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])
        proof, acc, at = proof + left + right, h(left + acc + right), at // 16
    return proof, acc


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in order}
    levels = {s: levels_of([leaf_of(r) for r in trees[s]]) for s in order}
    top = levels_of([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            changed = leaf_of(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            proof, acc = climb(levels[s], i, changed)
            over, acc = climb(top, k, acc)
            out.append((r[0], leaf_of(r), levels[s][-1][0], top[-1][0], h(proof + over), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("asking", [256, 1])
def test_manifest(spark, monkeypatch, asking):
    monkeypatch.setattr(merkle, "ASKING", asking)  # 1: nodes lie in several copies
    rows = odd_rows() + [(i % 700, f"T{i}", "en", f"s{i % 3}" if i % 2 else "hot", i) for i in range(900)] + [(i, "T", "en", f"u{i}", i) for i in range(300)]
    docs = table_of(spark, rows)
    got = merkle.verified(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)
    assert {True, False} == {r.verified for r in got}
    assert merkle.verified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "Ab", "en", None, i) for i in range(n)]
    got = merkle.verified(table_of(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


def test_proofs_of_some_leaves(spark):
    leaves, nodes, root = merkle.manifest(table_of(spark, odd_rows()), shared_dir(spark, "t"))
    some = merkle.proofs(leaves.where("doc_id % 9 = 0"), nodes)
    from pyspark.sql import functions as F

    assert {r[0] for r in some.select(merkle.fold(F.col("leaf"), F.col("path"))).collect()} == {root}
