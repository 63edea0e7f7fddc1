"""Vector codes, whitening and exact duplicates against brute force and on
awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regula.llm import exactdedup, vectorcodes, whitening
from tests.llm import cases

VECTORS = "vec_id long, embedding array<float>, label int, id long, vector string, code string, n long, component string"


def vector_table(spark, vectors, labels=None, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], labels[i] if labels else i % 3,
             7, "v", "c", 7, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS)


# ------------------------------------------------------------------ GNAT, codes

@pytest.mark.parametrize("spread", [2, 40, 100000])
def test_gnat_finds_the_nearest_entry_of_least_index(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (64, 4))
    points[40:50] = points[3]  # repeated entries
    queries = np.concatenate([rng.integers(-spread, spread + 1, (3000, 4)), points, rng.integers(-9 * spread, 9 * spread, (50, 4))])
    d = ((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    found, best, work = vectorcodes.Gnat(points).search(queries)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert work <= d.size


def test_gnat_leaves_out_most_of_clustered_entries():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10000, 10000, (8, 4))
    points = (centres[:, None, :] + rng.integers(-50, 50, (8, 8, 4))).reshape(64, 4)
    queries = points[rng.integers(0, 64, 1000)] + rng.integers(-20, 20, (1000, 4))
    *_, work = vectorcodes.Gnat(points).search(queries)
    assert work < 64 * len(queries) / 3


def test_gnat_of_few_or_equal_entries():
    one = np.array([[1, 2]])
    assert vectorcodes.Gnat(one).search(np.array([[5, 5], [1, 2]]))[0].tolist() == [0, 0]
    same = np.zeros((30, 2), np.int64)
    assert vectorcodes.Gnat(same).search(np.array([[5, 5]]))[0].tolist() == [0]


def codes_brute(rows):
    """rows: (vec_id, vector, label); plain Python integers throughout."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return {}
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in kept]
    width = len(x[0]) // 16
    cut = [[tuple(v[j * width:(j + 1) * width]) for j in range(16)] for v in x]
    first = sorted(range(len(kept)), key=lambda i: kept[i][0])[:64]
    books = [[cut[i][j] for i in first] for j in range(16)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda j, v: min((far(v, e), k) for k, e in enumerate(books[j]))
    for _ in range(2):
        new = []
        for j in range(16):
            got = {}
            for v in cut:
                got.setdefault(nearest(j, v[j])[1], []).append(v[j])
            new.append([tuple(sum(c) // len(got[k]) for c in zip(*got[k])) if k in got else e for k, e in enumerate(books[j])])
        books = new
    last = [[nearest(j, v[j]) for j in range(16)] for v in cut]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in last]
    of_label = {}
    for (_, _, label), e in zip(kept, error):
        of_label[label] = of_label.get(label, 0) + e
    return {r[0]: ("".join(f"{k:02x}" for _, k in n), e, of_label[r[2]], sha) for r, n, e in zip(kept, last, error)}


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [list(v) for v in rng.normal(0, 0.2, (150, 32)).round(2)]
    vectors += [vectors[0]] * 30 + [None, [], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [None] + [0.0] * 31]
    order = random.Random(2).sample(range(-50, len(vectors) - 50), len(vectors))
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(vectors))]
    table = vector_table(spark, vectors, labels, order)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vectorcodes.compress(table).collect()}
    assert got == codes_brute(list(zip(order, vectors, labels)))


def test_codes_of_many_labels_are_salted(spark):
    coded = spark.createDataFrame([(i, None if i < 90 else i, "00", i) for i in range(200)], "id long, label long, code string, error long")
    got = {r["id"]: r["label_error"] for r in vectorcodes.with_label_error(coded, few=3).collect()}
    assert got == {i: sum(range(90)) if i < 90 else i for i in range(200)}


def test_codes_awkward(spark):
    ones = [1.0] * 32
    table = vector_table(spark, [ones, ones, None, [1.0] * 48, [1.0] * 5, []], [1, None, 1, 1, 1, 1], [None, 4, 4, 5, 6, 7])
    got = vectorcodes.compress(table).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [(0, "00" * 16, 0, 0), (4, "00" * 16, 0, 0)]
    for nothing in (vector_table(spark, []), vector_table(spark, [None, [], [1.0] * 5])):
        assert vectorcodes.compress(nothing).collect() == []
    with pytest.raises(Exception, match="vector component"):
        vectorcodes.compress(vector_table(spark, [[1e30] * 16])).collect()


def test_decoded_codes_have_the_stated_error(spark):
    rng = np.random.default_rng(6)
    table = vector_table(spark, [list(v) for v in rng.normal(0, 0.2, (100, 32))])
    rows = table.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    books = vectorcodes.fit(rows, 32)
    raw = {r["id"]: r["vector"] for r in rows.collect()}
    for r in vectorcodes.decode(vectorcodes.encode(rows, 32, books), books).collect():
        assert sum((math.floor(256 * x) - y) ** 2 for x, y in zip(raw[r["id"]], r["decoded"])) == r["error"]


# -------------------------------------------------------------------- whitening

def whitening_brute(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    wide = x * n - sums
    centred = wide.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, (wide * wide).sum(axis=1), centred, values[::-1], axes[:, ::-1]


def whitened_rows(out):
    rows = out.collect()
    used = max((r["component"] for r in rows), default=0)
    table = {}
    for r in rows:
        table.setdefault(r["vec_id"], [None] * used)[r["component"] - 1] = r["whitened"]
    return rows, np.array([table[k] for k in sorted(table)])


@pytest.mark.parametrize("scales", [(1,) * 12, (3000, 500, 90, 40, 8, 3, 1, 0.5, 0.3, 0.2, 0.1, 0.05)])
def test_whitening_matches_eigenvectors(spark, scales):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    vectors = [list(v) for v in (rng.normal(size=(400, 12)) * 4 * scales) @ turn + rng.normal(size=12)]
    rows, got = whitened_rows(whitening.whiten(vector_table(spark, vectors)))
    n, off, centred, values, axes = whitening_brute(vectors)
    want = centred @ axes / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert got.shape == (400, 12) and np.abs(got - want * signs).max() < 1e-6
    for r in rows:
        assert r["n"] == n and int(r["deviation"]) == off[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-7


def test_whitening_of_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-300, 300, (200, 3))
    whole = np.concatenate([base, base[:, :2] + base[:, 1:], np.full((200, 2), 5)], axis=1)
    rows, got = whitened_rows(whitening.whiten(vector_table(spark, (whole / 64).tolist())))
    assert got.shape == (200, 3)
    assert np.abs(got.T @ got / 200 - np.eye(3)).max() < 1e-8 and rows[0]["identity_error"] < 1e-8


def test_whitening_awkward(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, -1.0]]
    table = vector_table(spark, [*good, None, [], [nan, 0.0], [0.0, -inf], [None, 1.0], [1.0]], ids=[None, 1, 1, 2, 3, 4, 5, 6, 7, 8])
    out = whitening.whiten(table).collect()
    assert len(out) == 8 and {r["n"] for r in out} == {4} and out[0]["identity_error"] < 1e-12
    assert {r["vec_id"] for r in out} == {None, 1, 2}
    for nothing in ([], [None], [[2.0, 2.0]] * 5):
        assert whitening.whiten(vector_table(spark, nothing)).collect() == []


def test_wide_integers_stay_exact():
    x = np.array([[1 << 29, 5], [7, 1 << 29]])
    n, sums = 10 ** 11, (10 ** 11 * 3, 10 ** 11 * 4)
    assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]


# ------------------------------------------------------------- exact duplicates

def dup_brute(rows):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [4, exactdedup.SHARE])
def test_exact_duplicates_match_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(exactdedup.winners, "__defaults__", (share, 64))
    rnd = random.Random(share)
    texts = ["Straße", "STRASSE", "ABC é", "abc É", "abc é", "", None, " "] + [f"Text {i}" for i in range(40)]
    rows = [(i, rnd.choice([rnd.choice(texts), "the Common text"])) for i in range(400)]
    got = exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == dup_brute(rows)


def test_winners_are_the_frequent_digests(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else "warm" if i % 10 == 1 else f"t{i}") for i in range(1000)], "id long, digest string")
    got = {r["digest"]: (r["keep_id"], r["group_size"], r["ties"]) for r in exactdedup.winners(rows, 16, 64).collect()}
    assert got == {"hot": (999, 334, 1), "warm": (991, len([i for i in range(1000) if i % 3 and i % 10 == 1]), 1)}


def test_exact_duplicates_awkward(spark):
    table = cases.awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = exactdedup.exact_duplicates(table)
    assert sorted(map(tuple, got.collect()), key=str) == dup_brute(rows)
    kept = exactdedup.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 5, 6, 7, 8, 9]
    assert exactdedup.exact_duplicates(cases.empty(spark)).count() == 0 and exactdedup.keep_one(cases.empty(spark)).count() == 0


def test_exact_duplicates_use_no_python_workers(spark):
    plan = exactdedup.exact_duplicates(cases.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InArrow", "InPandas"))
