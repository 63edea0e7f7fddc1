"""Near-duplicate operators against brute force and on awkward rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regula.llm import linededup, links, minhash, suffixdedup, text
from tests.llm import cases


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, **{i: 100 for i in range(101, 140)}}


def test_components_of_nothing(spark):
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (3, 40, 1000):
        a, b = base[:n], np.concatenate([base[n // 10:n], base[2000:2000 + n // 10]])
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sk = minhash.fast_sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 512)
        assert (sk != np.uint64(2**64 - 1)).all()
        assert abs((sk[0] == sk[1]).mean() - both) < 0.1


def _near_brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    base = [[f"v{rnd.randrange(4000)}" for _ in range(rnd.randrange(20, 150))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), "a b"), (len(rows) + 1, "A  b"), (len(rows) + 2, ""), (len(rows) + 3, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == _near_brute(rows, 3, 85)


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(cases.awkward(spark), shingle=3, percent=85)
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["component_id"], r["kept"]) for r in got.collect() if r["doc_id"])
    assert rows == [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True),
                    (8, 8, True), (9, 9, True)]
    assert got.count() == 13
    assert {r["doc_id"] for r in minhash.keep_one(cases.awkward(spark)).collect()} == {1, 4, 5, 6, 7, 8, 9, None}
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0


def _line_brute(docs):
    occ = [(i, p, x.strip(linededup.BLANKS)) for i, t in sorted(docs) if t is not None for p, x in enumerate(t.split("\n"))]
    lines = sorted({x for _, _, x in occ if x})
    q = linededup.Q
    sets = [frozenset(x[i:i + q] for i in range(max(1, len(x) - q + 1))) for x in lines]
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= linededup.PERCENT * (len(sets[i]) + len(sets[j]) - k) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    place, seen, kept = {x: label[i] for i, x in enumerate(lines)}, set(), {i: [] for i, _ in docs}
    for i, p, x in occ:
        if not x or place[x] not in seen:
            kept[i].append(p)
            seen.add(place.get(x))
    return {i: "\n".join(t.split("\n")[p] for p in kept[i]) if t is not None else None for i, t in docs}


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(60, 200))) for _ in range(30)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(6):
            x = list(rnd.choice(base))
            if rnd.random() < 0.4:
                x[rnd.randrange(len(x))] = "Z"
            lines.append("".join(x) if rnd.random() < 0.9 else "")
        docs.append((i, "\n".join(lines)))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == _line_brute(docs)


def test_line_dedup_awkward(spark):
    docs = cases.awkward(spark)
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [cases.words(80)] and by[2] == [""] and by[4] == [None] and by[5] == [""]
    assert by[9] == ["żółw 😀 ▁x  y\n\nlast"] and None in by[None]
    assert linededup.dedup_lines(cases.empty(spark)).count() == 0


def _repeat_brute(docs):
    first, out = {}, {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first[raw[p:p + 50]] = min(i, first.get(raw[p:p + 50], i))
    for i, t in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array_and_kasai():
    rng = np.random.default_rng(0)
    for n in (1, 9, 700):
        data = rng.integers(97, 99, n).astype(np.uint8)
        order, rank = suffixdedup.suffix_array(data, 1024)
        raw = data.tobytes()
        assert list(order) == sorted(range(n), key=lambda i: raw[i:]) and (rank[order] == np.arange(n)).all()
        lcp = suffixdedup.kasai(data, order, np.array([0]), np.array([n]), 50)
        for i in range(1, n):
            a, b = raw[order[i - 1]:], raw[order[i]:]
            k = next((j for j in range(min(len(a), len(b), 50)) if a[j] != b[j]), min(len(a), len(b), 50))
            assert lcp[i] == k or k == min(len(a), len(b)) <= lcp[i]  # zeros follow the end


@pytest.mark.parametrize("shard,part", [(1 << 20, 1 << 20), (1500, 700)])
def test_repeats_match_brute_force(spark, monkeypatch, shard, part):
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffixdedup, "PART_BYTES", part)
    rnd = random.Random(4)
    stock = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randrange(30, 160))) for _ in range(12)] + ["xyz" * 90]
    docs = [(i, "".join(rnd.choice(stock) if rnd.random() < 0.6 else "".join(rnd.choice("stuv") for _ in range(60)) for _ in range(5)))
            for i in range(60)] + [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 49)]
    got = suffixdedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == _repeat_brute(docs)


def test_repeats_awkward(spark):
    rows = [tuple(r) for r in suffixdedup.remove_repeats(cases.awkward(spark), with_text=True).collect()]
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert by[2][0][2] == by[2][0][1] > 0 and by[1][0][2] == 0 and by[4][0][1:4] == (0, 0, 0)
    assert by[3][0] == by[3][1]  # rows of one id do not cut each other
    assert suffixdedup.remove_repeats(cases.empty(spark)).count() == 0


def test_word_spans_and_hashes():
    column = pa.array(["ab cd", None, "ab\x0bcd  e", "", "x" * 400 + " ab", " "])
    data, offsets = text.text_bytes(column)
    starts, ends, rows = text.word_spans(data, offsets)
    found = [(int(r), data[a:b].tobytes()) for a, b, r in zip(starts, ends, rows)]
    assert found == [(0, b"ab"), (0, b"cd"), (2, b"ab"), (2, b"cd"), (2, b"e"), (4, b"x" * 400), (4, b"ab")]
    h = text.span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_family_whose_base_is_not_least_matches_brute_force(spark):
    # many edited copies, alike to their base only; 300 of them share buckets
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rnd.sample(range(8), 8):
            w[p * 37 + rnd.randrange(30)] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    rows.insert(200, (1000, " ".join(base)))
    want = _near_brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) == 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_long_lines_of_a_repeated_phrase_match_brute_force(spark):
    # 30 distinct shingles in lines of 1 500 to 9 000 characters, none byte-equal
    rnd = random.Random(12)
    docs = []
    for g in range(40):
        phrase = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
        docs += [(2 * g, phrase * 50), (2 * g + 1, phrase * 300)]
    signed = {r["k"] for r in linededup.signatures(linededup.line_rows(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")).collect()}
    assert len(signed) == len(docs)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == _line_brute(docs)


def test_contents_are_fetched_once_for_all_rounds(spark):
    # members alike to 8 only, which is not the bucket's least id
    base = [7919 * (i + 1) for i in range(100)]
    sets = {i: base[:10 * i] + base[10 * i + 10:] for i in range(8)} | {8: base, 9: [5, 6], 10: [5, 6, 7]}
    calls = []

    def near(ids):
        calls.append(sorted(r["id"] for r in ids.collect()))
        return links.likely_rows(spark.createDataFrame(sorted(sets.items()), "id long, s array<long>"), "id", ids).join(ids, "id", "left_semi")

    def marks(kept, ids):
        return links.set_marks(kept.join(ids, "id", "left_semi").select("id", F.explode("s").alias("h")), 4)

    def verify(kept, pairs):
        both = F.size(F.array_intersect("sa", "sb"))
        return links.paired(pairs, kept, "s").where(100 * both >= 85 * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    buckets = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 9), (2, 10), (3, 11)], "bucket long, id long")
    got = links.linked_components(buckets, near, verify, marks, 85)
    assert {r["id"]: r["component"] for r in got.collect()} == {i: 0 for i in range(1, 9)}
    assert calls == [list(range(11))]


def test_parities_of_sets(spark):
    sets = {1: [0, 63, 64, 200, -7], 2: [5], 3: list(range(0, 9000, 37))}
    rows = spark.createDataFrame([(i, h) for i, hs in sets.items() for h in hs], "id long, h long")
    for r in links.set_marks(rows, 4).collect():
        odd = [0] * 4
        for h in sets[r["id"]]:
            odd[(h >> 6) % 4] ^= 1 << (h & 63)
        assert r["n"] == len(sets[r["id"]]) and [r[f"w{j}"] % 2**64 for j in range(4)] == odd


def test_texts_are_not_broadcast_and_move_for_candidates_only(spark):
    rows = spark.createDataFrame([(i, cases.words(30, 100 * i)) for i in range(200)], "id long, text string")
    ids = spark.createDataFrame([(3,), (9,)], "id long")
    assert sorted(r["id"] for r in links.likely_rows(rows, "id", ids).collect()) == [3, 9]
    pairs = spark.createDataFrame([(3, 9)], "a long, b long")
    joined = links.paired(pairs, rows, "text")
    assert [(r["a"], r["b"], r["sa"], r["sb"]) for r in joined.collect()] == [(3, 9, cases.words(30, 300), cases.words(30, 900))]
    assert joined._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2


def test_finished_stars_take_no_round(spark, monkeypatch):
    rounds = []
    star_round = links._star_round
    monkeypatch.setattr(links, "_star_round", lambda edges: rounds.append(1) or star_round(edges))
    stars = [(1, 2), (3, 1), (1, 2), (5, 9), (5, 5)]
    got = links.components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted((r["id"], r["component"]) for r in got.collect()) == [(2, 1), (3, 1), (9, 5)] and not rounds
    # an id with two edges up, and a centre that has an edge up itself
    for edges, want in (([(1, 4), (2, 4)], {2: 1, 4: 1}), ([(1, 2), (2, 3)], {2: 1, 3: 1})):
        rounds.clear()
        got = links.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r["id"]: r["component"] for r in got.collect()} == want and len(rounds) == 1


def test_a_shingle_is_hashed_once_and_buckets_are_stored(spark):
    docs = spark.createDataFrame([(1, cases.words(60) + "\n" + "ab" * 400)], "doc_id long, text string")
    lines = linededup.line_rows(docs, "doc_id", "text")
    plan = linededup._cells(lines, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(substring(") == 1
    signed = linededup.signatures(lines)
    assert not [c for c in signed.columns if c.startswith("c")]
    parts = signed.groupBy("k").agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in parts] == [linededup.PARTS] * 2


def test_sets_of_a_pair_are_made_once(spark):
    pairs = spark.createDataFrame([(1, 2, [1, 2, 3, 4], [1, 2, 3, 4, 5]), (1, 3, [1, 2, 3, 4], [1, 2, 3, 9])],
                                  "a long, b long, sa array<long>, sb array<long>")
    met = links.alike(pairs, 80)
    assert [(r["a"], r["b"]) for r in met.collect()] == [(1, 2)]
    assert met._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
