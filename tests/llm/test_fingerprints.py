"""Syncmer fingerprints against a plain version in Python."""

import random
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from regula.llm import syncmers
from tests.llm import cases

K, S, INNER, DRIFT = syncmers.K, syncmers.S, syncmers.INNER, syncmers.DRIFT


def signed(text):
    h = xxhash.xxh64(text.encode("utf-32-be"), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def anchors(text):
    """hash (31 bits) -> first position."""
    top = lambda t: (signed(t) % (1 << 64)) >> 33
    if len(text) < K:
        return {top(text): 0} if text else {}
    s = [signed(text[i:i + S]) for i in range(len(text) - S + 1)]
    out = {}
    for p in range(len(text) - K + 1):
        if min(s[p:p + INNER]) in (s[p], s[p + INNER - 1]):
            out.setdefault(top(text[p:p + K]), p)
    return out


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    shifts = [b[h] - a[h] for h in a if h in b]
    if not shifts:
        return 0.0
    counts = Counter(shifts)
    at = min(counts, key=lambda d: (-counts[d], abs(d), d))
    return 2 * sum(abs(d - at) <= DRIFT for d in shifts) / (len(a) + len(b))


def printed(a):
    return "".join(f"{(h << 32) | p:016X}" for h, p in sorted(a.items()))


def expected(rows):
    """rows: (id, text) with distinct ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, t) in enumerate(rows):
        follow = rows[(n + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + follow[:len(t) // 2]
        a, e, f = anchors(t), anchors(edited), anchors(follow)
        out[i] = (printed(a), printed(e), pytest.approx(likeness(a, e)), pytest.approx(likeness(a, f)))
    return out


def got(spark, rows):
    out = syncmers.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in out.collect()}


def sample(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeżø😀") for _ in range(rnd.randrange(1, 8)))
    rows = []
    for i in range(n):
        size = rnd.choice([0, 3, 9, 12, 40, 160])
        text = " ".join(word() for _ in range(size))
        if rows and i % 4 == 0:  # the text before with a passage put in, or parts in another order
            old = rows[-1][1] or ""
            cut = len(old) // 2
            text = old[:cut] + " a passage put in " + old[cut:] if i % 8 else old[cut:] + old[:cut]
        rows.append((i * 7 - 20, None if i == 5 else "same line again\n" * 40 if i == 6 else text))
    return rows


@pytest.mark.parametrize("bucket", [4, 4096])
def test_fingerprints_equal_the_plain_version(spark, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET_IDS", bucket)
    rows = sample(60)
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows[:1]) == expected(rows[:1])


def test_order_and_place_of_passages_count(spark):
    rnd = random.Random(4)
    part = [" ".join(str(rnd.randrange(10 ** 6)) for _ in range(150)) for _ in range(3)]
    rows = [(1, part[0] + part[1]), (2, part[1] + part[0]), (3, part[2] + part[1] + part[0]), (4, part[2] + part[1] + "x" + part[0])]
    near = {i: r[3] for i, r in got(spark, rows).items()}
    assert 0.4 < near[1] < 0.6  # the same passages in another order: one of two aligns
    assert 0.7 < near[2] < 0.85  # moved as a whole: all of it aligns
    assert near[3] > 0.95


def test_repeated_ids_share_the_successor(spark):
    rows = [(1, "first " * 30), (1, "other " * 30), (2, "b " * 80), (2, "c " * 80), (3, "d " * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = syncmers.fingerprint_edits(df).collect()
    assert len(out) == 5
    edits = {r["doc_id"]: set() for r in out}
    for r in out:
        edits[r["doc_id"]].add(r["edited_sha256"])
    assert len(edits[1]) == 2 and len(edits[2]) == 2
    again = {(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in syncmers.fingerprint_edits(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in out}


def test_cost_of_a_character_does_not_grow_with_the_text(spark):
    rnd = random.Random(2)

    def seconds(n, size):
        texts = ["".join(rnd.choice("abcdefgh ") for _ in range(size)) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).cache()
        best = 99.0
        for _ in range(3):
            start = time.monotonic()
            syncmers.fingerprint_edits(df).write.format("noop").mode("overwrite").save()
            best = min(best, time.monotonic() - start)
        return best

    assert seconds(4, 128000) < 2.5 * seconds(512, 1000)


def test_no_python_workers(spark):
    plan = syncmers.fingerprint_edits(cases.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InArrow", "InPandas"))
