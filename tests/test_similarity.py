"""Similar items: exact search against dense brute force, recall of the
approximate one, and the work the bounds save."""

import numpy as np
import pyarrow as pa
import pytest

from regula.operators.similarity import _Index, similar_items, similar_items_lsh
from regula.plans.registry import ORACLES, QUERIES, load_all

COLS = ["item", "name"]


def dense_table(spark, dense):
    """Items (i, name) with a profile row each; some values are negative or nought."""
    keys = [(i, f"n{i % 3}") for i in range(len(dense))]
    entries = [(*keys[i], f"f{j}", float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v]
    return keys, spark.createDataFrame(entries, "item long, name string, feature string, value double"), spark.createDataFrame(keys, "item long, name string")


def neighbours(dense, keys, asked, k):
    s = dense.std(axis=0)
    z = (dense - dense.mean(axis=0))[:, s > 1e-9] / s[s > 1e-9]
    norm = np.linalg.norm(z, axis=1)
    out = {}
    for q in asked:
        den = norm * norm[q]
        score = np.round(np.where(den > 1e-12, z @ z[q] / np.where(den > 1e-12, den, 1), 0.0), 10)
        order = sorted((i for i in range(len(keys)) if i != q), key=lambda i: (-score[i], keys[i]))[:k]
        out[keys[q]] = [(keys[i], score[i]) for i in order]
    return out


def rows(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["q_item"], r["q_name"]), []).append(((r["item"], r["name"]), r["SimilarityScore"]))
    return out


@pytest.mark.parametrize("shard, block", [(6, 4), (4096, 1024)])
def test_equals_dense_brute_force(spark, shard, block):
    rng = np.random.default_rng(shard)
    dense = rng.integers(0, 4, (300, 9)) * (rng.random((300, 9)) < 0.3)
    dense[:, 8] = 2  # no variance
    dense[40:120] = dense[7]  # a third in one class
    dense[200:220, 1] *= -1
    keys, entries, items = dense_table(spark, dense.astype(float))
    asked = list(range(0, 300, 9))
    got = rows(similar_items(entries, items, COLS, items.where("item % 9 = 0"), k=5, shard=shard, block=block))
    want = neighbours(dense.astype(float), keys, asked, 5)
    assert got.keys() == want.keys()
    for key, found in want.items():
        assert [i for i, _ in got[key]] == [i for i, _ in found]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in found], abs=1e-9)


def test_few_items_and_profiles_at_the_mean(spark):
    dense = np.array([[1, 1], [1, 1], [0, 2], [2, 0], [0, 0]], float)
    keys, entries, items = dense_table(spark, dense)
    assert rows(similar_items(entries, items, COLS, items, k=9)).keys() == set(keys)
    got = rows(similar_items(entries, items, COLS, items, k=2))
    want = neighbours(dense, keys, range(5), 2)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}
    assert similar_items(entries.limit(0), items.limit(0), COLS, items.limit(0)).count() == 0


def test_every_item_is_asked_for_where_no_queries_are_stated(spark):
    rng = np.random.default_rng(5)
    dense = (rng.integers(0, 4, (120, 6)) * (rng.random((120, 6)) < 0.4)).astype(float)
    keys, entries, items = dense_table(spark, dense)
    got, want = rows(similar_items(entries, items, COLS, k=5, shard=16, block=8)), neighbours(dense, keys, range(120), 5)
    assert got.keys() == want.keys()
    assert all([i for i, _ in got[key]] == [i for i, _ in found] for key, found in want.items())


def test_every_drug_gets_recommendations(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    load_all()
    con = duckdb.connect()
    for name, sql in {
            "customer": "SELECT range AS c_custkey, 'c' || range AS c_name FROM range(3)",
            "orders": "SELECT range AS o_orderkey, range % 3 AS o_custkey, ['F', 'O', 'P'][range % 3 + 1] AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(1, 50)",
            "part": "SELECT range AS p_partkey, 'n' || range AS p_name, ['SMALL', 'LARGE'][range % 2 + 1] AS p_type, 'b' AS p_brand, 7 AS p_size FROM range(9)",
            "lineitem": "SELECT 1 + range % 49 AS l_orderkey, range % 9 AS l_partkey, 1 + range % 5 AS l_linenumber, ['F', 'O'][range % 2 + 1] AS l_linestatus FROM range(150)"}.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    found = QUERIES["M23_drug_recommendations_top5"](spark, str(tmp_path))
    got = sorted(tuple(r[c] for c in ("q_ApplNo", "q_DrugName", "rank", "ApplNo", "DrugName")) for r in found.collect())
    assert {r[0] for r in got} == set(range(1, 50))
    assert got == sorted(con.execute(f"SELECT q_ApplNo, q_DrugName, rank, ApplNo, DrugName FROM ({ORACLES['M23_drug_recommendations_top5']})").fetchall())


def test_bounds_save_work():
    rng = np.random.default_rng(2)
    n, width = 3000, 60
    common = rng.integers(0, 3, n)
    features = [[f"g{c}", *(f"r{j}" for j in rng.choice(width, 4, replace=False))] for c in common]
    impacts = [[1.0, *rng.random(4) * 0.02] for _ in range(n)]
    index = _Index(pa.table({"cid": [str(i) for i in range(n)], "a": [0.0] * n, "norm": [1.0] * n, "feature": features, "y": impacts}), 0.0)
    asked = ["g1", *(f"r{j}" for j in range(width))]
    values = [1.0] + [1.0] * width
    got = index.search(0.0, 1.0, asked, values, 5, 0.99)
    score = np.array([sum(y for f, y in zip(fs, ys) if f in asked) for fs, ys in zip(features, impacts)])
    assert [s for _, s in got] == pytest.approx(sorted(score, reverse=True)[:5])
    touched = index.computed
    assert touched < 0.7 * 5 * n
    assert index.search(0.0, 1.0, asked, values, 5, 9.0) == [] and index.computed == touched


def test_recall_of_the_approximate_search(spark):
    rng = np.random.default_rng(5)
    dense = (rng.integers(0, 4, (600, 24)) * (rng.random((600, 24)) < 0.2)).astype(float)
    keys, entries, items = dense_table(spark, dense)
    asked = list(range(0, 600, 20))
    exact = neighbours(dense, keys, asked, 5)
    got = rows(similar_items_lsh(entries, items, COLS, items.where("item % 20 = 0"), k=5))
    assert got.keys() == exact.keys()
    hits = sum(s >= exact[q][-1][1] - 1e-9 for q in exact for _, s in got[q])
    assert hits / (5 * len(asked)) >= 0.9
