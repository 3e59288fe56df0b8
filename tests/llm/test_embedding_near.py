"""Near vectors against all pairs."""

import numpy as np
import pytest

from learntrace.llm import embedding_near


def pairs_of(vectors, cosine=0.95):
    """ids -> (n_links, component_id, kept) by all pairs of usable vectors."""
    ok = {}
    for i, (_, v) in enumerate(vectors):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            ok[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = {i: {j for j in ok if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine} if i in ok else set() for i in range(len(vectors))}
    out = []
    for i in range(len(vectors)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        out.append((vectors[i][0], len(links[i]), min(ids, default=None), (min(ids, default=None)) == vectors[i][0]))
    return sorted(out, key=str)


def near(x, cosine, rng):
    z = rng.normal(size=x.shape)
    z -= (z @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def planted(rng, n=400, dim=32):
    base = rng.normal(size=(n, dim))
    crowd = [near(base[0], 0.985, rng) for _ in range(150)]
    chain = [base[1]]
    for _ in range(20):
        chain.append(near(chain[-1], 0.96, rng))
    edge = [near(base[i], c, rng) for i in range(100, 200) for c in (0.951, 0.949)]
    return np.concatenate([base, crowd, chain, edge])


@pytest.mark.parametrize("block", [2048, 16])
def test_all_pairs(spark, monkeypatch, block):
    """Crowds, chains and pairs near the threshold, with lists whole and cut into blocks."""
    monkeypatch.setattr(embedding_near, "BLOCK", block)
    x = planted(np.random.default_rng(5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, (x[5] * (1 if i % 2 else 3)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_near.embedding_digest(df).collect()}
    want = {r[0]: r[1:] for r in pairs_of(rows)}
    assert len(got) == len(want)
    found, all_links = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert found >= 0.995 * all_links
    assert sum(got[i] != want[i] for i in want) <= 8


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4000, 64))
    other = np.stack([near(v, 0.9501, rng) for v in base[:1500]])
    rows = [(i, v) for i, v in enumerate(np.concatenate([base, other]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert embedding_near.embedding_digest(df).where("n_links > 0").count() >= 0.96 * 3000


def awkward_vectors():
    one = [1.0, 2.0, 3.0]
    return [
        (1, one), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0, 0.0]),
        (11, [-1.0, -2.0, -3.0]), (12, [1e-300, 2e-300, 3e-300]), (13, [1e300, 2e300, 3e300]), (None, one), (14, one), (14, one), (15, [-0.0, 1.0, 0.0]), (16, [0.0, 1.0, 0.0]), (None, [5.0, -9.0, 1.0]),
    ]


def test_awkward_vectors(spark):
    rows = awkward_vectors()
    df = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id long, embedding array<double>, h string")
    got = sorted((tuple(r) for r in embedding_near.embedding_digest(df).collect()), key=str)
    assert got == pairs_of(rows)
    assert embedding_near.embedding_digest(df.limit(0)).count() == 0
    assert {r["n_links"] for r in embedding_near.embedding_digest(df.where("vec_id between 3 and 8")).collect()} == {0}
    left = embedding_near.drop_near_vectors(df.where("vec_id is not null and vec_id <> 14"))
    assert left.columns == df.columns and sorted(r["vec_id"] for r in left.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15]


def test_pivots_are_unlike_and_bounded(spark, monkeypatch):
    x = np.concatenate([planted(np.random.default_rng(1)), np.tile(np.ones(32), (50, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = embedding_near.choose_pivots(embedding_near.usable(df, "vec_id", "embedding"))
    assert 16 <= len(p) <= 150 and (p @ p.T - np.eye(len(p))).max() < embedding_near.ALIKE
    monkeypatch.setattr(embedding_near, "MAX_PIVOTS", 5)
    assert len(embedding_near.choose_pivots(embedding_near.usable(df, "vec_id", "embedding"))) <= 5
