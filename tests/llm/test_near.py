import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospector.llm import near_vectors as nv
from prospector.llm import ngram_join as nj
from prospector.llm.components import components


def corpus(rng: random.Random, families: int = 25, hot: int = 60) -> list[tuple[int, str | None]]:
    vocabulary = [f"w{i}" for i in range(3000)]
    texts: list[str | None] = []
    passage = rng.choices(vocabulary, k=40)
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 5]) if f else hot):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += passage
            texts.append(rng.choice([" ", "\n", "  "]).join(own).title() if rng.random() < 0.5 else " ".join(own))
    texts += [None, "", " \t ", "one", "One", "a b c", "a b c d", *texts[:5]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_ngram_components_match_brute_force(spark, seed, size, percent):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, tokens string, n int")
    got = {tuple(r) for r in nj.ngram_components(df, size, percent).collect()}
    assert got == set(nj.brute_force(docs, size, percent))


def test_ngram_components_of_driver_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {tuple(r) for r in nj.ngram_components(df, 4, 85).collect()}
    assert got == set(nj.brute_force(docs))


def test_ngram_components_of_chains_over_groups(spark):
    """Neighbours link, members further apart don't: every link counts."""
    words = [f"k{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 5 : i * 5 + 200])) for i in range(30)]
    docs += [(100 + i, " ".join(words[i : i + 7])) for i in range(20)]
    got = {tuple(r) for r in nj.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == set(nj.brute_force(docs))


def test_ngram_components_edges(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (4, ""), (9, "x " * 3000)]
    got = sorted(map(tuple, nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (4, 0, 4), (9, 1, 9)], key=str)
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_components_of_repeated_ids(spark):
    """Two texts under one id are one document: what links with either is in one component, and no row is multiplied."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(20, a), (20, b), (21, [*a, "x"]), (22, [*b, "y"]), (23, [*b, "y", "z"]), (24, ["other", *a[:30]])]
    got = sorted(map(tuple, nj.ngram_components(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"), 4, 85).collect()))
    assert got == [(20, 57, 20), (20, 57, 20), (21, 58, 20), (22, 58, 20), (23, 59, 20), (24, 28, 24)]


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(70)]
    random.Random(3).shuffle(path)
    star = [(1000, 1001 + i) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(path + star + [(5000, 5000)], "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(71), 0), **dict.fromkeys(range(1000, 1051), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk_links", [7, 10_000])
def test_components_of_random_links_in_chunks(spark, chunk_links):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)] * 2
    root = {n: n for link in links for n in link}
    for _ in range(len(root)):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    got = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), chunk_links).collect()]
    joined = {n for x, y in links if x != y for n in (x, y)}
    assert sorted(got) == sorted((n, root[n]) for n in joined)


def exact_links(rows, cosine):
    n = {}
    for i, (_, v, label) in enumerate(rows):
        for j, (_, u, other) in enumerate(rows):
            if i != j and label is not None and label == other and len(v) == len(u):
                a, b = np.array(v, float), np.array(u, float)
                n[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    return n


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 6)) if k else 50):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.06])).astype(np.float32).tolist(), int(k % 3)))
    links = exact_links(rows, 0.98)
    want = {i: sum(links.get((i, j), False) for j in range(len(rows))) for i in range(len(rows))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in nv.near_vectors(df, block=16).collect()}
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(want.values())
    assert all(got[i]["n_links"] <= want[i] for i in want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    one_block = {r["vec_id"]: r for r in nv.near_vectors(df, block=4096).collect()}
    assert got == one_block
    # Components against those of all links (a hot group of 50 and pairs near the threshold among them).
    root = list(range(len(rows)))
    for _ in root:
        for (i, j), near in links.items():
            if near:
                root[i] = root[j] = min(root[i], root[j])
    same = sum(got[i]["component_id"] == root[i] for i in got)
    assert same >= 0.97 * len(rows) and all(root[r["component_id"]] == root[i] for i, r in got.items())


def test_near_vectors_of_extreme_sizes(spark):
    """Squares of these components overflow or vanish; cosines don't depend on the size."""
    rows = [(i, [x * s for x in v], 1) for i, (v, s) in enumerate([([1.0, 2.0], 1e200), ([1.0, 2.0], 1e-200), ([1.0, 2.001], 1.0), ([2.0, -1.0], 1e300), ([2.0, -1.0], 1e-300)])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3)}


def test_near_vectors_recall_on_driver_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([r[2] for r in rows])
    near = ((x @ x.T) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in nv.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.95 * near.sum()
    assert all(got[r[0]] <= near[i].sum() for i, r in enumerate(rows))


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], 2), (10, [], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit(1)).withColumn("copies", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nv.near_vectors(df).collect()}
    want = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, None)} | {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False)}
    assert got == want
    assert nv.near_vectors(df.limit(0)).count() == 0


def test_a_token_that_all_have_is_dealt_over_tasks(spark):
    """Rows of a hot token are split, its cells repeated, and no pair is lost or doubled."""
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(600)], "id long, token long")
    cells = spark.createDataFrame([(7, g) for g in range(5)] + [(9, 1), (9, 2)], "token long, leader long")
    got = nj._by_token(rows, cells, 50)
    want = sorted((i, g) for i in range(600) if i % 3 or i == 9 for g in (range(5) if i % 3 else (1, 2)))
    assert sorted((r["id"], r["leader"]) for r in got.collect()) == want


def test_one_token_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(nj, "HOT_ROWS", 20)
    monkeypatch.setattr(nj._by_token, "__defaults__", (20,))
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(8)]
    docs = [(i, "the same long beginning of all " * 2 + " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(9)}" for w in rng.choice(base).split())) for i in range(150)]
    got = sorted(map(tuple, nj.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()))
    assert got == sorted(nj.brute_force(docs, 2, 80)) and len({c for _, _, c in got}) < 100


def test_bits_that_may_differ(spark):
    rng = np.random.default_rng(3)
    bits, tables = nv.tables_for(2000, 0.98)
    most = nv.differing_bits(bits, tables, 0.98)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
    planes = rng.standard_normal((16, bits * tables))
    assert ((x @ planes > 0) != (y @ planes > 0)).sum(1).max() <= most < bits * tables / 3
