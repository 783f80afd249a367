"""Near vectors, centroid rounds and spelling variants against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter as Count

import numpy as np
import pytest

from orarium.llm import kd_means, pruned_graph, spelling_variants

VECTORS = "vec_id long, embedding array<float>, ball string, shard int, cluster string, n int, v string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "x", None, None, 0, "v") for i, x in rows], VECTORS.replace("float", kind)).repartition(3)


# --- near vectors ---


def linked(rows, cosine=0.9):
    """vec_id -> n_links, component_id by comparing all pairs in double precision."""
    ids = [i for i, _ in rows]
    u = np.array([x for _, x in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    part = np.arange(len(ids))
    while True:
        now = np.array([part[near[i]].min() for i in range(len(ids))])
        if (now == part).all():
            break
        part = now
    least = {p: min(i for i, q in zip(ids, part, strict=True) if q == p) for p in set(part.tolist())}
    return {i: (int(n) - 1, least[p]) for i, n, p in zip(ids, near.sum(axis=1), part.tolist(), strict=True)}


def clouds(seed, size, spread, singles):
    """Groups of copies around random directions, from two rows to hundreds, with single rows between them."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=size) for _ in range(singles)]
    for n in (2, 2, 3, 5, 9, 40, 300):
        base = rng.normal(size=size)
        base /= np.linalg.norm(base)
        rows += [base + rng.normal(size=size) * spread / math.sqrt(size) for _ in range(n)] + [base] * (n > 30) * 20
    order = rng.permutation(len(rows))
    return [(int(k) + 10, rows[k] * rng.uniform(0.1, 5)) for k in order]


@pytest.mark.parametrize("spread", [0.1, 0.4])
def test_links_and_components_equal_all_pairs(spark, spread):
    """Tight groups, and loose ones in which only some pairs are linked."""
    rows = clouds(int(spread * 100), 24, spread, 600)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pruned_graph.near_vectors(frame(spark, rows)).collect()}
    want = linked(rows)
    assert sum(min(got[i][0], n) for i, (n, _) in want.items()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    if spread < 0.3:
        assert got == want


def test_many_cells(spark, monkeypatch):
    """Several centres, and centres of several cells, find what one cell finds."""
    monkeypatch.setattr(pruned_graph, "SHARD", 100)
    monkeypatch.setattr(pruned_graph, "CELL", 60)
    rows = clouds(3, 32, 0.15, 900)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pruned_graph.near_vectors(frame(spark, rows)).collect()}
    want = linked(rows)
    assert sum(got[i] == w for i, w in want.items()) >= 0.99 * len(want)
    assert sum(min(got[i][0], n) for i, (n, _) in want.items()) >= 0.97 * sum(n for n, _ in want.values())


def test_a_poor_search_is_run_again(spark, monkeypatch):
    """A search of one centre with a beam of one is widened until the audit is content."""
    monkeypatch.setattr(pruned_graph, "SHARD", 60)
    seen = []
    plain = pruned_graph.audit
    monkeypatch.setattr(pruned_graph, "audit", lambda *a: seen.append(plain(*a)) or seen[-1])
    rows = clouds(5, 6, 0.3, 500)
    got = {r.vec_id: r.n_links for r in pruned_graph.near_vectors(frame(spark, rows), probes=1, beam=1, recall=0.999).collect()}
    want = linked(rows)
    assert len(seen) > 1 and seen[-1] > seen[0]
    assert sum(min(got[i], n) for i, (n, _) in want.items()) >= 0.99 * sum(n for n, _ in want.values())


def test_pruned_lists_reach_every_node():
    rng = np.random.default_rng(8)
    units = rng.normal(size=(700, 16)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    lists = pruned_graph.pruned(units)
    assert all(i not in x and len(x) <= 2 * pruned_graph.DEGREE for i, x in enumerate(lists))
    cos = units @ units.T - 2 * np.eye(700)
    assert all(cos[i].argmax() in x for i, x in enumerate(lists))
    reached, front = {0}, {0}
    while front:
        front = {int(y) for x in front for y in lists[x]} - reached
        reached |= front
    assert len(reached) == 700


def test_near_vectors_of_odd_rows(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, None), (4, []), (5, [0, 0]), (6, [1, None]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (None, [1, 0]), (9, [1, 0, 0]), (10, [0, 1]), (10, [0, 1]), (10, [1, 0.01]), (11, [-0.0, 1]), (12, [1e-40, 1e-44]), (13, [3e38, 3e38])]
    got = Count((r.vec_id, r.n_links, r.component_id, r.kept) for r in pruned_graph.near_vectors(frame(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 13)] + [(None, 0, None, True)]
    assert got == Count([*alone, (1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (10, 3, 1, False), (10, 2, 10, True), (10, 2, 10, True), (11, 2, 10, False)])
    assert pruned_graph.near_vectors(frame(spark, [])).count() == 0
    assert pruned_graph.near_vectors(frame(spark, [(1, None)])).collect()[0].component_id == 1


# --- centroids ---


def rounds(rows, size, count, times, scale=64):
    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in x]) for i, x in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:count]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(times):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    return Count((i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centroids[near(v)[1]])).encode()).hexdigest()) for i, v in kept)


@pytest.mark.parametrize(("size", "chunk"), [(2, 50), (8, 64), (64, 8192)])
def test_rounds_equal_brute_force(spark, monkeypatch, size, chunk):
    """Low dimensions prune, whole numbers tie, and copies fall into one leaf."""
    monkeypatch.setattr(kd_means, "CHUNK", chunk)
    rng = np.random.default_rng(size)
    points = np.concatenate([rng.normal(size=(250, size)), rng.integers(-2, 3, (150, size)) / 64, np.ones((60, size)) * 0.25])
    rows = [(int(i), x) for i, x in enumerate(points.astype(np.float32))]
    got = kd_means.kd_means(frame(spark, rows), size=size).collect()
    assert Count((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == rounds(rows, size, 16, 3)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(o.distance for o in got if o.cluster == r.cluster) for r in got)


def test_trees_drop_only_farther_centroids():
    """Whole nodes are assigned in low dimensions, and each row goes where comparing all centroids sends it."""
    rng = np.random.default_rng(2)
    points, centroids = rng.integers(-40, 40, (3000, 2)), rng.integers(-40, 40, (16, 2))
    centroids[5] = centroids[9]  # a tie goes to the smaller number
    tree, order = kd_means.Tree.built(points)
    to, whole = np.full(3000, -1), 0
    for _, begin, end, own in tree.assigned(centroids):
        to[order[begin:end]] = own
        whole += (end - begin) * isinstance(own, int)
    assert (to == kd_means.distances(points, centroids).argmin(axis=1)).all() and whole > 1000
    assert (tree.sums[0] == points.sum(axis=0)).all() and 9 not in to


def test_centroids_of_odd_rows(spark):
    whole = [0.5] * 64
    rows = [(1, whole), (1, whole), (None, whole), (2, None), (3, [1.0] * 63), (4, [None, *whole[1:]]), (5, [float("nan"), *whole[1:]]), (6, [float("inf"), *whole[1:]]), (7, [-0.001] * 64), (8, [2.0e6, *whole[1:]])]
    got = Count((r.vec_id, r.distance) for r in kd_means.kd_means(frame(spark, rows)).collect())
    assert got == Count([(1, 0), (1, 0), (None, 0), (7, 0)])
    assert kd_means.kd_means(frame(spark, [])).count() == 0
    assert [r.cluster for r in kd_means.kd_means(frame(spark, [(None, whole)])).collect()] == [0]
    assert kd_means.kd_means(frame(spark, rows, "double")).count() == 4


# --- spelling variants ---

ROWS = "doc_id long, text string, word string, n int, form string, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, None) for i, t in rows], ROWS).repartition(3)


def edits(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(rows):
    n = Count()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    letters = list("abé×")
    words = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(250)] + [f"{x}WORD" for x in "abcdefgh"] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀBCDE", "àbcde"]
    weights = rng.zipf(1.3, len(words)).clip(1, 400).astype(float)
    rows = [(int(i), " ".join(rng.choice(words, 60, p=weights / weights.sum()))) for i in range(300)] + [(None, "aaaaa aaaaa " * 9), (7, None), (8, ""), (9, "12 _ --- \U0001f600"), (3, "abcdefgh" * 2000)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(documents(spark, rows)).collect()}
    want = variants(rows)
    assert got == want
    assert any(root != form for form, root, *_ in want.values() if form), "no chain of forms"


def test_every_pair_once(spark):
    """Repeated letters, where both segments meet, and edits at each place."""
    words = {w + x * k + y for w in ("aaaa", "abab", "éééé") for x in "ab" for k in range(4) for y in ("", "a", "zz")}
    words |= {"straight"[:i] + c + "straight"[i + r :] for i in range(9) for r in (0, 1) for c in ("", "x", "s")}
    words = sorted(w for w in words if len(w) >= 5)
    df = spark.createDataFrame([(w, k + 3) for k, w in enumerate(words)], "word string, n long")
    got = Count(tuple(sorted((r.a, r.b))) for r in spelling_variants.one_edit_pairs(df).collect())
    assert got == Count((a, b) for a in words for b in words if a < b and edits(a, b))


def test_variants_of_empty_tables(spark):
    assert spelling_variants.spelling_variants(documents(spark, [])).count() == 0
    assert spelling_variants.spelling_variants(documents(spark, [(1, None), (None, "only once said")])).count() == 0
