"""Operators that look at the whole corpus, against brute force, held-out accuracy or planted cases."""

from collections import Counter as Count

import numpy as np
import pytest
from pyspark.sql import functions as F

from orarium.llm import bbit_minhash, fair_mix, line_chunks, mixture_lid, quality_net, url_trees
from orarium.llm.components import components
from orarium.llm.compression_bands import repeated_words

SCHEMA = "doc_id long, text string, lang string, source string, quality string"


def words(rng, n, kind="w", size=500):
    return [f"{kind}{i}" for i in rng.integers(0, size, n)]


# --- components and near duplicates ---


def reach(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == reach(pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_rows():
    rng = np.random.default_rng(2)
    rows, at = [], 0

    def add(text):
        nonlocal at
        at += 1
        rows.append((at, text, "en", "s", None))

    for _ in range(12):
        base = words(rng, int(rng.integers(60, 400)), size=20_000)
        add(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for k in rng.integers(0, len(copy), max(1, len(copy) // int(rng.integers(30, 90)))):
                copy[k] = "changed" + str(rng.integers(0, 9))
            add("  ".join(copy).upper() if rng.integers(0, 4) == 0 else " ".join(copy))
    for _ in range(20):
        add(rows[0][1])
    for text in ("", None, "one two", "One  two", "three", " \n ", "one two three four five", "one two three four five six"):
        add(text)
    rows.append((None, rows[0][1], "en", "s", None))
    rows.append((5, rows[4][1], "en", "s", None))
    return rows


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rows = near_rows()
    of = {}
    for r in rows:
        if r[0] is not None:
            of.setdefault(r[0], sets(r[1]))
    ids = sorted(of)
    pairs = [(a, b) for a in ids for b in ids if a < b and of[a] and 100 * len(of[a] & of[b]) >= 85 * len(of[a] | of[b])]
    component = {i: i for i in ids} | reach(pairs)
    expected = [(r[0], len(sets(r[1])), component.get(r[0]), r[0] is None or component[r[0]] == r[0]) for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).repartition(5)
    assert len(pairs) > 300
    assert Count(tuple(r) for r in bbit_minhash.near_duplicates(docs).collect()) == Count(expected)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = words(rng, 300, size=9000)
    rows = []
    for i in range(400):
        copy = list(base)
        copy[int(rng.integers(0, 300))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    out = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def crowded_rows(n, planted, p=0.86):
    """Texts of passages of one pool, so that their buckets are crowded with what is no link, and near copies among them."""
    rng = np.random.default_rng(21)
    pool = [" ".join(words(rng, 30, "p", 50_000)) for _ in range(40)]
    texts = [" ".join(x for x, take in zip(pool, rng.random(40) < p, strict=True) if take) for _ in range(n)]
    for k in rng.choice(n, planted, replace=False):
        copy = texts[k].split()
        for at in rng.choice(len(copy) // 8 - 1, len(copy) // 65, replace=False):
            copy[8 * at + 4] = f"own{k}x{at}"
        texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


def test_links_in_crowded_buckets(spark, monkeypatch):
    """No link is lost where all classes share crowded buckets; blocks are small, so that there are several cells."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 200)
    rows = crowded_rows(900, 60)
    ids = {}
    of = [[ids.setdefault(s, len(ids)) for s in sets(t)] for _, t in rows]
    x = np.zeros((len(of), len(ids)), np.float32)
    for i, s in enumerate(of):
        x[i, s] = 1
    common, size = x @ x.T, x.sum(axis=1)
    alike = 100 * common >= 85 * (size[:, None] + size - common)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(alike), strict=True) if a < b]
    component = {i: i for i in range(len(rows))} | reach(pairs)
    assert len(pairs) >= 50
    got = {r.doc_id: r.component_id for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == component


def test_no_near_duplicates_of_no_rows(spark):
    assert bbit_minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    by = bbit_minhash.permutations()
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        n = 2000
        common = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = (bbit_minhash.minima(s, by) & np.uint64(15) for s in (x[:n], np.concatenate((x[:common], x[n : 2 * n - common]))))
        equal = (a == b).mean()
        errors.append(abs((equal - 1 / 16) / (1 - 1 / 16) - share))
    assert max(errors) < 0.15


# --- line chunks ---


def test_line_dedup(spark):
    rng = np.random.default_rng(4)
    line = lambda n: " ".join(words(rng, n, "l", 10_000))
    long = line(60)
    passage = "\n".join(line(8) for _ in range(12))
    rows = [(i, "\n".join([line(7) for _ in range(int(rng.integers(1, 6)))] + ([passage] if i % 3 == 0 else []) + ([long] if i % 4 == 0 else []) + [line(9)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same\nsame"), (None, "a\nb\n" + long), (0, rows[0][1])]
    out = line_chunks.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    # brute force: every chunk of every text, all but the first of equal removable ones gone
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    seen, expected = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            expected.append((d, None))
            continue
        lines = t.encode().split(b"\n")
        left = []
        for b, e, may in line_chunks.chunks(lines):
            data = b"\n".join(lines[b:e])
            if may and data in seen:
                continue
            seen |= {data} if may else set()
            left.append(data.decode())
        expected.append((d, "\n".join(left)))
    assert Count((r.doc_id, r.text) for r in out.collect()) == Count(expected)
    kept = [r.text for r in out.collect() if r.text]
    assert sum(long in t for t in kept) == 1
    inner = "\n".join(passage.split("\n")[3:9])
    assert sum(inner in t for t in kept) <= 2


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_line_dedup_by_either_join(spark, limit):
    rows = [(i, "a b c\nd e f\n" + "x y z\n" * (i % 3)) for i in range(30)]
    out = line_chunks.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=limit)
    assert out.count() == 30 and out.agg(F.sum("n_removed_chunks")).first()[0] > 20
    assert line_chunks.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_repeated_runs_go_whatever_surrounds_them(spark, limit):
    rng = np.random.default_rng(6)
    line = lambda n: " ".join(words(rng, n, "l", 100_000))
    passages = [[line(-(-54 // n)) for _ in range(n)] for n in range(2, 13)]
    short = [line(20), line(20)]
    rows = []
    for i in range(66):
        own = [[line(int(rng.integers(3, 30))) for _ in range(int(rng.integers(1, 5)))] for _ in range(2)]
        rows.append((i, own[0], passages[i % 11] if i < 55 else [short[i % 2]], own[1]))
    docs = spark.createDataFrame([(i, "\n".join(a + p + b)) for i, a, p, b in rows] + [(None, "x\n" + "\n".join(passages[0])), (90, None), (91, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.run_dedup(docs.repartition(3), broadcast_bytes=limit).collect()}
    for i, a, p, b in rows:
        again = i == 0 or 11 <= i < 55
        assert got[i].text == "\n".join(a + ([] if again else p) + b), i
        assert got[i].n_removed_lines == (len(p) if again else 0)
    assert got[None].n_removed_lines == 0 and got[90].text is None and (got[91].text, got[91].n_lines) == ("", 1)


def test_a_run_that_repeats_itself(spark):
    rng = np.random.default_rng(8)
    period = [" ".join(words(rng, 15, "l", 100_000)) for _ in range(2)]
    docs = spark.createDataFrame([(0, "\n".join(period * 6)), (1, "\n".join(["begin", *period * 2, "end"]))], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_chunks.run_dedup(docs).collect()}
    assert got[0][:4] == period * 2 and len(got[0]) < 12 and got[1] == ["begin", "end"]


# --- mixing ---


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("sa", "a", 10), ("sb", "b", 1000), ("sc", "c", 5), ("n", None, 200), ("sz", "z", 0)], "skey string, source string, source_size long")
    got = {r.source: r.target for r in fair_mix.source_targets(sizes).collect()}
    total, weight, size = 1215, {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}, {"a": 10, "b": 1000, "c": 5, "z": 0, None: 200}
    target, open_ = {}, set(weight)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    assert got == pytest.approx(target)


def mix_rows():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(words(rng, int(rng.integers(0, 60)))), "en", ["a", "b", "c", None, "d"][int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1]))], None) for i in range(3000)]
    return rows + [(9000, None, "en", "b", None), (9001, "x y", None, None, None), (9001, "x y", None, None, None), (None, "u v w", "en", "empty", None), (9002, "", "en", "nothing", None)]


def test_fair_mix(spark):
    docs = spark.createDataFrame(mix_rows(), SCHEMA).withColumn("taken", F.lit("clash"))
    out = fair_mix.fair_mix(docs).collect()
    again = fair_mix.fair_mix(docs.repartition(7)).collect()
    key = lambda rows: Count((r.doc_id, r.source, r.size, r.target, r.taken) for r in rows)
    assert key(out) == key(again) and len(out) == len(mix_rows())
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, 0, 0])
        by[r.source][1] += r.taken
        by[r.source][2] += r.size
    for source, (target, taken, _) in by.items():
        assert abs(taken - target) <= 3 if source != "empty" else taken <= target + 3
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(r.size for r in out))
    stream = fair_mix.mixed_stream(docs).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in stream) == sum(r.copies for r in out)
    assert fair_mix.fair_mix(spark.createDataFrame([], SCHEMA)).count() == 0


# --- URLs ---


def test_urls(spark):
    urls = [
        ("https://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/2", "a.example.com", "/en/2", "example.com/en/", "block"),
        ("http://badexample.com/en/2", "badexample.com", "/en/2", "com/", "allow"),
        ("http://x.net/es/#f", "x.net", "/es/", "net/es/", "block"),
        ("http://net/fr/a?b://c", "net", "/fr/a", "net/fr/", "block"),
        ("http://com", "com", "", None, None),
        ("http://x.org?q=/en/", "x.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("://É.COM/x", "É.com", "/x", "com/", "allow"),
    ]
    rows = [(i, u[0], "html", "host") for i, u in enumerate(urls)]
    out = {r.page_id: r for r in url_trees.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_trees.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_learn(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"https://site{i % 50}.{'com' if i % 3 else 'example.com'}/{'en' if i % 3 == 0 else 'de'}/{'a' * int(rng.integers(1, 9))}?{'&'.join(f'p{k}=1' for k in range(9 if i % 3 == 0 else 1))}") for i in range(600)]
    rows += [(1000 + i, f"https://site.org/{'x' * 4}?{'&'.join(f'p{k}=1' for k in range(9 if i % 2 else 1))}") for i in range(40)]
    out = url_trees.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out)


# --- classifiers ---


def quality_rows():
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(1200):
        good = i % 3 > 0
        w = words(rng, int(rng.integers(30, 200)))
        text = " ".join(w) + "." if good else " ".join(x + "###" if rng.integers(0, 3) else x for x in w)
        rows.append((i, text, "en", "s", "clash"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_net(spark):
    rows, labels = quality_rows()
    odd = [(5000, None, None, None, None), (5001, "", "en", "s", None), (None, "w1 w2", "en", "s", None), (5000, "w1", None, None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    known = spark.createDataFrame([*labels, (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_net.quality_scores(docs, known).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    none = known.limit(0)
    assert {r.score for r in quality_net.quality_scores(docs, none).collect()} == {0.5}
    assert quality_net.quality_scores(docs.limit(0), known).count() == 0
    one = quality_net.quality_scores(docs, known.where("quality = 1")).agg(F.min("score"), F.max("score")).first()
    assert 0.9 < one[0] == one[1] < 1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows[:400], SCHEMA).coalesce(1)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality_net.quality_scores(docs, k).collect()) for k in (known, flipped))
    assert a == b


def test_language_mixtures(spark):
    rng = np.random.default_rng(8)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["éau", "oui", "tre", "ção"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(5, 60))), lang, "s", None) for i, lang in enumerate(rng.choice(list(sounds), 600))]
    odd = [(9000, None, "aa", "s", None), (9001, "123 ²!", "aa", "s", None), (9002, text("aa", 80) + " " + text("bb", 40), None, "s", None), (None, text("cc", 20), None, "s", None), (9003, "", None, None, None)]
    out = {r.doc_id: r for r in mixture_lid.language_mixtures(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    held = [out[r[0]].lang_pred == r[2] for r in rows if out[r[0]].held_out]
    assert len(held) > 100 and np.mean(held) == 1
    assert [out[i].lang_pred for i in (9000, 9001, 9003)] == ["und"] * 3
    assert out[9002].langs == ["aa", "bb"] and abs(out[9002].shares[0] - 2 / 3) < 0.12
    assert out[None].lang_pred == "cc"
    nothing = spark.createDataFrame([(1, "abc", None, "s", None)], SCHEMA)
    assert mixture_lid.language_mixtures(nothing).first().lang_pred == "und"
    assert mixture_lid.language_mixtures(nothing.limit(0)).count() == 0


def test_windows_of_many_distinct_words():
    w = [str(i).encode() for i in range(3000)] * 2
    assert repeated_words(w) == 6000
    assert repeated_words(w[:3000]) == 0
    assert repeated_words(w[:3]) == 0


def test_every_repeated_run_holds_a_common_anchor():
    """Runs of 50 words or more, of lines of any length and with blank ones, in surroundings that differ."""
    rng = np.random.default_rng(12)
    line = lambda n: " ".join(words(rng, n, "l", 200)).encode()
    for longest in (1, 3, 6, 11, 12, 20, 45):
        for _ in range(60):
            run = [line(2)]
            while sum(len(x.split()) for x in run) < 50:
                run.append(line(int(rng.integers(0, longest + 1))))
            seen = []
            for _ in range(2):
                own = [[line(int(rng.integers(0, 25))) for _ in range(int(rng.integers(0, 5)))] for _ in range(2)]
                found = line_chunks.anchors(own[0] + run + own[1])
                seen.append({h for b, e, h in found if b >= len(own[0]) and e <= len(own[0]) + len(run)})
            assert seen[0] & seen[1]


def test_runs_equal_windows_of_every_line(spark):
    """What is extended from anchors is what comparing the windows of every line finds."""
    rng = np.random.default_rng(13)
    line = lambda: " ".join(words(rng, int(rng.choice([0, 1, 3, 8, 14, 30, 55])), "l", 100_000))
    shared = [[line() for _ in range(int(rng.integers(2, 9)))] for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [[line() for _ in range(int(rng.integers(1, 4)))] if rng.random() < 0.6 else shared[int(rng.integers(12))] for _ in range(4)]
        texts.append([x for p in parts for x in p])
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_removed_lines for r in line_chunks.run_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, gone = {}, {i: set() for i, _ in rows}
    for i, text in rows:
        lines = text.encode().split(b"\n")
        for b, e in sorted(line_chunks.windows(lines) | {(b, e) for b, e, may in line_chunks.chunks(lines) if may}):
            at = first.setdefault(b"\n".join(lines[b:e]), (i, b, e))
            if at != (i, b, e):
                gone[i] |= set(range(max(b, at[2]) if at[0] == i else b, e))
    assert got == {i: len(x) for i, x in gone.items()} and sum(got.values()) > 100
