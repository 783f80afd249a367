"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

DataFrame operations only. The URLs that a rule decides are the labelled ones. Features: lengths, depths, digit
ratios, entropy, parameter counts, and statistics of the host's suffix, its last label (how often labelled URLs have it,
and how many of those are blocked). A labelled URL sees the statistics of the other folds only (FOLDS, by its hash), so
its own label is no feature of it; all others see those of all folds. Each feature is cut into bins at quantiles; each level of a tree is one aggregation of
gradients by node, feature and bin, whose result (at most nodes x features x bins rows) picks the splits. Gradients are summed as whole
numbers, so that reruns agree. A tree is an expression over the bins.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and the trees' verdict; without
labelled URLs of both kinds the trees say what all labels say, or allow. Ties between splits go to the first feature and
the lowest bin. Repeated rows stay; a url of any length is read whole; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import pick, written

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled rows that the trees are fitted on (about; taken by hash), and folds of the suffix statistics.
TRAIN_ROWS, FOLDS = 200_000, 5
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 10, 3, 16, 0.4, 1.0, 20.0
SCALE = 1_000_000


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the rest of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none), F.coalesce(F.substring(tail, F.length(path) + 1, F.length(tail)), none)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as a string, and its verdict; null without one."""
    rule = verdict = F
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = rule.when(fits, F.lit(h + p))
        verdict = verdict.when(fits, F.lit(kind))
    return rule, verdict


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("double")


def entropy(x: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    n = F.length(x).cast("double")
    chars = F.array_distinct(F.split(x, ""))
    share = lambda c: (n - F.length(F.replace(x, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(pages: DataFrame, url: Column, host: Column, path: Column, rest: Column) -> DataFrame:
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    found = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_host_depth": count_of(host, r"\."),
        "f_path_depth": count_of(path, "/"),
        "f_digits": count_of(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_path_digits": count_of(path, "[0-9]") / F.greatest(F.length(path), F.lit(1)),
        "f_entropy": F.round(entropy(url), 9),
        "f_params": count_of(query, "[^&]+"),
        "f_query_length": F.length(query).cast("double"),
        "f_fragment": F.contains(rest, F.lit("#")).cast("double"),
    }
    return pages.withColumns(found).withColumn("suffix", F.substring_index(host, ".", -1))


def grow(table: DataFrame, features: list[str]) -> str:
    """The boosted trees, as an expression over the bins; table: y (1: block) and the bins of the labelled rows."""
    rows = table.agg(F.count("y").alias("n"), F.sum("y").alias("y")).first()
    n, y = rows[0] or 0, rows[1] or 0
    if not n:
        return "-1D"
    start = math.log((y + 0.5) / (n - y + 0.5))
    margin = f"{start!r}D"
    if not 0 < y < n:
        return margin
    stacked = f"stack({len(features)}, " + ", ".join(f"'{f}', {f}" for f in features) + ") AS (feature, bin)"
    for _ in range(TREES):
        nodes = {1: None}  # open nodes: number -> split
        tree: dict[int, tuple[str, int] | float] = {}
        for depth in range(DEPTH + 1):
            node = place(tree, 1)
            graded = table.selectExpr("*", f"{node} AS node", f"1 / (1 + exp(-({margin}))) AS q")
            graded = graded.selectExpr(*features, "node", f"cast(round((y - q) * {SCALE}) AS long) AS g", f"cast(round(q * (1 - q) * {SCALE}) AS long) AS h").where("node > 0")
            sums = graded.selectExpr("node", "g", "h", stacked).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                by.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g / SCALE, r.h / SCALE)
            for k in list(nodes):
                tree[k] = best_split(by[k], features) if k in by and depth < DEPTH else leaf(by.get(k))
                if isinstance(tree[k], tuple):
                    nodes |= {2 * k: None, 2 * k + 1: None}
                del nodes[k]
            if not nodes:
                break
        margin += " + " + value(tree, 1)
    return margin


def leaf(features: dict | None) -> float:
    if not features:
        return 0.0
    g, h = (sum(x[i] for x in next(iter(features.values())).values()) for i in (0, 1))
    return RATE * g / (h + LAMBDA)


def best_split(by: dict[str, dict[int, tuple[float, float]]], features: list[str]) -> tuple[str, int] | float:
    """The split with the largest gain; a leaf's value if none gains. Ties: the first feature, the lowest bin."""
    best, found = 1e-6, None
    for f in features:
        bins = sorted(by[f].items())
        g, h = (sum(x[i] for _, x in bins) for i in (0, 1))
        left_g = left_h = 0.0
        for b, (bg, bh) in bins[:-1]:
            left_g, left_h = left_g + bg, left_h + bh
            if min(left_h, h - left_h) * 4 < LEAST:
                continue
            gain = left_g**2 / (left_h + LAMBDA) + (g - left_g) ** 2 / (h - left_h + LAMBDA) - g**2 / (h + LAMBDA)
            if gain > best + 1e-9:
                best, found = gain, (f, b)
    return found or leaf(by)


def place(tree: dict, k: int) -> str:
    """The open node that a row falls to; 0 for finished leaves."""
    at = tree.get(k, k)
    if isinstance(at, tuple):
        return f"CASE WHEN {at[0]} <= {at[1]} THEN {place(tree, 2 * k)} ELSE {place(tree, 2 * k + 1)} END"
    return str(k) if k not in tree else "0"


def value(tree: dict, k: int) -> str:
    at = tree[k]
    if isinstance(at, tuple):
        return f"CASE WHEN {at[0]} <= {at[1]} THEN {value(tree, 2 * k)} ELSE {value(tree, 2 * k + 1)} END"
    return f"({at!r}D)"


def with_suffixes(base: DataFrame, labelled: DataFrame, none: Column) -> DataFrame:
    """base with f_suffix_count and f_suffix_blocked of its suffix: of all folds but the row's own."""
    seen = labelled.groupBy("suffix", "fold").agg(F.count("y").alias("n"), F.sum("y").alias("blocked"))
    every = seen.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    own = seen.select("suffix", "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
    others = own.join(every, "suffix").select("suffix", "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("blocked") - F.col("own_blocked")).alias("blocked"))
    left = others.unionByName(every.select("suffix", none.alias("fold"), "n", "blocked"))
    stats = written(left.select("suffix", "fold", F.log1p("n").alias("f_suffix_count"), ((F.col("blocked") + 1) / (F.col("n") + 2)).alias("f_suffix_blocked")), "url-suffixes")
    # few suffixes are in use, but nothing bounds them: Spark broadcasts the table only where its size allows it
    return base.join(stats, ["suffix", "fold"], "left").fillna({"f_suffix_count": 0.0, "f_suffix_blocked": 0.5})


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every page."""
    base = pick(pages, page_id=id_col, url=url_col)
    host, path, rest = parts(F.col("url"))
    base = base.withColumns({"host": host, "path": path, "rest": rest})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled})
    base = lexical(base, F.col("url"), F.col("host"), F.col("path"), F.col("rest")).drop("rest")
    none = F.lit(-1).cast("long")  # the fold of what has no label
    base = base.withColumn("fold", F.when(F.col("ruled").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS))).otherwise(none))
    base = written(base, "url-features")
    labelled = base.where("ruled IS NOT NULL").withColumn("y", (F.col("ruled") == "block").cast("int"))
    full = with_suffixes(base, labelled, none)
    features = [c for c in full.columns if c.startswith("f_")]
    total = labelled.count()
    part = full.where("ruled IS NOT NULL")
    if total > train_rows:
        part = part.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * train_rows / total))
    cuts = part.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in features]).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in features}
    binned = {f: sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)).cast("int").alias(f) for f in features}
    train = written(part.select(*binned.values(), (F.col("ruled") == "block").cast("int").alias("y")), "url-train")
    margin = grow(train, features)
    scored = full.select("page_id", "host", "path", "rule", "ruled", *binned.values()).withColumn("score", F.expr(f"1 / (1 + exp(-({margin})))"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
