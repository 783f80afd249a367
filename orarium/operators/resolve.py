"""Fuzzy entity resolution: candidates by shared tokens, best and one-to-one matches, location cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.text import jaccard
from orarium.operators.ranges import discard, settled
from orarium.operators.spatial import within

# Similarity that a name alone needs, and what the same locality adds to break ties.
NAME_ONLY, SAME_LOCALITY = 0.8, 0.01
#: Members of a class that are paired with those of another in one go.
BLOCK = 1_000


def token_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str = "tokens", ordered: bool = False) -> DataFrame:
    """left_key, right_key: pairs that share a token, as an equi join; ordered: only those with left_key < right_key, for a
    table with itself."""
    a, b = (df.select(F.col(k).alias(k), F.explode(tokens).alias("token")) for df, k in ((left, left_key), (right, right_key)))
    both = a.join(b, (a.token == b.token) & (F.col(left_key) < F.col(right_key))) if ordered else a.join(b, "token")
    return both.select(left_key, right_key).distinct()


def shared_tokens(most: int) -> int:
    """How many tokens make a key of `prefix_keys`, for sets of up to so many: more of them meet fewer strangers, but large
    sets have too many combinations."""
    return 3 if most <= 12 else 2 if most <= 40 else 1


def prefix_keys(sets: DataFrame, key: str, least: float, count: int) -> DataFrame:
    """key, _t, _tokens (their number), _taken, _hash: hashes of _taken tokens each, of which sets alike by `least` must have
    one in common; sets: key, _t (tokens, the rarest first).

    Sets of n tokens alike by `least` share c = ceil(least * n) or more, so both hold k of the shared ones among their
    n - c + k rarest. k is `count`, or what the larger set's c allows where that is less: a set with a small c has keys of
    every k from c on."""
    n = F.size("_t")
    c = F.greatest(F.ceil(F.round(F.lit(least) * n, 9)).cast("int"), F.lit(1))
    each = sets.withColumns({"_tokens": n, "_least": c}).withColumn("_taken", F.explode(F.sequence(F.least("_least", F.lit(count)), F.least("_tokens", F.lit(count)))))
    each = each.withColumn("_p", F.slice("_t", 1, F.col("_tokens") - F.greatest("_least", "_taken") + F.col("_taken")))
    at, last = (lambda i: F.col("_p")[i]), F.size("_p") - 1
    after = lambda i: F.when(i < last, F.sequence(i + 1, last)).otherwise(F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), last)
    one = F.transform(every, lambda i: F.xxhash64(at(i)))
    two = F.flatten(F.transform(every, lambda i: F.transform(after(i), lambda j: F.xxhash64(at(i), at(j)))))
    three = F.flatten(F.transform(every, lambda i: F.flatten(F.transform(after(i), lambda j: F.transform(after(j), lambda m: F.xxhash64(at(i), at(j), at(m)))))))
    hashes = F.when(F.col("_taken") == 1, one).when(F.col("_taken") == 2, two).otherwise(three)
    return each.select(key, "_t", "_tokens", "_taken", F.explode(hashes).alias("_hash"))


def similar(left: DataFrame, right: DataFrame | None, left_key: str, right_key: str, least: float, tokens: str = "tokens") -> DataFrame:
    """left_key, right_key, score: all pairs whose token sets have a Jaccard index of `least` or more; without a right
    table those of the left one with itself, left_key < right_key.

    Sets meet by combinations of their rarest tokens and by size; both sets travel with the keys, so each candidate is
    measured where it is met."""
    sides = [(left, left_key)] + ([(right, right_key)] if right is not None else [])
    rows = [settled(df.select(F.col(k).alias(k), F.array_distinct(tokens).alias("_t")).where(F.size("_t") > 0), "token-sets") for df, k in sides]
    tokens_of = lambda df: df.select(F.explode("_t").alias("token"))
    counts = (tokens_of(rows[0]) if right is None else tokens_of(rows[0]).unionByName(tokens_of(rows[1]))).groupBy("token").agg(F.count("*").alias("n"))
    count = shared_tokens(max(df.agg(F.coalesce(F.max(F.size("_t")), F.lit(0)).alias("n")).first().n for df in rows))

    def keyed(df: DataFrame, key: str) -> DataFrame:
        long = df.select(key, F.explode("_t").alias("token")).join(counts, "token")
        return prefix_keys(long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("_t")), key, least, count)

    a = keyed(rows[0], left_key)
    b = keyed(rows[1], right_key) if right is not None else a.withColumnRenamed(left_key, right_key)
    b = b.withColumnsRenamed({"_t": "_t2", "_tokens": "_tokens2"})
    fits = F.least("_tokens", "_tokens2") >= F.lit(least) * F.greatest("_tokens", "_tokens2") - 1e-9
    both = a.join(b, ["_taken", "_hash"]).where(fits if right is not None else fits & (F.col(left_key) < F.col(right_key)))
    return both.withColumn("score", jaccard(F.col("_t"), F.col("_t2"))).where(F.col("score") >= least).groupBy(left_key, right_key).agg(F.first("score").alias("score"))


def token_classes(rows: DataFrame, tokens: str = "tokens", by: list[str] | tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """One row for each set of tokens (sorted, without repeats; none for an empty one) and `by`, with further aggregates."""
    sets = rows.withColumn(tokens, F.array_sort(F.array_distinct(tokens))).where(F.size(tokens) > 0)
    return sets.groupBy(*by, tokens).agg(*[c.alias(n) for n, c in columns.items()])


def similar_classes(rows: DataFrame, key: str, least: float, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """class_key (the smallest key of equal sets), n, tokens of the classes of a table; and one < other, score: the pairs of
    classes whose sets have a Jaccard index of `least` or more."""
    classes = settled(token_classes(rows, tokens, class_key=F.min(key), n=F.count("*")).withColumnRenamed(tokens, "tokens"), "token-classes")
    return classes, similar(classes.select(F.col("class_key").alias("one"), "tokens"), None, "one", "other", least)


def similar_within(rows: DataFrame, key: str, least: float, tokens: str = "tokens") -> DataFrame:
    """key, class_key, n_similar: each row with the smallest key of its own set, and how many other rows of the table have
    a set with a Jaccard index of `least` or more. Rows without tokens are like none.

    Rows with equal sets are one class; only classes are compared, and what comes out is a row for each row, however
    many are alike. `similar_classes` has the pairs themselves, by class."""
    classes, pairs = similar_classes(rows, key, least, tokens)
    sizes = classes.select("class_key", "n")
    both = pairs.join(sizes.select(F.col("class_key").alias("one"), F.col("n").alias("n_one")), "one").join(sizes.select(F.col("class_key").alias("other"), F.col("n").alias("n_other")), "other")
    sides = F.array(F.struct(F.col("one").alias("class_key"), F.col("n_other").alias("more")), F.struct(F.col("other").alias("class_key"), F.col("n_one").alias("more")))
    more = both.select(F.inline(sides)).groupBy("class_key").agg(F.sum("more").alias("more"))
    counted = classes.join(more, "class_key", "left").select(F.col("tokens").alias("_t"), "class_key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_similar"))
    keyed = rows.select(F.col(key).alias(key), F.array_sort(F.array_distinct(tokens)).alias("_t"))
    return keyed.join(counted, "_t", "left").select(key, F.coalesce("class_key", F.col(key)).alias("class_key"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"))


def similar_pairs(rows: DataFrame, key: str, left_key: str, right_key: str, least: float, tokens: str = "tokens") -> DataFrame:
    """left_key, right_key, score: all pairs of rows of a table, left_key < right_key, whose token sets have a Jaccard index of
    `least` or more.

    Only classes of equal sets are compared; what is alike is then told of each pair of their rows, so what comes out grows
    with the square of the copies. Large classes meet in blocks: no key of a join has more than some BLOCK * BLOCK pairs."""
    classes, pairs = similar_classes(rows, key, least, tokens)
    blocks = classes.select("class_key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.array_sort(F.array_distinct(tokens)).alias("tokens"))
    members = keyed.join(classes.select("tokens", "class_key"), "tokens").join(blocks, "class_key").select("class_key", F.pmod(F.xxhash64("_k"), "blocks").cast("int").alias("_block"), "_k")
    links = pairs.unionByName(classes.where("n > 1").select(F.col("class_key").alias("one"), F.col("class_key").alias("other"), F.lit(1.0).alias("score")))
    for side, at in (("one", "_i"), ("other", "_j")):
        links = links.join(blocks.withColumnRenamed("class_key", side), side).withColumn(at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    links = links.where("one <> other OR _i <= _j")
    a = links.join(members.toDF("one", "_i", "_left"), ["one", "_i"])
    b = links.drop("score").join(members.toDF("other", "_j", "_right"), ["other", "_j"])
    both = a.join(b, ["one", "other", "_i", "_j"]).where("one <> other OR _i < _j OR _left < _right")
    return both.select(F.least("_left", "_right").alias(left_key), F.greatest("_left", "_right").alias(right_key), "score")


def most_alike(entries: DataFrame, known: DataFrame, key: str, other: str, least: float, position: str = "position", tokens: str = "tokens", by: list[str] | tuple[str, ...] = (), rank: str = "score") -> DataFrame:
    """key, other, score: for each entry the known row whose token set (of the same `by`) is most alike, from `least` on;
    ties, or with rank="position" all, by position.

    Equal sets are one class on both sides, of which the known row that comes first stands for all; classes meet by their
    rarest tokens, tagged with `by`. So the work grows with the number of different sets, not with pairs of rows."""
    tagged = F.transform(tokens, lambda t: F.concat_ws("|", *[F.col(c).cast("string") for c in by], t))
    mine = settled(token_classes(entries, tokens, by, n=F.count("*")).withColumn("_e", F.monotonically_increasing_id()), "entry-classes")
    theirs = settled(token_classes(known, tokens, by, first=F.min(F.struct(position, other))).withColumn("_k", F.monotonically_increasing_id()), "known-classes")
    pairs = similar(mine.select("_e", tagged.alias("tokens")), theirs.select("_k", tagged.alias("tokens")), "_e", "_k", least).join(theirs.select("_k", "first"), "_k")
    order = F.struct((-F.col("score")).alias("s"), F.col("first")) if rank == "score" else F.struct(F.col("first"), (-F.col("score")).alias("s"))
    best = pairs.groupBy("_e").agg(F.min(order).alias("best"))
    found = mine.join(best, "_e").select(*by, F.col(tokens).alias("_t"), "best")
    keyed = entries.select(key, *by, F.array_sort(F.array_distinct(tokens)).alias("_t"))
    return keyed.join(found, [*by, "_t"]).select(key, F.col(f"best.first.{other}").alias(other), (-F.col("best.s")).alias("score"))


def match_score(similarity: Column, same_address: Column, shares_token: Column, same_locality: Column) -> Column:
    """Above 1 for the same address and a shared name word; the similarity where it is high; null for no match."""
    base = F.when(same_address & shares_token, 1 + similarity).when(similarity >= NAME_ONLY, similarity)
    return base + F.when(same_locality, SAME_LOCALITY).otherwise(0.0)


def best_match(scored: DataFrame, key: str, other: str, position: str) -> DataFrame:
    """The best candidate of each key; ties keep the registry's order."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), position)
    return scored.where("score IS NOT NULL").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def closest(rows: DataFrame, key: str, group: str, address: str, near: str, tokens: str) -> DataFrame:
    """key, best, score: for each row the best other row of its group by match_score (ties: the smallest key); none without
    one. Rows of a group share a token (the group's); near: equal values count as the same locality.

    Rows with equal tokens at one address are a cell, in which nothing but the key and `near` tells them apart, so a row
    that isn't alone in its cell has its best there. Rows that are alone meet the other cells of their address, as one row
    each; rows alone at their address meet those with similar tokens. No pair of rows is made inside a cell. (Sets of
    99 tokens or more may differ by less than what `near` is worth: they meet the other cells too.)"""
    base = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(address).alias("a"), F.col(near).alias("r"), F.array_sort(tokens).alias("t"))
    cell = ["g", "a", "t"]
    first = Window.partitionBy(*cell).orderBy("k")
    close = Window.partitionBy(*cell, "r").orderBy("k")
    own = base.withColumns({"n": F.count("*").over(Window.partitionBy(*cell)), "k1": F.min("k").over(Window.partitionBy(*cell)), "k2": F.nth_value("k", 2).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "r1": F.min("k").over(Window.partitionBy(*cell, "r")), "r2": F.nth_value("k", 2).over(close.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    other = lambda a, b: F.when(F.col(a) == F.col("k"), F.col(b)).otherwise(F.col(a))
    one = F.lit(1.0)
    score = lambda s, same, nearby: match_score(s, same, F.lit(True), nearby)
    inside = own.where("n > 1").select("k", F.coalesce(other("r1", "r2"), other("k1", "k2")).alias("b"), score(one, F.lit(True), other("r1", "r2").isNotNull()).alias("score"))
    lone = own.where("n = 1 OR size(t) >= 99").select("k", "g", "a", "r", "t")
    by_near = base.groupBy(*cell, "r").agg(F.min("k").alias("b"))
    cells = by_near.groupBy("g", "a", F.col("t").alias("_t")).agg(F.map_from_entries(F.collect_list(F.struct("r", "b"))).alias("firsts"), F.min("b").alias("b"))
    met = lone.join(cells, ["g", "a"]).where("t <> _t").withColumn("_b", F.try_element_at("firsts", "r"))
    across = met.select("k", F.coalesce("_b", "b").alias("b"), score(jaccard(F.col("t"), F.col("_t")), F.lit(True), F.col("_b").isNotNull()).alias("score"))
    found = settled(inside.unionByName(across))
    # only a row without a better one at its address can be matched by name alone
    top = found.groupBy("k").agg(F.max("score").alias("top"))
    rest = lone.join(top.where(F.col("top") > 1 + SAME_LOCALITY), "k", "left_anti")
    tagged = lambda t: F.transform(t, lambda x: F.concat_ws("|", F.col("g").cast("string"), x))
    rest = settled(rest)
    peers = base.join(rest.select("g").distinct(), "g", "left_semi")
    named = similar(rest.withColumn("tokens", tagged(F.col("t"))), peers.select(F.col("k").alias("b"), tagged(F.col("t")).alias("tokens")), "k", "b", NAME_ONLY).where("k <> b")
    named = named.join(rest.select("k", F.col("a").alias("_a"), F.col("r").alias("_r")), "k").join(base.select(F.col("k").alias("b"), "a", "r"), "b")
    named = named.select("k", "b", score(F.col("score"), F.col("a") == F.col("_a"), F.col("r") == F.col("_r")).alias("score"))
    best = found.unionByName(named).groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("x"))
    return best.select(F.col("k").alias(key), F.col("x.b").alias("best"), (-F.col("x.s")).alias("score"))


def greedy_assignment(scored: DataFrame, lists: str, key: str, other: str) -> DataFrame:
    """One-to-one matches inside each list: entries in order of their best score, then of position; an entry whose best
    is taken gets its next strong candidate, or none.

    As every candidate would rather have the entry whose turn is first, offers can be made at once: each free entry asks
    its first candidate that no earlier entry holds, and a candidate holds the earliest that asks. Entries with one and
    the same list of candidates don't queue for its head: the second of them asks the second candidate, and so on, as the
    ones before it will hold what comes before. Rounds end when nobody is left to ask; what is kept between them is who
    holds each candidate.
    scored: lists, key, position, other, other_position, score, strong."""
    fit = settled(scored.where("score IS NOT NULL").select(lists, key, "position", other, "other_position", "score", "strong"), "candidates")
    order = Window.partitionBy(lists, key).orderBy(F.desc("score"), "other_position")
    ranked = fit.withColumn("choice", F.row_number().over(order)).where(F.col("strong") | (F.col("choice") == 1))
    turn = fit.groupBy(lists, key).agg(F.struct((-F.max("score")).alias("s"), F.min("position").alias("p"), F.first(key).alias("k")).alias("turn"))
    options = F.transform(F.array_sort(F.collect_list(F.struct("choice", other))), lambda x: x[other])
    entries = settled(ranked.groupBy(lists, key).agg(options.alias("options")).join(turn.hint("merge"), [lists, key]), "entries")
    offers = settled(entries.select(lists, key, "turn", "options", F.posexplode("options").alias("choice", other)), "offers")
    held = None
    while True:
        if held is None:
            free = offers.withColumn("holder", F.lit(None).cast(offers.schema["turn"].dataType))
        else:
            # merged: a round would send holders to the driver for a broadcast, and rounds are many
            free = offers.join(held.select(lists, key).hint("merge"), [lists, key], "left_anti").join(held.select(lists, other, F.col("turn").alias("holder")).hint("merge"), [lists, other], "left")
            free = free.where("holder IS NULL OR turn < holder")
        alike = Window.partitionBy(lists, "options")
        free = free.withColumns({"bound": F.min("holder").over(alike), "nth": F.dense_rank().over(alike.orderBy("turn")), "option": F.row_number().over(Window.partitionBy(lists, key).orderBy("choice"))})
        # beyond the first holder's turn the candidates still open differ between alike entries: those wait a round
        asks = free.where((F.col("option") == F.col("nth")) & ((F.col("nth") == 1) | F.col("bound").isNull() | (F.col("turn") < F.col("bound")))).select(lists, key, other, "turn", F.lit(True).alias("fresh"))
        rows = asks if held is None else held.withColumn("fresh", F.lit(False)).unionByName(asks)
        best = rows.groupBy(lists, other).agg(F.min(F.struct("turn", key, "fresh")).alias("b"))
        before, held = held, settled(best.select(lists, F.col(f"b.{key}").alias(key), other, F.col("b.turn").alias("turn"), F.col("b.fresh").alias("fresh")), "held")
        if before is not None:
            discard(before)
        # whoever asks has a candidate free or held by a later one, so somebody new holds one as long as anybody asks
        if held.where("fresh").isEmpty():
            break
    return entries.select(lists, key).join(held.select(lists, key, other).hint("merge"), [lists, key], "left").select(lists, key, other)


def unique_best(scored: DataFrame, key: str, other: str) -> DataFrame:
    """The best candidate where no other has the same score."""
    top = Window.partitionBy(key)
    tied = scored.withColumn("_top", F.max("score").over(top)).where("score = _top").groupBy(key).agg(F.count("*").alias("n"), F.first(other).alias(other), F.first("score").alias("score"))
    return tied.where("n = 1").drop("n")


def restore_streets(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """id, printed_key (words of the printed street) -> the map's street name: the one with that key, else the only one
    of which each printed word begins the word at its place."""
    keys = streets.groupBy("key").agg(F.count_distinct("name").alias("n"), F.first("name").alias("name"))
    exact = addresses.join(keys.withColumnRenamed("key", "printed_key"), "printed_key", "left")
    known = exact.where("n IS NOT NULL").select("id", F.when(F.col("n") == 1, F.col("name")).alias("name"))
    rest = exact.where("n IS NULL").select("id", F.split("printed_key", " ").alias("_p"))
    # candidates by the first letter and the number of words
    cut = streets.select("name", F.split("key", " ").alias("_w"))
    near = rest.withColumns({"_c": F.substring(F.get("_p", F.lit(0)), 1, 1), "_n": F.size("_p")}).join(cut.withColumns({"_c": F.substring(F.get("_w", F.lit(0)), 1, 1), "_n": F.size("_w")}), ["_c", "_n"])
    hits = near.where(F.forall(F.arrays_zip("_p", "_w"), lambda z: z["_w"].startswith(z["_p"]))).groupBy("id").agg(F.count_distinct("name").alias("n"), F.first("name").alias("name")).where("n = 1").select("id", "name")
    return known.unionByName(hits).where("name IS NOT NULL")


def locate(entities: DataFrame, places: DataFrame, radius: float = 300.0) -> DataFrame:
    """entity_id -> place_id and how it was found: by phone (most confident), by a name token and the address (most
    confident), by a name token within the radius (nearest). The first way that finds one is taken.

    entities: entity_id, phone, tokens, address_key, lat, lon; places: place_id, phones, tokens, address_key, confidence, lat, lon."""
    by_phone = entities.select("entity_id", "phone").join(places.select(F.explode("phones").alias("phone"), F.struct((-F.col("confidence")).cast("double").alias("rank"), "place_id").alias("best")).groupBy("phone").agg(F.min("best").alias("best")), "phone").select("entity_id", F.lit(1).alias("way"), "best")
    named = places.select(F.explode(F.array_distinct("tokens")).alias("token"), "address_key", "place_id", "confidence", "lat", "lon")
    asked = entities.select("entity_id", F.explode(F.array_distinct("tokens")).alias("token"), "address_key", "lat", "lon")
    # of the places of a token at one address only the most confident can be chosen, and at one spot only the first
    at_address = named.groupBy("token", "address_key").agg(F.min(F.struct((-F.col("confidence")).cast("double").alias("rank"), "place_id")).alias("best"))
    by_name = asked.join(at_address, ["token", "address_key"]).select("entity_id", F.lit(2).alias("way"), "best")
    spots = named.groupBy("token", "lat", "lon").agg(F.min("place_id").alias("place_id"))
    by_distance = within(asked.select("entity_id", "token", "lat", "lon"), spots, radius, ["token"]).select("entity_id", F.lit(3).alias("way"), F.struct(F.col("metres").alias("rank"), "place_id").alias("best"))
    every = by_phone.unionByName(by_name).unionByName(by_distance)
    return every.groupBy("entity_id").agg(F.min(F.struct("way", "best")).alias("x")).select("entity_id", "x.best.place_id", "x.way")
