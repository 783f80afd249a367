"""Rosters: known entities beyond the lists, how they are merged, and how printed rows find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.geo import REGISTRY_RADIUS_METRES, haversine
from orarium.functions.text import entity_id, match_key, name_tokens, normalize_phone
from orarium.operators.periods import held
from orarium.operators.ranges import spread
from orarium.operators.resolve import most_alike

# Metres between a place matched by phone and the address's own before it is reported, and how far a place
# of that name may lie from an address found exactly, by street or by locality.
DISAGREEMENT = 1500.0
SNAP = {"exact": 150.0, "street": 600.0, "locality": 2500.0}
BAD_PHONE = 0.6
#: Members up to which a roster is sent to every task.
SMALL_ROSTER = 10_000


def one_a_phone(members: DataFrame, stored: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(roster, unusable): one row a phone, named by its members in page order, the rest from the first; the date it was
    first named is kept. Rows without a phone can't be told apart and are reported.

    members: phone, name, address, position; stored: phone, date."""
    fine = members.where("phone <> ''")
    firsts = fine.groupBy("phone", "name").agg(F.min("position").alias("at"), F.min_by("address", "position").alias("address"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " - ")
    merged = firsts.groupBy("phone").agg(names.alias("name"), F.min_by("address", "at").alias("address"))
    before = stored.select("phone", F.col("date").alias("_date"))
    roster = merged.join(before, "phone", "left").select("phone", "name", "address", F.coalesce("_date", today).alias("date"))
    return roster, members.where("phone IS NULL OR phone = ''")


def next_roster(stored: DataFrame, named: DataFrame, sweep: bool, complete: bool, key: str = "phone") -> DataFrame:
    """A full read that came through replaces the roster; any other adds what the stored one lacks."""
    if sweep and complete:
        return named
    return stored.unionByName(named.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def first_named(rows: DataFrame, roster: DataFrame, row_key: str, phones: str = "phones") -> DataFrame:
    """row_key, phone: of the phones that a row prints the first that the roster has; of rows for one phone the first."""
    printed = rows.select(row_key, F.posexplode(phones).alias("_p", "phone")).join(roster.select("phone"), "phone")
    found = printed.groupBy(row_key).agg(F.min_by("phone", "_p").alias("phone"))
    return found.groupBy("phone").agg(F.min(row_key).alias(row_key))


def not_exempt(duties: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Duties (phone, date, …) but those of a phone inside an exemption's dates (phone, from, to)."""
    return duties.join(held(duties, exemptions, "date", "from", "to", ["phone"]), ["phone", "date"], "left_anti")


def entry_ids(entries: DataFrame, known: DataFrame) -> DataFrame:
    """key -> id: the phone's; with a bad phone the first known entity of the same locality with a name alike by 0.6 or
    more; else one made of name and locality.

    entries: key, name, locality, phone; known: id, name, locality, position."""
    bad = entries.where(normalize_phone(F.col("phone")).isNull()).select("key", match_key(F.col("locality")).alias("_l"), name_tokens(F.col("name")).alias("_t"))
    have = known.select("id", "position", match_key(F.col("locality")).alias("_l"), name_tokens(F.col("name")).alias("_k"))
    found = most_alike(bad.withColumnRenamed("_t", "tokens"), have.withColumnRenamed("_k", "tokens"), "key", "id", BAD_PHONE, by=["_l"], rank="position").select("key", F.col("id").alias("_id"))
    return entries.join(found, "key", "left").select("key", F.coalesce("_id", entity_id(F.col("phone"), F.col("name"), F.col("locality"))).alias("id"))


def same_word(a: Column, b: Column) -> Column:
    """Equal, or a letter apart (one more, one less, another) where both have six letters or more."""
    return (a == b) | ((F.length(a) >= 6) & (F.length(b) >= 6) & (F.levenshtein(a, b, 1) >= 0))


def match_members(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """row_id -> member_id and fit (one, several, elsewhere, none): the member that shares most words with a row.

    A surname at least must be the member's; of several with as many words those at a hinted place; a row with hints is
    no member's elsewhere. rows: row_id, words, hints (match keys); roster: member_id, words, surnames, place (a match key).

    Words that are equal, or one letter apart, share a form with one letter left out, which makes the join an equi join.
    Rows are dealt by row_id before their words are taken apart. A roster of up to SMALL_ROSTER members goes to all tasks;
    then no row moves again, and a task holds the pairs of a bounded number of rows."""
    rows, small = spread(rows, "row_id", rows=20_000), len(roster.select("member_id").take(SMALL_ROSTER + 1)) <= SMALL_ROSTER

    def forms(word: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substr(word, F.lit(1), k - 1), F.substr(word, k + 1)))
        return F.when(F.length(word) >= 6, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))

    wanted = rows.select("row_id", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''").select("row_id", "w", F.explode(forms(F.col("w"))).alias("form"))
    have = roster.select("member_id", "surnames", F.explode(F.array_distinct("words")).alias("v")).where("v <> ''").select("member_id", F.array_contains("surnames", F.col("v")).alias("is_surname"), "v", F.explode(forms(F.col("v"))).alias("form"))
    pairs = wanted.join(F.broadcast(have) if small else have, "form").where(same_word(F.col("w"), F.col("v"))).groupBy("row_id", "member_id").agg(F.count_distinct("w").alias("score"), F.bool_or("is_surname").alias("surname")).where("surname")
    top = pairs.withColumn("best", F.max("score").over(Window.partitionBy("row_id"))).where("score = best")
    placed = top.join(rows.select("row_id", "hints"), "row_id").join(F.broadcast(roster.select("member_id", "place")) if small else roster.select("member_id", "place"), "member_id")
    placed = placed.withColumn("fits", F.exists("hints", lambda h: F.contains(F.col("place"), h)))
    some = Window.partitionBy("row_id")
    placed = placed.withColumns({"any_fits": F.max("fits").over(some), "n": F.count("*").over(some)})
    left = placed.where("fits OR n = 1 OR NOT any_fits")
    chosen = left.groupBy("row_id").agg(F.count("*").alias("n"), F.first("member_id").alias("member"), F.bool_or("fits").alias("fits"), F.first(F.size("hints")).alias("n_hints"))
    fit = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several").when((F.col("n_hints") > 0) & ~F.col("fits"), "elsewhere").otherwise("one")
    return rows.select("row_id").join(chosen, "row_id", "left").select("row_id", F.when(fit == "one", F.col("member")).alias("member_id"), fit.alias("fit"))


def expired(lists: DataFrame, today: Column, last: str = "to") -> DataFrame:
    """Lists in force today or later: those whose period is over go."""
    return lists.where(F.col(last) >= today)


def rematched(entries: DataFrame, known: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Stored entries matched again with the entities known by now: key, entity_id of the most alike name (ties: the
    first); entries without one go, as they did before.

    entries: key, tokens; known: entity_id, tokens, position."""
    return most_alike(entries, known, key, "entity_id", least).select(key, "entity_id")


def choose_location(entities: DataFrame) -> DataFrame:
    """entity_id -> lat, lon, source, precision: an override, else the list's, else a place by phone or by name and
    address, else a place of that name near the geocoded address, else the geocoded address.

    entities: entity_id and the candidates override, listed, by_phone, by_name (structs lat, lon) and geocoded (struct
    lat, lon, precision); null where there is none."""
    spot = lambda c, source, precision: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.lat").alias("lat"), F.col(f"{c}.lon").alias("lon"), F.lit(source).alias("source"), precision.alias("precision")))
    exact = F.lit("exact")
    far = haversine(F.col("geocoded.lat"), F.col("geocoded.lon"), F.col("by_name.lat"), F.col("by_name.lon"), REGISTRY_RADIUS_METRES)
    reach = F.element_at(F.create_map(*[F.lit(x) for pair in SNAP.items() for x in pair]), F.col("geocoded.precision"))
    snapped = F.when(F.col("geocoded").isNotNull() & (far <= reach), spot("by_name", "places", exact))
    rounded = F.when(F.col("geocoded").isNotNull(), F.struct(F.round("geocoded.lat", 6).alias("lat"), F.round("geocoded.lon", 6).alias("lon"), F.lit("geocoder").alias("source"), F.col("geocoded.precision").alias("precision")))
    best = F.coalesce(spot("override", "override", exact), spot("listed", "list", exact), spot("by_phone", "places", exact), snapped, rounded)
    return entities.select("entity_id", best.alias("l")).select("entity_id", "l.*")


def disagreements(entities: DataFrame) -> DataFrame:
    """entity_id, metres: a place by phone that lies far from the street-level address."""
    metres = haversine(F.col("geocoded.lat"), F.col("geocoded.lon"), F.col("by_phone.lat"), F.col("by_phone.lon"), REGISTRY_RADIUS_METRES)
    return entities.where("geocoded.precision <> 'locality'").select("entity_id", metres.alias("metres")).where(F.col("metres") > DISAGREEMENT)


def first_duties(listings: DataFrame, key: str = "phone") -> DataFrame:
    """The first date that each entity was named on."""
    return listings.groupBy(key).agg(F.min("date").alias("date"))


def distinct_warnings(warnings: DataFrame, position: str) -> DataFrame:
    """Each (code, message) once, where it came first."""
    return warnings.groupBy("code", "message").agg(F.min(position).alias(position))
