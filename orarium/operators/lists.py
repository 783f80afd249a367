"""What a list of places shows: its order, its filter, its neighbours in time, and the feeds it splits into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.display import checked_text, is_duty_look, until_date
from orarium.functions.timez import local_to_instant
from orarium.operators.spatial import knn

LOOKS = ("duty", "open", "duty-unknown", "closed")


def by_distance(distance: str | None, name: str, key: str) -> list[Column]:
    """Nearest first (unplaced ones last), then by name in Greek order; the key settles what is left."""
    near = [F.col(distance).asc_nulls_last()] if distance else []
    return [*near, F.expr(f"{name} COLLATE el"), F.col(key)]


def in_list_order(rows: DataFrame, by: list[str], distance: str | None = None, name: str = "name", key: str = "entity_id", place: str = "place") -> DataFrame:
    """Adds the place in each area's list: open rows, those that close soon after the others, then the closed ones."""
    order = Window.partitionBy(*by).orderBy(F.col("look") == "closed", F.coalesce("closing_soon", F.lit(False)), *by_distance(distance, name, key))
    return rows.withColumn(place, F.row_number().over(order))


def next_to_open(rows: DataFrame, limit: int, distance: str | None = None, name: str = "name", key: str = "entity_id") -> DataFrame:
    """The closed ones that open first: by time, then as in the list."""
    closed = rows.where("look = 'closed' AND next_open IS NOT NULL")
    return closed.orderBy("next_open", *by_distance(distance, name, key)).limit(limit)


def nearest_open(rows: DataFrame, self_id: Column, shown: int = 3, distance: str = "metres", key: str = "entity_id") -> DataFrame:
    """The nearest that are open, in place of plain neighbours; not the place itself."""
    return rows.where((F.col("look") != "closed") & (F.col(key) != self_id)).orderBy(F.col(distance).asc_nulls_last(), key).limit(shown)


def list_filter(rows: DataFrame, by: list[str], wanted: str = "duty") -> DataFrame:
    """Rows that the filter `on duty` leaves in each list; where all open ones are on duty it would tell nothing apart,
    so it is off and hidden. Adds chips (whether it is shown) and active (what is applied)."""
    duty, shown = F.count_if(is_duty_look(F.col("look"))), F.count_if(F.col("look") != "closed")
    counts = rows.groupBy(*by).agg(duty.alias("n_duty"), shown.alias("n_open"))
    chips = F.col("n_open") > F.col("n_duty")
    both = rows.join(counts, by).withColumn("chips", chips).withColumn("active", F.when(chips & F.lit(wanted == "duty"), "duty").otherwise("all"))
    return both.where((F.col("active") == "all") | is_duty_look(F.col("look"))).drop("n_duty", "n_open")


def feeds(pins: DataFrame) -> dict[str, DataFrame]:
    """The three feeds of a map: on duty, open (clustered), closed."""
    on_duty = is_duty_look(F.col("look"))
    return {"duty": pins.where(on_duty), "clustered": pins.where(~on_duty & (F.col("look") != "closed")), "closed": pins.where("look = 'closed'")}


def clusters(pins: DataFrame, zoom: int, radius: int = 40, tile: int = 512) -> DataFrame:
    """Pins in the cells of a grid whose width is `radius` pixels at a zoom: x, y, n, and the mean place.

    The grid is of the map's square projection, so cells are equally wide on the screen everywhere."""
    cells = tile * 2**zoom / radius
    rad = F.radians("lat")
    x = F.floor((F.col("lon") + 180) / 360 * cells)
    y = F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * cells)
    return pins.where("lat IS NOT NULL").groupBy(x.cast("long").alias("x"), y.cast("long").alias("y")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def duty_end(date: Column, to: Column, next_day: Column, zone: Column | str) -> Column:
    """When a published duty ends; without printed hours at the next duty day's start."""
    following = F.date_add(date, 1)
    return F.when(to.isNull(), local_to_instant(following, F.lit("08:00"), zone)).otherwise(local_to_instant(F.when(next_day, following).otherwise(date), to, zone))


def upcoming(duties: DataFrame, now: Column, zone: str) -> DataFrame:
    """Published duties (date, to, next_day) that haven't ended."""
    return duties.where(duty_end(F.col("date"), F.col("to"), F.col("next_day"), zone) > now)


def duties_from(listings: DataFrame, first: Column, key: str = "entity_id") -> DataFrame:
    """An entity's published duties from a date on, numbered in order of date and place in the list."""
    order = Window.partitionBy(key).orderBy("date", "position")
    return listings.where(F.col("date") >= first).withColumn("nth", F.row_number().over(order))


def page_neighbours(dates: DataFrame, by: str, date: str = "date") -> DataFrame:
    """Each published date with the one before and the one after."""
    order = Window.partitionBy(by).orderBy(date)
    return dates.select(by, date).distinct().withColumns({"previous": F.lag(date).over(order), "following": F.lead(date).over(order)})


def todays_page(dates: DataFrame, by: str, today: Column, date: str = "date") -> DataFrame:
    """The date that a page for today shows: today, else the next published one, else the last."""
    at = F.col(date)
    return dates.groupBy(by).agg(F.coalesce(F.min(F.when(at >= today, at)), F.max(at)).alias("shown"))


def latest_pages(dates: DataFrame, by: str, most: int = 45, date: str = "date") -> DataFrame:
    """The last `most` published dates of each area."""
    order = Window.partitionBy(by).orderBy(F.desc(date))
    return dates.select(by, date).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def list_state(date: Column, first: Column, last: Column, pending: Column, settled: Column) -> Column:
    """loading, unpublished or settled, of a date's list: asked for and not answered; inside the published range and
    not asked for yet; else what has come."""
    published = F.coalesce(date.between(first, last), F.lit(False))
    waiting = F.coalesce(F.array_contains(pending, date), F.lit(False))
    come = F.coalesce(F.array_contains(settled, date), F.lit(False))
    return F.when(waiting | (published & ~come), "loading").when(come, "settled").otherwise("unpublished")


def locate_decision(area_chosen: Column, dismissed: Column, permission: Column, remembered: Column) -> Column:
    """Whether to ask for a position: skip, denied, locate or remembered, in this order of reasons."""
    return (
        F.when(area_chosen | dismissed, "skip")
        .when(permission == "denied", "denied")
        .when(permission == "granted", "locate")
        .when(remembered, "remembered")
        .otherwise("skip")
    )


def toggled(items: Column, item: Column, most: int) -> Column:
    """The list without the item, or with it at the end; the last `most` stay."""
    longer = F.array_append(items, item)
    kept = F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), F.lit(most))
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(kept)


def latest(rows: DataFrame, at: str = "updated_at") -> DataFrame:
    """One row: the latest time of all areas."""
    return rows.agg(F.max(at).alias("latest"))


def areas_by_group(areas: DataFrame, groups: DataFrame, group: str = "group_id") -> DataFrame:
    """Areas under their group's name, those of unknown groups together and last: group_name, nth_group, area, nth.

    groups: group_id, name (one row each)."""
    named = areas.join(groups.select(F.col("group_id").alias(group), F.col("name").alias("group_name")), group, "left")
    first = Window.orderBy(F.col("group_name").isNull(), F.expr("group_name COLLATE el"))  # one row for each group
    heads = named.select("group_name").distinct().withColumn("nth_group", F.row_number().over(first))
    inside = Window.partitionBy("nth_group").orderBy(F.expr("area COLLATE el"), "area")
    both = named.join(heads, named.group_name.eqNullSafe(heads.group_name)).drop(heads.group_name)
    return both.withColumn("nth", F.row_number().over(inside)).select("group_name", "nth_group", "area", "nth")


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How many places come from each source, at each precision."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def sections(rows: DataFrame, keys: list[str], position: str, entry: str) -> DataFrame:
    """Entries grouped to the sections of a list (by heading and window, by window, by hours): in page order, with the
    section's first place."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(entry).alias("e")))), lambda x: x["e"])
    return rows.groupBy(*keys).agg(F.min(position).alias("first"), listed.alias("entries"))


def offered(rows: DataFrame) -> DataFrame:
    """Rows that a list shows: all of an area whose regular hours are known (regular_known); of another's not the closed
    ones, which are only not on duty."""
    return rows.where(F.col("regular_known") | (F.col("look") != "closed"))


def neighbours(entities: DataFrame, k: int, metres=lambda d: d) -> DataFrame:
    """entity_id, other, metres, nth: the k nearest of each precisely placed entity; of one that isn't the first k others of
    its locality, with no distance, as one from the middle of a village would look more exact than it is.

    entities: entity_id, position (in the registry), locality, lat, lon, precision."""
    precise = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.coalesce(F.col("precision").isin("exact", "street"), F.lit(False))
    placed = entities.where(precise)
    near = knn(placed, placed, k, "entity_id", metres=metres)
    # k + 1 rows of a locality hold k others of anyone there
    first = Window.partitionBy("locality").orderBy("position", "entity_id")
    heads = entities.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).select("locality", F.col("entity_id").alias("other"), "_n")
    fellows = entities.where(~precise).select("entity_id", "locality").join(heads, "locality").where(F.col("entity_id") != F.col("other"))
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("_n"))
    there = fellows.withColumn("nth", nth).where(F.col("nth") <= k).select("entity_id", "other", F.lit(None).cast(near.schema["metres"].dataType).alias("metres"), "nth")
    return near.select("entity_id", "other", "metres", "nth").unionByName(there)


def status_rows(areas: DataFrame, now: Column, zone: str, hours: int = 36, locale: str = "en") -> DataFrame:
    """area_id, checked, checked_text, duty_until, fresh of every area: when it was checked (else updated), up to when its
    duties are published, and whether that is less than `hours` ago.

    areas: area_id, checked_at, updated_at, duties_to."""
    checked = F.coalesce("checked_at", "updated_at")
    fresh = checked.isNotNull() & (F.unix_micros(now) - F.unix_micros(checked) <= hours * 3_600_000_000)
    return areas.select("area_id", checked.alias("checked"), checked_text(checked, zone, locale).alias("checked_text"), F.when(F.col("duties_to").isNotNull(), until_date(F.col("duties_to"), now, zone, locale)).alias("duty_until"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def national_index(areas: DataFrame, entities: DataFrame, dates: DataFrame) -> DataFrame:
    """One row an area as the national index has it: area_id, bounds, center, n_entities, updated_at, checked_at, duties
    (from, to; null without any) and duty_dates in order.

    areas: area_id, bounds, center, updated_at, checked_at; entities: area_id; dates: area_id, date."""
    sizes = entities.groupBy("area_id").agg(F.count("*").alias("n_entities"))
    lists = dates.groupBy("area_id").agg(F.struct(F.min("date").alias("from"), F.max("date").alias("to")).alias("duties"), F.array_sort(F.collect_set("date")).alias("duty_dates"))
    both = areas.select("area_id", "bounds", "center", "updated_at", "checked_at").join(sizes, "area_id", "left").join(lists, "area_id", "left")
    return both.withColumns({"n_entities": F.coalesce("n_entities", F.lit(0)).cast("long"), "duty_dates": F.coalesce("duty_dates", F.array().cast(lists.schema["duty_dates"].dataType))})
