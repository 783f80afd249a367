"""A year's duty table out of positioned text, told apart by what the cells say rather than by where they stand.

    items   doc, page, position (order in the page), x, y, width, height, text; y grows upward, as on paper

A row begins at its date and takes what follows, up to the next one. Its hours, phone and flag are found by their form, so
columns may move from page to page and cells may be printed into one another. A row that a page break cut is put together
from both halves. A row that is incomplete or contradicts itself is returned with its reasons, never guessed.

All windows and groups are by document and town, so one town's pages are the largest unit that a sort holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orarium.functions.grammars import WEEKDAYS
from orarium.functions.text import clean_display, join_lines, match_key, squash
from orarium.functions.timez import iso_weekday
from orarium.functions.titles import built_date
from orarium.operators.ranges import settled, spread
from orarium.sources.sheets import upper_median

# The printed table's labels, flags and the word of a row that is on duty overnight; forms of its cells.
LABELS = ("Ημερομηνία", "Ωράριο", "Φαρμακείο", "Διεύθυνση", "Τηλέφωνο", "Διανυκτερεύει", "Ημέρα", "Αργία", "Υπεύθυνος", "Φαρμακοποιός", "Περιοχή")
YES, NO, OVERNIGHT, HOLIDAY, STAMP = "Ναι", "Όχι", "ΔΙΑΝΥΚΤΕΡΕΥΣΗ", "ΝΑΙ", "ΑΔΑ:"
TOWN = r"^(\p{Lu}[\p{Lu} ]*\p{Lu})\s+(20\d\d)$"
DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4}),?(?:\s+(\p{L}+))?$"
DATE_AND_MORE = r"^(\d{1,2}/\d{1,2}/\d{4}),?\s+(\p{L}+)\s*(.*)$"
WINDOW = r"\d{1,2}:\d{2}-\d{1,2}:\d{2}\*?"
ONE_LINE = rf"^(\d{{1,2}}/\d{{1,2}}/\d{{4}}),\s+((?:{WINDOW}(?:\s*&\s*)?)+)\s+(.*?)\s*(\d{{10}})\s+({YES}|{NO})\s+(\p{{L}}+)$"
WEEKDAY = r"(?iu:Δευτ[εέ]\p{M}?ρα|Τρ[ιί]\p{M}?τη|Τετ[αά]\p{M}?ρτη|Π[εέ]\p{M}?μπτη|Παρασκευ[ηή]\p{M}?|Σ[αά]\p{M}?ββατο|Κυριακ[ηή]\p{M}?)"
FOREIGN = rf"(?<!\S)(?:\d{{10}}|{YES}|{NO})(?!\S)"
# Fixed values, in points: a heading's height, how far above its date a row's item may lie, how far below it a flag is
# another row's, where the column of dates ends, how near to the date its weekday stands.
HEADING, ABOVE, BELOW, DATES_END, BESIDE = 9.5, 7.0, 15.0, 90.0, 25.0
#: Moves the lines that go on on the next page below all others.
NEXT_PAGE = 10_000.0


def is_flag(x: Column) -> Column:
    return x.isin(YES, NO)


def is_phone(x: Column) -> Column:
    return x.rlike(r"^\d{10}$")


def weekday_number(word: Column) -> Column:
    """1 (Monday) to 7 of a weekday's name in any case; null for another word."""
    plain = F.translate(F.regexp_replace(F.lower(word), r"\p{M}", ""), "άέήίό", "αεηιο")
    return F.nullif(F.array_position(F.lit(list(WEEKDAYS)), plain), F.lit(0))


def date_parts(x: Column) -> tuple[Column, Column]:
    """The date (null where there is none such) and the weekday's name ('' where none is printed) of `1/1/2026, Πέμπτη`."""
    day, month, year, name = (F.regexp_extract(x, DATE, k) for k in (1, 2, 3, 4))
    return F.when(year != "", built_date(year, month, day)), name


def whole_hours(x: Column) -> Column:
    """`08:00-14:30 & 17:30-08:00` of printed pieces put together; null unless they are one or two whole windows."""
    bare = F.regexp_replace(x, r"\s+", "")
    padded = F.regexp_replace(bare, r"(?<!\d)(\d):", "0$1:")
    return F.when(bare.rlike(f"^{WINDOW}(&{WINDOW})?$"), F.replace(padded, F.lit("&"), F.lit(" & ")))


def peeled(cells: DataFrame) -> DataFrame:
    """Adds phones, flags, side and rest: what the printing ran into a cell is taken out of it again.

    A cell of one word is what it is. Of several, a phone or a flag is another cell's, and then so is a weekday at either
    end (the last one goes before the first one)."""
    taken, none = F.col("kind").eqNullSafe("cell") & F.col("text").contains(" ") & F.col("text").rlike(FOREIGN), F.array().cast("array<string>")
    cells = cells.withColumn("_own", F.when(taken, squash(F.regexp_replace("text", FOREIGN, " "))))
    own, end = F.col("_own"), lambda pattern: F.nullif(F.regexp_extract("_own", pattern, 1), F.lit(""))
    return cells.withColumns({
        "phones": F.when(own.isNotNull(), F.regexp_extract_all("text", F.lit(r"(?<!\S)(\d{10})(?!\S)"), F.lit(1))).otherwise(none),
        "flags": F.when(own.isNotNull(), F.regexp_extract_all("text", F.lit(rf"(?<!\S)({YES}|{NO})(?!\S)"), F.lit(1))).otherwise(none),
        "side": F.coalesce(end(rf"(?:^| )({WEEKDAY})$"), end(rf"^({WEEKDAY})(?= )")),
        "rest": F.when(own.isNotNull(), F.regexp_replace(own, rf"^(?:{WEEKDAY}(?: |$))+|(?: {WEEKDAY})+$", "")).otherwise(F.when(F.col("kind") == "cell", F.col("text"))),
    }).drop("_own")


def with_parts(cells: DataFrame) -> DataFrame:
    """Adds phones, flags, weekday, hours and words of each cell of a row that begins at `start`."""
    rest = F.col("rest")
    near = weekday_number(rest).isNotNull() & (F.abs(F.col("x") - F.col("start.x")) < BESIDE)
    form = F.when(rest == "", "none").when(is_phone(rest), "phone").when(is_flag(rest), "flag").when(near, "weekday").when(rest.rlike(r"^[\d:\-*&\s]+$") & rest.rlike("[:&]"), "hours").when(rest.isNotNull(), "words")
    only = lambda k: F.when(F.col("_f") == k, rest)
    more = lambda c, k: F.concat(c, F.array_compact(F.array(only(k))))
    cells = peeled(cells).withColumn("_f", form)
    return cells.withColumns({"phones": more("phones", "phone"), "flags": more("flags", "flag"), "weekday": F.coalesce("side", only("weekday")), "hours": only("hours"), "words": only("words")}).drop("_f", "side", "rest")


def sections(items: DataFrame) -> DataFrame:
    """Items with their town, year, section (numbered by headings through the document), page_nth, kind (date, line, cell)
    and whether the section is its page's last and its rows are named ones. Labels and headings are gone, and a date that
    was run together with what follows it is two items."""
    text = squash(F.col("text"))
    found = items.select("doc", "page", "position", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "height", text.alias("text"))
    found = found.where((F.col("text") != "") & ~F.col("text").isin(*LABELS) & ~F.col("text").startswith(STAMP))
    heads = F.coalesce(F.col("text").rlike(TOWN) & (F.col("height") >= HEADING), F.lit(False))
    order = Window.partitionBy("doc").orderBy("page", "position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("heads", heads).withColumns({
        "section": F.count_if("heads").over(upto),
        "town": F.last(F.when(F.col("heads"), squash(F.regexp_extract("text", TOWN, 1))), ignorenulls=True).over(upto),
        "year": F.last(F.when(F.col("heads"), F.regexp_extract("text", TOWN, 2).cast("int")), ignorenulls=True).over(upto),
        "page_nth": F.dense_rank().over(Window.partitionBy("doc").orderBy("page")),
    })
    # where the page ends is seen before headings go: one at its foot is the last section, though empty
    found = found.withColumn("is_last_section", F.col("section") == F.max("section").over(Window.partitionBy("doc", "page")))
    found = found.where("NOT heads AND section > 0").drop("heads", "height")
    day, word, more = (F.regexp_extract("text", DATE_AND_MORE, k) for k in (1, 2, 3))
    known = weekday_number(word).isNotNull()
    joined = (F.col("x") < DATES_END) & F.col("text").rlike(DATE_AND_MORE) & ~F.col("text").rlike(DATE)
    two = F.array(
        F.struct(F.lit(0).alias("part"), F.col("x").alias("x"), F.concat(day, F.lit(","), F.when(known, F.concat(F.lit(" "), word)).otherwise("")).alias("text")),
        F.struct(F.lit(1).alias("part"), (F.col("x") + 60).alias("x"), squash(F.when(known, more).otherwise(F.concat_ws(" ", word, more))).alias("text")),
    )
    one = F.array(F.struct(F.lit(0).alias("part"), "x", "text"))
    found = found.withColumn("_i", F.explode(F.when(joined, two).otherwise(one))).drop("x", "text").select("*", "_i.*").drop("_i")
    kind = F.when((F.col("x") < DATES_END) & F.col("text").rlike(DATE), "date").when(F.col("text").rlike(ONE_LINE), "line").otherwise("cell")
    named = F.max(F.col("text") == OVERNIGHT).over(Window.partitionBy("doc", "page", "section"))
    return found.withColumns({"kind": kind, "named": named})


def owned(found: DataFrame) -> DataFrame:
    """Adds `start`, the date whose row an item is: the lowest one that lies above it or at most ABOVE below its top, else
    the last row of the page before in the same section (then `goes_on`), else null. Dates are their own rows."""
    start = F.when(F.col("kind") == "date", F.struct("page", "page_nth", "position", "x", "y", "text", "named"))
    found = found.withColumns({"_key": F.col("y") - F.when(F.col("kind") == "date", 0.0).otherwise(ABOVE), "_start": start})
    order = Window.partitionBy("doc", "section").orderBy("page", F.desc("_key"), F.col("kind") != "date", "position", "part").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("start", F.last("_start", ignorenulls=True).over(order))
    before = F.col("page_nth") - F.col("start.page_nth")
    fits = (before == 0) | ((before == 1) & ~F.col("start.named"))
    return found.withColumns({"goes_on": F.coalesce(before == 1, F.lit(False)), "start": F.when(fits, F.col("start"))}).drop("_key", "_start")


def tail_targets(drafts: DataFrame) -> DataFrame:
    """doc, section, tail_nth, page_nth, rank: which row without a flag (by rank on its page) a page's tail completes.

    A tail left by the page before takes the first one, then the page's own tail the next; one that finds none is left for
    the next page, and there it is given up. One fold over the few figures of a section's pages."""
    pages = drafts.groupBy("doc", "section", "page_nth").agg(F.count_if("flagless").alias("n"), F.max("has_tail").alias("has_tail"))
    pages = pages.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("page_nth", "n", "has_tail"))).alias("pages"))
    target = "array<struct<tail_nth:int,page_nth:int,rank:int>>"

    def step(acc, p):
        took = (acc["held"] == p["page_nth"] - 1) & (p["n"] > 0)
        rank = F.when(took, 2).otherwise(1)
        placed = p["has_tail"] & (p["n"] >= rank)
        give = lambda cond, tail, k: F.when(cond, F.array(F.struct(tail.alias("tail_nth"), p["page_nth"].alias("page_nth"), k.alias("rank")))).otherwise(F.array()).cast(target)
        out = F.concat(acc["out"], give(took, acc["held"], F.lit(1)), give(placed, p["page_nth"], rank))
        return F.struct(F.when(p["has_tail"] & ~placed, p["page_nth"]).otherwise(F.lit(-1)).alias("held"), out.alias("out"))

    start = F.struct(F.lit(-1).alias("held"), F.array().cast(target).alias("out"))
    return pages.select("doc", "section", F.inline(F.aggregate("pages", start, step, lambda a: a["out"])))


def rows(items: DataFrame) -> DataFrame:
    """doc, town, year, page, date_text, date, hours, overnight, phone, name, address and reasons of every row.

    Rows with an empty list of reasons are duties. Reasons: date, weekday, hours, phone, flag (missing, not whole, more than
    one, or a weekday that isn't the date's), name (a named row without one), orphan (a flag or hours above the first date
    of a page that continue no row; date_text is the cell). Rows of a section in which OVERNIGHT is printed have neither
    phone nor hours but a name. A row printed as one line of text has no name and address. Null text is no item."""
    cells = owned(sections(spread(items, "doc", rows=100_000)))
    whole = Window.partitionBy("doc", "page", "section")
    last = F.max(F.when(F.col("kind") == "date", F.struct(-F.col("y"), "position"))).over(whole)
    cells = with_parts(cells).withColumn("is_last", F.col("is_last_section") & ~F.col("named") & F.coalesce(F.struct(-F.col("start.y"), F.col("start.position")) == last, F.lit(False)))
    own = F.col("start").isNotNull() & ~F.col("goes_on")
    stray = F.max(F.when(own & F.col("is_last") & (F.size("flags") > 0) & (F.col("y") < F.col("start.y") - BELOW), F.col("y"))).over(whole)
    cells = cells.withColumn("_stray", stray).withColumn("is_tail", F.coalesce(own & F.col("is_last") & (F.col("kind") == "cell") & (F.col("y") <= F.col("_stray") + ABOVE), F.lit(False))).drop("_stray")
    cells = spread(settled(cells, "cells"), "doc", rows=100_000)  # pages are read once
    found, cells = cells.where("kind = 'line'"), cells.where("kind <> 'line'")
    # rows of a page, those without a flag numbered; then each tail goes to the row it completes
    drafts = cells.where(own).groupBy("doc", "section", "page_nth", F.col("start.position").alias("at")).agg(
        F.first("start").alias("start"), F.max("is_last").alias("is_last"), F.max("is_tail").alias("has_tail"),
        ((F.sum(F.when(~F.col("is_tail"), F.size("flags")).otherwise(0)) == 0) & ~F.first("named")).alias("flagless"),
    )
    down = Window.partitionBy("doc", "section", "page_nth").orderBy((~F.col("flagless")), F.desc("start.y"), "at")
    flagless = drafts.withColumn("rank", F.row_number().over(down)).where("flagless").select("doc", "section", "page_nth", "rank", F.col("start").alias("_to"), F.col("is_last").alias("_to_last"))
    targets = tail_targets(drafts).join(flagless, ["doc", "section", "page_nth", "rank"]).select("doc", "section", F.col("tail_nth").alias("page_nth"), "_to", "_to_last")
    moved = cells.where("is_tail").join(targets, ["doc", "section", "page_nth"]).withColumns({"start": F.col("_to"), "is_last": F.col("_to_last"), "turn": F.lit(1)}).drop("_to", "_to_last")
    stay = cells.where("NOT is_tail AND start IS NOT NULL").withColumn("turn", F.when(F.col("goes_on"), 2).otherwise(0))
    stay = stay.withColumn("y", F.col("y") - F.when(F.col("goes_on"), NEXT_PAGE).otherwise(0.0))
    every = stay.unionByName(moved)
    # one row a start
    sorted_cells = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct((-F.col("y")).alias("d"), "x", "turn", "position", F.col(c).alias("text")))))
    texts = lambda c: F.transform(c, lambda i: i["text"])
    plain = F.when(F.col("named") & (F.col("kind") == "cell") & ~F.col("goes_on") & ~F.col("text").isin(HOLIDAY, OVERNIGHT) & (match_key(F.col("text")) != match_key(F.col("town"))), F.col("text"))
    made = every.withColumn("plain", plain).groupBy("doc", "section", F.col("start.page").alias("page"), F.col("start.position").alias("at")).agg(
        F.first("start").alias("start"), F.first("town").alias("town"), F.first("year").alias("year"), F.max(F.col("is_last") & ~F.col("goes_on")).alias("held"),
        F.flatten(F.collect_list("phones")).alias("phones"), F.flatten(F.collect_list("flags")).alias("flags"),
        F.min_by("weekday", F.when(F.col("weekday").isNotNull(), F.struct("turn", "position", "part"))).alias("weekday"),
        F.array_join(texts(sorted_cells("hours")), "").alias("hours_text"), sorted_cells("words").alias("words"), join_lines(texts(sorted_cells("plain"))).alias("plain"),
    )
    day, printed = date_parts(F.col("start.text"))
    is_named = F.col("start.named")
    made = made.withColumns({"date": day, "hours": F.when(~is_named, whole_hours(F.col("hours_text"))), "weekday": F.when(printed != "", printed).when(~is_named, F.col("weekday"))})
    # the name and the address: the first line's outer parts, else the page's usual places
    line = F.filter("words", lambda w: F.abs(-w["d"] - F.col("start.y")) <= ABOVE)
    both = F.size("_line") >= 2
    made = made.withColumn("_line", line).withColumns({"_n": F.when(both, F.get("_line", F.lit(0))["x"]), "_a": F.when(both, F.element_at("_line", -1)["x"])})
    page = Window.partitionBy("doc", "section", "page")
    usual = lambda c: upper_median(F.collect_list(c).over(page))
    made = made.withColumns({"_un": F.when(F.size(F.collect_list("_n").over(page)) > 0, usual("_n")), "_ua": F.when(F.size(F.collect_list("_a").over(page)) > 0, usual("_a"))})
    for own_x, usual_x in (("_n", "_un"), ("_a", "_ua")):
        made = made.withColumn(own_x, F.coalesce(own_x, F.when(~F.col("held"), F.col(usual_x))))
    to_name = lambda w: F.coalesce(F.abs(w["x"] - F.col("_n")) <= F.abs(w["x"] - F.col("_a")), F.lit(True))
    side = lambda keep: clean_display(join_lines(texts(F.filter("words", keep))))
    name = F.when(is_named, clean_display(F.col("plain"))).otherwise(side(to_name))
    made = made.withColumns({"name": name, "address": F.when(~is_named, side(lambda w: ~to_name(w)))})
    phone, flag = F.get("phones", F.lit(0)), F.get("flags", F.lit(0))
    wrong = {
        "date": F.col("date").isNull(),
        "weekday": F.col("date").isNotNull() & ~F.coalesce(weekday_number(F.col("weekday")) == iso_weekday(F.col("date")), F.lit(False)),
        "hours": ~is_named & F.col("hours").isNull(),
        "phone": ~is_named & (F.size("phones") != 1),
        "flag": ~is_named & (F.size("flags") != 1),
        "name": is_named & (F.coalesce(F.col("name"), F.lit("")) == ""),
    }
    reasons = lambda w: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in w.items()])).alias("reasons")
    made = made.select("doc", "town", "year", "page", F.col("start.text").alias("date_text"), "date", "hours", F.when(is_named, F.lit(True)).when(F.size("flags") == 1, flag == YES).alias("overnight"), F.when(~is_named & (F.size("phones") == 1), phone).alias("phone"), "name", "address", reasons(wrong))
    # rows printed as one line
    read = [F.regexp_extract("text", ONE_LINE, k) for k in range(7)]
    lines = found.withColumns({"date": date_parts(read[1])[0], "hours": whole_hours(read[2])})
    bad = {"date": F.col("date").isNull(), "weekday": F.col("date").isNotNull() & ~F.coalesce(weekday_number(read[6]) == iso_weekday(F.col("date")), F.lit(False)), "hours": F.col("hours").isNull()}
    none = F.lit(None).cast("string")
    lines = lines.select("doc", "town", "year", "page", read[1].alias("date_text"), "date", "hours", (read[5] == YES).alias("overnight"), read[4].alias("phone"), none.alias("name"), none.alias("address"), reasons(bad))
    lost = cells.where(F.col("start").isNull() & (is_flag(F.col("text")) | F.col("text").rlike(r"\d:\d")))
    lost = lost.select("doc", "town", "year", "page", F.col("text").alias("date_text"), F.lit(None).cast("date").alias("date"), none.alias("hours"), F.lit(None).cast("boolean").alias("overnight"), none.alias("phone"), none.alias("name"), none.alias("address"), F.array(F.lit("orphan")).alias("reasons"))
    return made.unionByName(lines).unionByName(lost)
