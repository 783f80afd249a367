"""Queries of the spatial, text, resolution, capture, search and quality operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from orarium.functions import text
from orarium.functions.geo import haversine, in_box
from orarium.operators import capture, quality, resolve, search, spatial
from orarium.plans.registry import register
from orarium.sources import html
from orarium.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = register(QUERIES, ORACLE_SQL)


def point(key: Column) -> tuple[Column, Column]:
    """A place in Greece from a key: integer arithmetic only, the same in both engines."""
    return (F.lit(3500) + key * 37 % 650) / 100.0, (F.lit(2000) + key * 91 % 800) / 100.0


def placed(df, key: str):
    lat, lon = point(F.col(key))
    return df.withColumns({"lat": lat, "lon": lon})


LAT, LON = "(3500 + {k} * 37 % 650) / 100.0::DOUBLE", "(2000 + {k} * 91 % 800) / 100.0::DOUBLE"


def metres(a: str, b: str) -> str:
    return f"round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))::BIGINT"


def points_sql(name: str, table_: str, key: str, extra: str = "") -> str:
    return f"{name} AS (SELECT {key} AS id, {LAT.format(k=key)} AS lat, {LON.format(k=key)} AS lon{extra} FROM {table_})"


SUPPLIERS, NATIONS, CUSTOMERS = points_sql("s", "supplier", "s_suppkey", ", s_nationkey"), points_sql("n", "nation", "n_nationkey"), points_sql("c", "customer", "c_custkey", ", c_nationkey, c_mktsegment")


def whole(c: Column) -> Column:
    return F.round(c).cast("long")


@query(f"WITH {SUPPLIERS}, {NATIONS} SELECT s.id AS s_suppkey, n.id AS n_nationkey, {metres('s', 'n')} AS metres FROM s JOIN n ON s.s_nationkey = n.id")
def haversine_pairs(spark, d):
    s, n = placed(table(spark, d, "supplier"), "s_suppkey"), placed(table(spark, d, "nation"), "n_nationkey")
    n = n.select("n_nationkey", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    both = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    return both.select("s_suppkey", "n_nationkey", whole(haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))).alias("metres"))


@query(f"""WITH {SUPPLIERS}, r AS (SELECT a.id AS s_suppkey, b.id AS neighbour, {metres('a', 'b')} AS metres FROM s a JOIN s b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY metres, neighbour)::INT AS nth FROM r) SELECT * FROM k WHERE nth <= 3""")
def knn_suppliers(spark, d):
    s = placed(table(spark, d, "supplier"), "s_suppkey")
    return spatial.knn(s, s, 3, "s_suppkey", "neighbour", metres=whole)


@query(f"""WITH {CUSTOMERS}, {NATIONS}, r AS (SELECT c.id AS c_custkey, n.id AS n_nationkey, {metres('c', 'n')} AS metres, row_number() OVER (PARTITION BY c.id ORDER BY {metres('c', 'n')}, n.id) AS nth FROM c CROSS JOIN n WHERE c.id % 9 <> 0 AND n.id % 6 <> 0)
SELECT c_custkey, n_nationkey, metres FROM r WHERE nth = 1""")
def nearest_group(spark, d):
    """Every ninth customer and every sixth nation has no place (the nation half of one)."""
    c, n = placed(table(spark, d, "customer"), "c_custkey"), placed(table(spark, d, "nation"), "n_nationkey")
    c = c.withColumns({x: F.when(F.col("c_custkey") % 9 != 0, F.col(x)) for x in ("lat", "lon")})
    n = n.withColumn("lon", F.when(F.col("n_nationkey") % 6 != 0, F.col("lon")))
    return spatial.nearest(c.select("c_custkey", "lat", "lon"), n, "c_custkey", "n_nationkey", whole)


BOXES = "(VALUES (1, 'north', 21.0, 39.0, 26.0, 41.5), (2, 'middle', 20.5, 37.5, 25.0, 40.0), (3, 'town', 22.5, 39.5, 23.5, 41.0), (4, 'south', 20.0, 35.0, 28.0, 37.5))"


@query(f"""WITH {CUSTOMERS}, b AS (SELECT * FROM {BOXES} t(seq, area, west, south, east, north)),
r AS (SELECT c.id AS c_custkey, area, row_number() OVER (PARTITION BY c.id ORDER BY (east - west) * (north - south), seq) AS n FROM c LEFT JOIN b ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
SELECT c_custkey, area FROM r WHERE n = 1""")
def region_assign(spark, d):
    c = placed(table(spark, d, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    boxes = spark.sql(f"SELECT seq, area, double(west) AS west, double(south) AS south, double(east) AS east, double(north) AS north FROM {BOXES} AS b(seq, area, west, south, east, north)")
    return spatial.smallest_box(c, boxes, "c_custkey", "area", "seq")


@query(f"""WITH {CUSTOMERS} SELECT (lat BETWEEN 34.5 AND 41.8 AND lon BETWEEN 19.3 AND 26.0) AS inside, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def box_filter(spark, d):
    c = placed(table(spark, d, "customer"), "c_custkey")
    return c.groupBy(in_box(F.col("lat"), F.col("lon"), 19.3, 34.5, 26.0, 41.8).alias("inside")).agg(F.count("*").alias("n"))


@query(f"WITH {CUSTOMERS} SELECT id AS c_custkey, round(lat, 1) AS lat, round(lon, 1) AS lon FROM c WHERE lat BETWEEN 37.0 AND 38.5 AND lon BETWEEN 22.0 AND 24.25 AND c_mktsegment = 'BUILDING'")
def places_in_box(spark, d):
    """Customers written along a space-filling curve, and those of a box and a segment read back."""
    from orarium.operators.ranges import scratch
    from orarium.sources import sinks, tables

    path = scratch(spark, "places")
    sinks.write_places(placed(table(spark, d, "customer"), "c_custkey"), path)
    found = tables.places_in_box(spark, path, 22.0, 37.0, 24.25, 38.5, 1, where=F.col("c_mktsegment") == "BUILDING")
    return found.select("c_custkey", "lat", "lon")


@query(f"""WITH {CUSTOMERS}, p AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE lat END AS la, CASE WHEN id % 5 = 0 THEN NULL ELSE lon END AS lo, id % 3 = 0 AND c_nationkey % 4 <> 0 AS exact FROM c)
SELECT c_nationkey, count(*)::BIGINT AS n, round(coalesce(avg(la) FILTER (WHERE exact), avg(la)), 6) AS lat, round(coalesce(avg(lo) FILTER (WHERE exact), avg(lo)), 6) AS lon FROM p GROUP BY c_nationkey HAVING count(la) > 0""")
def locality_centroid(spark, d):
    c = placed(table(spark, d, "customer"), "c_custkey")
    c = c.withColumns({x: F.when(F.col("c_custkey") % 5 != 0, F.col(x)) for x in ("lat", "lon")})
    found = spatial.centroids(c, "c_nationkey", (F.col("c_custkey") % 3 == 0) & (F.col("c_nationkey") % 4 != 0))
    return found.withColumns({x: F.round(x, 6) for x in ("lat", "lon")})


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM g)
SELECT c_nationkey, c_mktsegment, n FROM r WHERE k = 1""")
def dominant_group(spark, d):
    return spatial.dominant(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


# --- text ---


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(translate(upper(p_name), 'ABEZHIKMNOPTYX', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ'), ' '), lambda x: len(x) > 2))), ' ') AS tokens FROM part""")
def name_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.name_tokens(F.col("p_name"))), " ").alias("tokens"))


@query(r"""SELECT doc_id, trim(regexp_replace(translate(upper(replace(strip_accents(line), 'ß', 'ss')), 'ABEZHIKMNOPTYX', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents)""")
def match_key(spark, d):
    """The key of each whole text."""
    return table(spark, d, "documents").select("doc_id", text.match_key(F.col("text")).alias("key"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM l)
SELECT doc_id, line_no::INT AS line_no, trim(regexp_replace(translate(upper(replace(strip_accents(line), 'ß', 'ss')), 'ABEZHIKMNOPTYX', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
FROM (SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM x)""")
def match_key_lines(spark, d):
    """match_key of every line of each text, with the line's position."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", text.match_key(F.col("line")).alias("key"))


SOUND = "p_name"
for _pattern, _to in (("au|ay", "av"), ("eu|ey", "ev"), ("ai", "e"), ("ei|oi|ui|yi", "i"), ("ou|oy", "o"), ("ph", "f"), ("ch|kh", "h"), ("th", "t"), ("dh", "d"), ("gh", "g"), ("mp|mb", "b"), ("nt", "d"), ("gk", "g"), ("gg", "ng"), ("x", "ks"), ("ks", "h"), ("[cq]", "k"), ("[jy]", "i"), ("w", "o"), ("u", "o"), ("[bf]", "v"), ("e", "i"), ("[^a-z0-9]", "")):
    SOUND = f"regexp_replace({SOUND}, '{_pattern}', '{_to}', 'g')"
SQUEEZE = "array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 OR c <> string_split({x}, '')[i - 1]), '')"


@query(f"WITH k AS (SELECT p_name, {SOUND} AS k FROM (SELECT DISTINCT p_name FROM part)) SELECT p_name, {SQUEEZE.format(x='k')} AS key FROM k")
def sound_key(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.place_sound(F.col("p_name")).alias("key"))


@query("""WITH b AS (SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM (SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT replace(n_name, '_', ' ') FROM nation)),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) AS n FROM b)
SELECT name, CASE WHEN n = 1 THEN base ELSE base || '-' || (n + (SELECT count(*) FROM (SELECT DISTINCT base FROM b) o WHERE o.base = r.base || '-' || n)) END AS slug FROM r""")
def slugify_unique(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    names = n.unionByName(n.select(F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")))
    return text.assign_slugs(names, ascii_only=True)


@query(r"""WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+30 2310 ' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN '0030210' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') WHEN 2 THEN '69' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') ELSE '1' || c_custkey END AS raw FROM customer),
n AS (SELECT c_custkey, regexp_replace(raw, '\D', '', 'g') AS g FROM p), m AS (SELECT c_custkey, CASE WHEN g LIKE '0030%' THEN g[5:] WHEN g LIKE '30%' AND len(g) = 12 THEN g[3:] ELSE g END AS g FROM n)
SELECT c_custkey, CASE WHEN regexp_full_match(g, '[26]\d{9}') THEN g END AS phone FROM m""")
def phone_normalize(spark, d):
    k = F.col("c_custkey")
    pad = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("+30 2310 "), pad(6))).when(k % 4 == 1, F.concat(F.lit("0030210"), pad(7))).when(k % 4 == 2, F.concat(F.lit("69"), pad(8))).otherwise(F.concat(F.lit("1"), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.normalize_phone(raw).alias("phone"))


@query("""SELECT p_partkey, 'x-' || substr(sha256(array_to_string(list_sort(list_distinct(list_filter(string_split(translate(upper(p_name), 'ABEZHIKMNOPTYX', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ'), ' '), lambda x: len(x) > 2))), ' ') || '|' || trim(regexp_replace(translate(upper(p_brand), 'ABEZHIKMNOPTYX', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ'), '[^A-ZΑ-Ω0-9]+', ' ', 'g'))), 1, 10) AS id FROM part""")
def hash_id(spark, d):
    return table(spark, d, "part").select("p_partkey", text.entity_id(F.lit(None).cast("string"), F.col("p_name"), F.col("p_brand")).alias("id"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1], '') AS first_link, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs FROM pages""")
def html_cards(spark, d):
    return html.page_cards(table(spark, d, "pages"))


@query("""SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k INT").k.alias("k"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages) SELECT page_id, nullif(regexp_extract('&' || q, '&utm_source=([^&]*)', 1), '') AS utm_source FROM u""")
def url_parameters(spark, d):
    return table(spark, d, "pages").select("page_id", text.query_parameter(F.col("url"), "utm_source").alias("utm_source"))


# --- resolution ---


def part_tokens(spark, d):
    name = F.coalesce(F.split("p_name", " "), F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.array_compact(F.array_distinct(F.concat(name, F.array("p_brand", "p_type")))).alias("tokens"))


PARTS = "t AS (SELECT p_partkey AS k, list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS tokens FROM part)"


@query(f"""WITH {PARTS}, x AS (SELECT k, len(tokens) AS n, unnest(tokens) AS tok FROM t), c AS (SELECT a.k AS left_key, b.k AS right_key, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS c FROM x a JOIN x b ON a.tok = b.tok AND a.k < b.k GROUP BY 1, 2)
SELECT left_key, right_key, c::DOUBLE / u AS score FROM c WHERE c::DOUBLE / u >= 0.8""")
def jaccard_parts(spark, d):
    """All pairs of parts whose tokens are alike by 0.8 or more, copies among them."""
    return resolve.similar_pairs(part_tokens(spark, d), "p_partkey", "left_key", "right_key", 0.8)


@query(f"""WITH {PARTS}, x AS (SELECT k, len(tokens) AS n, unnest(tokens) AS tok FROM t), c AS (SELECT a.k, b.k AS other, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS c FROM x a JOIN x b ON a.tok = b.tok AND a.k <> b.k GROUP BY 1, 2),
m AS (SELECT k, count(*) AS n FROM c WHERE c::DOUBLE / u >= 0.8 GROUP BY k)
SELECT k AS p_partkey, min(k) OVER (PARTITION BY list_sort(tokens)) AS class_key, coalesce(n, 0)::BIGINT AS n_similar FROM t LEFT JOIN m USING (k)""")
def part_classes(spark, d):
    """Each part with the smallest one of equal tokens, and how many others are alike by 0.8 or more."""
    return resolve.similar_within(part_tokens(spark, d), "p_partkey", 0.8)


@query("""WITH t AS (SELECT p_partkey AS k, p_brand, p_size, list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS tokens FROM part),
s AS (SELECT a.k AS p_partkey, b.k AS best, len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) AS sim, a.p_size = b.p_size AS same_size, a.k % 10 = b.k % 10 AS near FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.k <> b.k),
m AS (SELECT p_partkey, best, CASE WHEN same_size THEN 1 + sim WHEN sim >= 0.8 THEN sim END + CASE WHEN near THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, best) AS n FROM m WHERE score IS NOT NULL)
SELECT p_partkey, best, round(score, 6) AS score FROM r WHERE n = 1""")
def fuzzy_best_match(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") % 10).alias("near"), F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))).alias("tokens"))
    found = resolve.closest(part, "p_partkey", "p_brand", "p_size", "near", "tokens")
    return found.select("p_partkey", "best", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_brand, p_partkey // 400 AS street, list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type])) AS tokens FROM part),
s AS (SELECT a.p_brand, a.k AS entry, b.k AS match, a.street = b.street AS strong, len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) AS sim FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.k % 2 = 1 AND b.k % 2 = 0),
m AS (SELECT *, CASE WHEN strong THEN 1 + sim WHEN sim >= 0.8 THEN sim END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY score DESC, match) AS choice FROM m WHERE score IS NOT NULL),
o AS (SELECT p_brand, entry, max(score) AS best, list(match ORDER BY choice) FILTER (WHERE strong OR choice = 1) AS options FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY best DESC, entry) AS turn FROM o),
walk AS (SELECT p_brand, 0::BIGINT AS turn, NULL::BIGINT AS entry, NULL::BIGINT AS match, []::BIGINT[] AS taken FROM (SELECT DISTINCT p_brand FROM q)
  UNION ALL SELECT q.p_brand, q.turn, q.entry, list_filter(q.options, lambda x: NOT list_contains(w.taken, x))[1], list_concat(w.taken, list_filter(q.options, lambda x: NOT list_contains(w.taken, x))[1:1]) FROM walk w JOIN q ON q.p_brand = w.p_brand AND q.turn = w.turn + 1)
SELECT p_brand, entry, match FROM walk WHERE turn > 0""")
def greedy_assignment(spark, d):
    """Odd parts of a brand matched one to one with its even parts; parts of one street (400 numbers) are strong matches."""
    part = table(spark, d, "part")
    t = part.select("p_partkey", F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))).alias("tokens"), "p_brand", F.floor(F.col("p_partkey") / 400).alias("street"))
    odd = t.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "entry")
    even = t.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "match")
    # a street's numbers are bounded; beyond it only the most similar name can be chosen
    strong = odd.select("entry", "p_brand", "street").join(even.select("match", "p_brand", "street").hint("merge"), ["p_brand", "street"]).select("entry", "match")
    alike = resolve.most_alike(odd, even.withColumn("position", F.col("match")), "entry", "match", resolve.NAME_ONLY, by=["p_brand"]).select("entry", "match")
    mate = even.select("match", F.col("p_brand").alias("_brand"), F.col("street").alias("_street"), F.col("tokens").alias("_tokens"))
    pairs = strong.union(alike).distinct().join(odd.hint("merge"), "entry").join(mate.hint("merge"), "match").where("p_brand = _brand").withColumn("strong", F.col("street") == F.col("_street"))
    score = resolve.match_score(text.jaccard(F.col("tokens"), F.col("_tokens")), F.col("strong"), F.lit(True), F.lit(False))
    scored = pairs.select("p_brand", "entry", F.col("entry").alias("position"), "match", F.col("match").alias("other_position"), score.alias("score"), "strong")
    return resolve.greedy_assignment(scored, "p_brand", "entry", "match")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT lower(c_mktsegment) || 's' FROM customer)
SELECT a.w AS left_word, b.w AS right_word FROM w a JOIN w b ON a.w < b.w AND len(a.w) >= 6 AND len(b.w) >= 6 AND levenshtein(a.w, b.w) <= 1""")
def near_words(spark, d):
    seg = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("w")).distinct()
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().union(seg).union(seg.select(F.concat("w", F.lit("s")))).distinct()
    # words one edit apart share a form with one letter taken out
    cut = lambda n: w.select(F.col("w").alias(n), F.explode(F.array_distinct(F.concat(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.left("w", i - 1), F.substr("w", i + 1)))))).alias("form"))
    pairs = cut("left_word").join(cut("right_word"), "form").where("left_word < right_word").select("left_word", "right_word").distinct()
    return pairs.where(text.near_word(F.col("left_word"), F.col("right_word")))


# --- capture ---


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM v WHERE n = 1""")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("version"), "o_orderkey", "o_orderstatus")
    stored, fetched = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    return capture.upsert_latest(stored, fetched, ["o_custkey"], "version", ["o_orderkey", "o_orderstatus"]).select("o_custkey", "o_orderkey", "o_orderstatus")


#: Lines of one number in an order are told apart by all that the fold reads of them.
VERSIONS = "f AS (SELECT l_partkey, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag, l_quantity, l_linestatus) AS seq, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS flag, CASE WHEN l_quantity > 10 THEN l_quantity END AS qty, l_linestatus FROM lineitem)"


def versions(spark, d):
    seq = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_linestatus")
    return table(spark, d, "lineitem").select("l_partkey", seq.alias("seq"), "l_extendedprice", F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("qty"), "l_linestatus")


@query(f"WITH {VERSIONS} SELECT l_partkey, arg_max(l_extendedprice, seq) AS price, arg_max(flag, seq) FILTER (WHERE flag <> '') AS flag, arg_max(qty, seq) FILTER (WHERE qty IS NOT NULL) AS qty FROM f GROUP BY l_partkey")
def fold_non_blank(spark, d):
    return capture.fold(versions(spark, d), "l_partkey", "seq", ["l_extendedprice"], ["flag", "qty"]).withColumnRenamed("l_extendedprice", "price")


@query(f"WITH {VERSIONS}, b AS (SELECT *, lag(l_linestatus) OVER (PARTITION BY l_partkey ORDER BY seq) AS before FROM f) SELECT l_partkey, count(*)::BIGINT AS n_changes FROM b WHERE before <> l_linestatus GROUP BY l_partkey")
def kind_changes(spark, d):
    return capture.changes(versions(spark, d), "l_partkey", "seq", "l_linestatus").groupBy("l_partkey").agg(F.count("*").alias("n_changes"))


# four batches of orders, folded in turn: a later version replaces what is stored unless its content is the same
BATCHES = ", ".join(f"b{k} AS (SELECT o_custkey AS c, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, max((o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderkey % 4 = {k} GROUP BY 1)" for k in range(4))
FOLDED = ", ".join(f"s{k + 1} AS (SELECT coalesce(a.c, b.c) AS c, CASE WHEN b.c IS NULL OR a.c IS NOT NULL AND (b.v < a.v OR b.s = a.s) THEN a.s ELSE b.s END AS s, CASE WHEN b.c IS NULL OR a.c IS NOT NULL AND (b.v < a.v OR b.s = a.s) THEN a.v ELSE b.v END AS v FROM s{k} a FULL JOIN b{k + 1} b ON a.c = b.c)" for k in range(3))


@query(f"WITH {BATCHES}, s0 AS (SELECT * FROM b0), {FOLDED} SELECT c AS o_custkey, s AS o_orderstatus, v[2] AS o_orderkey FROM s3")
def bucketed_upsert(spark, d):
    """Orders come in four batches, the third one twice, and are read from the buckets that they touched."""
    from orarium.operators.ranges import scratch
    from orarium.streaming.buckets import BucketTable

    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("version"), "o_orderstatus", "o_orderkey")
    stored = BucketTable(spark, scratch(spark, "buckets"), ["o_custkey"], "version", ["o_orderstatus"], buckets=8, most_deltas=3)
    for batch in (0, 1, 2, 2, 3):
        stored.write(o.where(F.col("o_orderkey") % 4 == batch), batch)
    return stored.read().select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS sources,
arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 100000) AS last_large, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 100000) AS first_large FROM orders GROUP BY o_custkey""")
def registry_build(spark, d):
    o = table(spark, d, "orders").withColumn("large", F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice"))).withColumn("large_", F.col("large"))
    r = capture.build_registry(o, "o_custkey", "o_orderkey", "o_orderdate", ["o_orderstatus"], ["large"], ["large_"], "o_orderpriority")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return r.select("o_custkey", day("first_seen"), day("last_seen"), F.array_join("sources", ",").alias("sources"), F.col("o_orderstatus").alias("status"), F.col("large").alias("last_large"), F.col("large_").alias("first_large"))


CODES = "codes AS (SELECT p_brand, (row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1)::INT AS code FROM part GROUP BY p_brand)"


@query(f"WITH {CODES} SELECT p_partkey, code AS brand_code FROM part JOIN codes USING (p_brand)")
def dictionary_encode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return capture.encode(p, "p_brand", capture.dictionary(p, "p_brand", "p_partkey"), "brand_code")


@query("SELECT p_partkey, p_brand FROM part")
def dictionary_decode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    codes = capture.dictionary(p, "p_brand", "p_partkey")
    return capture.decode(capture.encode(p, "p_brand", codes, "brand_code"), "brand_code", codes, "p_brand")


@query("SELECT p_partkey, ((p_size > 25)::INT * 1) | ((p_type = 'PROMO')::INT * 2) AS flags FROM part")
def flag_pack(spark, d):
    return table(spark, d, "part").select("p_partkey", capture.flags(F.col("p_size") > 25, F.col("p_type") == "PROMO").alias("flags"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def anti_missing(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_known(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_suppkey % 3 = 0")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000 AND s_suppkey % 3 = 0").select("s_nationkey"))


def snapshots(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    at = lambda day: o.where(F.col("o_orderdate") < F.lit(day).cast("timestamp")).groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return at("1996-01-01"), at("1996-07-01")


SNAPSHOTS = "a AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_orderdate < DATE '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_orderdate < DATE '1996-07-01' GROUP BY 1), diff AS (SELECT o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'add' WHEN b.o_custkey IS NULL THEN 'remove' WHEN a.status <> b.status THEN 'update' END AS change FROM a FULL JOIN b USING (o_custkey))"


@query(f"WITH {SNAPSHOTS} SELECT * FROM diff WHERE change IS NOT NULL")
def keyed_diff(spark, d):
    before, after = snapshots(spark, d)
    return capture.keyed_diff(before, after, "o_custkey", ["status"])


@query(f"""WITH {SNAPSHOTS}, n AS (SELECT (SELECT count(*) FROM a)::BIGINT AS n_before, (SELECT count(*) FROM b)::BIGINT AS n_after, count(*) FILTER (WHERE change = 'add')::BIGINT AS n_add, count(*) FILTER (WHERE change = 'remove')::BIGINT AS n_remove, count(*) FILTER (WHERE change = 'update')::BIGINT AS n_update FROM diff)
SELECT *, CASE WHEN n_add + n_remove + n_update = 0 THEN 'none' WHEN n_before = 0 OR n_after = 0 OR 2 * (n_add + n_remove + n_update) > greatest(n_before, n_after) THEN 'replace' ELSE 'diff' END AS mode FROM n""")
def diff_mode(spark, d):
    before, after = snapshots(spark, d)
    return capture.diff_summary(before, after, capture.keyed_diff(before, after, "o_custkey", ["status"]))


@query("""SELECT user_id, floor((1706659200000000 - epoch_us(max(ts))) / 3600000000)::BIGINT AS age_hours FROM events GROUP BY user_id HAVING (1706659200000000 - epoch_us(max(ts))) / 3600000000 > 36""")
def stale_users(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("checked"))
    return capture.stale(last, "user_id", "checked", F.timestamp_micros(F.lit(1_706_659_200_000_000))).select("user_id", "age_hours")


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT (l_suppkey % 4)::VARCHAR, ',' ORDER BY (l_suppkey % 4)::VARCHAR) AS members, min(l_shipdate)::DATE AS date FROM lineitem GROUP BY l_orderkey),
g AS (SELECT DISTINCT members, date FROM s), l AS (SELECT members, date - lag(date) OVER (PARTITION BY members ORDER BY date) AS gap FROM g)
SELECT members, count(*)::BIGINT AS n_dates, max(gap)::INT AS longest_gap FROM l GROUP BY members""")
def rotation_gaps(spark, d):
    li = table(spark, d, "lineitem")
    dated = li.withColumn("date", F.min(F.to_date("l_shipdate")).over(Window.partitionBy("l_orderkey"))).withColumn("member", (F.col("l_suppkey") % 4).cast("string"))
    sets = capture.rotation(dated, ["l_orderkey"], "member", "date").select("members", "date").distinct()
    again = sets.withColumn("gap", F.date_diff("date", F.lag("date").over(Window.partitionBy("members").orderBy("date"))))
    return again.groupBy("members").agg(F.count("*").alias("n_dates"), F.max("gap").alias("longest_gap"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id)::BIGINT AS n_users, count(*)::BIGINT AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, bool_or(value IS NULL OR value > 50) AS flagged FROM events GROUP BY 1""")
def daily_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_events"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.bool_or(F.col("value").isNull() | (F.col("value") > 50)).alias("flagged"))


@query("""WITH p AS (SELECT user_id, isodow(ts)::INT AS wd, min(hour(ts)) || '-' || max(hour(ts)) AS pattern FROM events GROUP BY 1, 2)
SELECT user_id, pattern, array_to_string(list_sort(list(wd)), ',') AS days FROM p GROUP BY 1, 2""")
def weekday_hours_group(spark, d):
    days = table(spark, d, "events").groupBy("user_id", (F.weekday("ts") + 1).alias("wd")).agg(F.concat_ws("-", F.min(F.hour("ts")), F.max(F.hour("ts"))).alias("pattern"))
    return capture.group_equal_days(days, "user_id", "wd", "pattern")


# --- search ---


@query("""WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS n, lower(p_type) AS t FROM part),
s AS (SELECT *, CASE WHEN list_bool_and([starts_with(n[1], 'bo') OR starts_with(n[2], 'bo')]) THEN CASE WHEN starts_with(n[1], 'bo') THEN 0 ELSE 1 END WHEN starts_with(t, 'bo') THEN 2 END AS score FROM w)
SELECT p_partkey, score FROM s WHERE score IS NOT NULL""")
def ranked_search(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("name_words"), F.array(F.lower("p_type")).alias("substance_words"), F.col("p_partkey").cast("string").alias("code"))
    return search.ranked_search(p, "bo", "p_name", "code", ["bo"]).select("p_partkey", "score")


ASKED = """q AS (SELECT p_partkey AS query_id, [lower(p_type)] AS t, string_split(p_name, ' ') AS n, p_partkey % 5 AS kind FROM part),
asked AS (SELECT query_id, CASE kind WHEN 0 THEN [n[1][:2]] WHEN 1 THEN [n[1][:3], n[2][:2]] WHEN 2 THEN [t[1] || 's'] WHEN 3 THEN [n[2], t[1][:3]] ELSE [t[1][:-2] || 'ie'] END AS w FROM q)"""
HIT = "(starts_with({w}, {q}) OR len({w}) >= 7 AND (starts_with({q}, {w}) AND len({q}) - len({w}) <= 2 OR NOT starts_with({q}, {w}) AND starts_with({q}, {w}[:-2]) AND len({q}) - len({w}) + 1 <= 2))"


@query(f"""WITH {ASKED}, lists AS (SELECT DISTINCT w FROM asked), names AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS n, lower(p_type) AS t, p_type FROM part),
s AS (SELECT w, p_name, p_type, CASE WHEN len(list_filter(w, lambda q: len(list_filter(n, lambda x: {HIT.format(w='x', q='q')})) > 0)) = len(w) THEN CASE WHEN {HIT.format(w='n[1]', q='w[1]')} THEN 0 ELSE 1 END
  WHEN len(list_filter(w, lambda q: len(list_filter(list_append(n, t), lambda x: {HIT.format(w='x', q='q')})) > 0)) = len(w) THEN 2 END AS score FROM lists CROSS JOIN names),
r AS (SELECT w, p_partkey, score, row_number() OVER (PARTITION BY w ORDER BY score, p_name, p_partkey)::INT AS nth FROM s JOIN part USING (p_name, p_type) WHERE score IS NOT NULL)
SELECT query_id, p_partkey, score, nth FROM asked JOIN r USING (w) WHERE nth <= 3""")
def search_many(spark, d):
    """Three parts for each of as many queries as there are parts: whole and cut words, and words with other endings."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("name_words"), F.array(F.lower("p_type")).alias("substance_words"))
    k, n, t = F.col("p_partkey"), F.col("name_words"), F.col("substance_words")[0]
    asked = F.when(k % 5 == 0, F.array(F.left(n[0], F.lit(2)))).when(k % 5 == 1, F.array(F.left(n[0], F.lit(3)), F.left(n[1], F.lit(2)))).when(k % 5 == 2, F.array(F.concat(t, F.lit("s")))).when(k % 5 == 3, F.array(n[1], F.left(t, F.lit(3)))).otherwise(F.array(F.concat(F.left(t, F.length(t) - 1), F.lit("ie"))))
    return search.search_many(p.select(k.alias("query_id"), asked.alias("query_words")), p, "p_partkey", ["p_name", "p_partkey"], 3)


@query("""SELECT n_name, starts_with(k, 'nation1') AS starts FROM (SELECT n_name, replace(lower(n_name), '_', '') AS k FROM nation) WHERE contains(k, 'nation1')""")
def prefix_search(spark, d):
    n = table(spark, d, "nation").withColumn("key", F.replace(F.lower("n_name"), F.lit("_"), F.lit("")))
    return search.prefix_search(n, "key", "nation1", "n_name").select("n_name", "starts")


@query(f"""WITH {SUPPLIERS}, r AS (SELECT id AS s_suppkey, CASE WHEN id % 6 <> 0 THEN round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 40.64) / 2), 2) + cos(radians(40.64)) * cos(radians(lat)) * pow(sin(radians(lon - 22.94) / 2), 2)))))::BIGINT END AS metres FROM s)
SELECT s_suppkey, metres, row_number() OVER (ORDER BY metres ASC NULLS LAST, s_suppkey)::INT AS rank FROM r ORDER BY rank LIMIT 20""")
def nearest_first_sort(spark, d):
    s = placed(table(spark, d, "supplier"), "s_suppkey")
    far = F.when(F.col("s_suppkey") % 6 != 0, whole(haversine(F.lit(40.64), F.lit(22.94), F.col("lat"), F.col("lon"))))
    top = s.select("s_suppkey", far.alias("metres")).orderBy(F.asc_nulls_last("metres"), "s_suppkey").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("metres"), "s_suppkey")))


# --- quality ---


@query("""WITH r AS (
SELECT 'error' AS severity, 'unknown-entity' AS code FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0))
UNION ALL SELECT 'warn', 'duplicate-extended' FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'error', 'count' FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n NOT BETWEEN 10 AND 20000
UNION ALL SELECT 'warn', 'unmatched' FROM (SELECT avg((c_acctbal < 0)::INT) AS s FROM customer) WHERE s > 0.05
UNION ALL SELECT 'warn', 'no-location' FROM supplier WHERE s_acctbal < 0)
SELECT severity, code, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def quality_report(spark, d):
    li, c = table(spark, d, "lineitem"), table(spark, d, "customer")
    known = c.where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    counts = li.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    limits = counts.select("l_returnflag", F.lit(10).alias("low"), F.lit(20000).alias("high"))
    found = quality.report(
        quality.unknown(table(spark, d, "orders"), known, "o_custkey"),
        quality.duplicates(li, ["l_orderkey", "l_linenumber"]),
        quality.out_of_range(counts, limits, ["l_returnflag"], "n"),
        quality.share(c, F.col("c_acctbal") < 0, 0.05, "unmatched"),
        quality.rule(table(spark, d, "supplier"), "warn", "no-location", F.col("s_acctbal") < 0, F.col("s_name")),
    )
    return quality.summary(found)
