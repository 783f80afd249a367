import io
import unicodedata
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orarium.functions import grammars, text
from orarium.operators import capture, medicines, quality, resolve, search, spatial, visits
from orarium.sources import html, sheets, sinks, tables
from orarium.streaming import streams


def values(spark, rows, *columns, schema="x string"):
    return [r[0] if len(r) == 1 else tuple(r) for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(*columns).collect()]


def test_accents_agree_with_unicode(spark):
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1F00, 0x2000)) if chr(c).isalpha()]
    got = values(spark, letters, text.strip_marks(F.col("x")))
    assert got == ["".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x in letters]


def test_keys(spark):
    x = F.col("x")
    assert values(spark, ["Ε. ΒΕΝΙΖΕΛΟΥ  99", "EPMOY", "Άγιος Αθανάσιος!", "Only Latin"], text.match_key(x)) == ["Ε ΒΕΝΙΖΕΛΟΥ 99", "ΕΡΜΟΥ", "ΑΓΙΟΣ ΑΘΑΝΑΣΙΟΣ", "ΟΝLΥ LΑΤΙΝ"]
    assert values(spark, ["AΓIA 1O", "ΦΑΡΜ0ΚΕΙΟ", "ROAD 10"], text.clean_display(x)) == ["ΑΓΙΑ 1O", "ΦΑΡΜΟΚΕΙΟ", "ROAD 10"]
    a, b = values(spark, ["Κομνηνών", "Komninon"], text.latin_key(x))
    assert a == b == "KOMNINON"
    sounds = values(spark, ["Καλαμαριά", "kalamaria", "KALAMARIA", "Εύοσμος", "evosmos", "efosmos"], text.place_sound(x))
    assert len(set(sounds[:3])) == 1 and len(set(sounds[3:])) == 1
    assert values(spark, ["ντεπον", "DEPON", "ιβουπροφαίνη", "παρακεταμόλη"], text.medicine_sound(x)) == ["depon", "depon", "ivuprofeni", "paraketamoli"]
    assert values(spark, ["CETIRIZINE 40mg"], text.medicine_sound(x, True)) == ["setirizine 40 mg"]
    assert values(spark, [(["ΑΓΙΟΥ-", "ΔΗΜΗΤΡΙΟΥ", " ", "5"],)], text.join_lines(x), schema="x array<string>") == ["ΑΓΙΟΥ-ΔΗΜΗΤΡΙΟΥ 5"]


def test_match_keys_of_all_lines(spark, tmp_path):
    from orarium.plans.entity_queries import QUERIES

    spark.createDataFrame([(1, "Ermou 9\n\nΆγιος  Νίκος"), (2, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r.key for r in QUERIES["match_key_lines"](spark, f"file://{tmp_path}").collect()}
    assert got == {(1, 0): "ΕRΜΟU 9", (1, 1): "", (1, 2): "ΑΓΙΟΣ ΝΙΚΟΣ"}


def test_names_and_ids(spark):
    assert values(spark, ["+30 2310 123456", "00302310123456", "6912345678", "123", None], text.normalize_phone(F.col("x"))) == ["2310123456", "2310123456", "6912345678", None, None]
    a, b = text.name_tokens(F.col("a")), text.name_tokens(F.col("b"))
    rows = [("ΠΑΠΑΔΟΠΟΥΛΟΥ ΜΑΡΙΑ & ΣΙΑ Ο.Ε.", "Παπαδοπούλου Μαρία"), ("", "x"), ("ΓΕΩΡΓΙΟΥ", "Georgiou Nikos")]
    assert values(spark, rows, text.jaccard(a, b), schema="a string, b string") == [1.0, 0.0, 0.0]
    assert values(spark, rows, text.share_token(a, b), schema="a string, b string")[2] is True
    street = text.same_street(F.col("a"), F.col("b"))
    assert values(spark, [("Ε.ΒΕΝΙΖΕΛΟΥ 99", "ΕΛ. ΒΕΝΙΖΕΛΟΥ 99"), ("ΕΡΜΟΥ 9", "ΕΡΜΟΥ 8")], street, schema="a string, b string") == [True, False]
    near = text.near_word(F.col("a"), F.col("b"))
    assert values(spark, [("ΓΕΩΡΓΙΟΥ", "ΓΕΩΡΓΙΟΣ"), ("ΝΙΚΟΣ", "ΝΙΚΟΥ"), ("A", "A")], near, schema="a string, b string") == [True, False, True]
    ids = values(spark, [("2310123456", "Α"), (None, "ΜΑΡΙΑ ΝΙΚΟΥ"), ("9", "Νίκου Μαρία")], text.entity_id(F.col("p"), F.col("n"), F.lit("Κέντρο")), schema="p string, n string")
    assert ids[0] == "2310123456" and ids[1] == ids[2] and len(ids[1]) == 12


def test_transliteration_and_slugs(spark):
    x = F.col("x")
    assert values(spark, ["Νέα Μηχανιώνα", "Εύοσμος", "Ευκαρπία", "Μπότσαρη", "Λάμπρου", "Αγγελάκη", "αυ", None], text.transliterate(x)) == ["nea michaniona", "evosmos", "efkarpia", "botsari", "lamprou", "angelaki", "af", None]
    df = spark.createDataFrame([("Άγιος Αθανάσιος",), ("Αγιος Αθανασιος",), ("x",), ("x 2",), ("X",), ("!",)], "name string")
    slugs = {r.name: r.slug for r in text.assign_slugs(df).collect()}
    assert len(set(slugs.values())) == 6 and slugs["!"] == "area" and {slugs["Άγιος Αθανάσιος"], slugs["Αγιος Αθανασιος"]} == {"agios-athanasios", "agios-athanasios-2"} and slugs["x"] == "x-3"
    got = values(spark, ["DORALIN F.C.TAB 40MG/TAB", "PANADOL MAXIMUM", "A SYR 5"], text.split_name(x, ("SYR",)))
    assert [tuple(g) for g in got] == [("DORALIN", "F.C.TAB", "40MG/TAB"), ("PANADOL MAXIMUM", None, ""), ("A", "SYR", "5")]


def test_search(spark):
    rows = [("1000000000001", "DEPON TABLET 500MG", "PARACETAMOL"), ("1000000000002", "EXTRA DEPON", "PARACETAMOL"), ("1000000000003", "CETIRIZINE X", "CETIRIZINE"), ("1000000000004", "ALGOFREN", "IBUPROFEN")]
    prepared = search.prepare(spark.createDataFrame(rows, "barcode string, name string, substance string"), "name", "substance")
    find = lambda q: [(r.barcode[-1], r.score) for r in search.ranked_search(prepared, q, "name", "barcode").collect()]
    assert find("ντεπον") == [("1", 0), ("2", 1)]
    assert find("ιβουπροφαίνη") == [("4", 2)]
    assert find("σετιριζίνη") == [("3", 1)]
    assert find("παρακεταμόλη") == [("1", 2), ("2", 2)]
    assert find("d") == [] and find("000000000003") == [("3", 0)]


def test_capture(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("c", 1, "same")], "k string, v int, c string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 4, "y"), ("c", 9, "same"), ("d", 1, "n"), ("b", 5, "z")], "k string, v int, c string")
    out = capture.upsert_latest(old, new, ["k"], "v", ["c"])
    assert {tuple(r) for r in out.collect()} == {("a", 2, "y"), ("b", 5, "z"), ("c", 1, "same"), ("d", 1, "n")}
    lists = spark.createDataFrame([("g", date(2026, 1, d), c) for d, c in ((1, "x"), (2, "x"), (4, "x"), (5, "y"))], "g string, d date, c string")
    assert [r.d.day for r in capture.repeats_of_yesterday(lists, "g", "d", ["c"]).collect()] == [2]
    folded = capture.fold(spark.createDataFrame([("k", 1, "n1", "a"), ("k", 2, "n2", ""), ("k", 3, None, None)], "k string, s int, n string, v string"), "k", "s", ["n"], ["v"]).first()
    assert (folded.n, folded.v) == (None, "a")
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string").withColumn("p", F.monotonically_increasing_id())
    codes = {r.v: r.code for r in capture.dictionary(rows.coalesce(1), "v", "p").collect()}
    assert codes == {"b": 0, "a": 1}
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    after = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    diff = capture.keyed_diff(before, after, "k", ["v"])
    assert {tuple(r) for r in diff.collect()} == {(1, "remove"), (2, "update"), (4, "add")}
    assert capture.diff_summary(before, after, diff).first().mode == "replace"
    now = F.lit(datetime(2026, 1, 3))
    late = capture.stale(spark.createDataFrame([("a", datetime(2026, 1, 1, 12)), ("b", datetime(2026, 1, 1, 11)), ("c", None)], "k string, t timestamp"), "k", "t", now)
    assert [(r.k, r.age_hours) for r in late.collect()] == [("c", None), ("b", 37)]


def test_greedy_assignment_takes_best_scores_first(spark):
    rows = [("l", "e1", 1, "p1", 1, 1.5, True), ("l", "e1", 1, "p2", 2, 1.2, True), ("l", "e2", 2, "p1", 1, 1.9, True), ("l", "e3", 3, "p1", 1, 0.9, False), ("l", "e4", 4, "p9", 3, None, False)]
    df = spark.createDataFrame(rows, "list string, entry string, position int, other string, other_position int, score double, strong boolean")
    got = {r.entry: r.other for r in resolve.greedy_assignment(df, "list", "entry", "other").collect()}
    assert got == {"e1": "p2", "e2": "p1", "e3": None}


def test_locations_and_streets(spark):
    e = spark.createDataFrame([("a", "231", ["X"], "k", 40.0, 23.0), ("b", None, ["ΝΙΚΟΥ"], "ΕΡΜΟΥ 9", 40.0, 23.0), ("c", None, ["ΜΑΡΙΑ"], "-", 40.0, 23.0)], "entity_id string, phone string, tokens array<string>, address_key string, lat double, lon double")
    p = spark.createDataFrame([("p1", ["231"], ["Y"], "q", 0.5, 1.0, 1.0), ("p2", ["231"], ["Y"], "q", 0.9, 1.0, 1.0), ("p3", ["0"], ["ΝΙΚΟΥ"], "ΕΡΜΟΥ 9", 0.1, 1.0, 1.0), ("p4", ["0"], ["ΜΑΡΙΑ"], "z", 0.1, 40.001, 23.0), ("p5", ["0"], ["ΜΑΡΙΑ"], "z", 0.9, 40.002, 23.0)], "place_id string, phones array<string>, tokens array<string>, address_key string, confidence double, lat double, lon double")
    assert {r.entity_id: (r.place_id, r.way) for r in resolve.locate(e, p).collect()} == {"a": ("p2", 1), "b": ("p3", 2), "c": ("p4", 3)}
    streets = spark.createDataFrame([("ΕΡΜΟΥ", "Ερμού"), ("ΕΛΕΥΘΕΡΙΟΥ ΒΕΝΙΖΕΛΟΥ", "Ελευθερίου Βενιζέλου"), ("ΑΓΙΟΥ ΔΗΜΗΤΡΙΟΥ", "Αγίου Δημητρίου"), ("ΑΓΙΑΣ ΔΗΜΗΤΡΑΣ", "Αγίας Δήμητρας")], "key string, name string")
    asked = spark.createDataFrame([(1, "ΕΡΜΟΥ"), (2, "ΕΛ ΒΕΝΙΖΕΛΟΥ"), (3, "ΑΓ ΔΗΜΗΤΡ"), (4, "ΚΑΤΙ")], "id int, printed_key string")
    assert {r.id: r.name for r in resolve.restore_streets(asked, streets).collect()} == {1: "Ερμού", 2: "Ελευθερίου Βενιζέλου"}


def test_knn_widens_where_rows_are_sparse(spark):
    rows = [(i, 35.0 + (i * 37 % 60) / 10, 20.0 + (i * 91 % 70) / 10) for i in range(60)] + [(99, -40.0, 170.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    from math import asin, cos, radians, sin, sqrt

    def metres(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * asin(min(1, sqrt(h)))

    expected = {(a[0], b[0]) for a in rows for b in sorted((b for b in rows if b != a), key=lambda b: (round(metres(a, b)), b[0]))[:3]}
    out = spatial.knn(df, df, 3, degrees=0.5, metres=lambda d: F.round(d).cast("long"))
    assert {(r.id, r.other) for r in out.collect()} == expected


def test_visits(spark):
    t = lambda m: datetime(2026, 1, 1, m // 60, m % 60)
    df = spark.createDataFrame([("a", t(0)), ("a", t(29)), ("a", t(59)), ("a", t(88)), ("b", t(5))], "k string, at timestamp")
    assert {r.k: r.visits for r in visits.visit_counts(df, ["k"], "at").collect()} == {"a": 2, "b": 1}
    busy = spark.createDataFrame([("c", t(m), m) for m in (0, 1, 2, 3, 4, 5, 9, 10, 11, 40)], "k string, at timestamp, id int")
    got = {r.id: r.allowed for r in visits.rate_limit(busy, "k", "at", "id").collect()}
    assert [got[m] for m in (0, 1, 2, 3, 4, 5, 9, 10, 11, 40)] == [True] * 5 + [False, False, True, True, True]


def test_grammars(spark):
    x = F.col("x")
    heads = values(spark, ["Εφημερεύοντα Φαρμακεία από 8:00 έως 08:00", "Διανυκτερεύοντα Φαρμακεία", "κάτι"], grammars.heading(x))
    assert heads[0].kind == "on-duty" and tuple(heads[0].hours) == ("08:00", "08:00", True) and heads[1].kind == "overnight" and heads[1].hours is None and heads[2].kind is None
    extra = values(spark, ["Τρίτη, Πέμπτη & Παρασκευή (εκτός αργιών), λειτουργούν και 14:00-17:00", "τίποτα"], grammars.extra_hours(x))
    assert tuple(extra[0]) == ([2, 4, 5], "14:00", "17:00", True) and extra[1] is None
    cells = spark.createDataFrame([(1, "Δευτέρα: 08:00 - 14:30 και 17:00 - 21:00\nΣάββατο: 09:00 - 24:00"), (2, "Τετάρτη 28/10/2026: 10:00-12:00\nΤρίτη 28/10/2026: 10:00-12:00\nΔευτέρα: 9:00-8:00\nκάτι άλλο")], "k int, cell string")
    got = [(r.k, r.weekday, str(r.day) if r.day else None, r["from"], r["to"], r.error is None) for r in grammars.schedule_lines(cells, "k", "cell").orderBy("k", "position", "from").collect()]
    assert got == [(1, 1, None, "08:00", "14:30", True), (1, 1, None, "17:00", "21:00", True), (1, 6, None, "09:00", "00:00", True), (2, 3, "2026-10-28", "10:00", "12:00", True), (2, 2, "2026-10-28", None, None, False), (2, 1, None, None, None, False), (2, None, None, None, None, False)]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Δευτέρα έως Τετάρτη 08:00-14:00", [("1", "08:00", "14:00"), ("2", "08:00", "14:00"), ("3", "08:00", "14:00")]),
        ("Δευ, Παρ 8.00 - 14.00 & 17:00-24:00", [("1", "08:00", "14:00"), ("5", "08:00", "14:00"), ("1", "17:00", "00:00"), ("5", "17:00", "00:00")]),
        ("5/10 09:00-13:00", [("2026-10-05", "09:00", "13:00")]),
        ("5/10 - 7/10 09:00-13:00", [(f"2026-10-0{d}", "09:00", "13:00") for d in (5, 6, 7)]),
    ],
)
def test_free_hours(given, expected):
    assert grammars.free_hours(given, 2026, 10) == expected


@pytest.mark.parametrize("given", ["", "Δευτέρα", "08:00-14:00", "Δευτέρα 14:00-08:00", "Δευτέρα 08:00", "Καλημέρα 08:00-09:00", "Δευτέρα ~ 08:00-09:00"])
def test_free_hours_never_guesses(given):
    with pytest.raises(ValueError):
        grammars.free_hours(given, 2026, 10)


def test_html(spark):
    page = '<title>A &amp; B</title><a href="/x">x</a><p>y<p z><table><tr><td rowspan="2">a</td><td colspan=2>b&eacute;</td></tr><tr><td>c</td><td>d</td></tr></table><div class="card"><b>N &#39;1</b><i>2310</i></div><div class="card"><b>M</b></div>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    r = html.page_cards(df).where("page_id = 1").first()
    assert (r.title, r.n_links, r.first_link, r.n_paragraphs) == ("A &amp; B", 1, "/x", 2)
    cells = {(c["row"], c["column"]): c.text for c in html.table_cells(df).collect()}
    assert cells == {(0, 0): "a", (0, 1): "bé", (0, 2): "bé", (1, 0): "a", (1, 1): "c", (1, 2): "d"}
    got = [(c.position, c.name, c.phone) for c in html.cards(df, '<div class="card">', {"name": "<b>(.*?)</b>", "phone": "<i>(.*?)</i>"}).collect()]
    assert got == [(0, "N '1", "2310"), (1, "M", "")]


def workbook(path):
    cells = '<row r="1"><c r="A1" t="inlineStr"><is><t>τίτλος</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>2800000000011</v></c><c r="C3"><v>12.50</v></c></row><row r="4"><c r="A4"><v>1</v></c><c r="C4"><v>0</v></c></row>'
    data = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml" Type="t"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Barcode</t></si><si><r><t>Τιμή </t></r><r><t>λιανική</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')
    path.write_bytes(data.getvalue())


def test_sheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = sheets.sheets(spark, f"file://{tmp_path}/*.xlsx")
    assert rows.where("error IS NOT NULL").count() == 1
    table = sheets.by_header(rows.where("error IS NULL"), F.get("cells", F.lit(0)) == "Barcode", {"barcode": "^barcode", "price": "τιμη"}).withColumn("name", F.lit("n"))
    good, bad = sheets.prices(table)
    assert [(r.barcode, float(r.price)) for r in good.collect()] == [("2800000000011", 12.5)] and bad.count() == 1


def test_layout(spark):
    items = spark.createDataFrame([("d", 1, 5.0, 10.0, "b"), ("d", 1, 1.0, 10.4, "a"), ("d", 1, 1.0, 10.8, "c"), ("d", 1, 1.0, 50.0, "far")], "doc string, page int, x double, y double, text string")
    assert {r.text: r.line for r in sheets.text_lines(items).collect()} == {"b": 0, "a": 0, "c": 1, "far": 2}
    anchors = spark.createDataFrame([("d", 1, 12.0, "A"), ("d", 1, 90.0, "B")], "doc string, page int, y double, anchor string")
    assert {r.text: r.anchor for r in sheets.nearest_anchor(items, anchors).collect()} == {"a": "A", "b": "A", "c": "A"}
    marks = anchors.withColumnRenamed("anchor", "mark")
    assert {r.text: r.mark for r in sheets.bands(marks, items).collect()} == {"a": "A", "b": "A", "c": "A", "far": "A"}
    assert spark.range(1).select(sheets.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)))).first()[0] == 3
    rows = spark.createDataFrame([("1", "Α", "", 1, "t"), ("1", "Α", "", 2, "t"), ("1", "ΑΒ", "Ερμού", 3, "u")], "phone string, name string, address string, position int, town string")
    assert tuple(sheets.consensus(rows, "phone", "town").first()) == ("1", "ΑΒ", "Ερμού", "t", 2)


def test_medicines(spark):
    rows = spark.createDataFrame([("b1", 1, "OLD", 1.0, False, "t1", "A1", "sub", "co", None), ("b1", 2, "NEW 10", 2.5, True, "t2", "", "", None, None), ("b2", 1, "NEW 9", 3.0, False, "t1", "A2", "sub2", "co", True)], "barcode string, seq int, name string, price double, otc boolean, bulletin string, atc string, substance string, company string, not_reimbursed boolean")
    shortages = spark.createDataFrame([("b1", 1, "a"), ("b1", 2, "b"), ("zz", 3, "c")], "barcode string, position int, reason string").withColumns({"from": F.lit(None).cast("date"), "to": F.lit(None).cast("date")})
    out = medicines.assemble(rows, shortages)
    r = out.where("barcode = 'b1'").first()
    assert (r.name, r.price, r.otc, r.atc, r.substance, r.not_reimbursed, r.shortage.reason) == ("NEW 10", 2.5, True, "A1", "sub", False, "b")
    assert medicines.unmatched_shortages(shortages, out).count() == 1 and medicines.changed_kind(rows).count() == 1
    coded, books = medicines.encode(out.withColumn("price", F.col("price").cast("decimal(10,2)")))
    assert [r.barcode for r in coded.orderBy("position").collect()] == ["b2", "b1"]
    back = medicines.decode(coded, books)
    assert {(r.barcode, float(r.price), r.otc, r.substance) for r in back.collect()} == {("b1", 2.5, True, "sub"), ("b2", 3.0, False, "sub2")}


def test_quality(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    found = quality.report(quality.unknown(a, b, "k"), quality.duplicates(a, ["k"]), quality.share(a, F.col("k") == 2, 0.3, "ratio"))
    assert {(r.severity, r.code, r.n) for r in quality.summary(found).collect()} == {("error", "unknown-entity", 1), ("warn", "duplicate-extended", 1), ("warn", "ratio", 1)}
    assert not quality.passes(found) and quality.passes(found.where("severity = 'warn'"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "area string, v int, t string").select("v", "t", "area")
    path = f"file://{tmp_path}/out"
    sinks.write_changed(df, path, ["area"])
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    sinks.write_changed(df, path, ["area"])
    assert files == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    sinks.write_changed(df.withColumn("v", F.when(F.col("area") == "b", 9).otherwise(F.col("v"))), path, ["area"])
    changed = {p for p in tmp_path.rglob("*.parquet")} - set(files)
    assert changed and all("area=b" in str(p) for p in changed)
    long = "SUMMARY:" + "Φαρμακείο " * 20
    pieces = sinks.fold(long).split("\r\n")
    assert all(len(p.encode()) <= 75 for p in pieces) and "".join(p[1:] if k else p for k, p in enumerate(pieces)) == long
    events = spark.createDataFrame([("k", "u1", datetime(2026, 1, 1, 8), datetime(2026, 1, 1, 9), "a, b; c\nd", "here")], "k string, uid string, start timestamp, end timestamp, summary string, location string")
    ics = sinks.calendar(events, "k", F.lit(datetime(2026, 1, 1))).first().ics
    assert "DTSTART:20260101T080000Z" in ics and r"SUMMARY:a\, b\; c\nd" in ics
    pins = spark.createDataFrame([("x", "2", 40.0, 23.0, "open"), ("x", "1", 41.0, 22.0, "closed")], "area string, id string, lat double, lon double, kind string")
    assert sinks.feature_collections(pins, "area", ["kind"]).first().geojson.index('"id":"1"') < sinks.feature_collections(pins, "area", ["kind"]).first().geojson.index('"id":"2"')
    assert "&amp;" in sinks.sitemap(spark.createDataFrame([("m", "http://a/?x&y", date(2026, 1, 1))], "m string, path_url string, lastmod date"), "m").first().xml


def test_documents(spark, tmp_path):
    folder = tmp_path / "kavala" / "duties"
    folder.mkdir(parents=True)
    (folder / "2026-10-07.json").write_text('{"schemaVersion":1,"date":"2026-10-07","groups":[{"id":"g","name":"G","sections":[{"kind":"overnight","heading":"h","hours":{"from":"21:00","to":"08:00","toNextDay":true},"entries":[{"pharmacyId":"1"},{"pharmacyId":"2"}]},{"kind":"day","heading":"h2","hours":null,"onCall":true,"entries":[{"pharmacyId":"1"}]}]}]}')
    days = tables.duty_days(spark, f"file://{tmp_path}")
    from orarium.operators.schedules import flatten_duty_days

    assert days.first().area_id == "kavala"
    got = [(r.entity_id, r.kind, r["from"], r.next_day, r.on_call) for r in flatten_duty_days(days).orderBy("position").collect()]
    assert got == [("1", "overnight", "21:00", True, False), ("2", "overnight", "21:00", True, False), ("1", "day", None, None, True)]


def test_streams(spark, tmp_path):
    t = lambda m: datetime(2026, 1, 1, m // 60, m % 60)
    source = tmp_path / "in"
    for k, rows in enumerate(([("a", t(0)), ("a", t(1)), ("a", t(2)), ("a", t(3))], [("a", t(4)), ("a", t(5)), ("a", t(10)), ("b", t(9))])):
        spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.mode("append").parquet(f"file://{source}/{k}")
    read = lambda: spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{source}")
    for name, df, mode in (("limits", streams.rate_limit_stream(read(), "k", "at"), "append"), ("visits", streams.visit_stream(read(), "k", "at"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    allowed = {r.us // 60_000_000 % 1440: r.allowed for r in spark.table("limits").where("k = 'a'").collect()}
    assert [allowed[m] for m in (0, 1, 2, 3, 4, 5, 10)] == [True] * 5 + [False, True]
    assert spark.table("visits").groupBy("k").agg(F.max("visits")).where("k = 'a'").first()[1] == 1
    sink = streams.upsert_sink(f"file://{tmp_path}/up", ["k"], "v", ["c"])
    sink(spark.createDataFrame([("a", 1, "x")], "k string, v int, c string"), 0)
    sink(spark.createDataFrame([("a", 0, "old"), ("b", 1, "n")], "k string, v int, c string"), 1)
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/up/1").collect()} == {("a", 1, "x"), ("b", 1, "n")}
