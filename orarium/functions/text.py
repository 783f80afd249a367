"""Text keys, phones, ids and similarity, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latin capitals that are typed for Greek ones.
LATIN_LOOKALIKES, GREEK_LOOKALIKES = "ABEZHIKMNOPTYX", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_CLASS = "[Ͱ-Ͽἀ-῿]"
# Greek capitals in Latin letters, pairs and sounds of two letters first.
GREEKLISH = (("ΟΥ", "OU"), ("ΜΠ", "B"), ("ΝΤ", "D"), ("ΓΚ", "G"), ("ΘΘ|Θ", "TH"), ("Χ", "CH"), ("Ψ", "PS"), ("Ξ", "X"), ("Φ", "F"))
GREEK_CAPITALS, LATIN_CAPITALS = "ΑΒΓΔΕΖΗΙΚΛΜΝΟΠΡΣΤΥΩ", "AVGDEZIIKLMNOPRSTIO"
# Small Greek letters by ELOT 743, and the rewrites that make spellings of one sound equal, in order.
GREEK_SMALL = (("θ", "th"), ("χ", "ch"), ("ψ", "ps"))
GREEK_ONE, LATIN_ONE = "αβγδεζηικλμνξοπρσςτυφω", "avgdeziiklmnxoprsstyfo"
PLACE_SOUNDS = (
    ("au|ay", "av"), ("eu|ey", "ev"), ("ai", "e"), ("ei|oi|ui|yi", "i"), ("ou|oy", "o"), ("ph", "f"), ("ch|kh", "h"), ("th", "t"), ("dh", "d"), ("gh", "g"), ("mp|mb", "b"),
    ("nt", "d"), ("gk", "g"), ("gg", "ng"), ("x", "ks"), ("ks", "h"), ("[cq]", "k"), ("[jy]", "i"), ("w", "o"), ("u", "o"), ("[bf]", "v"), ("e", "i"),
)
# The same for medicine names.
MEDICINE_PAIRS = (("ου", "u"), ("αυ", "av"), ("ευ", "ev"), ("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("γγ", "ng"), ("τσ", "ts"), ("τζ", "tz"))
MEDICINE_ONE, MEDICINE_LATIN = "αβγδεζηθικλμνοπρσςτυφχω", "avgdezitiklmnoprsstifho"
MEDICINE_TWO = (("ξ", "ks"), ("ψ", "ps"))
MEDICINE_SOUNDS = (("ph", "f"), ("th", "t"), ("ch", "h"), ("ou", "u"), ("ai", "e"), ("[eo]i", "i"), ("qu", "kv"), ("x", "ks"))
MEDICINE_LAST = (("c", "k"), ("y", "i"), ("w", "v"), ("b", "v"), ("j", "i"))
# Words that say nothing about which entity it is.
NOISE = ("ΟΕ", "ΕΕ", "ΙΚΕ", "ΑΕ", "ΕΠΕ", "ΣΦ", "ΣΙΑ", "ΚΑΙ", "ΦΑΡΜΑΚΕΙΟ", "ΦΑΡΜΑΚΕΙΑ", "PHARMACY")


def _accents() -> tuple[str, str]:
    """Letters with marks and their bases, from Unicode's decompositions of Latin and Greek."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def rewrite(x: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x)


def squash(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_marks(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{M}", "")


def strip_accents(x: Column) -> Column:
    """Lower case without marks; final sigma is plain sigma."""
    return F.replace(F.lower(strip_marks(x)), F.lit("ς"), F.lit("σ"))


def join_lines(lines: Column) -> Column:
    """Lines of a wrapped cell as one; a line that ends in a hyphen goes on without a space."""
    clean = F.filter(F.transform(lines, squash), lambda x: x != "")
    return F.aggregate(clean, F.lit(""), lambda out, x: F.when(out == "", x).when(out.endswith("-"), F.concat(out, x)).otherwise(F.concat(out, F.lit(" "), x)))


def clean_display(x: Column) -> Column:
    """Inside words that have a Greek letter, Latin look-alikes (and a zero beside Greek) become Greek."""
    word = lambda w: F.when(w.rlike(GREEK_CLASS), F.regexp_replace(F.translate(w, LATIN_LOOKALIKES, GREEK_LOOKALIKES), "(?<=[Ͱ-Ͽ])0|0(?=[Ͱ-Ͽ])", "Ο")).otherwise(w)
    return F.array_join(F.transform(F.split(squash(x), " "), word), " ")


def match_key(x: Column) -> Column:
    """A key to compare names across sources: capitals, no marks, look-alikes Greek, single spaces."""
    upper = F.translate(F.upper(strip_marks(clean_display(x))), LATIN_LOOKALIKES, GREEK_LOOKALIKES)
    return F.trim(F.regexp_replace(upper, r"[^\p{L}\p{N}]+", " "))


def latin_key(x: Column) -> Column:
    """Like match_key, in Latin letters: Greek and Greeklish spellings meet."""
    key = F.translate(rewrite(match_key(x), GREEKLISH), GREEK_CAPITALS, LATIN_CAPITALS)
    return rewrite(key, (("Y", "I"), ("PH", "F"), (r"([A-Z])\1", "$1")))


def place_sound(x: Column) -> Column:
    """A rough sound key of a place name, shared by Greek and Latin spellings."""
    latin = F.translate(rewrite(strip_accents(x), GREEK_SMALL), GREEK_ONE, LATIN_ONE)
    return rewrite(rewrite(latin, PLACE_SOUNDS), (("[^a-z0-9]", ""), (r"(.)\1+", "$1")))


def medicine_sound(x: Column, soft_c: bool = False) -> Column:
    """The sound key of a medicine name, words apart; soft_c reads c before e, i, y as s.

    Pairs are taken left to right, so one pass over each text decides which letters pair."""
    low = F.lower(strip_marks(x))
    pairs = "|".join(p for p, _ in MEDICINE_PAIRS)
    pieces = F.regexp_extract_all(low, F.lit(f"(?s)({pairs}|.)"), F.lit(1))
    spelled = F.array_join(F.transform(pieces, lambda p: reduce(lambda c, r: c.when(p == r[0], r[1]), MEDICINE_PAIRS[1:], F.when(p == MEDICINE_PAIRS[0][0], MEDICINE_PAIRS[0][1])).otherwise(p)), "")
    latin = F.translate(rewrite(spelled, MEDICINE_TWO), MEDICINE_ONE, MEDICINE_LATIN)
    apart = rewrite(latin, (("[^a-z0-9]+", " "), (r"(\d)([a-z])", "$1 $2"), (r"([a-z])(\d)", "$1 $2")))
    soft = (("c(?=[eiy])", "s"),) if soft_c else ()
    return F.trim(rewrite(apart, (*MEDICINE_SOUNDS, *soft, *MEDICINE_LAST, (r"([a-z])\1+", "$1"))))


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def index_words(x: Column) -> Column:
    """The words of a name in both readings of c."""
    return F.array_distinct(F.concat(words(medicine_sound(x)), words(medicine_sound(x, True))))


def normalize_phone(raw: Column) -> Column:
    """Ten national digits starting with 2 or 6; null for anything else."""
    digits = F.regexp_replace(raw, r"\D", "")
    national = F.when(digits.startswith("0030"), F.substring(digits, 5, 40)).when(digits.startswith("30") & (F.length(digits) == 12), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(national.rlike(r"^[26]\d{9}$"), national)


def format_phone(phone: Column) -> Column:
    """A space after the area code, of three, four or five digits; mobiles in three groups; anything else as it is."""
    d = F.regexp_replace(phone, r"\D", "")
    cut = lambda *sizes: F.regexp_replace(d, "^" + "".join(rf"(\d{{{n}}})" for n in sizes) + "$", " ".join(f"${k + 1}" for k in range(len(sizes))))
    return F.when(F.length(d) != 10, phone).when(d.rlike("^21"), cut(3, 7)).when(d.rlike("^2[2-8]1"), cut(4, 6)).when(d.rlike("^2"), cut(5, 5)).when(d.rlike("^69"), cut(3, 3, 4)).otherwise(phone)


def phone_e164(phone: Column) -> Column:
    return F.concat(F.lit("+30"), phone)


def name_tokens(name: Column) -> Column:
    """The distinctive words of a name; dotted abbreviations are joined first."""
    joined = rewrite(name, ((r"(?<!\p{L})(\p{L})\.(?=\p{L}\.)", "$1"), (r"(\p{L})\.(\p{L})\.", "$1$2")))
    return F.array_distinct(F.filter(F.split(match_key(joined), " "), lambda t: (F.length(t) > 2) & ~t.isin(*NOISE)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of tokens in common; 0 where a side is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def share_token(a: Column, b: Column) -> Column:
    """A distinctive word in common, in Greek or Greeklish; a, b: name_tokens."""
    return F.arrays_overlap(F.transform(a, latin_key), F.transform(b, latin_key))


def same_street(a: Column, b: Column) -> Column:
    """A house number and a street word of four letters or more in common."""
    part = lambda x, p: F.filter(F.split(latin_key(x), " "), lambda w: w.rlike(p))
    return F.arrays_overlap(part(a, r"^\d+$"), part(b, r"^\d+$")) & F.arrays_overlap(part(a, "^[A-Z]{4,}$"), part(b, "^[A-Z]{4,}$"))


def entity_id(phone: Column, name: Column, locality: Column) -> Column:
    """The phone, or a digest of the sorted name words and the locality."""
    key = F.concat(F.array_join(F.array_sort(name_tokens(name)), " "), F.lit("|"), match_key(locality))
    return F.coalesce(normalize_phone(phone), F.concat(F.lit("x-"), F.substring(F.sha2(key, 256), 1, 10)))


def near_word(a: Column, b: Column) -> Column:
    """Equal, or one edit apart where both have six letters or more."""
    return (a == b) | (F.length(a) >= 6) & (F.length(b) >= 6) & (F.levenshtein(a, b, 1) >= 0)


def clean_address(x: Column) -> Column:
    return squash(rewrite(x, ((r"\(.*?\)", " "), (r"\s*,\s*", ", "))))


def split_name(name: Column, forms: tuple[str, ...]) -> Column:
    """brand, form and rest of a pack's name: the first later word that is a dotted code or a known form."""
    parts = F.split(name, r"\s+")
    is_form = lambda p: p.rlike(r"^[A-Z]+(\.[A-Z]+)+$") | p.isin(*forms)
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when((i > 0) & is_form(p), i)), lambda i: i.isNotNull()))
    return F.when(at.isNull(), F.struct(name.alias("brand"), F.lit(None).cast("string").alias("form"), F.lit("").alias("rest"))).otherwise(
        F.struct(F.array_join(F.slice(parts, 1, at), " ").alias("brand"), F.element_at(parts, at + 1).alias("form"), F.array_join(F.slice(parts, at + 2, F.size(parts)), " ").alias("rest"))
    )


def list_join(items: Column, last: str = " and ") -> Column:
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(last), F.element_at(items, -1)))


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def encode_component(x: Column) -> Column:
    """As a browser encodes a component: spaces as %20."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


# Pairs of ELOT 743, at a word's start where that differs, and letters before which υ sounds like f.
ELOT_PAIRS = {"αι": "ai", "ει": "ei", "οι": "oi", "υι": "yi", "ου": "ou", "γγ": "ng", "γκ": "gk", "γξ": "nx", "γχ": "nch", "μπ": "mp", "ντ": "nt"}
ELOT_INITIAL = {"μπ": "b", "ντ": "d"}
VOICELESS = "θκξπσςτφχψ"


def transliterate(x: Column) -> Column:
    """ELOT 743, lower case, without marks. Replacements in the order in which a reader from left to right would take them:
    αυ, ευ, ηυ by what follows, then the beginnings of words, then pairs (ου before υι, which shares a letter with it)."""
    plain = F.lower(strip_marks(F.lower(x)))
    plain = rewrite(plain, ((rf"([αεη])υ(?=[{VOICELESS}]|\P{{L}}|$)", "$1f"), (r"([αεη])υ", "$1v"), *((rf"(?<!\p{{L}}){pair}", latin) for pair, latin in ELOT_INITIAL.items())))
    for pair in sorted(ELOT_PAIRS, key=lambda p: p != "ου"):
        plain = F.replace(plain, F.lit(pair), F.lit(ELOT_PAIRS[pair]))
    for letter, latin in GREEK_SMALL:
        plain = F.replace(plain, F.lit(letter), F.lit(latin))
    return F.translate(plain, GREEK_ONE, LATIN_ONE)


def slugify(x: Column, ascii_only: bool = False) -> Column:
    """A lower-case ASCII slug; ascii_only skips the transliteration of Greek, and stays in the JVM."""
    latin = strip_accents(x) if ascii_only else transliterate(x)
    return rewrite(latin, (("[^a-z0-9]+", "-"), ("^-+|-+$", "")))


def assign_slugs(names: DataFrame, name: str = "name", ascii_only: bool = False) -> DataFrame:
    """name -> name, slug: unique whatever the input's order. The n-th name of a base gets -n; where that is itself
    another name's base, the number goes on until it is free."""
    base = names.select(F.col(name).alias("name")).distinct().withColumn("base", F.coalesce(F.nullif(slugify(F.col("name"), ascii_only), F.lit("")), F.lit("area")))
    ranked = base.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("name"))).withColumn("size", F.count("*").over(Window.partitionBy("base")))
    # bases that look like a numbered slug of another base: few, by their stem
    numbered = base.select(F.regexp_extract("base", r"^(.*)-(\d+)$", 1).alias("base"), F.try_to_number(F.nullif(F.regexp_extract("base", r"-(\d{1,6})$", 1), F.lit("")), F.lit("999999")).cast("int").alias("k")).where("base <> '' AND k >= 2").distinct()
    taken = numbered.groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("taken"))
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    slug = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", free.cast("string")))
    return ranked.join(taken, "base", "left").select("name", slug.alias("slug"))
