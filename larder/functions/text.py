"""Text functions as Column expressions. Patterns use Java's syntax with Unicode classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from larder.enums import BLOCKER, CATEGORY_HINTS, ORIGIN_RANKS, PRICE_PLACEHOLDERS
from larder.functions.patterns import MOST_EXPRESSIONS, outer_labels, words_in
from larder.runtime import ship

# --- fixed values: what a menu name is cleaned of ----------------------------------------------------------------------
CONTROL = r"[\r\n\t]+"
EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}"
    r"\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}]+"
)
HAN = r"[\x{4E00}-\x{9FFF}]+"
BRACKETED = r"\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|《[^《》]*》|〈[^〈〉]*〉"
OPENING = "([【《〈"
STRAY_BRACKET = r"[()\[\]【】《》〈〉]"
EDGE = r"^[\s+*~=#\-·※]+|[\s+*~=#\-·※]+$"
QUANTITY_UNITS = "g|kg|ml|l|p|개|인분|인"
SIZES = "大|中|小"
MODIFIERS = "대|중|소|곱빼기|곱배기|특대|왕|정식|세트|한상|특|스페셜"
NOTICE = r"(습니다|합니다|됩니다|입니다|있습니다|없습니다|않습니다|해요|돼요|예요|이에요|세요|주세요|바랍니다)\.?\s*$"
SET_OR_COURSE = r"(특선|코스|추가)\s*[a-z0-9]?\s*$"
VOLUME = r"\d+\s*(ml|㎖|리터)"
BRANCH = r"점\s*$"
PRICE_LINE = r"^₩?[\d,]+\s*원?$"
FOOD_CODE = r"^[A-Za-z]\d+(-\d+)+$"
# Korean syllables: the first lead, vowel and syllable, the code point before the first tail, and how many there are
LEAD, VOWEL, TAIL, SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00
LEADS, VOWELS, TAILS = 19, 21, 28
JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"
# letters that composition leaves as they are unless others stand among them: Latin, jamo and syllables, Han, kana without
# their marks, punctuation, signs, full-width forms, pictures
STABLE = (
    r"\x{0}-\x{2FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x{30A1}-\x{30FC}"
    r"\x{2002}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{2190}-\x{21FF}\x{2460}-\x{27BF}\x{3000}-\x{3029}\x{FF01}-\x{FFDC}\x{FE0F}\x{1F300}-\x{1FAFF}"
)
# ----------------------------------------------------------------------------------------------------------------------
#: One or more quantity, size or modifier endings; taking them off one by one until none is left takes off the same.
ENDINGS = rf"(\s*\d+\s*({QUANTITY_UNITS})|\s*({SIZES})|\s*\(?\s*({MODIFIERS})\s*\)?)(\s*\d+\s*({QUANTITY_UNITS})|\s*({SIZES})|\s*\(?\s*({MODIFIERS})\s*\)?)*\s*$"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(ArrayType(StringType()))
def _nfc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [None if s is None else unicodedata.normalize("NFC", s) for s in a])


def compose_hangul(text: Column) -> Column:
    """``text`` with its Korean jamo composed to syllables by arithmetic, the rest as it is."""

    def composed(part: Column) -> Column:
        code = lambda i: F.ascii(F.substr(part, F.lit(i), F.lit(1)))
        first, tail = code(1), F.when(F.length(part) == 3, code(3) - TAIL).otherwise(0)
        jamo = (F.length(part) > 1) & first.between(LEAD, LEAD + LEADS - 1)
        open_ = (F.length(part) == 2) & first.between(SYLLABLE, SYLLABLE + LEADS * VOWELS * TAILS - 1) & ((first - SYLLABLE) % TAILS == 0)
        made = F.when(jamo, SYLLABLE + ((first - LEAD) * VOWELS + code(2) - VOWEL) * TAILS + tail).when(open_, first + code(2) - TAIL)
        return F.when(made.isNotNull(), F.decode(F.unhex(F.hex(made)), "UTF-16BE")).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({JAMO}|[^\x{{1100}}-\x{{11FF}}\x{{AC00}}-\x{{D7A3}}]+|.)"), 0)
    return F.when(text.rlike(JAMO), F.array_join(F.transform(parts, composed), "")).otherwise(text)


def is_composed_by_hangul(text: Column) -> Column:
    """Whether canonical composition does no more to the text than ``compose_hangul``."""
    return ~text.rlike(f"[^{STABLE}]")


def nfc(text: Column) -> Column:
    """Canonical composition. Korean is composed by expressions; Python gets the texts with other letters that compose, nulls
    for the rest."""
    plain = is_composed_by_hangul(text)
    return F.when(plain, compose_hangul(text)).otherwise(_nfc(F.when(~plain, text)))


def with_nfc(df: DataFrame, *columns: str, **items: str) -> DataFrame:
    """``df`` with the columns composed, and in arrays of structs the field named (``array="field"``). Rows that are stable
    but for Korean never reach Python."""
    ship(df.sparkSession)
    def other(text: Column) -> Column:
        return F.coalesce(~is_composed_by_hangul(text), F.lit(False))

    def each(field: str, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: f(x[field])

    def with_names(field: str) -> Callable[[Column, Column], Column]:
        return lambda x, name: x.withField(field, name)

    def in_place(field: str) -> Callable[[Column], Column]:
        return lambda x: x.withField(field, compose_hangul(x[field]))

    found = [other(F.col(c)) for c in columns] + [F.coalesce(F.exists(a, each(f, other)), F.lit(False)) for a, f in items.items()]
    odd = reduce(lambda a, b: a | b, found)
    plain = df.filter(~odd).withColumns({c: compose_hangul(F.col(c)) for c in columns} | {a: F.transform(a, in_place(f)) for a, f in items.items()})
    rest = df.filter(odd).withColumns({c: _nfc(F.col(c)) for c in columns} | {a: F.zip_with(a, _nfc_each(F.transform(a, each(f, lambda t: t))), with_names(f)) for a, f in items.items()})
    return plain.unionByName(rest)


def strip(text: Column) -> Column:
    """Without white space at either end, that of Unicode and the separators U+001C to U+001F included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _count_any(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def strip_brackets(text: Column) -> Column:
    """Bracketed parts taken out until none is left, innermost first; there are at most as many rounds as openings."""
    rounds = _count_any(text, OPENING)
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), rounds), text, lambda s, _: F.regexp_replace(s, BRACKETED, ""))).otherwise(text)


def normalize_menu_name(name: Column, variants: list[tuple[str, str]] | None = None) -> Column:
    """A composed menu name without decoration, bracketed notes and size or quantity endings, in lower case.

    ``variants`` are replaced last, in order.
    """
    s = F.regexp_replace(name, CONTROL, " ")
    s = F.regexp_replace(s, EMOJI, " ")
    s = F.regexp_replace(s, HAN, " ")
    s = F.replace(s, F.lit("/"), F.lit(""))
    s = F.regexp_replace(strip_brackets(s), STRAY_BRACKET, "")
    s = F.regexp_replace(s, f"(?U){EDGE}", "")
    s = F.regexp_replace(s, f"(?iU){ENDINGS}", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")
    return reduce(lambda t, v: F.replace(t, F.lit(v[0]), F.lit(v[1])), variants or [], F.lower(s))


def is_notice(normalized: Column) -> Column:
    return normalized.rlike(f"(?U){NOTICE}")


def is_set_or_course(normalized: Column) -> Column:
    return normalized.rlike(f"(?iU){SET_OR_COURSE}")


def is_beverage(original: Column) -> Column:
    """By volume in the original name; normalising would take it off."""
    return original.rlike(f"(?iU){VOLUME}")


def has_term(text: Column, terms: list[str]) -> Column:
    if len(terms) > MOST_EXPRESSIONS:
        return F.size(words_in(text, terms)) > 0
    return reduce(lambda c, t: c | F.contains(text, F.lit(t)), terms, F.lit(False))


def is_branch(name: Column) -> Column:
    return name.rlike(f"(?U){BRANCH}")


def source_url(url: Column) -> Column:
    """Without query, fragment and slashes at the end of the path."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "(?<=[^/:])/+$", "")


def normalize_term(term: Column) -> Column:
    return F.regexp_replace(F.lower(term), r"(?U)\s+", "")


def flat(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def bigrams(text: Column) -> Column:
    """Distinct two-letter windows without spaces; a single letter is itself, an empty text has none."""
    s = flat(text)
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    none = F.array().cast("array<string>")
    return F.when(F.length(s) >= 2, F.array_distinct(windows)).when(F.length(s) == 1, F.array(s)).otherwise(none)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda t: t != ""))


def keyword_tokens(keyword: Column, most: int) -> Column:
    return F.slice(F.filter(F.split(F.lower(F.trim(keyword)), r"\s+"), lambda t: t != ""), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def strict_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def candidate_keys(normalized: Column) -> Column:
    """array<struct<key, allow_contain, ordinal>>: the name; for head_..._last also last+head and last."""
    parts = F.filter(F.transform(F.split(normalized, "_"), lambda p: F.trim(p)), lambda p: p != "")
    head, last = F.get(parts, 0), F.element_at(parts, -1)

    def key(text: Column, allow: Column, ordinal: int) -> Column:
        return F.struct(text.alias("key"), allow.alias("allow_contain"), F.lit(ordinal).alias("ordinal"))

    whole = key(normalized, F.lit(True), 0)
    three = F.array(whole, key(F.concat(last, head), F.lit(True), 1), key(last, F.contains(last, head), 2))
    return F.when(F.contains(normalized, F.lit("_")) & (F.size(parts) >= 2), three).otherwise(F.array(whole))


def origin_rank(origin: Column) -> Column:
    low = F.lower(F.coalesce(origin, F.lit("")))
    ranks = [reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words]) for words in ORIGIN_RANKS]
    return reduce(lambda c, r: c.when(r[1], r[0]), list(enumerate(ranks))[1:], F.when(ranks[0], 0)).otherwise(len(ranks))


def basis_key(basis: Column, origin: Column, code: Column) -> Column:
    """Order among foods of one name: 100 g first, then origin, then code."""
    return F.struct(F.when(F.coalesce(basis, F.lit("100g")) == "100g", 0).otherwise(1).alias("basis"), origin_rank(origin).alias("origin"), code.alias("code"))


def guess_brand(name: Column) -> Column:
    """The name without its last word if that ends as a branch does; empty for a single word."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    is_place = (F.size(words) >= 2) & is_branch(F.element_at(words, -1))
    return F.when(is_place, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.lit(""))


def keyword_tags(normalized: Column, keywords: list[tuple[str, str]]) -> Column:
    """Food types of the keywords that the name holds, less those inside a longer keyword that it holds too."""
    low = F.lower(F.coalesce(normalized, F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(outer_labels(low, keywords), lambda t: t != BLOCKER)))


def category_tags(category: Column, mapping: dict[str, list[str]]) -> Column:
    none = F.array().cast("array<string>")
    if not mapping:
        return none
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.element_at(table, F.trim(category)), none)


def suggest_type(category: Column) -> Column:
    hints = [(F.contains(category, F.lit(h)), t) for h, t in CATEGORY_HINTS]
    return reduce(lambda c, h: c.when(*h), hints[1:], F.when(*hints[0])).otherwise(F.lit(""))


def parse_price(text: Column) -> Column:
    """The first run of digits and commas as a number; none, or zero, is null."""
    digits = F.replace(F.regexp_extract(text, r"[\d,]+", 0), F.lit(","), F.lit(""))
    return F.when(digits.isin("", "0"), F.lit(None).cast("int")).otherwise(digits.try_cast("int"))


def _blank_to_null(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def menu_block(name: Column, price: Column) -> Column:
    """struct<name, price>, null without a name."""
    n = _blank_to_null(name)
    return F.when(n.isNotNull(), F.struct(n.alias("name"), parse_price(price).alias("price")))


def menu_row(text: Column) -> Column:
    """struct<name, price> of a row's lines: a last line that looks like a price, or stands for one, is the price."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), lambda line: line != "")
    last = F.element_at(lines, -1)
    priced = (F.size(lines) > 1) & (last.rlike(PRICE_LINE) | last.isin(*PRICE_PLACEHOLDERS))
    name = F.array_join(F.when(priced, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), " ")
    return F.when(F.size(lines) > 0, F.struct(name.alias("name"), F.when(priced, parse_price(last)).alias("price")))


def place_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"/place/(\d+)", 1)
    return F.when(found != "", found)


def coords_of_url(url: Column) -> Column:
    """struct<lat, lng> of a map url's ``c=lng,lat``, null without it."""
    lng, lat = (F.nullif(F.regexp_extract(url, r"[?&]c=(-?\d+\.\d+),(-?\d+\.\d+)", i), F.lit("")).cast("double") for i in (1, 2))
    return F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def contains_all(field: Column, wanted: Column) -> Column:
    """All tokens in the field, spaces and case aside; false for null."""
    low = flat(F.lower(field))
    return F.coalesce(F.forall(wanted, lambda t: F.contains(low, t)), F.lit(False))


def food_label(name: Column, origin: Column, category: Column) -> Column:
    """``name [origin · category]``, with what there is of the two."""
    inside = F.concat_ws(" · ", F.nullif(origin, F.lit("")), F.nullif(category, F.lit("")))
    return F.when(inside != "", F.concat(name, F.lit(" ["), inside, F.lit("]"))).otherwise(name)


def ocr_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(ocr_text(text), r"^\d+(\.\d+)?", 0), F.lit("")).cast("decimal(18,6)")


def ocr_date(text: Column) -> Column:
    found = F.regexp_extract(text, r"\d{4}[./-]\d{2}[./-]\d{2}", 0)
    return F.try_to_date(F.translate(F.nullif(found, F.lit("")), "./", "--"), "yyyy-MM-dd")
