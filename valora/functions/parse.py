"""Text to typed columns: listings, questions and answers.

Java regular expressions return '' where nothing matches, so every capture goes through
``nullif``; ``\\w`` is ASCII and case folding of accents needs ``(?u)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import col


def capture(c: str | Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def extract_num(c: str | Column, pattern: str) -> Column:
    return F.regexp_replace(capture(c, pattern), ",", "").try_cast("double")


def matches(c: str | Column, pattern: str) -> Column:
    return F.coalesce(F.lower(col(c)).rlike(pattern), F.lit(False))


def once(expr: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``expr`` once per row and hand the value to ``use``, however often that names it."""
    return F.transform(F.array(expr), use)[0]


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return F.coalesce(out, F.lit(False))


def split_location(c: str | Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(col(c), ","), lambda x: F.trim(x))
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def split_address(c: str | Column, states: Sequence[str] = tuple(fixed.STATES)) -> dict[str, Column]:
    """Zone, town, state; two parts with a known state mean town and state; else only the first."""
    parts = F.transform(F.split(col(c), ","), lambda x: F.trim(x))
    size = F.size(parts)
    p0, p1, p2 = (F.get(parts, F.lit(i)) for i in range(3))
    town_state = (size == 2) & F.lower(p1).isin(list(states))
    return {
        "colonia": F.when(~town_state, p0),
        "municipio": F.when(town_state, p0).when(size.isin(2, 3), p1),
        "estado": F.when(town_state, p1).when(size == 3, p2),
    }


def split_latlon(c: str | Column, strict: bool = True) -> tuple[Column, Column]:
    parts = F.transform(F.split(col(c), ","), lambda x: F.trim(x))
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    if not strict:
        return lat, lon
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(good, lat), F.when(good, lon)


def days_listed(c: str | Column) -> Column:
    low = F.lower(col(c))
    return F.when(low.rlike("hoy|today"), 0).otherwise(capture(low, r"(\d+)").try_cast("int"))


def clean_url(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(c)), "^http://", "https://")


def abs_url(base: str, href: str | Column) -> Column:
    return F.when(col(href).startswith("http"), col(href)).otherwise(F.concat(F.lit(base), col(href)))


def listing_id(c: str | Column) -> Column:
    return capture(F.trim(col(c)), fixed.LISTING_ID)


def map_literal(mapping: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def label(c: str | Column, mapping: Mapping[str, str], default: str | Column) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.element_at(map_literal(mapping), col(c)), fallback)


def canonical_type(c: str | Column, mapping: Mapping[str, str] = fixed.TYPE_MAP) -> Column:
    key = F.lower(F.trim(col(c)))
    return F.when(key.isNull(), F.lit("otro")).otherwise(label(key, mapping, key))


def classify_type(text: str | Column, rules=fixed.TYPE_RULES, default: str = "otro") -> Column:
    def first_rule(low: Column) -> Column:
        out = F.lit(default)
        for name, words in reversed(list(rules)):
            out = F.when(has_any(low, words), F.lit(name)).otherwise(out)
        return out

    return once(F.lower(col(text)), first_rule)


def is_owner(text: str | Column) -> Column:
    def verdict(low: Column) -> Column:
        return (
            F.when(has_any(low, fixed.OWNER_WORDS), True)
            .when(has_any(low, fixed.AGENCY_WORDS), False)
            .otherwise(False)
        )

    return once(F.lower(col(text)), verdict)


def extract_attrs(text: str | Column) -> dict[str, Column]:
    return {
        "area_m2": extract_num(text, fixed.TEXT_M2),
        "bedrooms": extract_num(text, fixed.TEXT_ROOMS).cast("int"),
        "bathrooms": extract_num(text, fixed.TEXT_BATHS),
        "parking": extract_num(text, fixed.TEXT_PARKING).cast("int"),
    }


def parse_price(c: str | Column, keep_dot: bool = True) -> Column:
    kept = r"[^0-9.]" if keep_dot else r"[^0-9]"
    return F.nullif(F.regexp_replace(col(c), kept, ""), F.lit("")).try_cast("double")


def digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^0-9]", "")


def extract_phone(text: str | Column, lo: int = 10, hi: int = 13) -> Column:
    found = F.regexp_extract_all(col(text), F.lit(fixed.PHONE), F.lit(0))
    good = F.filter(found, lambda x: F.length(digits(x)).between(lo, hi))
    return F.trim(F.get(good, F.lit(0)))


def clean_phone(c: str | Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 10, F.substring(d, 1, 10))


def is_valid_phone(c: str | Column) -> Column:
    return F.coalesce(digits(c).rlike(r"\d{10}"), F.lit(False))


def null_sentinel(c: str | Column, value: str) -> Column:
    return F.nullif(col(c), F.lit(value))


def collect_tags(cols: Sequence[str | Column]) -> Column:
    """The non-missing tags of repeated columns, trimmed."""
    tags = F.transform(F.array(*[col(c) for c in cols]), lambda x: F.trim(x))
    return F.filter(tags, lambda x: x.isNotNull() & ~F.lower(x).isin("", "nan"))


def tag_flags(tags: str | Column, mapping: Mapping[str, Sequence[str]] = fixed.TAG_FLAGS) -> dict[str, Column]:
    def flag(words: Sequence[str]) -> Column:
        return F.exists(col(tags), lambda x: has_any(F.lower(x), words)).cast("int")

    return {name: flag(words) for name, words in mapping.items()}


def text_flags(text: str | Column, words: Sequence[str]) -> dict[str, Column]:
    low = F.lower(col(text))
    return {f"feat_{w.replace(' ', '_')}": F.coalesce(low.contains(w), F.lit(False)).cast("int") for w in words}


def text_tags(text: str | Column, words: Sequence[str] = tuple(fixed.TEXT_AMENITIES)) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    return once(F.lower(F.coalesce(col(text), F.lit(""))), lambda low: F.filter(listed, lambda w: low.contains(w)))


def amenity_count(cols: Sequence[str | Column], mode: str = "flags") -> Column:
    """``flags`` sums 0/1 columns with NULL as 0; ``tags`` counts non-NULL columns."""
    total = F.lit(0)
    for c in cols:
        total = total + (F.coalesce(col(c), F.lit(0)) if mode == "flags" else col(c).isNotNull().cast("int"))
    return total


def extract_floor(text: str | Column) -> Column:
    return F.coalesce(*[capture(text, p).try_cast("int") for p in fixed.FLOOR_PATTERNS])


def categorise_poi(activity: str | Column, cats: Mapping[str, Sequence[str]] = fixed.POI_CATEGORIES) -> Column:
    """All categories whose words occur in the activity name; they overlap, hence an array."""
    def marks(low: Column) -> Column:
        found = [F.when(has_any(low, [w.lower() for w in words]), F.lit(cat)) for cat, words in cats.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return once(F.lower(F.coalesce(col(activity), F.lit(""))), marks)


def tokenize(text: str | Column, mode: str = "words") -> Column:
    """``words``: runs of letters, digits and underscores; ``letters``: runs of Spanish letters;
    ``letters4``: those of four or more."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    pattern = {"words": r"([\p{L}\p{N}_]+)", "letters": "([a-záéíóúüñ]+)", "letters4": "([a-záéíóúüñ]{4,})"}[mode]
    return F.regexp_extract_all(low, F.lit(pattern), F.lit(1))


def extract_price(text: str | Column, profile: str) -> Column:
    """First in-range price among the profile's patterns, in order of the patterns."""
    patterns, lo, hi, inclusive = fixed.ANSWER_PROFILES[profile]

    def ok(v: Column) -> Column:
        return v.between(lo, hi) if inclusive else (v > lo) & (v < hi)

    # Each pattern runs once per row; the array keeps their order.
    found = F.array(*[extract_num(F.trim(col(text)), p) for p in patterns])
    return F.get(F.filter(found, ok), F.lit(0))


def is_on_topic(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike(fixed.TOPIC), F.lit(False))


def parse_question(text: str | Column) -> dict[str, Column]:
    t = col(text)
    return {
        "colonia": F.trim(capture(t, fixed.Q_ZONE)),
        "m2": extract_num(t, fixed.Q_M2),
        "recamaras": extract_num(t, fixed.Q_ROOMS),
        "banos": extract_num(t, fixed.Q_BATHS),
        "lujo": t.rlike(fixed.Q_LUXURY).cast("int"),
        "amueblado": t.rlike(fixed.Q_FURNISHED).cast("int"),
        "nuevo": t.rlike(fixed.Q_NEW).cast("int"),
        "amenidades": text_tags(t, fixed.QUESTION_AMENITIES),
    }


def parse_question_v2(text: str | Column) -> dict[str, Column]:
    """As above with number words, parking and a lazily matched zone of up to four words."""
    t = col(text)
    words = "|".join(fixed.NUMBER_WORDS)

    def count_of(noun: str) -> Column:
        spelled = F.element_at(map_literal(fixed.NUMBER_WORDS), F.lower(capture(t, rf"(?iu)\b({words})\s+{noun}")))
        return F.coalesce(extract_num(t, rf"(?iu)(\d+(?:\.\d)?)\s*{noun}"), spelled.cast("double"))

    out = parse_question(text)
    out["colonia"] = F.trim(capture(t, fixed.Q_ZONE_LAZY))
    out["recamaras"] = count_of("rec[áa]mara")
    out["banos"] = count_of("ba[ñn]o")
    out["estacionamientos"] = count_of("(?:estacionamiento|caj[oó]n|cochera)")
    return out


def escape_words(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)
