"""Rule tables compiled to column expressions: additive scores, segments, reasons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import col
from valora.functions.parse import matches


@dataclass(frozen=True)
class Rule:
    """``weight`` points when ``column op value`` holds.

    Rules sharing a ``ladder`` name are tried in order and only the first that holds counts.
    """

    column: str
    op: str
    value: object
    weight: int
    ladder: str | None = None

    def predicate(self) -> Column:
        c = F.col(self.column)
        tests: dict[str, Callable[[], Column]] = {
            "eq": lambda: c == F.lit(self.value),
            "le": lambda: c <= F.lit(self.value),
            "ge": lambda: c >= F.lit(self.value),
            "in": lambda: c.isin(list(self.value)),
            "like": lambda: F.lower(c).rlike(self.value),
        }
        return F.coalesce(tests[self.op](), F.lit(False))


# --- fixed values: lead score rules --------------------------------------------------------
STUDENT_RULES = (
    Rule("price", "le", 12_000, 3, "price"),
    Rule("price", "le", 18_000, 2, "price"),
    Rule("price", "le", 25_000, 1, "price"),
    Rule("furnished", "eq", 1, 3),
    Rule("property_type", "in", ("departamento", "casa"), 2),
    Rule("description", "like", fixed.SCORE_STUDENT, 4),
    Rule("has_minisplit_ac", "eq", 1, 1),
    Rule("bedrooms", "in", (1, 2), 1),
    Rule("allows_pets", "eq", 1, 1),
)
SENIOR_RULES = (
    Rule("has_elevator", "eq", 1, 4),
    Rule("floor", "eq", 0, 3),
    Rule("has_security_24h", "eq", 1, 3),
    Rule("has_lobby", "eq", 1, 1),
    Rule("property_type", "in", ("departamento", "casa"), 2),
    Rule("description", "like", fixed.SCORE_SENIOR, 3),
    Rule("price", "le", 30_000, 2),
    Rule("has_gym", "eq", 1, 1),
    Rule("has_garden", "eq", 1, 1),
    Rule("furnished", "eq", 1, 1),
)
RELOCATION_RULES = (
    Rule("furnished", "eq", 1, 4),
    Rule("has_security_24h", "eq", 1, 3),
    Rule("has_gym", "eq", 1, 2),
    Rule("has_pool", "eq", 1, 2),
    Rule("has_elevator", "eq", 1, 2),
    Rule("has_lobby", "eq", 1, 1),
    Rule("has_sala_juntas", "eq", 1, 1),
    Rule("has_coworking", "eq", 1, 1),
    Rule("property_type", "in", ("departamento", "oficina"), 1),
    Rule("colonia", "in", tuple(fixed.ZONES_RELOCATION), 3),
    Rule("description", "like", fixed.SCORE_RELOCATION, 3),
    Rule("price", "ge", 25_000, 2),
    Rule("price", "ge", 50_000, 1),
)
PROFILES = {"student": STUDENT_RULES, "senior": SENIOR_RULES, "relocation": RELOCATION_RULES}


def score(rules: Sequence[Rule]) -> Column:
    """Sum of the weights of the rules that hold; a rule on a NULL column does not hold."""
    total = F.lit(0)
    ladders: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.ladder:
            ladders.setdefault(rule.ladder, []).append(rule)
        else:
            total = total + F.when(rule.predicate(), rule.weight).otherwise(0)
    for steps in ladders.values():
        step = F.lit(0)
        for rule in reversed(steps):
            step = F.when(rule.predicate(), rule.weight).otherwise(step)
        total = total + step
    return total


def max_score(rules: Sequence[Rule]) -> int:
    """Highest reachable score, derived from the table so that it can never disagree with it."""
    best: dict[str, int] = {}
    total = 0
    for rule in rules:
        if rule.ladder:
            best[rule.ladder] = max(best.get(rule.ladder, 0), rule.weight)
        else:
            total += rule.weight
    return total + sum(best.values())


def segment_by_text(text: str | Column) -> Column:
    senior = matches(text, fixed.KW_ACCESS) | matches(text, fixed.KW_SECURITY) | matches(text, fixed.KW_QUIET)
    return F.when(matches(text, fixed.KW_STUDENT), "student").when(senior, "senior").otherwise("general")


def segment_flags(text: str | Column, price: str, rooms: str, ptype: str) -> dict[str, Column]:
    """The boolean parts of the budget-and-rooms segmentation."""
    home = F.coalesce(F.lower(F.trim(col(ptype))).isin(fixed.RESIDENTIAL), F.lit(False))
    rooms0 = F.coalesce(col(rooms), F.lit(0))
    words = {
        "kw_student": matches(text, fixed.KW_RULE_STUDENT),
        "kw_access": matches(text, fixed.KW_RULE_ACCESS),
        "kw_security": matches(text, fixed.KW_RULE_SECURITY),
        "kw_quiet": matches(text, fixed.KW_RULE_QUIET),
        "kw_comfort": matches(text, fixed.KW_RULE_COMFORT),
    }
    student = (
        home
        & F.coalesce(col(price) <= fixed.PRICE_STUDENT_MAX, F.lit(False))
        & (rooms0.isin(0, 1, 2) | words["kw_student"])
    )
    senior = (
        home
        & F.coalesce(col(price).between(fixed.PRICE_SENIOR_MIN, fixed.PRICE_SENIOR_MAX), F.lit(False))
        & rooms0.isin(0, 1, 2, 3)
        & (words["kw_access"] | words["kw_security"] | words["kw_quiet"] | words["kw_comfort"])
    )
    return {**words, "is_student": student, "is_senior": senior}


def segment_from_flags() -> Column:
    return F.when(F.col("is_student"), "student").when(F.col("is_senior"), "senior").otherwise("general")


def segment_reason(price: str, rooms: str) -> Column:
    """The rules that fired, joined by ' | '; expects the columns of :func:`segment_flags`."""
    # Halves go up; format_number alone takes them to the even neighbour.
    money = F.concat(F.lit("precio $"), F.format_number(F.floor(col(price) + 0.5), 0))
    # An unknown number of rooms passes the filter as 0 but is not itself a reason.
    few_rooms = col(rooms).isin(0, 1, 2)
    student = F.concat_ws(
        " | ",
        F.when(col(price) <= fixed.PRICE_STUDENT_MAX, money),
        F.when(F.col("kw_student"), "keyword universitario"),
        F.when(few_rooms, F.concat(col(rooms).cast("int").cast("string"), F.lit(" rec."))),
    )
    senior = F.concat_ws(
        " | ",
        F.when(F.col("kw_access"), "accesibilidad"),
        F.when(F.col("kw_security"), "seguridad 24h"),
        F.when(F.col("kw_quiet"), "zona tranquila"),
        F.when(F.col("kw_comfort"), "jardín/patio"),
        money,
    )
    return F.when(F.col("is_student"), student).when(F.col("is_senior"), senior).otherwise("")


def zone_tier(name: str | Column) -> Column:
    low = F.lower(col(name))

    def member(zones: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(z) for z in zones]), lambda z: low.contains(z))

    return F.when(low.isNull(), F.lit(None)).when(member(fixed.ZONES_PREMIUM), "premium").when(
        member(fixed.ZONES_MIDDLE), "media"
    ).otherwise("otra")


def stars(p: str | Column) -> Column:
    return F.when(col(p) < 0.001, "***").when(col(p) < 0.01, "**").when(col(p) < 0.05, "*").otherwise("n.s.")
