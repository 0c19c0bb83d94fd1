"""Typed columns to text: money, labels, questions, examples and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.numeric import col, half_up, price_range, unit_hash
from valora.functions.parse import label
from valora.functions.rules import zone_tier


def fmt_money(c: str | Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(col(c), 0)), F.lit("---"))


def fmt_int(c: str | Column) -> Column:
    return F.coalesce(F.floor(col(c)).cast("bigint").cast("string"), F.lit("---"))


def truncate_text(c: str | Column, n: int, mode: str = "hard") -> Column:
    """Whitespace squeezed; cut at ``n`` characters, or at the last blank before them."""
    flat = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    head = F.substring(flat, 1, n)
    if mode == "hard":
        return head
    at_word = F.coalesce(F.nullif(F.regexp_extract(head, r"^(.*) ", 1), F.lit("")), head)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(at_word, F.lit("…")))


def price_band(p: str | Column) -> Column:
    money = fmt_money(p)
    out = F.concat(money, F.lit(fixed.PRICE_BANDS[-1][1]))
    for high, text in reversed(fixed.PRICE_BANDS[:-1]):
        out = F.when(col(p) < high, F.concat(money, F.lit(text))).otherwise(out)
    return F.when(col(p).isNotNull(), out)


def zone_context(name: str | Column) -> Column:
    return F.coalesce(F.concat(col(name), label(zone_tier(name), fixed.ZONE_TEXT, "")), F.lit(""))


def num_txt(c: str | Column, unit: str = "", missing: str = "No especificado") -> Column:
    return F.coalesce(F.concat(F.floor(col(c)).cast("bigint").cast("string"), F.lit(unit)), F.lit(missing))


def bool_txt(c: str | Column) -> Column:
    return F.when(col(c).isNull(), "No especificado").when(col(c) == 1, "Sí").otherwise("No")


def _m2_tier(ratio: Column) -> Column:
    out = F.lit(fixed.M2_TIERS[-1][1])
    for low, text in reversed(fixed.M2_TIERS[:-1]):
        out = F.when(ratio > low, F.lit(text)).otherwise(out)
    return out


def factor_list(tags: Column | None = None) -> Column:
    """Sentences that justify a price, from price, m2 and the condition flags."""
    ratio = F.when(F.col("m2") > 0, F.col("price") / F.col("m2"))
    parts = [
        F.when(
            ratio.isNotNull(),
            F.concat(
                F.lit("La superficie de "), F.floor(F.col("m2")).cast("string"),
                F.lit(" m² implica un precio por m² de $"), F.format_number(half_up(ratio, 0), 0),
                F.lit("/mes, "), _m2_tier(ratio), F.lit(" para la zona."),
            ),
        ),
        F.when(
            F.col("lujo") == 1,
            "El atributo de lujo incrementa el precio entre 20-35% respecto a propiedades estándar.",
        ),
        F.when(F.col("amueblado") == 1, "Estar amueblado agrega aproximadamente 10-20% al precio de renta base."),
        F.when(
            F.col("nuevo") == 1,
            "Al ser construcción nueva, el precio refleja un premium del 5-15% sobre propiedades similares más antiguas.",
        ),
    ]
    if tags is not None:
        top = F.array_join(F.slice(tags, 1, 3), ", ")
        parts.append(
            F.when(
                F.size(tags) > 0,
                F.concat(F.lit("Amenidades como "), top, F.lit(" aumentan el atractivo y el precio de mercado.")),
            )
        )
    parts.append(
        F.when(
            F.col("views") > 50,
            F.concat(
                F.lit("Con "), F.floor(F.col("views")).cast("bigint").cast("string"),
                F.lit(" vistas en portal, esta propiedad tiene alta demanda relativa."),
            ),
        )
    )
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def pick(options: list[str], u: Column) -> Column:
    index = F.floor(u * len(options)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), index)


def question_text(seed: int, tags: Column) -> Column:
    """One of the templates, chosen by the hashed id, filled with the listing's attributes."""
    extra = F.array_join(
        F.concat(
            F.filter(
                F.array(
                    F.when(F.col("amueblado") == 1, "Amueblado"),
                    F.when(F.col("lujo") == 1, "Lujo"),
                    F.when(F.col("nuevo") == 1, "Construcción nueva"),
                ),
                lambda x: x.isNotNull(),
            ),
            F.slice(tags, 1, 2),
        ),
        ", ",
    )
    values = {
        "tipo": label(F.lower(F.col("property_type")), fixed.QUESTION_TYPES, "propiedad"),
        "colonia": F.coalesce(F.col("colonia"), F.lit("Monterrey")),
        "municipio": F.coalesce(F.col("municipio"), F.lit("Monterrey")),
        "rec": num_txt("recamaras", missing="no especificado"),
        "ban": num_txt("banos", missing="no especificado"),
        "m2": num_txt("m2", " m²", missing="superficie no especificada"),
        "extras": F.when(extra != "", F.concat(extra, F.lit(". "))).otherwise(""),
    }
    out = pick(fixed.QUESTION_TEMPLATES, unit_hash("listing_id", seed))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def example_messages(seed: int, tags: Column) -> Column:
    """System, user and assistant turns of one worked valuation."""
    zone = F.coalesce(F.col("colonia"), F.lit("Monterrey"))
    town = F.coalesce(F.col("municipio"), F.lit("Monterrey"))
    lines = [
        F.concat(F.lit("**Colonia:** "), zone, F.lit(", "), town),
        F.concat(F.lit("**Recámaras:** "), num_txt("recamaras")),
        F.concat(F.lit("**Baños:** "), num_txt("banos")),
        F.concat(F.lit("**Superficie:** "), num_txt("m2", " m²", "No especificada")),
        F.concat(F.lit("**Amueblado:** "), bool_txt("amueblado")),
        F.concat(F.lit("**Lujo:** "), bool_txt("lujo")),
        F.concat(F.lit("**Construcción nueva:** "), bool_txt("nuevo")),
        F.when(F.size(tags) > 0, F.concat(F.lit("**Amenidades:** "), F.array_join(tags, ", "))),
        F.when(
            F.col("views").isNotNull(),
            F.concat(F.lit("**Vistas en portal:** "), F.floor(F.col("views")).cast("bigint").cast("string")),
        ),
    ]
    user = F.concat(
        F.lit("Tengo una propiedad con estas características:\n\n"),
        F.concat_ws("\n", *lines),
        F.lit("\n\n"),
        pick(fixed.EXAMPLE_QUESTIONS, unit_hash("listing_id", seed)),
    )
    low, high = price_range("price")
    factors = factor_list(tags)
    bullets = F.array_join(F.transform(factors, lambda f: F.concat(F.lit("- "), f)), "\n")
    advice = F.when(
        F.coalesce(F.col("lujo") == 1, F.lit(False)),
        "Para el segmento lujo, asegúrate de destacar los acabados y la exclusividad de la zona en el anuncio.",
    ).otherwise(
        F.concat(F.lit("Precio competitivo para el segmento. Publicar a "), price_band("price"), F.lit(" es adecuado."))
    )
    answer = F.concat(
        F.lit("Basándome en el mercado actual de Monterrey, el precio estimado de renta para esta propiedad es **"),
        price_band("price"),
        F.lit(" MXN/mes**, con un rango de mercado de **"),
        fmt_money(low), F.lit("–"), fmt_money(high),
        F.lit(" MXN/mes** dependiendo de la negociación y condiciones específicas.\n\n"),
        zone_context("colonia"),
        F.when(
            F.size(factors) > 0,
            F.concat(F.lit("\n\n**Factores que justifican este precio:**\n"), bullets),
        ).otherwise(""),
        F.lit("\n\n**Recomendación:** "),
        advice,
    )

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", F.lit(fixed.EXAMPLE_SYSTEM)), turn("user", user), turn("assistant", answer))


def render_prompt(system: str | Column, user: str | Column, family: str | Column) -> Column:
    fam = F.lit(family) if isinstance(family, str) else family
    out = F.lit(None).cast("string")
    for name, (head, middle, tail) in fixed.CHAT_TEMPLATES.items():
        text = F.concat(F.lit(head), col(system), F.lit(middle), col(user), F.lit(tail))
        out = F.when(fam == name, text).otherwise(out)
    return out


def comparable_line(rank: Column, price: Column) -> Column:
    """``n. zone — attributes → $price MXN/mes`` from columns m2, recamaras, amueblado, lujo, colonia; half a peso goes up."""
    attrs = F.concat_ws(
        ", ",
        F.when(F.col("m2") > 1, F.concat(F.floor(F.col("m2")).cast("string"), F.lit("m²"))),
        F.when(F.col("recamaras") > 0, F.concat(F.col("recamaras").cast("string"), F.lit(" rec"))),
        F.when(F.col("amueblado") == 1, "amueblado"),
        F.when(F.col("lujo") == 1, "lujo"),
    )
    return F.concat(
        F.lit("  "), rank.cast("string"), F.lit(". "), F.coalesce(F.col("colonia"), F.lit("?")), F.lit(" — "),
        F.when(attrs != "", attrs).otherwise("sin datos"),
        F.lit(" → $"), F.format_number(F.round(price), 0), F.lit(" MXN/mes"),
    )


def property_text(question: str = "pregunta") -> Column:
    """Text key of a listing for retrieval."""
    return F.concat_ws(
        " ",
        F.col(question),
        F.nullif(F.col("colonia"), F.lit("")),
        F.nullif(F.col("municipio"), F.lit("")),
        F.when(F.col("recamaras") != 0, F.concat(F.col("recamaras").cast("string"), F.lit(" recamaras"))),
        F.when(F.col("m2") != 0, F.concat(F.col("m2").cast("bigint").cast("string"), F.lit(" metros"))),
    )
