"""Column functions for text, prices, dates and places. None of them is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Python's ``strip`` sees it, as a class of patterns that begin with ``(?U)``.
WHITE = r"\s\x{1c}-\x{1f}"

#: The same as characters.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

PRICE = "decimal(18,6)"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without white space at the ends; blank becomes null. The expression holds ``c`` once, so that texts stripped again and again stay short to plan."""
    return F.try_element_at(F.array_remove(F.array(F.trim(c.cast("string"), F.lit(WHITE_CHARS))), F.lit("")), F.lit(1))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"(?U)[{WHITE}]+", " ")


def upper_stripped(c: Column) -> Column:
    return F.upper(stripped(c))


def proof_type(c: Column) -> Column:
    return F.translate(upper_stripped(c), "- ", "__")


def parse_price(c: Column) -> Column:
    """Price of a text: comma or dot, anything else but digits and minus signs dropped; null if that is no number."""
    kept = F.regexp_replace(F.replace(stripped(c), F.lit(","), F.lit(".")), r"[^0-9.\-]", "")
    return kept.try_cast(PRICE)


def price_of(c: Column, kind: str) -> Column:
    """Price of a column of that type: numbers as they are (NaN and infinity are null), truth values never, texts by ``parse_price``."""
    if kind == "boolean":
        return F.lit(None).cast(PRICE)
    if kind in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string").try_cast(PRICE))
    if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint"):
        return c.try_cast(PRICE)
    return parse_price(c)


def parse_date(c: Column) -> Column:
    """Date of a text, by the first format that fits. A time zone is dropped with the time: the date is the one written."""
    text = stripped(c)
    local = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$", "$1")
    tries = [F.try_to_timestamp(local, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")]
    return F.coalesce(*tries)


def date_of(c: Column, kind: str) -> Column:
    return c.cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else parse_date(c)


def safe_double(c: Column) -> Column:
    """Finite number of a column; null for anything else."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def week_start(d: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", d).cast("date")


def country_code(name: Column) -> Column:
    """ISO alpha-2 of a country given by code or name; null if unknown."""
    return once(upper_stripped(name), _country_code)


def _country_code(upper: Column) -> Column:
    alpha3 = F.when(upper.rlike(r"^\p{L}{3}$"), F.try_element_at(literal_map(fixed.COUNTRY_ALPHA3), upper))
    return F.when(upper.rlike(r"^\p{L}{2}$"), upper).otherwise(F.coalesce(alpha3, F.try_element_at(literal_map(fixed.COUNTRY_NAMES), collapsed(upper))))


def canonical_brand(raw: Column) -> Column:
    """Canonical store brand; if no pattern fits, what stands before the first comma, cut at 80 characters."""
    found = None
    # Most names fit no pattern; looking for a word that every match holds is far cheaper than the pattern itself.
    low = F.lower(F.translate(raw, "\u017f\u0130\u0131\u212a", "siik"))
    for pattern, name, word in fixed.BRANDS:
        fits = low.contains(word) & raw.rlike("(?iuU)" + pattern)
        found = F.when(fits, F.lit(name)) if found is None else found.when(fits, F.lit(name))
    segment = stripped(F.substring_index(raw, ",", 1))
    return F.when(F.nullif(raw, F.lit("")).isNotNull(), found.otherwise(F.substring(segment, 1, 80)))


def city_title(raw: Column) -> Column:
    """City in title case without a district at its end."""
    runs = F.regexp_extract_all(F.lower(stripped(raw)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    title = F.array_join(F.transform(runs, F.initcap), "")
    return stripped(F.regexp_replace(title, "(?iu)" + fixed.DISTRICT, ""))


def raw_brand(*columns: Column) -> Column:
    """The first of some columns that is not blank, with single spaces, cut at 200 characters."""
    return F.substring(collapsed(F.coalesce(*(stripped(c) for c in columns))), 1, 200)


def _check_digit(code: Column, length: int) -> Column:
    """The mod-10 check digit that the digits before the last call for; weights 3, 1, ... from the right."""
    digit = lambda i: F.ascii(F.substring(code, i, 1)) - 48
    odd, even = (sum((digit(i) for i in range(begin, 0, -2)), F.lit(0)) for begin in (length - 1, length - 2))
    return (F.lit(10) - (odd * 3 + even) % 10) % 10


def barcode_error(raw: Column) -> Column:
    """What is wrong with a barcode of 8 or 13 digits; null if nothing is."""
    return code_error(stripped(raw))


def code_error(stripped_code: Column) -> Column:
    """As ``barcode_error`` of a code that is stripped already."""
    return once(stripped_code, _code_error)


def _code_error(code: Column) -> Column:
    got = F.substring(code, -1, 1)

    def checked(n: int) -> Column:
        say = lambda want: F.when(want != got, F.concat(F.lit(f"checksum EAN-{n} invalide (attendu "), want, F.lit(", recu "), got, F.lit(")")))
        return once(_check_digit(code, n).cast("string"), say)

    return (
        F.when(code.isNull(), F.lit("product_code vide"))
        .when(~code.rlike("^[0-9]+$"), F.concat(F.lit("contient des caracteres non numeriques: '"), code, F.lit("'")))
        .when(F.length(code) == 8, checked(8))
        .when(F.length(code) == 13, checked(13))
        .otherwise(F.concat(F.lit("longueur EAN invalide: "), F.length(code).cast("string"), F.lit(" chiffres (attendu 8 ou 13)")))
    )


def discount_error(price: Column, full: Column, discounted: Column) -> Column:
    """What is wrong with a price marked as discounted against its full price; null if nothing is, or nothing can be said."""
    both = discounted & price.isNotNull() & full.isNotNull()
    return F.when(
        both & (full <= price), F.concat(F.lit("prix remisé ("), price.cast("string"), F.lit("€) ≥ prix sans remise ("), full.cast("string"), F.lit("€)"))
    ).when(both & ((full - price) / full > 0.95), F.concat(F.lit("remise > 95% : "), price.cast("string"), F.lit("€ vs "), full.cast("string"), F.lit("€")))


def normal_barcode(raw: Column) -> Column:
    """Digits alone, padded with zeros to 8 or 13; longer ones stay as they are, and none becomes null."""
    digits = F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit(""))
    return F.when(F.length(digits) <= 8, F.lpad(digits, 8, "0")).when(F.length(digits) <= 13, F.lpad(digits, 13, "0")).otherwise(digits)


def dashed_uuid(raw: Column) -> Column:
    """A UUID of 32 hexadecimal digits in its form with dashes, lower case; other texts stay as they are."""
    bare = F.replace(F.lower(raw), F.lit("-"), F.lit(""))
    parts = "".join(rf"([0-9a-f]{{{n}}})" for n in (8, 4, 4, 4, 12))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, rf"^{parts}\R?$", "$1-$2-$3-$4-$5")).otherwise(raw)
