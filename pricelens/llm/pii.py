"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Fixed values: the four base patterns and their limits, which the results must follow. Lookbehinds with ``\\G`` and possessive
repeats leave the matches of those patterns as they are, and keep the matcher from trying every start inside one long run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused
from .spans import SPAN, chars_of, digits_of, find_spans, joined

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Percent, without and with a word of the kind within ``NEAR`` characters before the span.
SCORES = {"email": (90, 100), "ip": (60, 85), "card": (80, 95), "phone": (60, 90), "iban": (90, 100)}
WORDS = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": r"card|visa|credit|payment|karte|tarjeta|carte",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|llame",
    "iban": r"iban|account|bank|konto|cuenta|compte",
}
NEAR = 40
LIKELY = 85


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""
    worth = F.transform(
        F.reverse(chars_of(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """The mod-97 check of an international account number without spaces."""
    moved = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))
    rest = F.aggregate(
        chars_of(moved), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )
    return rest == 1


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _confirm(kind: str):
    if kind == "ip":
        return lambda m: F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        return lambda m: F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m))
    if kind == "phone":
        return lambda m: F.length(digits_of(m)).between(8, 15)
    if kind == "iban":
        return lambda m: mod97(F.replace(m, F.lit(" "), F.lit("")))
    return None


def pii_spans(text: Column) -> dict[str, Column]:
    """An array of spans for each kind; ``text`` must not be null."""
    gates = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.rlike(r"\+[0-9]"),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}

    def score(kind: str):
        low, high = SCORES[kind]
        before = lambda start: F.lower(F.substring(text, F.greatest(start - NEAR + 1, F.lit(1)), F.least(start, F.lit(NEAR))))
        return lambda start: F.when(before(start).rlike(WORDS[kind]), high).otherwise(low)

    return {kind: find_spans(kind, text, patterns[kind], gates[kind], _confirm(kind), score(kind)) for kind in KINDS}


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with a column ``into``: a struct with one array of (kind, start, end, score) for each kind.

    Positions are code points, end exclusive. A null text counts as empty and has no spans. Every row is kept.
    """
    found = pii_spans(text_of(text))
    return df.withColumn(into, F.struct(*(found[k].alias(k) for k in KINDS)))


def all_spans(pii: str = "pii") -> Column:
    return F.concat(*(F.col(f"{pii}.{k}") for k in KINDS)).cast(SPAN)


def redact(df: DataFrame, text: str = "text", at_least: int = 0, mark: str = "[{}]", recount: str | None = None) -> DataFrame:
    """``df`` with each span of at least that score in ``text`` replaced by its kind, and ``recount`` set to the new length.

    Where spans overlap, all of them go and the kind of the first is put there. Null texts stay null. All columns and rows of ``df``
    stay, whatever their names; an empty table gives an empty result.
    """
    pii, chosen = unused(df, "pii", "spans")
    found = find_pii(df, text, pii)
    spans = F.array_sort(F.transform(F.filter(all_spans(pii), lambda s: s["score"] >= at_least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.col(f"`{text}`")

    def step(done: Column, s: Column) -> Column:
        fresh = F.concat(
            done["out"],
            F.when(s["start"] >= done["at"], F.concat(F.substring(whole, done["at"] + 1, s["start"] - done["at"]), F.replace(F.lit(mark), F.lit("{}"), s["kind"]))).otherwise(""),
        )
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), fresh.alias("out"))

    masked = F.aggregate(
        F.col(chosen),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda done: F.concat(done["out"], F.substring(whole, done["at"] + 1, F.length(whole))),
    )
    out = found.withColumn(chosen, spans).withColumn(text, F.when(F.size(chosen) > 0, masked).otherwise(whole))
    if recount in df.columns:
        out = out.withColumn(recount, F.length(F.col(f"`{text}`")).cast(df.schema[recount].dataType))
    return out.select(*(f"`{c}`" for c in df.columns))


def pii_report(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, digest of the base spans, all spans, and how many of them are likely.

    A null text counts as empty and has no spans. Every row is kept, also one that repeats an id; texts are read whole, and an empty table gives an empty result.
    """
    found = find_pii(df.select(doc_id, text), text, "__pii").select(
        F.col(doc_id).alias("doc_id"),
        *(F.size(f"__pii.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        joined(F.concat(*(F.col(f"__pii.{k}") for k in BASE_KINDS))).alias("__base"),
        joined(all_spans("__pii")).alias("spans"),
        F.size(F.filter(all_spans("__pii"), lambda s: s["score"] >= LIKELY)).cast("long").alias("n_likely"),
    )
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("__base", 256).alias("base_sha256"), "spans", "n_likely")
