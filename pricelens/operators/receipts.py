"""Receipts: from a corpus of texts, transcribed or JSON, to tickets and line items.

Everything is an expression within a row, so a corpus is parsed where it lies. Lines of a text are classified by patterns, and
one fold over them assembles the items; it carries the name that waits for a price, the items so far and how many lines ahead
are already used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import WHITE, collapsed, once, stripped
from ..schemas import RECEIPT

#: Patterns and words that receipts are read by.
PRICE = r"\d{1,4}[.,]\d{2}"
DATE_TIMES = [
    (r"(\d{2})[/\-.](\d{2})[/\-.](\d{4})\s+(\d{1,2})[:hH](\d{2})", "dmy"),
    (r"(\d{2})[/\-.](\d{2})[/\-.](\d{2})\s+(\d{1,2})[:hH](\d{2})", "dmy"),
    (r"(\d{4})[/\-.](\d{2})[/\-.](\d{2})\s+(\d{1,2})[:hH](\d{2})", "ymd"),
    (r"(\d{2})[/\-.](\d{2})[/\-.](\d{4})\b", "dmy"),
]
JSON_DATES = [*((f"^{p}$", order) for p, order in DATE_TIMES[:3]), (r"^(\d{2})[/\-.](\d{2})[/\-.](\d{4})$", "dmy"), (r"^(\d{2})[/\-.](\d{2})[/\-.](\d{2})$", "dmy")]
QUANTITY = rf"^\s*(\d{{1,3}})\s*[xX×]\s*({PRICE})\s*$"
WEIGHT = rf"(?iu)(\d+[.,]\d+)\s*kg\s*[xX×]?\s*({PRICE})\s*(?:€/?kg)?"
KG_ONLY = r"(?iu)^(\d+[.,]\d+)\s*kg\s*(?:€|EUR)?\s*$"
PER_KG = rf"(?iu)^({PRICE})\s*(?:€|EUR)?\s*/?\s*kg\s*$"
PRODUCT = rf"^(.+?)\s+({PRICE})\s*(?:€|EUR)?\s*[A-Z0-9]?\s*$"
LONE_PRICE = rf"^({PRICE})\s*(?:€|EUR)?\s*(?:\d+)?\s*$"
LONE_QUANTITY = r"^\s*(\d{1,3})\s*[xX×]\s*$"
SECTION = r"^>{1,2}\s+"
LONE_DATE, LONE_TIME = r"^(\d{2})[/\-.](\d{2})[/\-.](\d{2,4})$", r"^(\d{1,2}):(\d{2})$"
HEADER_NOISE = r"(?iu)^(www\.|http|@|tel\b|tél\b|fax\b|siret|siren|rcs|tva\s*intracom)"
STREET = r"(?iu)\b(rue|avenue|av\.?|bd|boulevard|chemin|place|route|rte|impasse|allée|allee|zone|zac|zi)\b"
IGNORED = [
    "total", "sous-total", "sous total", "sstotal", "tva", "t.v.a", "ht", "ttc", "net a payer", "net à payer", "a payer", "à payer", "montant", "espece", "espèce", "especes", "espèces", "carte bancaire", "cb ",
    "cheque", "chèque", "rendu", "monnaie", "remise", "fidelite", "fidélité", "points", "client", "merci", "au revoir", "siret", "tel ", "tél ", "rcs", "ape ", "naf ", "ticket", "caisse", "vendeur",
    "operateur", "opérateur", "code", "facture", "n°", "article(s)", "articles", "heure", "telephone", "téléphone", "fruits", "poisson", "chocolat", "dietetique", "diététique",
]
FOOTER = ["total", "net a payer", "net à payer", "a payer", "à payer", "ttc", "carte bancaire", "espece", "espèce"]
CHATTY = ["note:", "the image shows", "i think", "newspaper", "this image", " cette image", "je pense"]
CHAT_PREFIX = r"(?iu)^(?:note\s*:|the image shows|i think|here is|voici|il s'agit)"
BAD_STORE = r"(?iu)[(){}]|^(?:here|note|the image)"
HEADER_LINES = 6
#: What every dated line holds; line breaks as patterns see them.
DAY, BREAKS = r"\d{2}[/\-.]\d{2}[/\-.]\d{2}", r"\n\r\x0b\f\x85\u2028\u2029"

ITEM = "struct<nom_produit:string,prix_unitaire_ou_kg:double,unites:int>"
TICKET = f"struct<date:string,chaine_supermarche:string,adresse:string,produits:array<{ITEM}>>"


def _any_of(line: Column, words: list[str]) -> Column:
    least = [w for w in words if not any(o != w and o in w for o in words)]  # what holds a longer one holds these
    return once(F.lower(line), lambda low: reduce(Column.__or__, (low.contains(w) for w in least)))


def _number(line: Column, pattern: str, group: int) -> Column:
    """The number in a group of a pattern; null where the line is not of that pattern, as nothing is found then."""
    return F.replace(F.regexp_extract(line, pattern, group), F.lit(","), F.lit(".")).try_cast("double")


def _letters(line: Column) -> Column:
    return F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))


def plausible(name: Column) -> Column:
    """Whether a line may name a product."""
    return (F.length(name) >= 2) & ~name.rlike(PER_KG) & ~name.rlike(LONE_PRICE) & name.rlike(r"\p{L}[^\p{L}]*\p{L}")


def clean_lines(text: Column) -> Column:
    """The lines of a text, stripped and with single spaces, without empty ones."""
    # White space within lines is collapsed in one pass over the text; single spaces, which are most of it, are not touched.
    spaced = F.regexp_replace(text, rf"(?U) [{WHITE}&&[^{BREAKS}]]+|[{WHITE}&&[^{BREAKS} ]][{WHITE}&&[^{BREAKS}]]*", " ")
    return F.filter(F.transform(F.split(spaced, r"\R"), lambda x: F.trim(x)), lambda x: x != "")


def _composed(text: Column, pattern: str, order: str) -> Column:
    """``yyyyMMdd HH:mm`` of the first match of a date pattern; null if there is none, or none such date."""
    a, b, c = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    year, day = (c, a) if order == "dmy" else (a, c)
    timed = pattern.count("(") > 3
    hour, minute = (F.lpad(F.regexp_extract(text, pattern, 4), 2, "0"), F.regexp_extract(text, pattern, 5)) if timed else (F.lit("00"), F.lit("00"))
    made = F.concat(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), b, day, F.lit(" "), hour, F.lit(":"), minute)
    return F.when(text.rlike(pattern) & F.try_to_timestamp(made, F.lit("yyyyMMdd HH:mm")).isNotNull(), made)


def receipt_date(lines: Column, dated: Column) -> Column:
    """``yyyyMMdd HH:mm`` of the first of the ``dated`` lines that names a day there is, else of the last lone date and last lone time; empty if there is none."""
    dated = F.transform(dated, lambda x: F.coalesce(*(_composed(x, p, order) for p, order in DATE_TIMES)))
    lone = lambda p: F.try_element_at(F.filter(lines, lambda x: x.rlike(p)), F.lit(-1))
    both = F.concat_ws(" ", lone(LONE_DATE), lone(LONE_TIME))
    return F.coalesce(F.try_element_at(F.filter(dated, lambda d: d.isNotNull()), F.lit(1)), *(_composed(both, f"^{p}$", order) for p, order in DATE_TIMES[:2]), F.lit(""))


def _has_date(line: Column) -> Column:
    return line.rlike(DAY) & reduce(Column.__or__, (line.rlike(p) for p, _ in DATE_TIMES))


def receipt_header(marked: Column) -> Column:
    """struct(chain, address, used): the store's chain and address among the first marked lines, and the numbers of lines that are header."""
    first = F.transform(F.slice(marked, 1, HEADER_LINES), lambda x, i: F.struct(x["line"].alias("line"), x["dated"].alias("dated"), x["priced"].alias("priced"), i.alias("nr")))
    start = F.struct(F.lit("").alias("chain"), F.array().cast("array<string>").alias("address"), F.array().cast("array<int>").alias("used"), F.lit(False).alias("stop"))

    def state(s: Column, chain=None, address=None, used=None, stop=None) -> Column:
        return F.struct(*(F.coalesce(new, s[k]).alias(k) if new is not None else s[k].alias(k) for k, new in (("chain", chain), ("address", address), ("used", used), ("stop", stop))))

    def step(s: Column, x: Column) -> Column:
        line, mine = x["line"], F.concat(s["used"], F.array(x["nr"]))
        chain_like = (_letters(line) >= 3) & (_letters(line) / F.length(line) >= 0.5)
        return (
            F.when(s["stop"], state(s))
            .when(line.rlike(HEADER_NOISE), state(s, used=mine))
            .when(x["dated"], state(s, used=mine, stop=F.lit(True)))
            .when(x["priced"], state(s, stop=F.lit(True)))
            .when((s["chain"] == "") & chain_like, state(s, chain=line, used=mine))
            .when((s["chain"] != "") & (line.rlike(r"\b\d{5}\b") | line.rlike(STREET)), state(s, address=F.concat(s["address"], F.array(line)), used=mine))
            .otherwise(state(s))
        )

    return F.aggregate(first, start, step, lambda s: F.struct(s["chain"].alias("chain"), F.array_join(s["address"], ", ").alias("address"), s["used"].alias("used")))


def _marked(line: Column) -> Column:
    """What a line is, worked out once: numbers are null where it is no line of that kind. Most kinds have a price, so other lines are not searched for them."""
    kg = F.when(F.lower(line).contains("kg"), F.struct(_number(line, WEIGHT, 2).alias("weight"), line.rlike(KG_ONLY).alias("only"), _number(line, PER_KG, 1).alias("price")))
    quantity = F.when(line.rlike(QUANTITY), F.struct(_number(line, QUANTITY, 1).cast("int").alias("times"), _number(line, QUANTITY, 2).alias("each")))
    none = F.lit(None).cast("double")

    def mark(priced: bool) -> Column:
        return F.struct(
            line.alias("line"), (line.startswith(">") & line.rlike(SECTION)).alias("section"), _has_date(line).alias("dated"), F.lit(priced).alias("priced"), kg.alias("kg"),
            (_number(line, LONE_PRICE, 1) if priced else none).alias("price"), (none if priced else _number(line, LONE_QUANTITY, 1)).cast("int").alias("count"),
            (quantity if priced else F.when(F.lit(False), quantity)).alias("quantity"), (_number(line, PRODUCT, 2) if priced else none).alias("product"),
        )

    return F.when(line.rlike(PRICE), mark(True)).otherwise(mark(False))


def _product_name(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, PRODUCT, 1), r"^[ .\-:]+|[ .\-:]+$", "")


def receipt_items(marked: Column, header: Column) -> Column:
    """The items of a receipt's marked lines, those numbered in ``header`` left out."""
    ahead = F.transform(
        marked,
        lambda x, i: F.struct(x.alias("this"), F.try_element_at(marked, i + 2).alias("next"), F.try_element_at(marked, i + 3).alias("after"), F.array_contains(header, i).alias("header")),
    )
    start = F.struct(F.lit(None).cast("string").alias("pending"), F.array().cast(f"array<{ITEM}>").alias("items"), F.lit(0).alias("skip"), F.lit(False).alias("done"), F.lit(False).alias("begun"))
    none = F.lit(None).cast("string")

    def state(s: Column, pending: Column | None = None, items: Column | None = None, skip: Column | int = 0, done: Column | None = None, begun: Column | None = None) -> Column:
        return F.struct(
            (s["pending"] if pending is None else pending).alias("pending"), (s["items"] if items is None else items).alias("items"), (F.lit(skip) if isinstance(skip, int) else skip).alias("skip"),
            (s["done"] if done is None else done).alias("done"), (s["begun"] if begun is None else begun).alias("begun"),
        )

    def sold(s: Column, name: Column, price: Column, units: Column = F.lit(1), skip: Column | int = 0, ok: Column = F.lit(True)) -> Column:
        item = F.struct(name.alias("nom_produit"), F.bround(price, 2).alias("prix_unitaire_ou_kg"), units.cast("int").alias("unites"))
        return state(s, none, F.when(ok, F.concat(s["items"], F.array(item))).otherwise(s["items"]), skip, None, s["begun"] | ok)

    def product(s: Column, name: Column, ok: Column, this: Column, nxt: Column, used: Column) -> Column:
        return sold(s, name, F.coalesce(nxt["quantity"]["each"], nxt["kg"]["weight"], this["product"]), F.coalesce(nxt["quantity"]["times"], F.lit(1)), used, ok)

    def step(s: Column, x: Column) -> Column:
        this, nxt, after = x["this"], x["next"], x["after"]
        waits, price, total = s["pending"].isNotNull(), this["price"], nxt["price"]  # a line waits only if it is plausible
        by_total = F.when(price > 0, F.greatest(F.lit(1), F.bround(total / price, 0).cast("int"))).otherwise(1)
        is_total, counted = total.isNotNull(), nxt["count"].isNotNull()
        units = F.when(is_total & after.isNotNull(), F.coalesce(after["count"], by_total)).when(counted, nxt["count"]).when(is_total & (price > 0), by_total).otherwise(1)
        used = F.when(is_total & after.isNotNull(), 2).when(counted | (is_total & (price > 0)), 1).otherwise(0)
        last = F.try_element_at(s["items"], F.lit(-1))
        recounted = F.concat(
            F.slice(s["items"], F.lit(1), F.greatest(F.size(s["items"]) - 1, F.lit(0))),
            F.array(F.struct(last["nom_produit"].alias("nom_produit"), last["prix_unitaire_ou_kg"].alias("prix_unitaire_ou_kg"), this["count"].alias("unites"))),
        )
        ahead_used = F.when(nxt["quantity"].isNotNull() | nxt["kg"]["weight"].isNotNull(), 1).otherwise(0)
        return (
            F.when(s["done"], state(s))
            .when(s["skip"] > 0, state(s, skip=s["skip"] - 1))
            .when(x["header"], state(s))
            .when(this["section"], state(s, none))
            .when(this["dated"] & this["product"].isNull(), state(s))
            .when(_any_of(this["line"], IGNORED), F.when(s["begun"] & _any_of(this["line"], FOOTER), state(s, done=F.lit(True))).otherwise(state(s, none)))
            .when(this["kg"]["weight"].isNotNull() & waits, sold(s, s["pending"], this["kg"]["weight"]))
            .when(waits & this["kg"]["only"] & nxt["kg"]["price"].isNotNull(), sold(s, s["pending"], nxt["kg"]["price"], skip=1))
            .when(this["count"].isNotNull() & (F.size(s["items"]) > 0), state(s, none, recounted))
            .when(price.isNotNull() & waits, sold(s, s["pending"], price, units, used))
            .when(this["product"].isNotNull() & this["quantity"].isNull(), once(_product_name(this["line"]), lambda name: once(plausible(name), lambda ok: product(s, name, ok, this, nxt, ahead_used))))
            .otherwise(state(s, F.when(price.isNull() & plausible(this["line"]), this["line"])))
        )

    return F.aggregate(ahead, start, step, lambda s: s["items"])


def text_ticket(text: Column) -> Column:
    """The ticket that a transcribed receipt shows."""

    def read(lines: Column, marked: Column, header: Column) -> Column:
        dated = F.transform(F.filter(marked, lambda m: m["dated"]), lambda m: m["line"])
        items = receipt_items(marked, header["used"])
        return F.struct(receipt_date(lines, dated).alias("date"), header["chain"].alias("chaine_supermarche"), header["address"].alias("adresse"), items.alias("produits"))

    return once(clean_lines(text), lambda lines: once(F.transform(lines, _marked), lambda marked: once(receipt_header(marked), lambda header: read(lines, marked, header))))


def unfenced(text: Column) -> Column:
    """A text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))


def json_candidates(text: Column) -> Column:
    """Pieces of a noisy text that may be a receipt's JSON: all of it, all from each ``{"ticket":`` on, and each of repeated objects."""
    return once(unfenced(text), _candidates)


def _candidates(whole: Column) -> Column:
    tails = lambda pieces: F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), ""))
    closed = lambda p: F.concat(F.when(p.startswith("{"), "").otherwise("{"), p, F.when(p.endswith("}"), "").otherwise("}"))
    fixed = lambda parts: F.when(F.size(parts) > 1, F.transform(parts, lambda p: closed(F.trim(p)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(whole), once(F.split(whole, r"(?i)(?=\{\s*\"ticket\"\s*:)"), tails), once(F.split(whole, r"\}\s*\n\s*\{"), fixed)))


def _parsed(text: Column) -> Column:
    """The ticket of a JSON text, with or without its wrapper; null if it isn't one. Values are still texts."""
    bare = F.from_json(text, RECEIPT["ticket"].dataType)
    return F.coalesce(F.from_json(text, RECEIPT)["ticket"], once(bare, lambda bare: F.when(bare["date"].isNotNull() | bare["chaine_supermarche"].isNotNull() | bare["produits"].isNotNull(), bare)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def best_json(text: Column) -> Column:
    """Of the candidates in a text the ticket with the most fields and named items; the earliest of equals."""
    scored = F.transform(
        json_candidates(text),
        lambda c: once(
            _parsed(c),
            lambda t: F.struct(
                (
                    F.when(_blank(t["chaine_supermarche"]) != "", 5).otherwise(0) + F.when(_blank(t["date"]) != "", 3).otherwise(0) + F.when(_blank(t["adresse"]) != "", 1).otherwise(0)
                    + 10 * F.coalesce(F.size(F.filter(t["produits"], lambda p: _blank(p["nom_produit"]) != "")), F.lit(0))
                ).alias("score"), t.alias("ticket"),
            ),
        ),
    )
    valid = F.filter(scored, lambda s: s["ticket"].isNotNull())
    nothing = F.struct(F.lit(-1).alias("score"), F.lit(None).cast(RECEIPT["ticket"].dataType).alias("ticket"))
    return F.aggregate(valid, nothing, lambda best, s: F.when(s["score"] > best["score"], s).otherwise(best), lambda best: best["ticket"])


def store_like(name: Column) -> Column:
    """Whether a text may be a store's name, rather than an explanation."""
    return (F.length(name) <= 80) & ~_any_of(name, CHATTY) & ~name.rlike(BAD_STORE)


def json_date(text: Column) -> Column:
    """``yyyyMMdd HH:mm`` of a receipt's date; a text that is none stays as it is."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{8} \d{2}:\d{2}$"), t).otherwise(F.coalesce(*(_composed(t, p, order) for p, order in JSON_DATES), t))


def normal_ticket(raw: Column) -> Column:
    """struct(ticket, reason): a JSON ticket with typed values, or what is wrong with it."""
    return once(raw, lambda r: once(json_date(_blank(r["date"])), lambda day: _normal_ticket(r, day)))


def _normal_ticket(raw: Column, day: Column) -> Column:
    chain = _blank(raw["chaine_supermarche"])
    price_text = lambda p: F.regexp_replace(F.replace(F.trim(p["prix_unitaire_ou_kg"]), F.lit(","), F.lit(".")), r"[^0-9.]", "")
    price = lambda p: F.when(_blank(p["prix_unitaire_ou_kg"]) == "", 0.0).otherwise(once(price_text(p), lambda x: F.when(x == "", 0.0).otherwise(x.try_cast("double"))))
    units = lambda p: F.when(_blank(p["unites"]) == "", 1).otherwise(F.greatest(F.lit(1), F.bround(p["unites"].try_cast("double"), 0).cast("int")))
    named = F.filter(raw["produits"], lambda p: p.isNotNull() & (_blank(p["nom_produit"]) != ""))
    items = F.transform(named, lambda p: F.struct(collapsed(F.trim(p["nom_produit"])).alias("nom_produit"), F.bround(price(p), 2).alias("prix_unitaire_ou_kg"), units(p).alias("unites")))
    return once(items, lambda items: _typed_ticket(raw, day, chain, items))


def _typed_ticket(raw: Column, day: Column, chain: Column, items: Column) -> Column:
    some = F.coalesce(items, F.array().cast(f"array<{ITEM}>"))
    reason = (
        F.when(raw.isNull(), "no ticket JSON")
        .when((day != "") & F.try_to_timestamp(day, F.lit("yyyyMMdd HH:mm")).isNull(), "invalid date")
        .when((chain != "") & ~store_like(chain), "invalid chaine_supermarche")
        .when(F.exists(items, lambda p: p["prix_unitaire_ou_kg"].isNull()), "invalid price")
        .when(F.exists(items, lambda p: p["unites"].isNull()), "invalid unites")
    )
    ticket = F.struct(day.alias("date"), chain.alias("chaine_supermarche"), _blank(raw["adresse"]).alias("adresse"), F.array_distinct(some).alias("produits"))
    return F.struct(F.when(reason.isNull(), ticket).alias("ticket"), reason.alias("reason"))


def clean_transcription(text: Column) -> Column:
    """A transcription without fences, chatty lines, lines that begin with "json", and empty lines."""
    lines = F.transform(F.split(unfenced(F.regexp_replace(text, r"\r\n?", "\n")), "\n"), lambda x: F.coalesce(stripped(x), F.lit("")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(CHAT_PREFIX) & ~F.lower(x).startswith("json")), "\n")


def output_error(text: Column, mode: str) -> Column:
    """Why a model's output is no use in a mode (transcribe, json or multipass); null if it is."""
    empty = F.when(stripped(text).isNull(), F.lit("empty output"))
    if mode == "transcribe":
        for marker in CHATTY:
            empty = empty.when(F.lower(text).contains(marker), F.lit(f"chatty output ({marker})"))
        lines = F.filter(F.split(text, r"\R"), lambda x: stripped(x).isNotNull())
        return empty.when(F.size(lines) < 2, "transcription too short").when(F.trim(text).startswith("{") & text.contains('"ticket"'), "model returned JSON instead of transcription")
    if mode not in ("json", "multipass"):
        return empty
    said = lambda ticket: F.when(ticket.isNull(), "invalid or missing ticket JSON").when((ticket["chaine_supermarche"] == "") & (F.size(ticket["produits"]) == 0), "empty ticket")
    return empty.otherwise(once(normal_ticket(best_json(text))["ticket"], said))


def merge_partial(parts: DataFrame, key: str = "ticket_id", order: str = "pass_nr", text: str = "text") -> DataFrame:
    """One ticket from the JSON of several passes: the first value of each header field, and the last list of items that isn't empty."""
    raw = parts.select(key, order, _parsed(unfenced(F.col(text))).alias("t"))
    head = lambda c: F.coalesce(F.min_by(F.trim(f"t.{c}"), F.when(F.trim(f"t.{c}") != "", F.col(order))), F.lit("")).alias(c)
    items = F.max_by("t.produits", F.when(F.size("t.produits") > 0, F.col(order))).alias("produits")
    return raw.groupBy(key).agg(head("date"), head("chaine_supermarche"), head("adresse"), items).select(key, F.struct("date", "chaine_supermarche", "adresse", "produits").alias("ticket"))


def read_receipts(df: DataFrame, key: str = "ticket_id", text: str = "text") -> DataFrame:
    """key, ticket, reason: the JSON ticket of a text where there is a valid one, else the transcribed one; a blank text has a reason."""
    blank = stripped(F.col(text)).isNull()
    given = normal_ticket(best_json(F.col(text)))["ticket"].cast(TICKET)
    ticket = F.coalesce(F.when(F.col(text).contains("{"), given), text_ticket(F.col(text)).cast(TICKET))
    return df.select(key, F.when(~blank, ticket).alias("ticket"), F.when(blank, F.lit("empty text")).alias("reason"))


def ticket_rows(read: DataFrame, key: str = "ticket_id") -> DataFrame:
    """key, enseigne, ticket_date, total_amount: the total is null without items."""
    total = F.aggregate("ticket.produits", F.lit(0).cast("decimal(18,2)"), lambda a, p: (a + p["prix_unitaire_ou_kg"].cast("decimal(12,2)") * F.greatest(p["unites"], F.lit(1))).cast("decimal(18,2)"))
    return read.where("reason is null").select(
        key,
        F.nullif(F.trim("ticket.chaine_supermarche"), F.lit("")).alias("enseigne"),
        F.try_to_timestamp("ticket.date", F.lit("yyyyMMdd HH:mm")).cast("date").alias("ticket_date"),
        F.when(F.size("ticket.produits") > 0, total).alias("total_amount"),
    )


def line_rows(read: DataFrame, key: str = "ticket_id") -> DataFrame:
    """The items as rows; line_index is their place in the ticket, so items without a name leave gaps."""
    # The outer form, as the plain one has the optimiser ask beforehand whether there are items, which parses every text twice.
    rows = read.select(key, F.posexplode_outer("ticket.produits").alias("line_index", "p")).where("trim(p.nom_produit) <> ''")
    price, units = F.coalesce(F.col("p.prix_unitaire_ou_kg"), F.lit(0.0)).cast("decimal(10,2)"), F.coalesce(F.nullif(F.col("p.unites"), F.lit(0)), F.lit(1)).cast("decimal(10,3)")
    return rows.select(
        key, "line_index", F.trim("p.nom_produit").alias("raw_text"), units.alias("quantity"), price.alias("unit_price"), F.round(price * units, 2).cast("decimal(10,2)").alias("line_total"),
        F.lit(None).cast("string").alias("ean"), F.lit("none").alias("match_method"), F.lit(None).cast("decimal(5,2)").alias("match_confidence"), F.lit(True).alias("needs_validation"), F.lit(False).alias("validated_by_user"),
    )


def parse_receipts(df: DataFrame, key: str = "ticket_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tickets, line items, errors) of a corpus of receipt texts."""
    read = read_receipts(df, key, text)
    return ticket_rows(read, key), line_rows(read, key), read.where("reason is not null").select(key, "reason")
