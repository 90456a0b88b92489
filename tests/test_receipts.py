import re

from pyspark.sql import functions as F

from pricelens.operators import receipts

PLAIN = """GRANDES HALLES
8 avenue des Tilleuls
31000 Toulouse
Tel 05 00 00 00 00

03/11/2025 18:05

LENTILLES VERTES         2,05 €
JUS DE POMME 1L          1,85 €
SAVON OLIVE              3,10 €

SOUS TOTAL               7,00
TOTAL TTC                7,00 €
MERCI"""
COUNTED = """MARCHE DU COIN
59000 Lille
21/06/2025 10:12
BISCUITS AVOINE          5,00 €
2 x 2,50
CAROTTES VRAC            1,53 €
0,850 kg x 1,80 €/kg
TOTAL                    6,53"""
SPREAD = """EPICERIE NORD
3 RUE HAUTE
09/02/25
08:55
> CONSERVES
POIS CHICHES BOCAL 400G
1,30 €
3,90 € 12
3 x
POIRE CONFERENCE
0,640 kg €
2,50 €/kg
1,60 €
RIZ ROND SACHET 1KG
2,20 € 12
TOTAL"""
JSON = 'Here: {"ticket": {"date": "15/10/24", "chaine_supermarche": "LIDL", "adresse": "", "produits": [{"nom_produit": "PAIN  X", "prix_unitaire_ou_kg": "1,20", "unites": 2}, {"nom_produit": "PAIN X", "prix_unitaire_ou_kg": 1.2, "unites": 2}, {"nom_produit": "", "unites": 1}, {"nom_produit": "LAIT", "prix_unitaire_ou_kg": 0.95, "unites": 0.972}]}}'


def test_receipts(spark):
    df = spark.createDataFrame([("a", PLAIN), ("b", COUNTED), ("c", SPREAD), ("d", "```json\n" + JSON[6:] + "\n```"), ("e", JSON), ("f", " "), ("g", None), ("h", "www.example.fr\nTel 01")], "ticket_id string, text string")
    tickets, lines, errors = receipts.parse_receipts(df)
    heads = {r.ticket_id: (r.enseigne, str(r.ticket_date), None if r.total_amount is None else float(r.total_amount)) for r in tickets.collect()}
    assert heads["a"] == ("GRANDES HALLES", "2025-11-03", 7.0) and heads["b"][:2] == ("MARCHE DU COIN", "2025-06-21") and heads["c"][:2] == ("EPICERIE NORD", "2025-02-09")
    assert heads["d"] == heads["e"] == ("LIDL", "2024-10-15", 3.35) and heads["h"] == (None, "None", None)
    found = {}
    for r in lines.orderBy("ticket_id", "line_index").collect():
        found.setdefault(r.ticket_id, []).append((r.raw_text, float(r.unit_price), int(r.quantity)))
    assert found["a"] == [("LENTILLES VERTES", 2.05, 1), ("JUS DE POMME 1L", 1.85, 1), ("SAVON OLIVE", 3.1, 1)]
    assert found["b"] == [("BISCUITS AVOINE", 2.5, 2), ("CAROTTES VRAC", 1.8, 1)]
    assert found["c"] == [("POIS CHICHES BOCAL 400G", 1.3, 3), ("POIRE CONFERENCE", 2.5, 1), ("RIZ ROND SACHET 1KG", 2.2, 1)]
    assert found["d"] == found["e"] == [("PAIN X", 1.2, 2), ("LAIT", 0.95, 1)]
    assert {r.ticket_id for r in errors.collect()} == {"f", "g"}


def test_partial_tickets_merge(spark):
    """Of several passes the first value of each header field, and the last list that isn't empty."""
    head = '{"ticket": {"date": " ", "chaine_supermarche": "HALLES", "adresse": ""}}'
    late = '```json\n{"ticket": {"date": "03/11/2025", "chaine_supermarche": "OTHER", "adresse": "3 RUE HAUTE", "produits": [{"nom_produit": "PAIN", "prix_unitaire_ou_kg": 1.2, "unites": 1}]}}\n```'
    empty = '{"ticket": {"date": "", "produits": []}}'
    df = spark.createDataFrame([("a", 1, head), ("a", 2, late), ("a", 3, empty), ("a", 4, "no JSON"), ("b", 1, None)], "ticket_id string, pass_nr int, text string")
    got = {r.ticket_id: r.ticket for r in receipts.merge_partial(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.date, a.chaine_supermarche, a.adresse, [p.nom_produit for p in a.produits]) == ("03/11/2025", "HALLES", "3 RUE HAUTE", ["PAIN"])
    assert (b.date, b.chaine_supermarche, b.produits) == ("", "", None)


def test_transcription_is_cleaned(spark):
    text = "```\nNote: this is blurred\r\nHALLES\r\n\r\n  PAIN 1,20 €\njson follows\nI think so\n```"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(receipts.clean_transcription(df.t)).collect()] == ["HALLES\nPAIN 1,20 €", "", None]


def test_model_output_is_judged(spark):
    good = '{"ticket": {"chaine_supermarche": "HALLES", "produits": []}}'
    cases = {
        ("", "json"): "empty output", (" ", "transcribe"): "empty output", ("one line", "transcribe"): "transcription too short", ("A\nthis image is dark", "transcribe"): "chatty output (this image)", ("A\nB", "transcribe"): None,
        ('{"ticket": {\n}}', "transcribe"): "model returned JSON instead of transcription", ("no ticket", "json"): "invalid or missing ticket JSON", ('{"ticket": {"chaine_supermarche": "", "produits": []}}', "multipass"): "empty ticket", (good, "json"): None, ("x", "other"): None,
    }
    for (text, mode), want in cases.items():
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(receipts.output_error(df.t, mode)).first()[0] == want, (text, mode)


def test_lines_of_odd_white_space_are_searched_for_prices_only_with_one(spark):
    text = "\u00a0A  B\t C\x1f\r\n\r\n x \u2028y\u3000\x0bz \x85 \n\u2003"
    lines = spark.createDataFrame([(text,)], "t string").select(receipts.clean_lines(F.col("t")).alias("x"))
    assert lines.first().x == ["A B C", "x", "y", "z"]
    plan = lines.select(F.transform("x", receipts._marked).alias("m"))
    marks = plan.first().m
    assert [m.priced for m in marks] == [False] * 4 and all(m.kg is None and m.quantity is None for m in marks)
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("lower(") == 2  # of lines with a price and without; what is to be ignored is asked where it matters


def test_a_text_is_searched_once_for_candidates(spark):
    """Each pattern is named once, however many candidates a text has; they are those that plain Python finds."""
    texts = ['Voici: {} {"ticket": 1} x {"Ticket" : 2}', '{"a": 1}\n{"b": 2}\n {"c": 3}', '```json\n{"ticket": 3}\n```', "", "}\n{"]
    expected = []
    for text in texts:
        whole = re.sub(r"^```json\n|\n```$", "", text)
        pieces = re.split(r'(?i)(?=\{\s*"ticket"\s*:)', whole)
        parts = re.split(r"\}\s*\n\s*\{", whole)
        fixed = [("" if p.startswith("{") else "{") + p + ("" if p.endswith("}") else "}") for p in (x.strip(" ") for x in parts)] if len(parts) > 1 else []
        expected.append(list(dict.fromkeys([whole, *("".join(pieces[i:]) for i in range(len(pieces))), *fixed])) )
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    made = df.select("i", receipts.json_candidates(F.col("x")).alias("c"))
    assert [list(dict.fromkeys(r["c"])) for r in made.orderBy("i").collect()] == expected
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
