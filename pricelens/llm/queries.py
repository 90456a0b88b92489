"""Registered queries of the subpackage: thin wrappers that bind each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import cover_tree, dual_tree, exact_dedup, langid, licenses, merkle, order_minhash, packing, pii, secret_ledger, sentencepiece_viterbi, toxicity, vptree
from .common import read


def op1_vptree(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_near_dedup(spark, sf_dir):
    return order_minhash.near_groups(read(spark, sf_dir, "documents"))


def op3_licenses(spark, sf_dir):
    return licenses.license_report(read(spark, sf_dir, "documents"))


def op4_langid(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_pii(spark, sf_dir):
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_viterbi.encoding_report(read(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secret_ledger.secret_report(read(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op11_dual_tree(spark, sf_dir):
    return dual_tree.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_cover_tree(spark, sf_dir):
    return cover_tree.near_vectors(read(spark, sf_dir, "embeddings"))


def op13_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=tampered, instead={"n_chars": F.col("n_chars") + 1})


QUERIES = {
    "op1_vptree": op1_vptree,
    "op2_near_dedup": op2_near_dedup,
    "op3_licenses": op3_licenses,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_dual_tree": op11_dual_tree,
    "op12_cover_tree": op12_cover_tree,
    "op13_merkle": op13_merkle,
}


def _matches(kinds: dict[str, str]) -> str:
    """DuckDB SQL for every match of the patterns in the documents, with its position: rid, kind, nr, m, start."""
    found = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {nr} AS nr, t, unnest(regexp_extract_all(t, '{pattern}')) AS m, "
        f"unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS gap, "
        f"unnest(range(1, 1 + len(regexp_extract_all(t, '{pattern}')))) AS i FROM d"
        for nr, (kind, pattern) in enumerate(kinds.items())
    )
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        p AS (SELECT *, cast(sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) - length(m) AS BIGINT) AS start FROM f)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN j % 2 = 0 THEN cast(substr(reverse({_DIGITS}), j + 1, 1) AS INT)
    ELSE (2 * cast(substr(reverse({_DIGITS}), j + 1, 1) AS INT)) % 10 + cast(substr(reverse({_DIGITS}), j + 1, 1) AS INT) // 5 END
    FOR j IN range(0, length({_DIGITS}))]) % 10 = 0"""
_MOVED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_MOD97 = f"""list_reduce(list_prepend(0, [CASE WHEN substr({_MOVED}, j, 1) BETWEEN '0' AND '9' THEN ascii(substr({_MOVED}, j, 1)) - 48
    ELSE ascii(substr({_MOVED}, j, 1)) - 55 END FOR j IN range(1, 1 + length({_MOVED}))]),
    lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"""

def _leaf(n_chars: str) -> str:
    told = lambda c: f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Unsigned crc32 of the id as text: each character is taken in, then eight steps by bit (written as -1).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]) FOR c IN string_split(cast(doc_id AS VARCHAR), '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
_PAIRS = "[sha256(list_aggregate(l[2 * i - 1 : 2 * i], 'string_agg', '')) FOR i IN range(1, (len(l) + 1) // 2 + 1)]"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_dual_tree": f"""
        WITH tf AS (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS t FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents)) GROUP BY ALL),
            lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
            whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
            weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN whole GROUP BY t, docs),
            asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
            scores AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
                FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN lengths USING (r) CROSS JOIN whole GROUP BY item_id, r, doc_id)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """,
    "op12_cover_tree": """
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            links AS MATERIALIZED (SELECT a.r, b.r AS s, a.vec_id AS vec_id, b.vec_id AS far FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
            reached(r, far) AS (SELECT r, vec_id FROM e UNION SELECT l.r, c.far FROM links l JOIN reached c ON l.s = c.r),
            n AS (SELECT r, count(*) AS n_links FROM links GROUP BY r),
            least AS (SELECT e.vec_id, coalesce(any_value(n_links), 0) AS n_links, min(far) AS component_id FROM e JOIN reached USING (r) LEFT JOIN n USING (r) GROUP BY r, e.vec_id)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM least
        UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE label IS NULL OR vec_id IS NULL OR embedding IS NULL
            OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
    """,
    "op13_merkle": f"""
        WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM (
                SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS shown FROM documents)),
            floors(lang, level, l) AS (SELECT lang, 0, list(leaf ORDER BY r) FROM d GROUP BY lang
                UNION ALL SELECT lang, level + 1, {_PAIRS} FROM floors WHERE len(l) > 1),
            subroots AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM floors WHERE len(l) = 1),
            tops(level, l) AS (SELECT 0, list(subroot ORDER BY r) FROM subroots UNION ALL SELECT level + 1, {_PAIRS} FROM tops WHERE len(l) > 1),
            steps AS (SELECT doc_id, leaf, d.lang, d.r, level, (d.r >> level) % 2 AS odd, coalesce(l[xor(d.r >> level, 1) + 1], '') AS sibling
                    FROM d JOIN floors f ON d.lang IS NOT DISTINCT FROM f.lang WHERE len(l) > 1
                UNION ALL SELECT doc_id, leaf, d.lang, d.r, 100 + level, (s.r >> level) % 2, coalesce(l[xor(s.r >> level, 1) + 1], '')
                    FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN tops WHERE len(l) > 1),
            ways AS (SELECT lang, r, list(odd ORDER BY level) AS odds, list(sibling ORDER BY level) AS siblings, string_agg(sibling, '' ORDER BY level) AS proof FROM steps GROUP BY lang, r),
            folds(lang, r, k, h) AS (SELECT lang, r, 0, shown FROM d
                UNION ALL SELECT f.lang, f.r, k + 1, sha256(CASE WHEN odds[k + 1] = 1 THEN siblings[k + 1] || h ELSE h || siblings[k + 1] END)
                    FROM folds f JOIN ways w ON f.lang IS NOT DISTINCT FROM w.lang AND f.r = w.r WHERE k < len(odds)),
            root AS (SELECT l[1] AS root FROM tops WHERE len(l) = 1)
        SELECT d.doc_id, d.leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root LEFT JOIN ways w ON d.lang IS NOT DISTINCT FROM w.lang AND d.r = w.r
            JOIN folds f ON d.lang IS NOT DISTINCT FROM f.lang AND d.r = f.r AND k = coalesce(len(odds), 0)
    """,
    "op6_pii": f"""
        WITH {_matches({
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
            "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b",
        })},
        k AS (SELECT rid, kind, nr, start, kind || ':' || start || ':' || (start + length(m)) AS s, lower(substr(t, greatest(start - 39, 1), least(start, 40))) AS before
              FROM p WHERE CASE kind WHEN 'email' THEN true
                  WHEN 'ip' THEN list_max([cast(x AS HUGEINT) FOR x IN string_split(m, '.')]) <= 255
                  WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
                  WHEN 'phone' THEN length({_DIGITS}) BETWEEN 8 AND 15
                  ELSE {_MOD97} END),
        g AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
                  count(*) FILTER (kind = 'phone') AS n_phone, string_agg(s, ',' ORDER BY nr, start) FILTER (kind <> 'iban') AS base,
                  string_agg(s, ',' ORDER BY nr, start) AS spans, count(*) FILTER (CASE kind
                      WHEN 'ip' THEN regexp_matches(before, '{pii.WORDS["ip"]}') WHEN 'phone' THEN regexp_matches(before, '{pii.WORDS["phone"]}')
                      WHEN 'card' THEN regexp_matches(before, '{pii.WORDS["card"]}') ELSE true END) AS n_likely
              FROM k GROUP BY rid)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_likely, 0) AS n_likely
        FROM d LEFT JOIN g USING (rid)
    """,
    "op8_secrets": f"""
        WITH {_matches({
            "assign": """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?[A-Za-z0-9+/_.=-]+""",
            "access": "AKIA[A-Z0-9]+",
            "hex": "[0-9a-f]+",
            "pem": "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
            "host_token": "gh[pousr]_[A-Za-z0-9]{36,}",
        })},
        k AS (SELECT rid, kind, nr, start, kind || ':' || start || ':' || (start + length(m)) AS s FROM p
              WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '^[A-Za-z_]+["'']? *[:=] *["'']?(.*)$', 1)) >= 6
                  WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24 ELSE true END),
        g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(s, ',' ORDER BY start, nr) FILTER (nr < 3) AS base, string_agg(s, ',' ORDER BY start, nr) AS spans FROM k GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
}
