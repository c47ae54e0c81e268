"""SQL for DuckDB, for the operators that SQL can express: 2, 5, 6, 8 and 9."""

from __future__ import annotations

from . import pii
from .secrets import KINDS, MORE

def _ascii_lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words5(column: str) -> str:
    return r"regexp_extract_all(" + _ascii_lower(column) + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words5("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_words5('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT item, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS gram FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dg.doc_id, dg.k, dg.i, g.item FROM dg JOIN g ON dg.k = g.k AND dg.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: The patterns as given, without the shortcuts of the operator's; each letter of `assign` in either case of ASCII.
_either = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_ASSIGN_NAME = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')})"
_SECRETS = {
    "assign": (_ASSIGN_NAME + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", r"""length(regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
    "access": ("AKIA[A-Z0-9]+", "length(hit) >= 16"),
    "hex": ("[0-9a-f]+", "length(hit) >= 32"),
    **{k: (p.replace("}+", "}"), "true") for k, (p, _) in MORE.items()},
}
_parts = " UNION ALL ".join(f"SELECT row_, '{k}' AS kind, {KINDS.index(k)} AS rank, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d" for k, (p, _) in _SECRETS.items())
_test = "CASE kind " + " ".join(f"WHEN '{k}' THEN {test}" for k, (_, test) in _SECRETS.items()) + " END"
SECRETS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_, coalesce(text, '') AS t FROM documents),
m AS ({_parts}),
u AS (SELECT row_, kind, rank, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
v AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row_, kind ORDER BY i) AS BIGINT) AS e FROM u),
s AS (SELECT *, e - length(hit) AS b, kind || ':' || (e - length(hit)) || ':' || e AS said FROM v WHERE {_test}),
a AS (SELECT row_, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(said, ',' ORDER BY b, rank, e) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY b, rank, e) AS spans FROM s GROUP BY row_)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_)"""

_BITS = "array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)] FOR c IN string_split(sha1(h), '')], '')"
ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last, {_BITS} AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum([CASE WHEN substr(bits, 5 * i + j, 1) = '1' THEN 1 << (5 - j) ELSE 0 END FOR j IN range(1, 6)]) AS INTEGER) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM r"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ascii_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN CAST(substr({_DIGITS}, i, 1) AS INTEGER) * 2 // 10 + CAST(substr({_DIGITS}, i, 1) AS INTEGER) * 2 % 10 ELSE CAST(substr({_DIGITS}, i, 1) AS INTEGER) END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"
_BARE = "replace(hit, ' ', '')"
_VALUES = f"[CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END AS BIGINT) FOR c IN string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), '')]"
_MOD97 = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {_VALUES}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
_BEFORE, _AFTER = "substr(t, greatest(b - 39, 1), least(b, 40))", "substr(t, e + 1, 40)"
_apart = lambda kind: f"NOT regexp_matches(CASE WHEN b > 0 THEN substr(t, b, 1) ELSE '' END, '{pii.BESIDE[kind]}') AND NOT regexp_matches(substr(t, e + 1, 1), '{pii.BESIDE[kind]}')"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_matches(hit, '{pii.OCTETS}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    "iban": (pii.IBAN, f"{_apart('iban')} AND {_MOD97}"),
    "ssn": (pii.SSN, f"{_apart('ssn')} AND regexp_matches({_ascii_lower(f'({_BEFORE} || chr(32) || {_AFTER})')}, 'ssn|social|security')"),
}
_pii_parts = " UNION ALL ".join(f"SELECT row_, t, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d" for i, (k, (p, _)) in enumerate(_PII.items()))
_pii_test = "CASE kind " + " ".join(f"WHEN '{k}' THEN {test}" for k, (_, test) in _PII.items()) + " END"
PERSONAL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_, coalesce(text, '') AS t FROM documents),
m AS ({_pii_parts}),
u AS (SELECT row_, t, kind, rank, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
v AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row_, kind ORDER BY i) AS BIGINT) AS e FROM u),
w AS (SELECT *, e - length(hit) AS b FROM v),
s AS (SELECT *, kind || ':' || b || ':' || e AS said FROM w WHERE {_pii_test}),
a AS (SELECT row_, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII)},
             string_agg(said, ',' ORDER BY rank, b) FILTER (rank < 4) AS base, string_agg(said, ',' ORDER BY rank, b) AS spans FROM s GROUP BY row_)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_)"""

ORACLES = {"op2_pii": PERSONAL, "op5_decontamination": DECONTAMINATION, "op6_secret_scans": SECRETS, "op8_warc_packages": ARCHIVES, "op9_near_duplicates": NEAR_DUPLICATES}
