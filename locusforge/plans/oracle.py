"""SQL for an independent engine: the derived study, its QC and what follows, as common table expressions."""

from __future__ import annotations

from ..functions import builds
from .view import VIEW_SQL

_B = "GRCh38"
_PRIMARY = ", ".join(f"'{c}'" for c in builds.CHROMOSOMES)


def _case(column: str, values: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def off(column: str) -> str:
    return f"CAST({_case(column, builds.offsets(_B))} AS BIGINT)"


def size(column: str) -> str:
    return f"CAST({_case(column, builds.lengths(_B))} AS BIGINT)"


def code(c: str, at: str, ref: str, alt: str) -> str:
    return f"CASE WHEN {at} >= 1 AND {at} <= {size(c)} AND {ref} IN ('A','C','G','T') AND {alt} IN ('A','C','G','T') AND {ref} <> {alt} THEN ({off(c)} + {at} - 1) * 16 + 4 * (instr('ACGT', {ref}) - 1) + instr('ACGT', {alt}) - 1 END"


def finite(x: str) -> str:
    return f"coalesce(isfinite({x}), false)"


_Y = "(abs({z}) * 0.7071067811865476e0)"


def tail(z: str) -> str:
    """erfc(abs(z) / sqrt(2)), by other means than the engine's: the power series, and the trapezoid rule with its pole's share taken off."""
    y = _Y.format(z=z)
    series = "1e0"
    for n in range(45, 0, -1):
        series = f"(1e0 + 2e0 * {y} * {y} / {2 * n + 1}e0 * {series})"
    near = f"1e0 - 1.1283791670955126e0 * exp(-{y} * {y}) * {y} * {series}"
    total = f"list_sum([exp(-0.0625e0 * i * i) / (0.0625e0 * i * i + {y} * {y}) FOR i IN range(1, 40)])"
    far = f"0.25e0 * {y} * exp(-{y} * {y}) / 3.141592653589793e0 * (1e0 / ({y} * {y}) + 2e0 * {total}) - 2e0 / (exp(8e0 * 3.141592653589793e0 * {y}) - 1e0)"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {y} < 1.5e0 THEN {near} ELSE {far} END"


P_FROM_Z = tail("z")
#: The quantile of p / 2: a rational start, then Newton's steps on the tail. Columns x0, x1, x2 and x of k.
QUANTILE = f"""x0 AS (SELECT *, t - (2.515517e0 + 0.802853e0 * t + 0.010328e0 * t * t) / (1e0 + 1.432788e0 * t + 0.189269e0 * t * t + 0.001308e0 * t * t * t) AS x0 FROM (SELECT *, sqrt(-2e0 * ln(p_value / 2e0)) AS t FROM k WHERE p_value > 0 AND p_value < 1 AND beta <> 0)),
x1 AS (SELECT *, x0 + ({tail('x0')} - p_value) / (2e0 * exp(-x0 * x0 / 2e0) * 0.3989422804014327e0) AS x1 FROM x0),
x2 AS (SELECT *, x1 + ({tail('x1')} - p_value) / (2e0 * exp(-x1 * x1 / 2e0) * 0.3989422804014327e0) AS x2 FROM x1),
x AS (SELECT *, x2 + ({tail('x2')} - p_value) / (2e0 * exp(-x2 * x2 / 2e0) * 0.3989422804014327e0) AS x FROM x2)"""

N = """n AS (
  SELECT *, CASE bare WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN 'M' THEN 'MT' WHEN '25' THEN 'MT' WHEN '26' THEN 'MT' ELSE bare END AS c,
         CASE WHEN standard_error > 0 THEN beta / standard_error END AS z
  FROM (SELECT *, upper(trim(regexp_replace(chromosome, '^chr', '', 'i'))) AS bare FROM g))"""

_any = lambda test: " OR ".join(f"coalesce({test.format(a)}, false)" for a in ("reference_allele", "alternate_allele", "effect_allele", "other_allele"))
REASONS = {
    "missing_chromosome": "c IS NULL",
    "unsupported_contig": f"c NOT IN ({_PRIMARY})",
    "missing_coordinate": "base_pair_location IS NULL",
    "nonpositive_coordinate": "base_pair_location < 1",
    "coordinate_out_of_range": f"base_pair_location >= 1 AND base_pair_location > {size('c')}",
    "missing_reference_allele": "reference_allele IS NULL",
    "missing_alternate_allele": "alternate_allele IS NULL",
    "missing_effect_allele": "effect_allele IS NULL",
    "missing_other_allele": "other_allele IS NULL",
    "multiallelic": _any("{} LIKE '%,%'"),
    "symbolic_allele": _any("regexp_matches({}, '^[<*]')"),
    "indel": _any("length({}) <> 1"),
    "invalid_allele": _any("{} NOT IN ('A','C','G','T')"),
    "same_alleles": "reference_allele = alternate_allele OR effect_allele = other_allele",
    "orientation_mismatch": "effect_allele <> alternate_allele OR other_allele <> reference_allele",
    "invalid_standard_error": "standard_error <= 0",
    "invalid_effect_allele_frequency": "effect_allele_frequency < 0 OR effect_allele_frequency > 1",
    "invalid_p_value": "p_value < 0 OR p_value > 1",
    "missing_statistics": "beta IS NULL OR z IS NULL OR standard_error IS NULL OR standard_error <= 0",
}
# DuckDB 2.0 hangs under a LIMIT where these two are kept for several readers.
Q = (
    "q0 AS (SELECT *, "
    + code("c", "base_pair_location", "other_allele", "effect_allele")
    + " AS variant_code, [x FOR x IN ["
    + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in REASONS.items())
    + """] IF x IS NOT NULL] AS base_reasons FROM n),
q1 AS NOT MATERIALIZED (SELECT *, variant_code IS NOT NULL AND count(*) OVER (PARTITION BY variant_code) > 1 AS again,
              row_number() OVER (PARTITION BY variant_code ORDER BY ordinal) = 1 AS first_copy FROM q0),
q AS NOT MATERIALIZED (SELECT *, CASE WHEN again THEN list_append(base_reasons, 'duplicate_variant') ELSE base_reasons END AS reasons,
             len(base_reasons) = 0 AND (NOT again OR first_copy) AS kept FROM q1)"""
)
K = """k AS (
  SELECT ordinal, c AS chromosome, CAST(base_pair_location AS BIGINT) AS base_pair_location, reference_allele, alternate_allele,
         alternate_allele AS effect_allele, reference_allele AS other_allele, beta, standard_error, effect_allele_frequency, p_value, z,
         variant_code, CAST(floor(variant_code / 16) AS BIGINT) AS global_position, CAST(variant_code % 16 AS INTEGER) AS substitution
  FROM q WHERE kept)"""
P = f"""p AS (SELECT *, CASE WHEN p_value BETWEEN 0 AND 1 THEN p_value ELSE {P_FROM_Z} END AS p_resolved,
                     CASE WHEN p_value BETWEEN 0 AND 1 THEN 'supplied' WHEN z IS NOT NULL THEN 'derived' ELSE 'unresolved' END AS p_source FROM k)"""


def regions(threshold: str, padding: int) -> str:
    return f"""w AS (SELECT chromosome, greatest(base_pair_location - {padding}, 1) AS a, least(base_pair_location + {padding}, 2147483647) AS z FROM p WHERE p_resolved <= {threshold}),
w1 AS (SELECT *, max(z) OVER (PARTITION BY chromosome ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
w2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chromosome ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM w1),
r AS (SELECT chromosome, min(a) AS region_start, max(z) AS region_end, count(*) AS seed_snps FROM w2 GROUP BY chromosome, island)"""


PANEL = "panel AS (SELECT variant_code, ordinal % 160 = 0 AS hm3 FROM k WHERE ordinal % 40 = 0)"
IN_REGION = "EXISTS (SELECT 1 FROM r WHERE r.chromosome = x.chromosome AND x.base_pair_location BETWEEN r.region_start AND r.region_end)"
IN_PANEL = "variant_code IN (SELECT variant_code FROM panel)"

_PI = "3.141592653589793e0"
EAF_CODE = f"CAST(CASE WHEN effect_allele_frequency BETWEEN 0 AND 1 THEN round_even(162.33804195373324e0 * asin(sqrt(least(1e0 - 1e-12, greatest(1e-12, effect_allele_frequency)))), 0) ELSE 128 END AS INTEGER)"
Z_CODE = "CAST(CASE WHEN z IS NULL THEN 510 WHEN z >= -3.5 AND z < 3.5 THEN floor((z + 3.5e0) / 0.013725490196078431e0) ELSE 511 END AS INTEGER)"


def grid(code_: str, steps: int = 255) -> str:
    return f"power(sin({code_} * ({_PI} / {2 * steps}e0)), 2)"


def half_log(f: str) -> str:
    safe = f"least(1e0 - 1e-12, greatest(1e-12, {f}))"
    return f"0.5e0 * log2(2e0 * {safe} * (1e0 - {safe}))"


ROWS = "rows_ AS (SELECT *, CAST(row_number() OVER (ORDER BY variant_code) - 1 AS BIGINT) AS row_id FROM p)"
E = f"""e0 AS (SELECT *, CAST(floor(row_id / 65536) AS INTEGER) AS block_id, {Z_CODE} AS z_code, {EAF_CODE} AS eaf_code FROM rows_),
e1 AS (SELECT *, CASE WHEN standard_error > 0 THEN log2(standard_error) + {half_log(grid('eaf_code'))} END AS residual FROM e0),
e2 AS (SELECT block_id, coalesce(median(residual), 0e0) AS se_centre FROM e1 GROUP BY block_id),
e3 AS (SELECT e1.*, e2.se_centre, residual - se_centre AS delta FROM e1 JOIN e2 USING (block_id)),
e4 AS (SELECT *, CAST(CASE WHEN residual IS NULL THEN 62 WHEN delta >= -1 AND delta < 1 THEN floor((delta + 1e0) / 0.03225806451612903e0) ELSE 63 END AS INTEGER) AS se_code FROM e3),
e AS (SELECT *, CASE WHEN z_code = 511 THEN 1 ELSE 0 END + CASE WHEN se_code = 63 THEN 2 ELSE 0 END + CASE WHEN effect_allele_frequency BETWEEN 0 AND 1 THEN 0 ELSE 4 END AS flags FROM e4)"""
D = f"""d0 AS (SELECT *, CASE WHEN flags & 1 <> 0 THEN CAST(CAST(z AS FLOAT) AS DOUBLE) WHEN z_code < 510 THEN -3.5e0 + (z_code + 0.5e0) * 0.013725490196078431e0 END AS dz,
                     CASE WHEN flags & 4 <> 0 THEN CAST(CAST(effect_allele_frequency AS FLOAT) AS DOUBLE) ELSE {grid('eaf_code')} END AS deaf,
                     CASE WHEN flags & 2 <> 0 THEN power(2e0, CAST(CAST(log2(standard_error) AS FLOAT) AS DOUBLE)) WHEN se_code < 62 THEN power(2e0, -1e0 + (se_code + 0.5e0) * 0.03225806451612903e0 + se_centre - {half_log(grid('eaf_code'))}) END AS dse FROM e),
d AS (SELECT *, dz * dse AS dbeta FROM d0)"""

L = f"""l0 AS (SELECT *, CAST(floor(row_id / 65536) AS INTEGER) AS block_id, CAST(CASE WHEN z IS NULL THEN 510 WHEN z >= -3.5 AND z <= 3.5 THEN least(floor((z + 3.5e0) / 0.013725490196078431e0), 509) ELSE 511 END AS INTEGER) AS z_code,
  CAST(CASE WHEN effect_allele_frequency BETWEEN 0 AND 1 THEN round_even(161.70142218136185e0 * asin(sqrt(least(1e0 - 1e-12, greatest(1e-12, effect_allele_frequency)))), 0) ELSE 255 END AS INTEGER) AS eaf_code FROM rows_),
l1 AS (SELECT *, CASE WHEN eaf_code = 255 THEN 0.5e0 ELSE {grid('eaf_code', 254)} END AS f FROM l0),
l2 AS (SELECT *, {half_log('f')} AS v, CASE WHEN standard_error > 0 THEN log2(standard_error) + {half_log('f')} END AS residual FROM l1),
l3 AS (SELECT block_id, coalesce(median(residual), 0e0) AS se_centre FROM l2 GROUP BY block_id),
leg AS (SELECT l2.*, l3.se_centre, residual - se_centre AS delta, CAST(CASE WHEN residual IS NULL THEN 62 ELSE least(61, greatest(0, floor((residual - se_centre + 1e0) / 2e0 * 62e0 - 0.5e0))) END AS INTEGER) AS se_code FROM l2 JOIN l3 USING (block_id)),
ld AS (SELECT *, CASE WHEN z_code = 511 THEN z WHEN z_code < 510 THEN -3.5e0 + (z_code + 0.5e0) * 0.013725490196078431e0 END AS dz, CASE WHEN effect_allele_frequency BETWEEN 0 AND 1 THEN f ELSE effect_allele_frequency END AS deaf,
  CASE WHEN se_code < 62 THEN power(2e0, -1e0 + (se_code + 1e0) * 0.03225806451612903e0 + se_centre - v) END AS dse FROM leg)"""
Q8 = f"""c0 AS (SELECT *, CASE WHEN dz IS NULL THEN 254 WHEN dz >= -3.5 AND dz <= 3.5 THEN least(floor((dz + 3.5e0) / 0.027559055118110236e0), 253) ELSE 255 END AS z8, CASE WHEN deaf BETWEEN 0 AND 1 THEN round_even(161.70142218136185e0 * asin(sqrt(least(1e0 - 1e-12, greatest(1e-12, deaf)))), 0) ELSE 255 END AS eaf8 FROM d),
c AS (SELECT *, CASE WHEN z8 = 255 THEN CAST(CAST(dz AS FLOAT) AS DOUBLE) WHEN z8 < 254 THEN -3.5e0 + (z8 + 0.5e0) * 0.027559055118110236e0 END AS cz, CASE WHEN eaf8 = 255 THEN CAST(CAST(deaf AS FLOAT) AS DOUBLE) ELSE {grid('eaf8', 254)} END AS ceaf FROM c0)"""


#: What is added before a value is cut to its decimals. Short decimals often lie on ties of one half, but none on ties of this.
NUDGE = 0.49871


def _cut(text: str) -> str:
    """round(x, n) as floor(x * 10^n + NUDGE) / 10^n, which engines evaluate alike; round(x) stays."""
    out, at = "", 0
    while (i := text.find("round(", at)) >= 0:
        depth, comma, j = 1, -1, i + 6
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text[j], 0)
            if text[j] == "," and depth == 1:
                comma = j
            j += 1
        inner = _cut(text[i + 6 : comma if comma > 0 else j - 1])
        if comma > 0:
            scale = f"1e{int(text[comma + 1 : j - 1])}"
            out += text[at:i] + f"(floor(({inner}) * {scale} + {NUDGE}e0) / {scale})"
        else:
            out += text[at:i] + f"round({inner})"
        at = j
    return out + text[at:]


def sql(body: str, *ctes: str) -> str:
    return f"WITH {VIEW_SQL}, " + ", ".join(ctes) + f" {_cut(body)}"


BASE = (N, Q, K)
RESOLVED = (*BASE, P)
ENCODED = (*RESOLVED, ROWS, E)
DECODED = (*ENCODED, D)
LEGACY = (*RESOLVED, ROWS, L)
