"""Deterministic studies."""

import math

COLS = "ordinal long, chromosome string, base_pair_location long, reference_allele string, alternate_allele string, effect_allele string, other_allele string, beta double, standard_error double, effect_allele_frequency double, p_value double, variant_id string, rsid string, annotation string, z double"


def rows(n=1200):
    out = []
    for i in range(1, n + 1):
        ref, alt = "CGTA"[(i - 1) % 4], "ACGT"[(i - 1) % 4]
        beta, se = math.sin(i / 13) / 5, 0.02 + (i % 17) / 1000
        out.append([i, "1", 100000 + i, ref, alt, alt, ref, beta, se, 0.1 + (i % 20) / 100, math.erfc(abs(beta / se) / math.sqrt(2)), f"1:{100000 + i}:{ref}:{alt}", f"rs{i}", "abc"[(i - 1) % 3], beta / se])
    return out


def frame(spark, data):
    return spark.createDataFrame([tuple(r) for r in data], COLS)


def study(spark, n=1200):
    return frame(spark, rows(n))
