"""Reference assemblies: chromosome order, lengths and offsets."""

from __future__ import annotations

import re
from itertools import accumulate

CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]
#: Base pairs of chromosomes 1 to 22, X and Y.
LENGTHS = {
    "GRCh38": [248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415],
    "GRCh37": [249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566],
}


def normalize_build(name: str) -> str:
    """GRCh37, hg19, 37 or GRCh38, hg38, 38, in any case and punctuation."""
    key = re.sub("[^a-z0-9]", "", str(name).lower())
    for build, names in {"GRCh37": {"grch37", "hg19", "37"}, "GRCh38": {"grch38", "hg38", "38"}}.items():
        if key in names:
            return build
    raise ValueError(f"unknown genome build {name!r}; use GRCh37 or GRCh38")


def lengths(build: str) -> dict[str, int]:
    return dict(zip(CHROMOSOMES, LENGTHS[normalize_build(build)], strict=True))


def offsets(build: str) -> dict[str, int]:
    """Bases before each chromosome."""
    sizes = LENGTHS[normalize_build(build)]
    return dict(zip(CHROMOSOMES, [0, *accumulate(sizes)][:-1], strict=True))
