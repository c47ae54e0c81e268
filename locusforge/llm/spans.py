"""Regular expression matches with code-point offsets, as column expressions.

Spark returns matches or pieces between them, but no offsets; both come from the same matcher here, so that running
lengths of pieces and matches give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_HITS = "array<struct<start:int,end:int,text:string>>"


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, text). needs: a string that any match holds, looked for first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_HITS).alias("out"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    some = text.rlike(pattern) if needs is None else text.contains(needs) & text.rlike(pattern)
    return F.when(some, F.aggregate(pairs, start, step, lambda done: done["out"])).otherwise(F.array().cast(_HITS))


def kept(hits: Column, kind: str, test: Callable[[Column], Column] | None = None, score: Callable[[Column], Column] | None = None, cut: float = 0.0) -> Column:
    """Hits that pass a test on their text, as spans with a score of at least the cut."""
    good = F.filter(hits, lambda x: test(x["text"])) if test else hits
    spans = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (score(x) if score else F.lit(1.0)).alias("score")))
    return F.filter(spans, lambda x: x["score"] >= cut) if cut else spans


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then kind in the order of `kinds`, then end."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), F.array_position(rank, x["kind"]).alias("b"), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; of overlapping spans the first by start covers the rest of the others."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.concat(done["out"], F.array(piece)).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), x["end"].alias("end"), x["kind"].alias("kind"))))
    joined = F.aggregate(ordered, start, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
