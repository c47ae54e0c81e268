"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. Columns only.

Kinds of the base rule are email, ip, card (16 to 19 digits, Luhn) and phone. Beyond it come iban (mod-97) and
ssn (no checksum, so that words nearby have to speak for it); either is reported from a score of 0.7. An account number is
as long as its country has it, so that words that follow aren't part of it.

Edge cases: null and empty texts have no spans; runs of any length are matched without recursion (possessive
quantifiers); repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import spans as S

# Each pattern starts where a run starts, or where the last match ended: a start within a run cannot match
# where that of the run itself doesn't, and trying each makes long runs quadratic.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN = "(?:" + "|".join(f"(?:{'|'.join(c for c, k in IBAN_LENGTHS.items() if k == n)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))) + ")"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Characters that must not stand next to a match of these.
BESIDE = {"iban": "^[A-Za-z0-9]$", "ssn": "^[0-9-]$"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
CONTEXT = {
    "email": r"(?i)mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security",
}
NEAR = 40  # code points on either side that count as context


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 1 to 20 digits pass Luhn's checksum; every other digit from the right but the last counts twice, less 9 over 9."""
    padded = F.lpad(number, 20, "0")
    twice = F.translate(padded, "123456789", "246813579")
    total = sum((F.substring(twice if i % 2 else padded, i, 1).cast("int") for i in range(1, 21)), F.lit(0))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its first four characters put last and letters as 10 to 35, leaves 1 by 97."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def spans_of(text: Column, context: bool = True) -> dict[str, Column]:
    """Kind -> spans with scores: 0.6 for a match without checksum, 0.8 for one that passes, 0.2 more with context."""

    def score(kind: str, base: float):
        def of(x: Column) -> Column:
            around = F.concat_ws(" ", F.substring(text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR))), F.substring(text, x["end"] + 1, NEAR))
            return F.when(around.rlike(CONTEXT[kind]), base + 0.2).otherwise(F.lit(base))

        return of if context else None

    n = lambda x: F.length(digits(x))

    def apart(kind: str, pattern: str, needs: str | None = None) -> Column:
        """Matches that the character before or after doesn't carry on."""
        before = lambda x: F.when(x["start"] > 0, F.substring(text, x["start"], 1)).otherwise("")
        return F.filter(S.matches(text, pattern, needs), lambda x: ~before(x).rlike(BESIDE[kind]) & ~F.substring(text, x["end"] + 1, 1).rlike(BESIDE[kind]))

    return {
        "email": S.kept(S.matches(text, EMAIL, "@"), "email", None, score("email", 0.6)),
        "ip": S.kept(S.matches(text, IP), "ip", lambda x: x.rlike(OCTETS), score("ip", 0.6)),
        "card": S.kept(S.matches(text, CARD), "card", lambda x: n(x).between(16, 19) & luhn(digits(x)), score("card", 0.8)),
        "phone": S.kept(S.matches(text, PHONE, "+"), "phone", lambda x: n(x).between(8, 15), score("phone", 0.6)),
        "iban": S.kept(apart("iban", "(?=[A-Z]{2}[0-9]{2})" + IBAN), "iban", mod97, score("iban", 0.8), 0.7 if context else 0),
        "ssn": S.kept(apart("ssn", SSN, "-"), "ssn", None, score("ssn", 0.6), 0.7),
    }


def found(text: Column) -> Column:
    """An array of (kind, start, end, score) by kind as listed, then start."""
    by_kind = spans_of(F.coalesce(text, F.lit("")))
    return F.concat(*(by_kind[k] for k in KINDS))


def find_pii(docs: DataFrame) -> DataFrame:
    """The documents with their spans as `pii`, in place of any column of that name."""
    return docs.withColumn("pii", found(F.col("text")))


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced by <KIND> in text (null stays null) and n_chars, where there is one, counted anew."""
    spans = shared.fresh(docs, "lf_spans")
    out = docs.withColumn(spans, found(F.col("text"))).withColumn("text", S.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    base = F.filter("pii", lambda x: x["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS), F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed(F.col("pii")).alias("spans"))
