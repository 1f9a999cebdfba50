"""Personal data with DataFrame operations only.

A kind has a cheap test that most texts fail, a pattern that proposes spans, a check that confirms
them (digit counts, number ranges, the Luhn sum, the ISO 7064 remainder modulo 97) and words whose
presence next to a span raises its score. Row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import pieces

NEAR = 48  # code points on either side in which context words count
CONTEXT = 0.3  # what a context word adds to a score
ALNUM = "[A-Za-z0-9]"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    turned = F.reverse(number)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(number) - 1)
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN leaves the remainder 1: its first four characters go last, letters count
    from 10."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(a: Column, c: Column) -> Column:
        is_digit = c <= "9"
        value = F.when(is_digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(a * F.when(is_digit, 10).otherwise(100) + value, F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def is_ip(hit: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return F.rlike(hit, F.lit(rf"\A{part}(?:\.{part}){{3}}\z"))


def is_card(hit: Column) -> Column:
    number = digits(hit)
    return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)


def is_phone(hit: Column) -> Column:
    return F.length(digits(hit)).between(10, 15)


def is_iban(hit: Column) -> Column:
    code = F.replace(hit, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)


#: Characters of an IBAN by country, as registered or in use.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GF GP GQ GR IT KM MC MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def iban_pattern() -> str:
    """Groups of four, with or without blanks, to the length of the country; a code that is not
    listed may have any. Letters and digits on either side rule a span out before it is taken."""
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    forms = []
    for size, codes in IBAN_LENGTHS.items():
        fours, rest = divmod(size - 4, 4)
        short = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{short}")
    forms.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?")
    return rf"(?<!{ALNUM})(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?!{ALNUM})"


def is_ssn(hit: Column) -> Column:
    return ~F.rlike(hit, F.lit(r"\A(?:000|666|9)|-00-|-0000\z"))


class Kind(NamedTuple):
    name: str
    test: Callable[[Column], Column]
    pattern: str
    check: Callable[[Column], Column]
    words: str  # context words
    score: float  # without context
    least: float  # score to be reported
    alone: bool  # letters and digits on either side rule it out


def matching(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


#: In the order of the report. Where a long run of characters could be tried from each of its
#: places, the pattern starts at the run's start or where the last match ended, which finds the
#: same spans in linear time; loops are possessive where nothing after them could need a step back.
KINDS = (
    Kind(
        "email",
        lambda text: F.contains(text, F.lit("@")),
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True),
        "e-?mail|mail|contact|write|reach",
        0.7,
        0.0,
        False,
    ),
    Kind(
        "ip",
        matching(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
        is_ip,
        "ip|address|host|server|login",
        0.5,
        0.0,
        False,
    ),
    Kind(
        "card",
        matching(r"[0-9](?:[\x20-]?[0-9]){13}"),
        r"[0-9](?:[\x20-]?[0-9])++",
        is_card,
        "card|visa|mastercard|amex|credit|debit|payment|pay",
        0.6,
        0.0,
        False,
    ),
    Kind(
        "phone",
        matching(r"\+[0-9]"),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        is_phone,
        "phone|tel|call|mobile|cell|fax|contact",
        0.5,
        0.0,
        False,
    ),
    Kind(
        "iban",
        matching(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        iban_pattern(),
        is_iban,
        "iban|account|bank|transfer",
        0.6,
        0.0,
        True,
    ),
    Kind(
        "ssn",
        matching("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        is_ssn,
        "ssn|social|security|taxpayer",
        0.4,
        0.5,
        True,
    ),
)

BASE = ("email", "ip", "card", "phone")
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of a kind; matches that fail are dropped."""

    def near(p: Column) -> Column:
        around = F.concat_ws(" ", F.right(p["before"], F.lit(NEAR)), F.left(p["after"], F.lit(NEAR)))
        return F.rlike(around, F.lit(rf"(?i)(?<![a-z])(?:{kind.words})"))

    def apart(p: Column) -> Column:
        return ~F.rlike(p["before"], F.lit(rf"{ALNUM}\z")) & ~F.rlike(p["after"], F.lit(rf"\A{ALNUM}"))

    def good(p: Column) -> Column:
        return kind.check(p["piece"]) & apart(p) if kind.alone else kind.check(p["piece"])

    found = F.transform(
        F.filter(pieces(text, kind.pattern), good),
        lambda p: F.struct(
            p["start"].alias("start"),
            F.lit(rank).alias("rank"),
            p["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.round(kind.score + F.when(near(p), CONTEXT).otherwise(0.0), 2).alias("score"),
        ),
    )
    kept = F.filter(found, lambda s: s["score"] >= kind.least) if kind.least else found
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(kind.test(text), kept.cast(f"array<{SPAN}>")).otherwise(none)


def listed(spans: Column) -> Column:
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every text: one row per row of ``df``.

    Returns ``(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found)``. Places are code
    points, ends exclusive. ``found`` lists all spans as structs with kind and score, ordered by
    start and then by kind; ``spans`` has them as text; ``base_sha256`` is the hash of that text
    for the kinds in ``BASE``, whatever their score. A social security number counts only next to
    a context word. Null text counts as empty; repeated rows give repeated rows; an empty table
    gives no rows; other columns are ignored.
    """
    frame = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    frame = frame.select(
        key, *[spans_of(F.col("_text"), k, i).alias(f"_{k.name}") for i, k in enumerate(KINDS)]
    )
    every = F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in KINDS]))
    frame = frame.withColumn("_all", every)
    base = F.filter("_all", lambda s: s["rank"] < len(BASE))
    return frame.select(
        key,
        *[F.size(f"_{name}").cast("bigint").alias(f"n_{name}") for name in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("_all")).alias("spans"),
        F.transform(
            "_all",
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["score"].alias("score"),
            ),
        ).alias("found"),
    )
