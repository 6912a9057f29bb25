"""PII (8): patterns propose, checksums confirm, context words adjust.

DataFrame functions only. Each kind has a pattern, a check on the match (Luhn
for cards, mod 97 for IBANs, value ranges and digit counts for others), a
starting score, and words that raise the score when they stand within
``CONTEXT`` code points of the match. Base kinds keep every checked match,
whatever its score; the kinds that the method adds need ``ACCEPT``.

Positions: ``regexp_extract_all`` cuts a text into (gap, match) pairs, whose
lengths add up to code point offsets. A closing ``|\\z`` lets the search end
in one scan, and look-behinds bar starts inside a run of characters that an
earlier start has ruled out, so the patterns are linear in the text. Texts
without a kind's telling character skip its pattern.

Null is the empty text: no spans. Repeated rows give equal rows. Extra columns
are passed through by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
ACCEPT = 0.6
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Luhn check of the digits of s."""
    d = F.transform(F.filter(F.split(F.reverse(digits(s)), ""), lambda x: x != ""), lambda x: x.cast("int"))
    odd = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(odd, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """ISO 7064 check of an IBAN: the first four characters moved to the end,
    letters as two digits, the number modulo 97 is 1."""
    plain = F.regexp_replace(s, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, x: F.when(value(x) > 9, (a * 100 + value(x)) % 97)
                       .otherwise((a * 10 + value(x)) % 97)) == 1


def n_digits(least: int, most: int):
    return lambda s: F.length(digits(s)).between(least, most)


def octets(s: Column) -> Column:
    # by text, so that very long digit runs need no number: leading zeros may stand before at most three digits
    return F.forall(F.split(s, r"\."), lambda x: x.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def ssn(s: Column) -> Column:
    return ~s.rlike("^(000|666|9[0-9]{2})|^...-00|0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a pattern that every match contains
    check: object
    score: float
    words: tuple[str, ...]
    base: bool = False


_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds as listed in the contract, then those that the method adds. A
#: base pattern matches what the contract's does: possessive closings (nothing
#: follows) need no stack, and starts are barred where the plain pattern's
#: leftmost match can't start.
KINDS = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@",
         lambda s: F.lit(True), 0.8, ("mail", "contact", "contacto", "kontakt", "write to", "courriel", "correo"), True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+){3}", r"[0-9]\.[0-9]", octets, 0.6,
         ("ip", "address", "server", "host", "adresse", "dirección"), True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", r"[0-9][ -]?[0-9][ -]?[0-9]", luhn, 0.7,
         ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "cvv"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", n_digits(9, 15), 0.7,
         ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"), True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", mod97, 0.9, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", ssn, 0.4,
         ("ssn", "social security", "tax id")),
    Kind("local_phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}[.-][0-9]{4}",
         lambda s: F.lit(True), 0.4, ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")),
]
RAISE = 0.2


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches."""
    both = rf"(?s)(.*?)({pattern}|\z)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("gap"),
                         F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("hit"))
    kind = "struct<at:int,found:array<struct<start:int,end:int,s:string>>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("s")))
        return F.struct(end.alias("at"), F.when(F.length(x["hit"]) > 0, F.concat(acc["found"], one))
                        .otherwise(acc["found"]).alias("found")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def spans_of(text: Column, kind: Kind) -> Column:
    """array of SPAN of one kind."""
    words = "(?iu)(?<![\\p{L}])(?:" + "|".join(kind.words) + ")"

    def scored(x: Column) -> Column:
        near = F.concat(F.substr(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"])),
                        F.lit("\n"), F.substr(text, x["end"] + 1, F.lit(CONTEXT)))
        value = F.lit(kind.score) + F.when(near.rlike(words), RAISE).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        F.least(F.lit(1.0), value).alias("score")).cast(SPAN)

    good = F.filter(places(text, kind.pattern), lambda x: kind.check(x["s"]))
    spans = F.transform(good, scored)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= ACCEPT)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(kind.gate), spans).otherwise(none)


def find(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """The input with ``out``: spans of all kinds, by start, then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = reduce(F.concat, [spans_of(t, k) for k in KINDS])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i)])
    keyed = F.transform(every, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x.alias("span")))
    return docs.withColumn(out, F.when(t.rlike("[0-9@]"), F.transform(F.array_sort(keyed), lambda x: x["span"]))
                           .otherwise(F.array().cast(f"array<{SPAN}>")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, and the highest score."""
    base = [k.name for k in KINDS if k.base]
    found = find(docs.select("doc_id", "text"), out="pii_spans").select("doc_id", "pii_spans")
    own = F.filter("pii_spans", lambda x: x["kind"].isin(base))
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(listed(own), 256).alias("base_sha256"),
                        listed(F.col("pii_spans")).alias("spans"),
                        F.array_max(F.transform("pii_spans", lambda x: x["score"])).alias("max_score"))
