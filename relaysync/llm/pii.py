"""Personal data in whole texts: patterns propose, checksums confirm, context scores.

Built-in functions only.  Matches come from ``regexp_extract_all`` and the
gaps between them from ``split`` with the same pattern (both scan left to
right without overlap), so positions are running sums of lengths in code
points.  The patterns are the contract's, written so that each text is
scanned in linear time: a match may start only where a run of its first class
starts or the previous match ended, and repeats that can give nothing back
are possessive.  Neither changes which spans match.

Kinds: email, ip, card, phone (the base), and iban (country code, check
digits, as many more characters as that country's numbers have, single spaces
between any of them, mod-97 = 1).  Only an iban's first four characters are
consumed, so a candidate that fails hides none that starts inside it; valid
ones that overlap are all listed.  A span's score starts at its
kind's prior and rises when a word of its kind stands within ``CONTEXT``
characters before it.

Defined results: null or empty text has no spans; equal starts order by kind
as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaysync.llm.common import own_columns, read

CONTEXT = 40
RUN = 256

# fixed values: lengths of account numbers by country (the registry's, and those in use that it does not list)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(v.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, v in IBAN_LENGTHS.items())

# fixed values: kind, cheap necessary condition, pattern (a group, where there is one, is the whole span)
PATTERNS = (
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", None, rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z0-9]{{4}}"),
)
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.9}
WORDS = {
    "email": "mail|contact|correo|courriel|kontakt",
    "ip": "address|server|host|login|adresse",
    "card": "card|visa|pay|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|llam|appel|anruf",
    "iban": "iban|account|bank|cuenta|compte|konto",
}
KINDS = tuple(k for k, _, _ in PATTERNS)
BASE = KINDS[:4]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check (the last digit counts once)."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its first four characters moved last, is 1 modulo 97."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    part = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(part, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        # at most 255: three digits without leading zeros
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        d = _digits(s)
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return mod97(s)
    return F.lit(True)


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _spans(kind: str, text: Column) -> Column:
    rank = KINDS.index(kind)
    need, pattern = next((n, p) for k, n, p in PATTERNS if k == kind)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"), m.alias("whole")))
    if kind == "iban":
        both = F.zip_with(both, F.regexp_extract_all(text, F.lit(pattern), 1), lambda x, w: x.withField("whole", w))
    # in runs of RUN matches: an accumulated array is copied at every step
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")),
                       lambda k: F.slice(both, k * RUN + 1, F.lit(RUN)))
    long = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + F.length(x["g"]) + F.length(x["m"])))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(long, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
                         lambda a: a["starts"])

    def step(acc, x):
        a = acc["at"] + F.length(x["g"])
        e = a + F.length(x["whole"])
        near = F.lower(F.right(x["g"], F.lit(CONTEXT))).rlike(WORDS[kind])
        span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"),
                        (F.lit(PRIOR[kind]) + F.when(near, (1 - PRIOR[kind]) / 2).otherwise(0.0)).alias("score"))
        kept = F.when(_confirmed(kind, x["whole"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((a + F.length(x["m"])).cast("int").alias("at"), kept.cast(_SPAN).alias("spans"))

    spans = F.flatten(F.zip_with(runs, starts, lambda run, at: F.aggregate(
        run, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"])))
    may = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
    return F.when(may & (F.size(found) > 0), spans).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, column: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array column of spans (start, rank, kind, end, score) in text order."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(k, text) for k in KINDS]))
    # a generator of one row: later uses of the column do not repeat the search
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], F.explode(F.array(spans)).alias(into))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets (overlaps: the first wins)."""
    def step(acc, s):
        take = s["start"] >= acc["at"]
        return F.struct(F.when(take, s["end"]).otherwise(acc["at"]).alias("at"),
                        F.when(take, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                                              F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = own_columns(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")

    def of(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = {k: of(k) for k in KINDS}
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count[k] for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("pii")).alias("spans"), count["iban"],
                        F.coalesce(F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), F.lit(0.0)).alias("top_score"))
