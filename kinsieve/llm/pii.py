"""Operator 3: personal data by patterns, checksums and context words, in DataFrame expressions only.

Patterns propose spans (code points, end exclusive). Validators confirm them: octets, digit counts,
Luhn, mod-97. Words just before a span move its score. The four base kinds keep every confirmed span;
the added kinds (iban, short_card, local_phone) keep those whose score reaches MIN_SCORE.

Cases: a null or empty text has no spans (zero counts, digest and list of the empty string). Rows
keep their number, repeated and null ids included; extra columns keep their values, whatever their names. Patterns use possessive
repeats, so very long texts and digit runs need no stack and no quadratic scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read

# Base patterns as in the contract, with possessive repeats, and starts only where a leftmost match can start.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "local_phone": r"(?<![0-9+.])0[0-9](?:[\x20()./-]{0,2}[0-9]){6,12}(?![0-9])",
}
#: A text without this can't match.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|credit|carte|karte|kreditkarte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telephone|téléphone|telefon|handy|anruf|teléfono|móvil|llamar|appeler",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
CONTEXT |= {"short_card": CONTEXT["card"], "local_phone": CONTEXT["phone"]}
#: Score of a confirmed span, and what a context word within NEAR characters before it adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "short_card": 0.3, "local_phone": 0.3}
BONUS, NEAR, MIN_SCORE = 0.3, 40, 0.5
OCTET = "0*(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = [*BASE, *ADDED]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _doubled(F.try_to_number(c, F.lit("9")).cast("int"), i))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    bare = F.regexp_replace(account, " ", "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(code(c) > 9, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _octets(m),
        "card": lambda: F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: mod97(m),
        "short_card": lambda: luhn(_digits(m)),
        "local_phone": lambda: n.between(8, 14),
    }[kind]()


def _octets(m: Column) -> Column:
    """Whether each dotted part is at most 255, with any number of leading zeros."""
    return m.rlike(rf"^{OCTET}(?:\.{OCTET})*$")


def _placed(text: Column, hits: Column, kind: str, pattern: str) -> Column:
    """Hits with their places: a match starts after all gaps and matches before it."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))
    # only confirmed matches enter the array, which grows by copies
    span = lambda a, x: F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["n"]).alias("e"), x["m"].alias("m"))
    return F.aggregate(
        steps,
        start,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.when(_confirmed(kind, x["m"]), F.concat(a["out"], F.array(span(a, x)))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def one(x: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), x["s"] - NEAR + 1), F.least(F.lit(NEAR), x["s"]))
        near = before.rlike(rf"(?iu)(?<![\p{{L}}])(?:{CONTEXT[kind]})(?![\p{{L}}])")
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(near, min(1.0, PRIOR[kind] + BONUS)).otherwise(PRIOR[kind]).alias("score"))

    return F.filter(F.transform(spans, one), lambda x: x["score"] >= MIN_SCORE)


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with a struct column: for each kind an array of (kind, s, e, score) in order of place."""
    t = F.col(text)
    none = "cast(array() as array<{}>)"
    has_digit = t.rlike("[0-9]")
    wanted = {k: t.contains(NEEDS[k]) if k in NEEDS else has_digit for k in KINDS}
    hits, placed_at = free(docs, "_hits"), free(docs, "_placed")
    found = docs.withColumn(hits, F.struct(*(F.coalesce(F.when(wanted[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))), F.expr(none.format("string"))).alias(k) for k, p in (BASE | ADDED).items())))
    placed = found.withColumn(
        placed_at, F.struct(*(F.when(F.size(F.col(hits)[k]) > 0, _placed(t, F.col(hits)[k], k, p)).otherwise(F.expr(none.format("struct<s:int,e:int,m:string>"))).alias(k) for k, p in (BASE | ADDED).items()))
    )
    scored = F.struct(*(F.when(F.size(F.col(placed_at)[k]) > 0, _scored(t, F.col(placed_at)[k], k)).otherwise(F.expr(none.format("struct<kind:string,s:int,e:int,score:double>"))).alias(k) for k in KINDS))
    return placed.withColumn(into, scored).drop(hits, placed_at)


def _listed(*spans: Column) -> Column:
    return F.array_join(F.transform(reduce(lambda a, b: F.concat(a, b), spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, digest of the base spans, all spans and their scores of each row."""
    s = F.col("pii_spans")
    found = with_spans(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    every = [s[k] for k in KINDS]
    return found.select(
        key,
        *(F.size(s[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(*(s[k] for k in BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(*every).alias("spans"),
        F.array_join(F.transform(reduce(lambda a, b: F.concat(a, b), every), lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; overlapping spans are one, of the kind that starts first."""
    into, cut_at = free(docs, "pii_spans"), free(docs, "_cut")
    t, s = F.col(text), F.col(into)
    spans = F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.transform(s[k], lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))) for k in KINDS]))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int,kind:string>>)").alias("out"))

    def merge(a: Column, x: Column) -> Column:
        e = -x["e"]
        kept = F.struct(F.greatest(a["at"], e).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("a"), x["s"].alias("b"), x["kind"].alias("kind")))).alias("out"))
        return F.when(x["s"] >= a["at"], kept).otherwise(F.struct(F.greatest(a["at"], e).alias("at"), a["out"].alias("out")))

    # each entry: the clear text from a to b, then a kind; an overlapped span's end is the next entry's a
    marked = with_spans(docs, text, into).withColumn(cut_at, F.when(F.size(spans) > 0, F.aggregate(spans, empty, merge)))
    cut = F.col(cut_at)
    piece = lambda a, b: F.substring(t, a + 1, b - a)
    rebuilt = F.concat(F.array_join(F.transform(cut["out"], lambda x: F.concat(piece(x["a"], x["b"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""), F.expr(f"substring(`{text}`, `{cut_at}`.at + 1)"))
    return marked.withColumn(text, F.when(cut.isNotNull(), rebuilt).otherwise(t)).drop(cut_at, into)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents", "doc_id", "text"))
