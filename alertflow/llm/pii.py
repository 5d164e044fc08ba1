"""Personal data in texts: patterns propose spans, checksums confirm them,
context words adjust their score.  Spark built-ins only.

Base kinds (always kept once valid): email, ip (parts at most 255), card (14
to 19 digits passing Luhn), phone (10 to 15 digits).  The method adds iban
(mod-97) and ssn, which count from ``MIN_SCORE`` on; a context word near the
span raises a score.  Positions are code points, end exclusive.

The patterns below find the same matches as the plain ones of the contract
but never scan a run of characters twice: possessive runs, and a start only
where a run starts (or where the previous match ended).

A text is cut into pieces of some ``PIECE`` characters where no match can go
on, and each piece is searched and masked on its own, so the work grows with
the text and not with the square of its spans.  A stretch that offers no such
place (digits, capitals and blanks only, say) is one piece whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The head of an account number; group 1 is the run after it, which may go on into other words.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"
# Characters of an account number by country, as registered (ISO 13616)
IBAN_LENGTHS = {n: codes.split() for n, codes in (
    (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"),
    (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"),
    (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"),
    (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"),
    (32, "LC"), (33, "RU"))}
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# At least PIECE characters, up to the next character that no pattern takes, or the
# blank after a small letter (no pattern takes both); then what is left of the text.
PIECE = 4096
PIECES = rf"(?s).{{{PIECE}}}.*?(?=[^A-Za-z0-9._%+@\x20()-]|(?<=[a-z])\x20)|.+"

# kind: (pattern, a character the text must hold, score without context, context words)
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write"),
    "ip": (IP, ".", 0.6, "ip|address|host|server"),
    "card": (CARD, None, 0.8, "card|visa|credit|pay"),
    "phone": (PHONE, "+", 0.7, "phone|call|tel|fax|mobile"),
    "iban": (IBAN, None, 0.9, "iban|account|bank|konto|compte|cuenta"),
    "ssn": (SSN, "-", 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    each = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5))
                          .otherwise(d.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number passes the mod-97 check."""
    compact = F.regexp_replace(iban, "[^A-Z0-9]", "")
    turned = F.concat(compact.substr(F.lit(5), F.length(compact)),
                      compact.substr(1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), lambda a, ch: F.when(
        ch.between("0", "9"), (a * 10 + ch.cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97))
    return rest == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(IP_VALID)
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    return F.lit(True)


def account_number(head: Column, run: Column) -> Column:
    """The account number that starts with ``head``: of the parts of head and
    run that end where a word ends and pass mod-97, the one as long as its
    country says, else the longest; null if there is none."""
    words = F.split(run, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.concat(head, F.array_join(F.slice(words, 1, n), " ")))
    size = lambda part: F.length(F.replace(part, F.lit(" ")))
    parts = F.filter(parts, lambda part: size(part).between(15, 34) & ~part.rlike("[a-z]") & mod97(part))
    country, fixed = head.substr(1, 2), F.lit(0)
    for n, codes in IBAN_LENGTHS.items():
        fixed = F.when(country.isin(codes), n).otherwise(fixed)
    return F.coalesce(F.get(F.filter(parts, lambda part: size(part) == fixed), F.lit(0)),
                      F.get(F.reverse(parts), F.lit(0)))


SPAN = "struct<start: int, kind_no: int, stop: int, score: double>"


def find(kind: str, text: Column, before: Column, after: Column) -> Column:
    """Valid spans of one kind in a piece of text, in its order; added kinds only
    with a score of ``MIN_SCORE`` or more.  ``before`` and ``after`` are the
    characters around the piece.

    The pieces between matches give the positions: a match starts after all
    pieces and matches before it.  Only the head of an account number is
    matched, so a head that turns out to be none hides no later one.
    """
    pattern, needs, _, _ = KINDS[kind]
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if kind == "iban":
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        found = F.zip_with(matched, runs, account_number)
    else:
        found = matched
    steps = F.transform(F.arrays_zip(matched.alias("matched"), found.alias("found"), gaps.alias("gap")),
                        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["matched"]).alias("size"),
                                           p["found"].alias("found")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    no = list(KINDS).index(kind)
    place = "struct<start: int, stop: int, found: string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast(f"array<{place}>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        stop = at + F.length(s["found"])
        span = F.struct(at.alias("start"), stop.alias("stop"), s["found"].alias("found"))
        fits = s["found"].isNotNull() & (at >= acc["free"])  # a head inside an account number is none
        return F.struct((at + s["size"]).alias("at"), F.when(fits, stop).otherwise(acc["free"]).alias("free"),
                        F.when(fits, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["spans"])
    spans = F.filter(spans, lambda s: _valid(kind, s["found"]))
    around = F.concat(before, text, after)
    spans = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(no).alias("kind_no"), s["stop"].alias("stop"),
        score(kind, around, s["start"] + F.length(before), s["stop"] + F.length(before)).alias("score")))
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    there = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(there, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def score(kind: str, text: Column, start: Column, stop: Column) -> Column:
    """The kind's score, higher when one of its context words is near."""
    _, _, alone, context = KINDS[kind]
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.concat_ws(" ", text.substr(first + 1, start - first), text.substr(stop + 1, F.lit(CONTEXT_CHARS)))
    return F.least(F.lit(1.0), F.lit(alone) + F.when(F.lower(near).rlike(rf"\b(?:{context})"), CONTEXT_BONUS).otherwise(0.0))


def with_spans(docs: DataFrame, text: str, column: str) -> DataFrame:
    """Add the pieces of the text, in order: ``at`` (characters before it),
    ``body`` and ``spans``, whose positions count from the piece, by start, then
    kind.  Together the bodies are the text; a null or empty one has no piece."""
    cut = docs.withColumn(column, F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")),
                                                       F.lit(PIECES), F.lit(0)))
    pieces = F.col(column)
    at = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(
        acc, F.array(F.element_at(acc, -1) + F.length(p))))
    none = F.lit("")
    # a piece but the last has more characters than the context
    around = F.transform(pieces, lambda p, i: F.struct(
        p.alias("body"), F.coalesce(F.right(F.get(pieces, i - 1), F.lit(CONTEXT_CHARS)), none).alias("before"),
        F.coalesce(F.get(pieces, i + 1).substr(1, CONTEXT_CHARS), none).alias("after")))
    parts = cut.withColumn(column, F.zip_with(around, F.slice(at, F.lit(1), F.size(pieces)), lambda p, n: F.struct(
        n.alias("at"), p["body"].alias("body"), p["before"].alias("before"), p["after"].alias("after"))))
    return parts.withColumn(column, F.transform(column, lambda p: F.struct(
        p["at"].alias("at"), p["body"].alias("body"),
        F.array_sort(F.concat(*[find(k, p["body"], p["before"], p["after"]) for k in KINDS])).alias("spans"))))


def _names() -> Column:
    return F.array(*[F.lit(k) for k in KINDS])


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(_names(), s["kind_no"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, all
    spans and their scores, per row of ``docs``.

    A null or empty text has no spans; null ids and repeated rows each give a
    row; an empty table gives an empty result; extra columns are ignored.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "pieces")
    spans = F.flatten(F.transform("pieces", lambda p: F.transform(p["spans"], lambda s: F.struct(
        (p["at"] + s["start"]).alias("start"), s["kind_no"].alias("kind_no"),
        (p["at"] + s["stop"]).alias("stop"), s["score"].alias("score")))))
    found = found.select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["kind_no"] == n)).cast("long").alias(f"n_{k}")  # noqa: B023
                    for n, k in enumerate(BASE)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def masked(text: Column, spans: Column) -> Column:
    """A piece with every span (sorted) replaced by its kind in brackets; spans
    that overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(F.element_at(_names(), s["kind_no"] + 1)), F.lit("]"))
        fresh_span = s["start"] >= acc["at"]
        out = F.when(fresh_span, F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), label)
                     ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (null stays null) and
    ``n_chars`` set to the new length where that column exists."""
    p = "pii_pieces"
    while any(c.lower() == p for c in docs.columns):
        p = "_" + p
    found = with_spans(docs, "text", p)
    whole = F.array_join(F.transform(p, lambda x: F.when(F.size(x["spans"]) > 0, masked(x["body"], x["spans"])
                                                         ).otherwise(x["body"])), "")
    out = found.withColumn("text", F.when(F.exists(p, lambda x: F.size(x["spans"]) > 0), whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return out.select(*[f"`{c}`" for c in docs.columns])
