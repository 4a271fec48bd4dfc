"""Personal data: regular expressions propose spans, checksums confirm, context words adjust the score.

Only column expressions are used. A pattern's spans follow from its matches and
from the gaps that splitting the text at the matches leaves: offsets are
running sums of their lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import free_name

#: Kinds in the order in which equal starts are listed (fixed values). The first four are base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = 4
#: Patterns. A run of characters that may open a match is entered at its beginning only, or right
#: where the match before ended, and repeats are possessive, so time stays linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that make a kind likelier when they stand shortly before it.
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"\b(?:ip|host|server|address|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"\b(?:tel|phone|call|mobile|fax)\b",
    "iban": r"\b(?:iban|bank|account|transfer|konto|cuenta|compte)\b",
    "ssn": r"\b(?:ssn|social security|taxpayer|tax id)\b",
}
#: Score of a confirmed span, and what context adds.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
CONTEXT_SCORE = 0.2
#: What the score of a span of a kind that is not base must reach. The base kinds are fixed by their patterns and checks.
ADDED_SCORE = 0.5
CONTEXT_CHARS = 40
#: Where a kind needs a character, texts without it are not searched.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-"}
_HIT = "array<struct<at:int,stop:int,hit:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Luhn: doubled every second digit from the right, the digit sum is a multiple of ten."""
    digits = F.reverse(_digits(hit))

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod_97(hit: Column) -> Column:
    """ISO 13616: with the first four characters moved to the end and letters as numbers, the rest by 97 is 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, k: Column) -> Column:
        c = F.substring(turned, k, F.lit(1))
        letter = c.rlike("[A-Z]")
        return F.when(letter, rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & _mod_97(hit)
    if kind == "ssn":  # numbers that are never given out
        return ~hit.rlike("^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _placed(hits: Column, gaps: Column) -> Column:
    """Matches with the code points where they start and stop."""

    def add(done: Column, k: Column) -> Column:
        at = done["at"] + F.length(F.get(gaps, k))
        stop = at + F.length(F.get(hits, k))
        one = F.struct(at.alias("at"), stop.alias("stop"), F.get(hits, k).alias("hit"))
        return F.struct(stop.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, add, lambda done: done["found"])


def _spans(text: Column, kind: str, hits: Column, gaps: Column) -> Column:
    """The confirmed spans of one kind with their scores."""

    def confirmed(s: Column) -> Column:
        return _confirmed(kind, s["hit"])

    def span(s: Column) -> Column:
        begin = F.greatest(s["at"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, begin + 1, s["at"] - begin)).rlike(CONTEXT[kind])
        score = F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        return F.struct(
            s["at"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), score.alias("score")
        )

    empty = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int,score:double>>")
    found = F.transform(F.filter(_placed(hits, gaps), confirmed), span)
    if KINDS.index(kind) >= BASE_KINDS:
        found = F.filter(found, lambda s: s["score"] >= F.lit(ADDED_SCORE))
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with all confirmed spans of the whole text.

    ``spans_col`` is array<struct<start, order, kind, stop, score>>, sorted by start and
    kind; offsets are code points, stop exclusive. Matches of one kind do not
    overlap, those of two kinds may. A match that its check refuses is dropped.
    ``score`` is the kind's own plus what a context word in the CONTEXT_CHARS
    before it adds. It decides over spans of the added kinds (``iban``, ``ssn``): below ADDED_SCORE
    they are dropped, as a bare number of an ssn's form is; base spans stay
    whatever their score. Null and empty texts give an empty
    array. All columns of ``docs`` stay, but one named ``spans_col``, in any case, is replaced.
    """
    own, p = [c for c in docs.columns if c.lower() != spans_col.lower()], free_name(docs, "_pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*own).withColumn(f"{p}_text", text)
    text, none = F.col(f"{p}_text"), F.array().cast("array<string>")
    rows = rows.withColumns(
        {f"{p}_h_{k}": F.when(text.rlike(NEEDED[k]), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS}
    )
    rows = rows.withColumns({f"{p}_g_{k}": F.when(F.size(f"{p}_h_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    rows = rows.withColumns({f"{p}_s_{k}": _spans(text, k, F.col(f"{p}_h_{k}"), F.col(f"{p}_g_{k}")) for k in KINDS})
    spans = F.array_sort(F.concat(*[F.col(f"{p}_s_{k}") for k in KINDS]))
    return rows.select(*own, spans.alias(spans_col))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    Of overlapping spans the first names the replacement and all their characters
    go. Texts without a span, nulls included, stay as they are, and so do all other columns; every row counts for itself.
    """
    text = F.col(text_col)

    def add(done: Column, s: Column) -> Column:
        free = s["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        parts = F.when(free, F.concat(done["parts"], F.array(between, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), parts.otherwise(done["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    tail = F.aggregate(
        F.col(spans_col), zero, add, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.length(text)))
    )
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, tail).otherwise(text))
