"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a DataFrame expression; a text without ``@``, ``+`` or digits costs three scans. A text's cost is
that of its length and n log n of its matches, however many there are.

Defined results: a null text counts as empty (no spans); an empty text has no spans; texts of any
length are scanned whole; each row is judged alone, so repeated rows give repeated results; an
empty table gives an empty table; other columns of the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrace.llm.common import columns, let

NEAR = 40  # code points before a span in which context words count
BLOCK = 1024  # code points of the pieces that a text with spans is cut into


@dataclass(frozen=True)
class Kind:
    """A kind of span. Possessive quantifiers and ``\\G`` keep each pattern linear in the text and find
    what the plain greedy pattern finds, leftmost and non-overlapping."""

    name: str
    pattern: str
    check: str  # none, octets, luhn, digits, mod97, hex
    score: float  # of a confirmed span without context
    context: str  # words that raise the score by 0.3
    base: bool  # base spans stay whatever their score


_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "none", 0.8, "e-?mail|contact|correo|courriel|kontakt", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "octets", 0.6, "ip|server|host|address|adresse", True),
    # A card is a whole run of digits with single separators; runs of other lengths are passed over at once.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])", "luhn", 0.7, "card|visa|mastercard|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "digits", 0.6, "phone|tel|call|mobile|telefon|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "mod97", 0.8, "iban|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "none", 0.3, "ssn|social security|tax id", False),
    Kind("local_phone", r"(?<![0-9+().-])(?<![0-9)] )\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])", "none", 0.3, "phone|tel|call|mobile|telefon|fax", False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+", "hex", 0.3, "tokens?|secrets?|keys?|apikey|password|passwd|credentials?", False),
)
#: Spans of the kinds that are not base stay from this score on.
MIN_SCORE = 0.5


def _confirmed(found: Column, check: str) -> Column:
    if check == "octets":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).substr(1, 3).cast("int") <= 255))
    if check == "luhn":
        digits = F.translate(found, " -", "")
        n = F.length(digits)

        def total(d: Column) -> Column:
            padded = F.lpad(d, 20, "0")
            at = lambda i: F.substring(padded, i, 1).cast("int")
            twice = lambda i: at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)
            return sum((twice(i) if i % 2 else at(i) for i in range(1, 21)), F.lit(0))

        return n.between(12, 19) & (F.when(n.between(12, 19), let(digits, total)).otherwise(1) % 10 == 0)
    if check == "digits":
        return F.length(F.translate(found, "+ ().-", "")).between(9, 15)
    if check == "hex":
        return found.rlike("^[0-9A-Fa-f]+$") & found.rlike("[0-9]") & found.rlike("[A-Fa-f]")
    if check == "mod97":
        code = F.replace(found, F.lit(" "), F.lit(""))
        turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
        letter = lambda c: F.when(c < "A", c).otherwise((F.ascii(c) - 55).cast("string"))
        digits = F.array_join(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), letter), "")
        rest = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)
        return F.length(code).between(15, 34) & (rest == 1)
    return F.lit(True)


def running(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """Each value joined with all before it, by doubling distances: log n passes over the array."""
    n = F.size(values)
    passes = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)).otherwise(F.array().cast("array<int>"))
    distances = F.transform(passes, lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(distances, values, lambda a, d: F.transform(a, lambda x, i: join(x, F.coalesce(F.get(a, i - d), F.lit(start)))))


def blocks_of(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, so that a part of it costs no walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the text of the blocks."""
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    across = F.concat(F.substr(block(first), a % BLOCK + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(block(last), 1, b % BLOCK))
    return F.when(first == last, F.substring(block(first), a % BLOCK + 1, b - a)).otherwise(across)


def _spans(text: Column, blocks: Column, found: Column, kind: Kind, order: int) -> Column:
    """The confirmed spans of a kind. Ends are running sums of the texts between matches and the matches."""
    def of(ends: Column) -> Column:
        value = F.transform(found, lambda v, i: F.struct(v.alias("value"), F.get(ends, i).alias("end")))
        confirmed = F.filter(value, lambda m: _confirmed(m["value"], kind.check))

        def span(m: Column) -> Column:
            start = m["end"] - F.length(m["value"])
            near = part(blocks, F.greatest(start - NEAR, F.lit(0)), start).rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{kind.context})(?![\p{{L}}\p{{N}}])")
            score = F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0)
            return F.struct(start.alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), m["value"].alias("value"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        spans = F.transform(confirmed, span)
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string,score:double>>")
    lengths = let(F.split(text, kind.pattern, -1), lambda pieces: F.transform(found, lambda v, i: F.length(v) + F.length(F.get(pieces, i))))
    return F.when(F.size(found) > 0, let(running(lengths, lambda x, y: x + y, 0), of)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` and an array ``out`` of struct(kind, start, end, value, score), by start and then kind.

    start and end count code points, end exclusive; a column ``out`` of the input is replaced. Kinds are searched apart, so spans of two kinds
    may overlap."""
    names = [f"_lt_pii_{k.name}" for k in kinds]
    whole, digit = "_lt_pii_text", "_lt_pii_digit"
    had = columns(docs, out)
    df = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(digit, F.col(whole).rlike("[0-9]"))
    needs = {"email": F.contains(F.col(whole), F.lit("@")), "phone": F.col(digit) & F.contains(F.col(whole), F.lit("+"))}
    none = F.array().cast("array<string>")
    df = df.withColumns({n: F.when(needs.get(k.name, F.col(digit)), F.regexp_extract_all(F.col(whole), F.lit(k.pattern), F.lit(0))).otherwise(none) for n, k in zip(names, kinds, strict=True)})
    some = sum((F.size(n) for n in names[1:]), F.size(names[0])) > 0
    every = let(blocks_of(F.col(whole)), lambda b: F.concat(*[_spans(F.col(whole), b, F.col(n), k, i) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]))
    shown = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score"))
    found = F.when(some, F.transform(F.array_sort(every), shown)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>"))
    return df.withColumn(out, found).select(*had, out)


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets, such as [EMAIL].

    Spans that overlap are replaced as one, named by the first. A null text stays null; texts
    without spans are left as they are."""
    df = find_pii(docs, text, "_lt_pii", kinds)
    whole, spans = F.col(text), F.col("_lt_pii")

    def clean(blocks: Column, ends: Column) -> Column:
        """``ends`` are the greatest ends so far: a span that starts before one is hidden with an earlier span."""
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        first = F.filter(F.transform(spans, lambda s, i: F.struct(before(i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))), lambda s: s["to"] >= s["from"])
        hidden = F.transform(first, lambda s: F.concat(part(blocks, s["from"], s["to"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(hidden, ""), part(blocks, before(F.size(spans)), F.length(whole)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
    told = let(blocks_of(whole), lambda b: let(ends, lambda e: clean(b, e)))
    return df.withColumn(text, F.when(F.size(spans) > 0, told).otherwise(whole)).select(*columns(docs))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The query's columns from :func:`find_pii`."""
    df = find_pii(docs.select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(span_digest(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), span_digest(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def text_length(text: str = "text") -> Column:
    """Code points of a text, 0 for null."""
    return F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
