"""Personal data by patterns, checksums and context words, in column expressions only.

A pattern proposes spans, a validator (Luhn for cards, mod 97 for bank accounts, ranges and digit counts for
the others) confirms them, and words nearby move the score.  Positions are code points, ends exclusive: they
are running totals of the lengths of matches and of the gaps that splitting leaves between them.

The patterns here find what the plain ones beside them find.  They start only where a run of characters starts
(or where the match before ended) and never give characters back, so that long runs take linear time.
A bank account may be followed by more capitals or digits, so each end of a word in its run is a candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_SPAN = "struct<start:int,end:int,found:string>"
SPAN = f"array<{ONE_SPAN}>"
BLOCK = 64  # spans whose running totals grow one array
CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS  # characters; an even cut that positions are looked up in
CONTEXT_BEFORE, CONTEXT_AFTER, CONTEXT_STEP = 40, 25, 0.15
ADDED_AT = 0.5  # score from which the method's own kinds are reported


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a digit string passes the Luhn check."""
    back = F.reverse(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), step)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """True where an account number without blanks leaves 1: its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        letter = code >= 65
        return (rest * F.when(letter, 100).otherwise(10) + code - F.when(letter, 55).otherwise(48)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), step) == 1


def in_range(found: Column) -> Column:
    """True where each part of a dotted address is 255 at most, leading zeros allowed."""
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """hint: a cheap test that any text with a match passes; words move the score up, against moves it down."""

    name: str
    pattern: str
    hint: str
    score: float
    words: tuple[str, ...]
    against: tuple[str, ...] = ()
    base: bool = True


#: Characters of a bank account number by country.
ACCOUNT_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A whole account number without blanks: of its country's size, or of 15 to 34 characters where the country is not listed.
ACCOUNT = "^(?:{}|(?!{})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})$".format(
    "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, c in ACCOUNT_SIZES.items()), "|".join(ACCOUNT_SIZES.values()).replace(" ", "|")
)
#: Kinds in the order in which spans with one start are listed.  Their plain patterns:
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([\x20-]?[0-9])+
#: phone  \+[0-9][\x20().0-9-]+[0-9]
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, ("mail", "contact", "write", "@")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address", "login"), ("version", "release")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9](?:[\x20-]?[0-9]){11}", 0.7, ("card", "visa", "credit", "debit", "payment"), ("order", "invoice", "tracking")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"+", 0.7, ("phone", "tel", "call", "mobile", "fax"), ("score",)),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.8, ("iban", "account", "bank", "transfer"), (), False),
)


def confirmed(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return in_range(found)
    n = F.length(digits(found))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(digits(found))).otherwise(False)


def hinted(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit(kind.hint)) if len(kind.hint) == 1 else text.rlike(kind.hint)


def account_size(run: Column) -> Column:
    """Characters, blanks included, of the longest account number that a run starts with and that ends with a word; 0 if none."""

    def step(acc: Column, word: Column) -> Column:
        number = F.concat(acc["number"], word)
        good = F.when(number.rlike(ACCOUNT), mod97(number)).otherwise(False)
        size = F.when(good, F.char_length(number) + acc["blanks"]).otherwise(acc["size"])
        return F.struct(number.alias("number"), (acc["blanks"] + 1).alias("blanks"), size.alias("size"))

    start = F.struct(F.lit("").alias("number"), F.lit(0).alias("blanks"), F.lit(0).alias("size"))
    return F.aggregate(F.split(run, " "), start, step, lambda acc: acc["size"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def in_blocks(rows: Column) -> Column:
    """An array cut into arrays of BLOCK entries, one at least."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK)), lambda at: F.slice(rows, at, BLOCK))


def laid_out(steps: Column) -> Column:
    """Spans of (gap, found, size, move) entries: each starts a gap after the entry before, which covers ``move`` characters.

    Running totals are taken inside blocks, then over blocks: growing one long array entry by entry would copy it each time.
    """
    none = F.struct(F.array().cast(SPAN).alias("spans"), F.lit(0).alias("at"))

    def inside(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"))
        return F.struct(F.array_append(acc["spans"], span).cast(SPAN).alias("spans"), (start + x["move"]).alias("at"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found")))

    def joined_up(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), moved))

    def spans_of(rows: Column) -> Column:
        per_block = F.transform(in_blocks(rows), lambda block: F.aggregate(block, none, inside))
        few = F.aggregate(rows, none, inside, lambda acc: acc["spans"])
        return F.when(F.size(rows) <= BLOCK, few).otherwise(let(per_block, joined_up).cast(SPAN))

    return let(steps, spans_of)


def apart(spans: Column) -> Column:
    """Of spans by start, those that do not start inside the one taken before."""
    none = F.array().cast(SPAN)

    def inside(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["done"]
        spans = F.when(fits, F.array_append(acc["spans"], s).cast(SPAN)).otherwise(acc["spans"])
        return F.struct(spans.alias("spans"), F.when(fits, s["end"]).otherwise(acc["done"]).alias("done"))

    def over(acc: Column, block: Column) -> Column:
        taken = F.aggregate(block, F.struct(none.alias("spans"), acc["done"].alias("done")), inside)
        return let(taken, lambda t: F.struct(F.array_append(acc["blocks"], t["spans"]).cast(f"array<{SPAN}>").alias("blocks"), t["done"].alias("done")))

    first = F.struct(F.array().cast(f"array<{SPAN}>").alias("blocks"), F.lit(0).alias("done"))
    return let(spans, lambda rows: F.aggregate(in_blocks(rows), first, over, lambda acc: F.flatten(acc["blocks"])))


def groups_of(spans: Column) -> Column:
    """Spans by start, each one that overlaps the ones before made one with them; the first gives ``found``."""
    none = F.array().cast(SPAN)
    empty = F.lit(None).cast(ONE_SPAN)

    def inside(acc: Column, s: Column) -> Column:
        last = acc["last"]
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["found"].alias("found")).cast(ONE_SPAN)
        new = last.isNull() | (s["start"] >= last["end"])
        done = F.when(new & last.isNotNull(), F.array_append(acc["spans"], last).cast(SPAN)).otherwise(acc["spans"])
        return F.struct(done.alias("spans"), F.when(new, s.cast(ONE_SPAN)).otherwise(wider).alias("last"))

    def over(acc: Column, block: Column) -> Column:
        taken = F.aggregate(block, F.struct(none.alias("spans"), acc["last"].alias("last")), inside)
        return let(taken, lambda t: F.struct(F.array_append(acc["blocks"], t["spans"]).cast(f"array<{SPAN}>").alias("blocks"), t["last"].alias("last")))

    def closed(acc: Column) -> Column:
        return F.flatten(F.array_append(acc["blocks"], F.array(acc["last"])).cast(f"array<{SPAN}>"))

    first = F.struct(F.array().cast(f"array<{SPAN}>").alias("blocks"), empty.alias("last"))
    return let(spans, lambda rows: F.aggregate(in_blocks(rows), first, over, closed))


def accounts(text: Column, kind: Kind) -> Column:
    """Bank accounts with their positions; each start is looked at by itself, and none starts inside the one before.

    The pattern takes the first four characters and looks ahead at the run, up to the character after it.
    """
    runs = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
    gaps = F.split(text, kind.pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda g, r: let(account_size(r), lambda n: step_of(g, F.substring(r, F.lit(1), n), n, F.lit(4))))
    found = F.filter(laid_out(steps), lambda s: s["end"] > s["start"])
    return F.when(hinted(text, kind), apart(found)).otherwise(F.array().cast(SPAN))


def step_of(gap: Column, found: Column, size: Column, move: Column) -> Column:
    return F.struct(F.char_length(gap).alias("gap"), found.alias("found"), size.alias("size"), move.alias("move"))


def proposed(text: Column, kind: Kind) -> Column:
    """All matches of a kind's pattern with their positions."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: let(F.char_length(m), lambda n: step_of(g, m, n, n)))
    return F.when(hinted(text, kind), laid_out(steps)).otherwise(F.array().cast(SPAN))


def chunks_of(text: Column) -> Column:
    """A text as an array of CHUNK characters each, the last one shorter."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.octet_length(text) <= CHUNK, F.array(text)).otherwise(cut)


def stretch(chunks: Column, begin: Column, end: Column) -> Column:
    """Characters begin to end of a text cut by ``chunks_of``, without walking the text from its start."""
    first = F.shiftright(begin, CHUNK_BITS)
    part = F.array_join(F.slice(chunks, first + 1, F.shiftright(end, CHUNK_BITS) - first + 1), "")
    return F.substring(part, begin - F.shiftleft(first, CHUNK_BITS) + 1, F.greatest(end - begin, F.lit(0)))


def score_of(chunks: Column, kind: Kind, span: Column) -> Column:
    """The kind's score, moved up by a word for it nearby and down by one against it."""
    before = F.lower(stretch(chunks, F.greatest(span["start"] - CONTEXT_BEFORE, F.lit(0)), span["start"]))
    after = F.lower(stretch(chunks, span["end"], span["end"] + CONTEXT_AFTER))
    near = F.concat(before, F.lit(" "), after)

    def has(words: tuple[str, ...]) -> Column:
        return near.rlike(r"\b(?:" + "|".join(words) + ")") if words else F.lit(False)

    moved = F.lit(kind.score) + F.when(has(kind.words), CONTEXT_STEP).otherwise(0.0) - F.when(has(kind.against), CONTEXT_STEP).otherwise(0.0)
    return F.round(F.least(moved, F.lit(1.0)), 2)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with pii_spans: array of (start, rank, kind, end, score, base) by start, then kind; and pii_text and pii_chunks, the text read.

    NULL text counts as empty; every row is read by itself, so repeated rows repeat.  Columns of those three names are replaced.
    """
    found = docs.withColumn("pii_text", F.coalesce("text", F.lit("")))
    names = [f"_pii_{k.name}" for k in KINDS]
    text = F.col("pii_text")

    def valid(k: Kind) -> Column:
        if k.name == "iban":
            return accounts(text, k)
        return F.filter(proposed(text, k), lambda s: confirmed(k.name, s["found"]))

    found = found.withColumns({n: valid(k) for n, k in zip(names, KINDS, strict=True)})

    any_span = F.greatest(*[F.size(n) for n in names]) > 0
    found = found.withColumn("pii_chunks", F.when(any_span, chunks_of(text)).otherwise(F.array(F.lit(""))))

    def full(n: str, rank: int, k: Kind) -> Column:
        return F.transform(
            F.col(n),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(k.name).alias("kind"),
                s["end"].alias("end"),
                score_of(F.col("pii_chunks"), k, s).alias("score"),
                F.lit(k.base).alias("base"),
            ),
        )

    every = F.concat(*[full(n, r, k) for r, (n, k) in enumerate(zip(names, KINDS, strict=True))])
    kept = F.filter(every, lambda s: s["base"] | (s["score"] >= ADDED_AT))
    return found.withColumn("pii_spans", F.array_sort(kept)).drop(*names)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, a digest of base spans, all spans and their scores."""
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda name: F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return find_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(k.name) for k in KINDS if k.base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in brackets; overlapping spans become one.

    The columns stay as they are; n_chars is counted anew where there is one.  NULL texts stay NULL.
    """
    chunks, spans = F.col("pii_chunks"), F.col("pii_spans")
    length = F.char_length("text")
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("found")))

    def pieces(taken: Column) -> Column:
        """Each mask and the text up to the next one."""
        until = F.concat(F.slice(F.transform(taken, lambda s: s["start"]), 2, F.size(taken)), F.array(length))
        return F.zip_with(taken, until, lambda s, end: F.concat(s["found"], stretch(chunks, s["end"], end)))

    masked = let(groups_of(bare), lambda g: F.concat(stretch(chunks, F.lit(0), g[0]["start"]), F.array_join(pieces(g), "")))
    out = find_spans(docs).withColumn("text", F.when(F.col("text").isNull() | (F.size("pii_spans") == 0), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("pii_spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)
