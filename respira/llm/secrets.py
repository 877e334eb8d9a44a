"""Secret scans in DataFrame functions only: base patterns, and windowed entropy of candidate strings.

Base patterns are assignments, access keys and hex runs. Candidates beside them are long runs of key characters that
hold digits and letters; over each, a window slides along, and the counts of its characters are kept up by one in and
one out, and with them the sum of count * log2(count) that gives the window's Shannon entropy. The class of the string
(hex, mixed-case alphanumeric, base64) sets the entropy that counts as random. A candidate whose best window reaches it
is a span of kind `entropy`, unless the allow-list suppresses it: placeholders, runs of one character or of counting
characters, identifiers with a fixed layout, file names and paths of plain words. Spans inside base spans are not
repeated. The allow-list never takes base spans away.

Positions are code points, end exclusive: a lazy group before each match gives the text between matches, and lengths add
up.

Nulls: a null text is empty and has no spans; a null doc_id stays null. Repeated rows are scanned once each. Spans tie
only between kinds; those come as listed. Very long texts are scanned whole, in time that grows as their length; matches
are counted up in runs of RUN, and a run of key characters is searched once however long it is. An empty table gives no rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with the pattern whose whole match is the span.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SPANS = "array<struct<start:int,end:int,value:string,part:string>>"
MIN_ASSIGNED = 6
MIN_CANDIDATE = 20
CANDIDATE = r"\b[A-Za-z0-9+/=_-]{20,}+"
RUN = 256
#: What makes a run worth a window: digits among letters.
WORTH = r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z])"
WINDOW = 20
#: Bits a character in a window of 20, per class; the most such a window can have is log2(20) = 4.32, in hex 3.94.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.7}
#: The allow-list.
ALLOWED = (
    r"(?i)example|sample|dummy|changeme|placeholder|redacted|your[_-]?(api|key|token|secret)|xxxx|test[_-]?(key|token)",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_:+-]*$",
    r"^[A-Za-z][A-Za-z/_=+-]*+[0-9]{0,4}$",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, checked: int) -> Column:
    """array<start, end, value, part> of the leftmost non-overlapping matches; part is group `checked` of the pattern."""
    lead = rf"(?s)(.*?)({pattern}|\z)"  # the end counts as a match, or the rest would be searched from each of its places
    gaps, values = F.regexp_extract_all(text, F.lit(lead), F.lit(1)), F.regexp_extract_all(text, F.lit(lead), F.lit(2))
    parts = F.regexp_extract_all(text, F.lit(lead), F.lit(2 + checked)) if checked else values
    rows = F.arrays_zip(gaps.alias("gap"), values.alias("value"), parts.alias("part"))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("done"))
    span = lambda start, end, x: F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["part"].alias("part"))

    def add(state, x):
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(span(start, end, x))).alias("done"))

    def join(state, run):
        moved = F.transform(run["done"], lambda x: span(state["at"] + x["start"], state["at"] + x["end"], x))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["done"], moved).alias("done"))

    def counted(every):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(every, k * RUN + 1, F.lit(RUN)), begin, add))
        return F.aggregate(runs, begin, join, lambda state: state["done"])

    return F.filter(_let(rows, counted), lambda x: x["value"] != "")


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of a window of `width` characters; of the whole if it is shorter.

    State: a count per ASCII character, the sum of c*log2(c) over them, and the least such sum of a full window.
    """
    term = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c) + 1)
    left = F.slice(F.concat(F.array_repeat(F.lit(0), width), codes), F.lit(1), F.char_length(value))  # what leaves the window as a character comes in
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.least(F.char_length(value), F.lit(width)).alias("span"), F.lit(1e9).alias("least"))

    def bump(n, at, by):
        return F.concat(F.slice(n, F.lit(1), at - 1), F.array(F.element_at(n, at) + by), F.slice(n, at + 1, F.lit(128) - at))

    def step(state, x):
        c = F.element_at(state["n"], x["into"])
        more = F.struct(bump(state["n"], x["into"], 1).alias("n"), (state["s"] + term(c + 1) - term(c)).alias("s"))

        def less(m):
            gone = F.element_at(m["n"], F.greatest(x["out"], F.lit(1)))
            full = x["out"] > 0
            n, s = F.when(full, bump(m["n"], F.greatest(x["out"], F.lit(1)), -1)).otherwise(m["n"]), F.when(full, m["s"] + term(gone - 1) - term(gone)).otherwise(m["s"])
            return F.struct(n.alias("n"), s.alias("s"))

        def closed(m):
            i = state["i"] + 1
            return F.struct(m["n"].alias("n"), m["s"].alias("s"), i.alias("i"), state["span"].alias("span"), F.when(i >= state["span"], F.least(state["least"], m["s"])).otherwise(state["least"]).alias("least"))

        return _let(_let(more, less), closed)

    best = F.aggregate(F.arrays_zip(codes.alias("into"), left.alias("out")), start, step, lambda x: F.log2(x["span"].cast("double")) - x["least"] / x["span"])
    return F.when(F.char_length(value) > 0, best).otherwise(F.lit(0.0))


def char_class(value: Column) -> Column:
    return F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def suppressed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found: array<start, end, kind, value> of every row, base spans and entropy spans, by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.expr(f"cast(array() as {SPANS})")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def found(pattern: str, checked: int = 0) -> Column:
        # most texts have no match at all, and a search costs less than splitting the text by matches
        return F.when(F.col("text").rlike(pattern), _matches(F.col("text"), pattern, checked)).otherwise(none)

    rows = rows.select("doc_id", found(ASSIGN, 1).alias("assign"), found(ACCESS).alias("access"), found(HEX).alias("hex"), found(CANDIDATE).alias("wide"))
    named = lambda kind, k: F.transform(F.filter(kind, lambda x: F.char_length(x["part"]) >= MIN_ASSIGNED), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
    rows = rows.select("doc_id", F.concat(named("assign", 0), named("access", 1), named("hex", 2)).alias("base"), F.filter("wide", lambda x: x["value"].rlike(WORTH) & ~suppressed(x["value"])).alias("wide"))
    fresh = F.filter("wide", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    random = F.filter(fresh, lambda x: window_entropy(x["value"]) >= F.element_at(F.create_map(*(F.lit(v) for kv in THRESHOLDS.items() for v in kv)), char_class(x["value"])))
    extra = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", extra)).alias("found"))


def digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    return scan(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
