"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words set a score.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds), and ``iban``, ``ssn`` (social security
numbers) and ``key`` (long tokens of letters and digits), which the method adds. Matches of a kind are
leftmost and do not overlap; a match that fails its check is dropped and not tried again in another way.
Card numbers must pass Luhn, account numbers the remainder 1 by 97, the parts of an address must be at
most 255, a phone number has 8 to 15 digits, a key has letters and digits.

A span scores by its evidence: a checksum or a strict form gives most, and words that begin like "card" or
"call" within ``CONTEXT`` characters before or after it, itself left out, add ``NEAR``. Base spans are always
kept; a span of an added kind must reach ``least``: an account number does by its checksum, the others only with
a word near them.

Only DataFrame functions. To get positions, the matches of a text are marked by ``regexp_replace`` and
the text is split at the marks: the odd parts are the matches, and the lengths of the parts give the
positions, in code points. The patterns have no loops over groups and no start inside a run of their
own characters, so a text of any length is read in linear time: a dot inside a domain and a separator
inside a number become single stand-in characters first, which keeps positions.

Defined results: a null or empty text has no spans; rows are independent of each other, so repeated
rows repeat their result and an empty table gives no rows; other columns pass through, except those
named ``spans``, ``n_email``, ``n_ip``, ``n_card`` and ``n_phone``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialframes.llm.common import read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key")
CONTEXT = 40
NEAR = 0.3
WORDS = {
    "email": "e-?mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|insurance",
    "key": "key|token|secret|password|passwd|bearer|credential|api",
}
EVIDENCE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.5, "key": 0.5}

_OPEN, _SHUT = "\x01", "\x02"  # around a match
_DOT, _SEP = "\x03", "\x04"  # a dot inside a domain, a separator inside a number
_OTHER = "\x05"  # stands for these characters where a text has them itself

_LOCAL = r"A-Za-z0-9._%+\-" + _DOT
# before the replacement of stand-ins -> after it
_DOMAIN_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
_DIGIT_GAP = r"(?<=[0-9])[ -](?=[0-9])"
PATTERNS = {
    # a local part starts where its run starts, or where the match before ended inside the run
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{_SEP}])[0-9][0-9{_SEP}]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: What a text must hold to be searched for a kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{14}", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "key": "[A-Za-z0-9+/_-]{20}"}


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT + _DOT + _SEP, _OTHER * 4)


def _parts(clean: Column, kind: str) -> Column:
    """The text cut at its matches: even parts lie between them, odd parts are matches."""
    ready = clean
    if kind == "email":
        ready = F.regexp_replace(clean, _DOMAIN_DOT, _DOT)
    elif kind == "card":
        ready = F.regexp_replace(clean, _DIGIT_GAP, _SEP)
    marked = F.regexp_replace(ready, PATTERNS[kind], f"{_OPEN}$0{_SHUT}")
    return F.split(marked, f"[{_OPEN}{_SHUT}]", -1)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _mod97(found: Column) -> Column:
    """Remainder by 97 of an account number: first four characters to the end, letters as 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (rest * F.when(value >= 10, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(step(rest, char)))


def _valid(found: Column, kind: str) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # by length first: a part of any length is compared without a number type
        return F.forall(F.split(found, r"\."), lambda part: _at_most_255(part))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "ssn":
        return F.lit(True)
    if kind == "key":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    length = F.length(F.replace(found, F.lit(" "), F.lit("")))
    return length.between(15, 34) & (_mod97(found) == 1)


def _at_most_255(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(F.lit(False))


_BLOCK = 128  # parts that are joined before they are appended to the rest
_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _spans(clean: Column, kind: str) -> Column:
    """Confirmed spans of one kind in order of their start."""

    def after(parts: Column, i: Column) -> Column:
        """What follows a part: a match is longer than four characters, so these parts are enough."""
        return F.array_join(F.transform(F.slice(parts, i + 2, F.lit(CONTEXT // 2)), lambda p: F.left(p, F.lit(CONTEXT))), "")

    def step(parts: Column, state: Column, i: Column) -> Column:
        part, odd = F.get(parts, i), i % 2 == 1
        end = state["at"] + F.length(part)
        near = F.lower(F.concat(state["tail"], F.lit(" "), F.left(after(parts, i), F.lit(CONTEXT))))
        high, low = min(1.0, round(EVIDENCE[kind] + NEAR, 6)), EVIDENCE[kind]
        span = F.struct(
            F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end"),
            F.when(near.rlike(f"(?<![a-z])(?:{WORDS[kind]})"), F.lit(high)).otherwise(F.lit(low)).alias("score"),
        )
        tail = F.when(F.length(part) >= CONTEXT, F.right(part, F.lit(CONTEXT))).otherwise(F.right(F.concat(state["tail"], part), F.lit(CONTEXT)))
        found = F.when(odd & _valid(part, kind), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), tail.alias("tail"), found.alias("spans"))

    none = F.array().cast(_SPAN)

    def block(parts: Column, state: Column, number: Column) -> Column:
        own = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("spans"))
        numbers = F.sequence(number * _BLOCK, F.least(number * _BLOCK + _BLOCK, F.size(parts)) - 1)
        done = F.aggregate(numbers, own, lambda s, i: step(parts, s, i))
        add = lambda s: F.struct(s["at"].alias("at"), s["tail"].alias("tail"), F.concat(state["blocks"], F.array(s["spans"])).alias("blocks"))
        return F.element_at(F.transform(F.array(done), add), 1)

    def search(parts: Column) -> Column:
        # spans are appended within blocks and blocks to each other: appending copies what is there
        first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
        return F.aggregate(numbers, first, lambda state, number: block(parts, state, number), lambda state: F.flatten(state["blocks"]))

    searched = F.element_at(F.transform(F.array(_parts(clean, kind)), search), 1)
    return F.when(clean.rlike(HINTS[kind]), searched).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows with ``spans``, an array of ``(kind, start, end, score)`` by kind and start, and the
    number of spans of each base kind."""
    made = {"spans", *[f"n_{k}" for k in BASE]}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    clean = _clean(F.col(text))
    # one column per kind first: each is computed once however often the next step names it
    rows = docs.select(*kept, *[_spans(clean, kind).alias(f"__{kind}") for kind in KINDS])
    added = [F.filter(f"__{kind}", lambda s: s["score"] >= least) for kind in KINDS if kind not in BASE]
    names = [c for c in rows.columns if c not in {f"__{k}" for k in KINDS}]
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.concat(*[F.col(f"__{k}") for k in BASE], *added).alias("spans"),
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE],
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The text with every span replaced by its kind in brackets; overlapping spans count as one of
    the kind that starts first."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        between = F.substr(F.col(text), (s["at"] + 1).cast("int"), F.greatest(span["start"] - s["at"], F.lit(0)).cast("int"))
        done = F.struct(span["end"].alias("at"), F.concat(s["out"], between, F.lit("["), span["kind"], F.lit("]")).alias("out"))
        inside = F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out"))
        return F.when(span["start"] >= s["at"], done).otherwise(inside)

    by_start = F.array_sort("spans", lambda a, b: (a["start"] - b["start"]).cast("int"))
    tail = lambda s: F.concat(s["out"], F.substr(F.col(text), (s["at"] + 1).cast("int")))
    return found.withColumn(text, F.aggregate(by_start, state, step, tail))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    digest = F.sha2(_joined(base), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, _joined(F.col("spans")).alias("spans"))
