"""Personal data and secrets, found with DataFrame expressions alone.

Regular expressions propose spans, validators (Luhn, mod-97, mod-23, ranges, digit counts, kinds of characters)
confirm them, and words nearby move the score. A kind's pattern walks a text once: its matches are set
between marks, at which the text is then split, so the lengths of pieces and matches give every match's
place by a running sum over the matches, which alone are shuffled (never texts). Patterns use
possessive runs and look-behinds so that a long run of letters or digits is scanned once and no match
recurses, however long the text.

Base kinds: email, ip, card, phone. Added kinds: iban (mod-97), dni (mod-23), ssn, local_phone and birth_date
(which need a word of context), access_key (well-known prefixes, web tokens, key blocks) and secret (a value
of letters and digits given to a password, token or key). Offsets are code points, ends exclusive.

Defined cases: null or empty text has no spans; repeated rows get equal results, each its own row; null
ids pass through; an empty table stays empty; the input's other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points of text on either side in which context words count.
NEAR = 40
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    #: A Java pattern with the matches of the plain pattern, in linear time.
    pattern: str
    #: Of these, a text must hold one for the pattern to be tried at all.
    needs: tuple[str, ...]
    base: bool
    prior: float
    #: Lower-case words that raise the score when near.
    context: str


AFTER = r"(?:\G|(?<![%s]))"
DIGITS = tuple("0123456789")
KINDS = (
    Kind("email", AFTER % r"A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), True, 0.9, "mail|contact|write"),
    Kind("ip", AFTER % "0-9" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), True, 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[ -]?+[0-9]){13,}+", DIGITS, True, 0.8, "card|visa|credit|account|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), True, 0.7, "phone|tel|call|mobil"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", DIGITS, False, 0.9, "iban|bank|konto|account"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), False, 0.3, r"ssn|social|security"),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", DIGITS, False, 0.3, r"phone|tel|call|mobil|fax"),
    Kind("dni", r"(?<![A-Za-z0-9])[0-9]{8}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])", DIGITS, False, 0.6, r"dni|nif|identi"),
    Kind("birth_date", r"(?<![0-9./-])[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9])", DIGITS, False, 0.3, r"born|birth|geb|naiss|nac[ie]|\bn[ée]e?\b|dob"),
    Kind("access_key", r"(?<![A-Za-z0-9_])(?:A(?:KIA|SIA|GPA|IDA|ROA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|sk[-_](?:live_|test_|proj-|ant-)?[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "gh", "xox", "sk", "AIza", "glpat", "eyJ", "-----BEGIN"), False, 0.9, "key|token|secret"),
    Kind("secret", r"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|secret|private|auth)[_-]?(?:key|token)|credentials?)[\"']?[ \t]{0,3}+[:=][ \t]{0,3}+[\"']?[a-z0-9+/_.~=@$!%^&*-]{8,}+", ("=", ":"), False, 0.8, "key|login|user|auth"),
)
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    back = F.split(F.reverse(digits), "")

    def value(d, i):
        twice = d.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN (no spaces) with its head moved to its end and letters as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _varied(secret: Column) -> Column:
    """True if what is assigned has letters, digits and at least five different characters, as words do not."""
    value = F.regexp_replace(secret, "^[^:=]*[:=][ \t\"']*", "")
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 5)


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match is what it looks like; nulls and failures are false."""
    n = F.length(_digits(match))
    return (
        F.when(kind == "ip", match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", n.between(14, 19) & luhn(_digits(match)))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "iban", F.length(F.translate(match, " ", "")).between(15, 34) & (mod97(F.translate(match, " ", "")) == 1))
        .when(kind == "dni", F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), F.substring(match, 1, 8).try_cast("int") % 23 + 1, F.lit(1)) == F.right(match, F.lit(1)))
        .when(kind == "birth_date", F.try_to_date(F.regexp_replace(match, "[./-]", "-"), "d-M-yyyy").isNotNull())
        .when(kind == "secret", _varied(match))
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$"))
        .otherwise(True)
    )


def _score(kind: Column, around: Column) -> Column:
    out = F.lit(0.0)
    for k in KINDS:
        out = F.when(kind == k.name, F.least(F.lit(1.0), F.lit(k.prior) + F.when(around.rlike(k.context), 0.3).otherwise(0.0))).otherwise(out)
    return out


#: Set around matches; in the text itself, SPARE takes its place for the search.
MARK, SPARE = "\x01", "\x02"


def _matches(kind: int, text: Column) -> Column:
    """Array of (kind, match, code points before it since the last match, text around it)."""
    k = KINDS[kind]
    pieces = F.split(F.regexp_replace(text, k.pattern, MARK + "$0" + MARK), MARK, -1)  # piece, match, piece, ..., piece
    at = lambda i: F.get(pieces, i)
    around = lambda i: F.lower(F.concat_ws(" ", F.right(at(i - 1), F.lit(NEAR)), F.substring(at(i + 1), 1, NEAR)))
    out = F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(F.lit(kind).alias("kind"), at(i).alias("match"), F.length(at(i - 1)).alias("gap"), around(i).alias("around")))
    none = F.array().cast("array<struct<kind:int,match:string,gap:int,around:string>>")
    tried = F.lit(False)
    for needed in k.needs:
        tried = tried | text.contains(needed)
    return F.when(tried, F.when(F.size(pieces) > 1, out)).otherwise(none)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col and spans, an array of (start, kind number, end, kind, score) sorted so.

    Rows are told apart by id and digest of the text, so a task that runs again gives the same groups;
    rows that repeat are counted on the way and given out as often as they came.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, SPARE).alias("__text"))
    every = F.concat(*(F.coalesce(_matches(k, F.col("__text")), F.array().cast("array<struct<kind:int,match:string,gap:int,around:string>>")) for k in range(len(KINDS))))
    flat = rows.select("__id", F.md5("__text").alias("__row"), F.posexplode_outer(every).alias("at", "m")).select("__id", "__row", "at", "m.*")
    single = flat.groupBy(*flat.columns).agg(F.count("*").alias("copies"))
    size = F.length("match")
    order = W.partitionBy("__id", "__row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + size).over(order)
    name = F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind") + 1)
    placed = single.withColumn("end", end).withColumn("start", F.col("end") - size).withColumn("name", name)
    scored = placed.withColumn("score", _score(F.col("name"), F.col("around")))
    base = F.col("kind") < sum(k.base for k in KINDS)
    good = F.col("match").isNotNull() & _valid(F.col("name"), F.col("match")) & (base | (F.col("score") >= threshold))
    span = F.when(good, F.struct("start", "kind", "end", F.col("name").alias("name"), "score"))
    found = scored.groupBy("__id", "__row").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("copies").alias("copies"))
    return found.select(F.col("__id").alias(id_col), "spans", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(id_col, "spans")


def op3(docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"))
    n_base = sum(k.base for k in KINDS)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < n_base)
    return found.select("doc_id", *(count(i).alias(f"n_{KINDS[i].name}") for i in range(n_base)), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 3).alias("score"))
