"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found in a text (one regular expression, no overlaps) and validated:

* ``email``: an address; its local part is replaced, letters by letters and
  digits by digits, the domain stays;
* ``date``: year-month-day or day-month-year with a real calendar day from
  1800-03-01 to 2200-02-28, replaced by a day of that range;
* ``ip``: four numbers up to 255, replaced by four such numbers;
* ``ssn``: ddd-dd-dddd with a valid area, group and serial, replaced by a valid one;
* ``phone``: + country code and 7 to 12 digits; the country code and all
  punctuation stay;
* ``card``: 13 to 19 digits, or four groups of four, that pass the Luhn check;
  replaced by digits that pass it;
* ``number``: any other 9 to 19 digits, or four groups of four; replaced by as
  many digits.

Every replacement is a keyed permutation of its format: a Feistel network
whose round function is a SHA-256 of key, kind, round and the other half. So
equal values get equal pseudonyms in all documents, different values different
ones, and the holder of the key can undo it (``inverse=True``).

Values that look like a kind but fail its validation stay as they are
(numbers excepted). Null texts stay null, empty ones empty; repeated rows get
equal results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: days of the 400-year calendar cycle, 146097 = 189 * 773
DAY_BASE, DAY_L, DAY_R = "1800-03-01", 189, 773

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4})(?!\d|[./-]\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)"
PHONE = r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{2,5}(?!\d)"
NUMBER = r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{9,19})(?!\d)"
ANY = "|".join((EMAIL, DATE, IP, SSN, PHONE, NUMBER))


def _number(key: str, kind: str, i: Column, x: Column) -> Column:
    """Round function to a whole number below 2**48."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _feistel_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str, inverse: bool) -> Column:
    """Permutation of Z_a x Z_b: each round moves one half by a function of the other."""
    sign = -1 if inverse else 1

    def step(acc, i):
        move_l = i % 2 == 0
        l = F.when(move_l, F.pmod(acc["l"] + sign * _number(key, kind, i, acc["r"]), F.lit(a))).otherwise(acc["l"])
        r = F.when(move_l, acc["r"]).otherwise(F.pmod(acc["r"] + sign * _number(key, kind, i, acc["l"]), F.lit(b)))
        return F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r"))

    return F.aggregate(_rounds(inverse), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shift(half: Column, other: Column, key: str, kind: str, i: Column, sign: int) -> Column:
    """``half`` with every digit and ASCII letter moved within its class by a
    stream from the other half; all other characters stay."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)
    chars = F.filter(F.split(half, ""), lambda c: c != "")

    def move(c, n):
        s = F.conv(F.substring(digest, (n % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign
        out = c
        for alphabet in ("0123456789", LOWER, UPPER):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + s, F.lit(len(alphabet))) + 1, F.lit(1))) \
                .otherwise(out)
        return out

    return F.array_join(F.transform(chars, move), "")


def _feistel_text(text: Column, key: str, kind: str, inverse: bool) -> Column:
    """Permutation of the strings of one character pattern."""
    sign = -1 if inverse else 1
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"),
                     F.substring(text, cut + 1, F.length(text)).alias("r"))

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shift(acc["l"], acc["r"], key, kind, i, sign)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(_shift(acc["r"], acc["l"], key, kind, i, sign)).alias("r"))

    out = F.aggregate(_rounds(inverse), start, step)
    return F.concat(out["l"], out["r"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of a digit string; whether its last digit counts double."""
    values = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def add(acc, x):
        d = x["d"].cast("int")
        two = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((x["n"] % 2 == 0) == F.lit(doubled_last), two).otherwise(d)

    numbered = F.transform(values, lambda d, n: F.struct(d.alias("d"), n.alias("n")))
    return F.aggregate(numbered, F.lit(0), add)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, n: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), n + 1))), F.lit(1)))
        .otherwise(c)), "")


def kind_of(m: Column) -> Column:
    """Validated kind of a match, null if it fails validation."""
    parts = F.split(m, r"\.")
    day = _as_date(m)
    ssn = F.split(m, "-")
    number = _digits(m)
    return (F.when(m.contains("@"), "email")
            .when(m.startswith("+"), F.when(F.length(number).between(8, 15), "phone"))
            .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})$"),
                  F.when(F.datediff(day, F.lit(DAY_BASE).cast("date")).between(0, DAY_L * DAY_R - 1), "date"))
            .when(F.size(parts) == 4, F.when(F.forall(parts, lambda p: p.cast("int") <= 255), "ip"))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"),
                  F.when((ssn[0].cast("int").between(1, 899)) & (ssn[0] != "666") & (ssn[1] != "00")
                         & (ssn[2] != "0000"), "ssn"))
            .when((F.length(number) >= 13) & (_luhn_sum(number, False) % 10 == 0), "card")
            .otherwise("number"))


def _as_date(m: Column) -> Column:
    iso = F.when(m.rlike(r"^\d{4}-"), m).otherwise(
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """Pseudonym of a match (the match itself if it is of no valid kind)."""
    kind = kind_of(m)
    at = F.instr(m, "@")
    email = F.concat(_feistel_text(F.substring(m, F.lit(1), at - 1), key, "email", inverse),
                     F.substring(m, at, F.length(m)))
    n = F.datediff(_as_date(m), F.lit(DAY_BASE).cast("date"))
    pair = _feistel_pair(F.floor(n / DAY_R), n % DAY_R, DAY_L, DAY_R, key, "date", inverse)
    moved = F.date_add(F.lit(DAY_BASE).cast("date"), (pair["l"] * DAY_R + pair["r"]).cast("int"))
    date = (F.when(m.rlike(r"^\d{4}-"), F.date_format(moved, "yyyy-MM-dd"))
            .when(m.contains("/"), F.date_format(moved, "dd/MM/yyyy"))
            .otherwise(F.date_format(moved, "dd.MM.yyyy")))
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    quad = _feistel_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip", inverse)
    ip = F.concat_ws(".", F.floor(quad["l"] / 256).cast("string"), (quad["l"] % 256).cast("string"),
                     F.floor(quad["r"] / 256).cast("string"), (quad["r"] % 256).cast("string"))
    s = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area = F.when(s[0] > 666, s[0] - 2).otherwise(s[0] - 1)            # 001-899 without 666
    code = _feistel_pair(area * 99 + s[1] - 1, s[2] - 1, 898 * 99, 9999, key, "ssn", inverse)
    back = F.floor(code["l"] / 99)
    ssn = F.concat_ws("-", F.lpad(F.when(back >= 665, back + 2).otherwise(back + 1).cast("string"), 3, "0"),
                      F.lpad((code["l"] % 99 + 1).cast("string"), 2, "0"),
                      F.lpad((code["r"] + 1).cast("string"), 4, "0"))
    prefix = F.regexp_extract(m, r"^\+\d{1,3}?(?=[ (-])|^\+\d", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    phone = F.concat(prefix, _refill(rest, _feistel_text(_digits(rest), key, "phone", inverse)))
    # the digits alone are permuted, so that a number is linked however it is
    # grouped. All but the last move; the last keeps its distance from the Luhn
    # check digit, so cards stay cards and other numbers do not become any
    own = _digits(m)
    front = F.substring(own, F.lit(1), F.length(own) - 1)
    far = F.pmod(F.substring(own, -1, 1).cast("int") + _luhn_sum(front, True), F.lit(10))
    moved_front = _feistel_text(front, key, "number", inverse)
    number = _refill(m, F.concat(moved_front, F.pmod(far - _luhn_sum(moved_front, True) % 10, F.lit(10)).cast("string")))
    return (F.when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip)
            .when(kind == "ssn", ssn).when(kind == "phone", phone)
            .when(kind.isin("card", "number"), number).otherwise(m))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False, text_col: str = "text",
                 count_col: str | None = None) -> DataFrame:
    """``docs`` with the PII of the text column replaced, in one narrow pass;
    ``count_col`` adds the number of values found valid."""
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)
    swapped = F.transform(found, lambda m: pseudonym(m, key, inverse))
    joined = F.array_join(F.flatten(F.zip_with(
        between, swapped, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    touched = text.rlike(r"@|[0-9]{3}|[0-9]\.[0-9]|[0-9]/[0-9]")        # cheap: most texts have none
    out = docs
    if count_col:
        valid = F.size(F.filter(found, lambda m: kind_of(m).isNotNull())).cast("bigint")
        out = out.withColumn(count_col, F.when(touched, valid).otherwise(F.lit(0).cast("bigint")))
    return out.withColumn(text_col, F.when(touched, joined).otherwise(text))


def op4_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get("spark.loanlens.pseudonymKey", "key for tests only")
    return pseudonymise(docs, key, count_col="n_values").select("doc_id", "n_values", "text")
