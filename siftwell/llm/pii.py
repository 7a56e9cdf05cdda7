"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Card numbers (checked by Luhn's sum), international account numbers (checked modulo 97), IPv4 addresses, telephone numbers, dates (checked against the calendar) and e-mail
addresses are found in whole texts. Each is permuted within its own format by a keyed Feistel network, so equal values
get equal pseudonyms in every document, different values different ones, and a pseudonym is valid where the value was:
cards pass Luhn's sum, accounts (IBAN) have their check digits, dates exist, octets fit. What fails its check stays as it is. Round functions are SHA-256 of key,
round and the other half.

Telephone numbers: +code with 7 to 15 digits, whether or not single spaces, dots or hyphens part them; an area code in
parentheses; 0 and area code, then space, slash or hyphen; 01 23 45 67 89; 555-123-4567 and 555.123.4567. Cards: digits
alone, or groups of 4-4-4-4, 4-6-5 or 4-6-4. Left out, and so in clear: local numbers without an area code, national ones
without separators or with spaces only and no leading 0, +44 (0)20 forms, 00 in place of + without separators,
extensions; cards grouped in other ways; IPv6; dates in words, of one-digit or two-digit parts or with hyphens in
another order; e-mail addresses with letters beyond a-z in the domain or with a quoted name. The domain stays by design.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._common import table

ROUNDS = 8
_EMAIL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]{0,62}[\p{L}\p{N}_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
_ISO = r"(?<![\d-])\d{4}-\d\d-\d\d(?![\d-])"
_DOTTED = r"(?<![\d.])\d\d\.\d\d\.\d{4}(?![\d]|\.\d)"
_SLASHED = r"(?<![\d/])\d\d/\d\d/\d{4}(?![\d/])"
_PHONE = "|".join(
    (
        r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
        r"(?<![\d+])\+(?:\d[ .-]?){6,14}\d(?!\d)",
        r"(?<![\w+])(?<!\d[.,/-])0\d{2,4}[ /-]\d(?:[ -]?\d){3,9}(?![\w])",
        r"(?<![\w+])(?<!\d[.,/-])0\d(?: \d\d){4}(?![\w])",
        r"(?<![\w+])(?<!\d[.,/-])(?:1[.-])?\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w]|[.-]\d)",
    )
)
_CARDS = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}"
# Countries with account numbers of the international form.
_COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
_ACCOUNTS = rf"(?:{_COUNTRIES})\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
_ACCOUNT = rf"(?<![0-9A-Za-z]){_ACCOUNTS}(?![0-9A-Za-z])"
_CARD = rf"(?<![0-9A-Za-z])(?:{_CARDS})(?![0-9A-Za-z])"
PATTERN = "|".join(f"(?:{p})" for p in (_EMAIL, _IP, _ISO, _DOTTED, _SLASHED, _ACCOUNT, _CARD, _PHONE))
#: Days of a Gregorian cycle of 400 years, 189 x 773, from this date on.
CYCLE, RADIX_A, RADIX_B, FIRST_DAY = 146_097, 189, 773, "1700-01-01"


def _classes(least: int = 8) -> tuple[list[tuple[int, int]], str]:
    """Letters and numerals beyond ASCII: runs of code points (first, size), split by category where that leaves enough, and the letters of no such run."""
    kinds = [(p, unicodedata.category(chr(p))) for p in range(0x80, 0x110000)]
    runs, rest = [], []
    for wanted, run in groupby(kinds, lambda x: x[1][0] if x[1][0] in "LN" else ""):
        if not wanted:
            continue
        parts: list[list[int]] = []
        long_before = True
        for _, part in groupby(run, lambda x: x[1]):
            own = [p for p, _ in part]
            long = len(own) >= least
            if parts and not long and not long_before:
                parts[-1] += own
            else:
                parts.append(own)
            long_before = long
        for part in parts:
            if len(part) >= least:
                runs.append((part[0], len(part)))
            else:
                rest += part
    return runs, "".join(map(chr, rest))


RUNS, REST = _classes()


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def permute_number(n: Column, a: int, b: int, key: str) -> Column:
    """A permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b)).cast("long").alias("r"))

    def one(s: Column, i: Column) -> Column:
        left, right = F.pmod(s["l"] + _number(_hash(key, i, s["r"])), F.lit(a)), F.pmod(s["r"] + _number(_hash(key, i, s["l"])), F.lit(b))
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(s["l"]).cast("long").alias("l"), F.when(odd, s["r"]).otherwise(right).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: s["l"] * b + s["r"])


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))


def _shifted(s: Column, hexes: Column) -> Column:
    """Every digit and letter of s moved within its class by two or four hexadecimal digits of hexes; the rest stays."""
    runs = F.expr(f"from_json('{[{'f': f, 'n': n} for f, n in RUNS]}', 'array<struct<f:int,n:int>>')".replace("'f'", '"f"').replace("'n'", '"n"'))

    def other(c: Column, p: Column) -> Column:
        n = F.conv(F.substr(hexes, F.pmod(4 * (p - 1), F.lit(64)) + 1, F.lit(4)), 16, 10).cast("int")
        code, at = F.ascii(c), F.instr(F.lit(REST), c)
        run = F.filter(runs, lambda r: (r["f"] <= code) & (code < r["f"] + r["n"]))
        moved = F.transform(run, lambda r: F.decode(F.unhex(F.lpad(F.hex(r["f"] + F.pmod(code - r["f"] + n, r["n"])), 8, "0")), "UTF-32"))
        return F.coalesce(F.get(moved, F.lit(0)), F.when(at > 0, F.substr(F.lit(REST), F.pmod(at - 1 + n, F.lit(len(REST))) + 1, F.lit(1))), c)

    def one(p: Column) -> Column:
        c, n = F.substr(s, p, F.lit(1)), F.conv(F.substr(hexes, F.pmod(2 * (p - 1), F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, size: F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + n, F.lit(size)))
        return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).when(c < "\x80", c).otherwise(other(c, p))

    return F.array_join(F.transform(_chars(s), one), "")


def permute_text(s: Column, key: str) -> Column:
    """A permutation of the texts that have the same length and the same class of character at each place."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))

    def one(v: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, _shifted(v["l"], _hash(key, i, v["r"]))).otherwise(v["l"]).alias("l"),
            F.when(odd, v["r"]).otherwise(_shifted(v["r"], _hash(key, i, v["l"]))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda v: F.concat(v["l"], v["r"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a text of digits; valid if divisible by 10."""

    def one(total: Column, p: Column) -> Column:
        d = F.substr(digits, p, F.lit(1)).cast("int") * F.when(F.pmod(F.length(digits) - p, F.lit(2)) == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(_chars(digits), F.lit(0), one)


def _refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by those of digits, in order."""

    def one(p: Column) -> Column:
        c = F.substr(form, p, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(F.regexp_replace(F.substr(form, F.lit(1), p), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(form), one), "")


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    # bound once by aggregate(): a chain of plain expressions would repeat the network at every use
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key + "card")
    new = F.aggregate(F.array(F.concat(body, F.lit("0"))), F.lit(""), lambda _, z: F.concat(F.substr(z, F.lit(1), F.length(z) - 1), F.pmod(-luhn_sum(z), F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, F.aggregate(F.array(new), F.lit(""), lambda _, z: _refilled(m, z))).otherwise(m)


def mod_97(s: Column) -> Column:
    """A text of digits and capital letters (10 to 35) as a number, modulo 97."""

    def one(rest: Column, p: Column) -> Column:
        c = F.substr(s, p, F.lit(1))
        return F.when(c.between("0", "9"), F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(rest * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_chars(s), F.lit(0), one)


def _account(m: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits follow from both."""
    bare, country = F.translate(m, " ", ""), F.substr(m, F.lit(1), F.lit(2))
    fits = mod_97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))) == 1
    check = lambda b: F.lpad((98 - mod_97(F.concat(F.translate(b, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
    new = F.aggregate(F.array(permute_text(F.substr(m, F.lit(5), F.length(m)), key + "account")), F.lit(""), lambda _, b: F.concat(country, check(b), b))
    rest = F.substr(m, F.lit(6), F.length(m))  # else it may be a card number with a word before it
    return F.when(fits, new).when(rest.rlike(rf"\A(?:{_CARDS})\z"), F.concat(F.substr(m, F.lit(1), F.lit(5)), _card(rest, key))).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    n = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    fits = ~F.exists(F.split(m, r"\."), lambda x: x.cast("int") > 255)
    dotted = lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)])
    return F.when(fits, F.aggregate(F.array(permute_number(n, 1 << 16, 1 << 16, key + "ip")), F.lit(""), lambda _, v: dotted(v))).otherwise(m)


def _date(m: Column, form: str, key: str) -> Column:
    day = F.to_date(F.try_to_timestamp(m, F.lit(form)))
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(n, RADIX_A, RADIX_B, key + "date").cast("int")), form)
    return F.when(day.isNotNull() & n.between(0, CYCLE - 1), new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted."""
    code = F.regexp_extract(m, r"^(\+\d{1,3})", 1)
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(n.between(7, 15), F.concat(code, permute_text(F.substr(m, F.length(code) + 1, F.length(m)), key + "phone"))).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of what PATTERN has found."""
    name = F.substring_index(m, "@", 1)
    return (
        F.when(F.contains(m, F.lit("@")), F.concat(permute_text(name, key + "mail"), F.substr(m, F.length(name) + 1, F.length(m))))
        .when(m.rlike(r"\A(?:\d{1,3}\.){3}\d{1,3}\z"), _ip(m, key))
        .when(m.rlike(r"\A\d{4}-\d\d-\d\d\z"), _date(m, "yyyy-MM-dd", key))
        .when(m.rlike(r"\A\d\d\.\d\d\.\d{4}\z"), _date(m, "dd.MM.yyyy", key))
        .when(m.rlike(r"\A\d\d/(?:0\d|1[0-2])/\d{4}\z"), _date(m, "dd/MM/yyyy", key))
        .when(m.rlike(r"\A\d\d/\d\d/\d{4}\z"), _date(m, "MM/dd/yyyy", key))
        .when(m.rlike(rf"\A{_ACCOUNTS}\z"), _account(m, key))
        .when(m.rlike(rf"\A(?:{_CARDS})\z"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found (long) and changed (boolean) for every row of (doc_id, text).

    A null text stays null with n_found 0, an empty one empty. Repeated rows get the same result. Slashed dates are read
    as day, month, year, or, where that can't be, as month, day, year (two such dates may then get one pseudonym). Only documents in which the pattern occurs are taken apart; other columns are not read.
    """
    t = F.col("text")
    rows = docs.select("doc_id", "text")
    rows = rows.withColumn("found", F.when(t.rlike(PATTERN), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn("gaps", F.when(F.col("found").isNotNull(), F.split(t, PATTERN, -1)))
    new = F.array_join(F.zip_with("gaps", F.transform("found", lambda m: pseudonym(m, key)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    rows = rows.withColumn("new", F.when(F.col("found").isNotNull(), new).otherwise(t))
    return rows.select("doc_id", F.col("new").alias("text"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.col("new") != t, F.lit(False)).alias("changed"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, pseudonymised under the session's siftwell.pii.key."""
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("siftwell.pii.key", "public test key"))
