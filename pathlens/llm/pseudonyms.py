"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by pattern and validated; a valid one is replaced by
another valid value of its format, permuted under a secret key. The permutation
is a Feistel network over symbols of mixed radix: in each round the symbols at
every other place are shifted by keyed hashes of the remaining ones, so it is a
bijection of the format's values, equal values stay equal in every document, and
a holder of the key can undo it. There is no table of values and no shuffle.

kind    valid if                                       permuted, and what stays
email   local part and dotted domain                   ASCII letters and digits of the local part; the domain stays
iban    the remainder by 97 is 1                       account part, letter by letter, digit by digit; check digits are renewed
card    13 to 19 digits, Luhn sum, issuer digits       all but the first two digits; the check digit is renewed
phone   + and country code with 7 to 14 more digits,   the national digits; country code, punctuation and a leading 0 of
        3-3-4 also with the area in brackets, 0d 4x2   0d dd dd dd dd stay
ssn     area, group and serial in use                  all three, among those in use
date    in the calendar, 1900-01-01 to 2100-05-01      the day, within these days
ipv4    four numbers to 255                            all four

The same number with other punctuation, or date in another order, gets the same
pseudonym. What is not valid stays as it is.

Defined cases: a null text stays null and has no finds; empty texts stay empty;
rows and columns are kept as given, but for ``text``; columns named like the
added ``n_found`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint import let
from .work import unused

ROUNDS = 8

EMAIL = r"(?<![\w.%+-])[\p{L}\d_.%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+"
IBAN = r"(?<![\w])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w])"
_GAP = r"[   ./()-]{0,2}"
#: Where a country's length is fixed, so many digits are taken; what follows may be another number.
_ABROAD = rf"(?<![\w+])\+(?:(?:1(?:{_GAP}\d){{10}}|3[34](?:{_GAP}\d){{9}}|44(?:{_GAP}\d){{10}})(?!\w)|[1-9](?:{_GAP}\d){{7,16}}+(?!\w))"
_PAIRS = r"(?<![\w+(])0[1-9](?:[   .-]\d{2}){4}(?!\w|[.-]?\d)"
PHONE = rf"{_ABROAD}|(?<![\w+(])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\)[ .-]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\w)|{_PAIRS}"
#: What stays before the national digits.
COUNTRY = r"^(?:\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|0(?=\d(?:\D\d{2}){4}$))"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[/.-]\d)"
CARD = r"(?<![\w.-])\d{4}(?:\d{9,15}|(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{5})(?![\w]|[.-]\d)"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
ANY = "|".join((EMAIL, IBAN, CARD, PHONE, SSN, DATE, IPV4))
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"

Texts = Callable[[Column], Column]


def digest(key: str, kind: str, step: Column, place: Column, rest: Column) -> Column:
    """48 bits of a keyed hash."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), place.cast("string"), rest)
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def permute(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed bijection of arrays of whole numbers below their radices."""

    def step(held: Column, number: Column) -> Column:
        others = F.array_join(F.transform(held, lambda x, i: F.when(i % 2 != number % 2, x.cast("string")).otherwise(F.lit("."))), ",")
        return let(others, lambda rest: F.transform(held, lambda x, i: F.when(i % 2 == number % 2, F.pmod(x + F.pmod(digest(key, kind, number, i, rest), F.get(radices, i)), F.get(radices, i))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, step)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _base(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65).otherwise(0)


def permute_string(text: Column, key: str, kind: str) -> Column:
    """Each ASCII digit becomes a digit, each ASCII letter one of its case; the rest stays."""

    def of(chars: Column) -> Column:
        values = F.transform(chars, lambda c: F.when(_base(c) > 0, F.ascii(c) - _base(c)).otherwise(0).cast("long"))
        radices = F.transform(chars, lambda c: F.when(_base(c) == 48, 10).when(_base(c) > 0, 26).otherwise(1).cast("long"))
        return let(radices, lambda r: let(permute(values, r, key, kind), lambda p: F.array_join(F.transform(chars, lambda c, i: F.when(_base(c) > 0, F.char(F.get(p, i) + _base(c))).otherwise(c)), "")))

    return let(characters(text), of)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def refill(form: Column, symbols: Column, pattern: str = "^[0-9]$") -> Column:
    """``form`` with its characters of ``pattern`` replaced by those of ``symbols`` in turn."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("s"))
    put = lambda a, c: F.when(c.rlike(pattern), F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.substring(symbols, a["k"], F.lit(1))).alias("s"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s")))
    return F.aggregate(characters(form), start, put, lambda a: a["s"])


def luhn(digits: Column) -> Column:
    """The Luhn sum of all digits, by 10."""
    weigh = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(characters(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10


def by_97(text: Column) -> Column:
    """The remainder of a number by 97, letters counting as 10 to 35."""
    return F.aggregate(characters(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def email(m: Column, key: str) -> Column:
    return F.concat(permute_string(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def iban(m: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        account = F.substring(plain, F.lit(5), F.length(plain))
        valid = by_97(F.concat(account, F.substring(plain, 1, 4))) == 1
        renewed = let(permute_string(account, key, "iban"), lambda a: F.concat(country, F.lpad((98 - by_97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(valid, let(renewed, lambda r: refill(m, r, "^[A-Z0-9]$"))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        valid = F.length(d).between(13, 19) & d.rlike(ISSUER) & (luhn(d) == 0)
        body = let(permute_string(F.substring(d, F.lit(3), F.length(d) - 3), key, "card"), lambda p: F.concat(F.substring(d, 1, 2), p))
        whole = let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(valid, let(whole, lambda w: refill(m, w))).otherwise(m)

    return let(digits_of(m), of)


def phone(m: Column, key: str) -> Column:
    # the country code is known by its digits, so that grouping does not matter
    signed = F.regexp_replace(m, F.lit("[^0-9+]"), F.lit(""))
    kept = digits_of(F.when(m.startswith("+"), F.regexp_extract(signed, COUNTRY, 0)).otherwise(F.regexp_extract(m, COUNTRY, 0)))

    def of(d: Column, n: Column) -> Column:
        national = F.substring(d, n + 1, F.length(d))
        whole = let(permute_string(national, key, "phone"), lambda p: F.concat(F.substring(d, F.lit(1), n), p))
        return F.when(F.length(national).between(7, 14), let(whole, lambda w: refill(m, w))).otherwise(m)

    return let(digits_of(m), lambda d: let(F.length(kept), lambda n: of(d, n)))


def ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).try_cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = permute(values, F.array(*(F.lit(x).cast("long") for x in (898, 99, 9999))), key, "ssn")
    said = let(moved, lambda p: F.format_string("%03d-%02d-%04d", F.when(F.get(p, F.lit(0)) >= 665, F.get(p, F.lit(0)) + 2).otherwise(F.get(p, F.lit(0)) + 1), F.get(p, F.lit(1)) + 1, F.get(p, F.lit(2)) + 1))
    return F.when(valid, said).otherwise(m)


#: 270 * 271 days from 1900-01-01 on.
DAYS = (270, 271)


def date(m: Column, key: str) -> Column:
    formats = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy"))
    day = lambda f: F.datediff(F.try_to_date(m, f), F.lit("1900-01-01").cast("date")).cast("long")
    out = m
    for begins, form in reversed(formats):
        moved = let(permute(F.array(F.floor(day(form) / DAYS[1]), day(form) % DAYS[1]), F.array(*(F.lit(x).cast("long") for x in DAYS)), key, "date"), lambda p: (F.get(p, F.lit(0)) * DAYS[1] + F.get(p, F.lit(1))).cast("int"))
        said = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), moved), form)
        out = F.when(m.rlike(begins) & F.coalesce(day(form).between(0, DAYS[0] * DAYS[1] - 1), F.lit(False)), said).otherwise(out)
    return out


def ipv4(m: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        moved = permute(parts, F.array_repeat(F.lit(256).cast("long"), 4), key, "ipv4")
        return F.when(F.forall(parts, lambda x: x < 256), F.array_join(F.transform(moved, lambda x: x.cast("string")), ".")).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.try_cast("long")), of)


def pseudonym(m: Column, key: str) -> Column:
    """What a candidate becomes; itself if it is not valid."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(m, F.lit("@")), email(m, key)).when(m.rlike("^[A-Z]"), iban(m, key)).when(whole(CARD), card(m, key))
        .when(whole(PHONE), phone(m, key)).when(whole(SSN), ssn(m, key)).when(whole(DATE), date(m, key)).otherwise(ipv4(m, key))
    )


def pseudonymise(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``documents`` with ``column`` rewritten and ``n_found``, the number of values replaced."""
    (result,) = unused(documents, "pseudonymised")
    text = documents[column]
    # a candidate holds a digit or an at sign; other texts are not searched
    may = text.rlike("[0-9@]")
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = let(found, lambda all_found: F.struct(all_found.alias("old"), F.transform(all_found, lambda m: pseudonym(m, key)).alias("new")))
    whole = let(new, lambda n: F.struct(F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(n["new"], i), F.lit("")))), "").alias("text"), F.size(F.filter(F.zip_with(n["old"], n["new"], lambda a, b: a != b), lambda x: x)).cast("long").alias("n")))
    done = documents.withColumn(result, F.when(may, whole))
    return done.withColumn(column, F.when(may, F.col(result)["text"]).otherwise(text)).withColumn("n_found", F.coalesce(F.col(result)["n"], F.lit(0).cast("long"))).drop(result)
