"""Format-preserving Feistel pseudonyms of personal data, in DataFrame functions only.

Numbers and dates that validate are permuted within their own format by a keyed Feistel network over
Z_a x Z_b: two halves take turns in adding a keyed hash of the other, modulo their own size, which is
a bijection for any a and b. So equal values have equal pseudonyms in all documents, different values
different ones, and a pseudonym validates as its original did:

  card       13 to 19 digits, issuer range, Luhn    the first four digits stay, the check digit is new
  iban       country, length, remainder mod 97      country and letters stay, the check digits are new
  ssn        area, group and serial in range        over the valid numbers alone
  phone      see PHONES                             the last ten digits, in place; their kind of area and number stays
  ip         four octets up to 255                  over the 2**32 addresses
  date       a day that exists, four formats        the days of its 196 years, within the format
  email      local part and domain                  keyed hash, a domain under .example
  secret     32 to 64 hex digits, or the value      keyed hash of the same length
             after token, password, secret or key

What looks like one of these but does not validate stays as it is. All matches of a text are found by
one pattern and replaced within the row: no shuffle, and no document is read twice.

Values that stand side by side, with a single blank or hyphen between, are found as one run of groups
and told apart in it, from left to right: at each group the best span of groups is taken (see rank()), and if
there is none the group stays.

dd/MM/yyyy and MM/dd/yyyy share strings: what reads as the former is permuted among these, and the rest,
with a day above 12, among the rest, so no two slash dates have one pseudonym.

A null text stays null and has 0 found; an empty one stays empty, and an empty table too. Texts of any
length are read whole; each alternative of the pattern begins at the start of its run and does not go
back into it, so a run of any length is read once. Repeated rows have equal results. A column that has
the name of the count is replaced by it; other columns, whatever their names, stay as they are.

The key decides all pseudonyms: who knows it can invert them. It is a parameter; the query takes it from
spark.conf (KEY_SETTING), and only where that is unset, as for synthetic tables, the one in this file.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm.common import table

ROUNDS = 8
#: The days of the years 1 to 9999 are 51 windows of 101 x 709 days; the first begins at EPOCH, and the years are taken as a ring.
DAYS, WINDOWS = (101, 709), 51
EPOCH = "1900-01-01"
#: Steps of a walk from one slash date with a day above 12 to the next: six of ten dates have one.
WALK = 64
KEY_SETTING, UNSAFE_KEY = "spark.auralake.pseudonym.key", "auralake"

EMAIL = r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: Three groups; (415)555-1234; +14155551234; +49 30 1234567; 06 12 34 56 78 and +33 6 12 34 56 78; 4155551234, ten
#: digits as an area and an exchange begin. Seven digits alone are too common to be taken for a phone.
PHONES = (
    r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-][0-9]{3,4}[ .\-][0-9]{3,4}",
    r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[0-9]{3}[ .\-][0-9]{4}",
    r"\+[0-9]{7,15}",
    r"\+[0-9]{1,3}[ .\-](?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-]?[0-9]{5,8}",
    r"(?:0|\+[0-9]{1,3}[ .\-]?)[0-9](?:[ .\-][0-9]{2}){4}",
    r"[2-9][0-9]{2}[2-9][0-9]{6}(?![.\-/][0-9])",
)
PHONE = "(?:" + "|".join(rf"{p}(?![A-Za-z0-9])" for p in PHONES) + ")"
SECRET = r"[A-Fa-f0-9]{32,64}"
VALUE = r"(?=[A-Za-z0-9_/+\-]{8})(?<=[=: \"'])(?<=(?i:token|password|passwd|secret|api[_ \-]?key) ?[=:] ?[\"']?)[A-Za-z0-9_/+\-]{8,}+"
#: Groups of digits, or an account number and what follows it, as far as they reach: values side by side are told apart later.
_GROUPS = r"(?:[ \-][0-9]++(?![A-Za-z0-9]))*+"
RUN = rf"(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]++(?![A-Za-z0-9]){_GROUPS}"
IBAN_RUN = rf"{IBAN}(?![A-Za-z0-9]){_GROUPS}"
#: Groups of a span, at most: a card of single digits.
SPAN = 19
#: Groups that are told apart in one go.
BLOCK = 512
#: How cards are printed, with any of the separators.
PRINTED = r"[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}"
ONE_SEPARATOR = r"[0-9]+(?:(?: [0-9]+)*|(?:-[0-9]+)*)"
#: All begin where no letter or digit stands before, so within a word nothing is tried.
_END, _NO_DOT = r"(?![A-Za-z0-9])", r"(?<![.\-/])"
_ALL = (rf"(?<![._%+\-]){EMAIL}", VALUE, SECRET + _END, IBAN_RUN, _NO_DOT + RUN, _NO_DOT + SSN + _END, _NO_DOT + DATE + _END, rf"(?<!\.){IP}(?!\.?[A-Za-z0-9])", rf"(?<![+.\-/]){PHONE}")
#: What any match holds: texts without it are not searched.
ANY = "[0-9@=:]|[A-Fa-f]{32}"
ALL = "(?<![A-Za-z0-9])(?:" + "|".join(_ALL) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once: inside a lambda an expression is else evaluated at each mention."""
    return F.get(F.transform(F.array(value), body), 0)


def keyed(key: str, label: str, *parts: Column) -> Column:
    """A whole number below 2**56 from a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(label), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, label: str) -> Column:
    """struct(l, r): the image of (left, right) under a keyed bijection of Z_a x Z_b."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(s["l"] + F.pmod(keyed(key, label, i, a, b, s["r"]), a), a)).otherwise(s["l"])
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(keyed(key, label, i, a, b, s["l"]), b), b))
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def permuted(digits: Column, key: str, label: str) -> Column:
    """Digits of the same number, by a Feistel network over its two halves; one digit or none stays."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    part = lambda from_, k: F.substring(digits, from_, k).cast("long")
    out = let(feistel(part(F.lit(1), a), part(a + 1, n - a), size(a), size(n - a), key, label), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0")))
    return F.when(n > 1, out).otherwise(digits)


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn by those of digits."""
    at = lambda i: F.length(only_digits(F.substring(form, F.lit(1), i)))
    one = lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, the last digit being the check digit."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x)


def card_fits(d: Column) -> Column:
    """Whether digits have an issuer's range and Luhn's remainder."""
    issuer = d.rlike("^(4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-7]|30|38|39|6011|65|64[4-9]|62|35)")
    return issuer & (F.pmod(luhn_sum(d), F.lit(10)) == 0)


def card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        def made(inner: Column) -> Column:
            bare = F.concat(F.substring(d, 1, 4), inner)
            return let(bare, lambda x: refilled(m, F.concat(x, F.pmod(10 - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))

        new = let(permuted(F.substring(d, F.lit(5), F.length(d) - 5), key, "card"), made)
        return F.when(card_fits(d), new)

    return let(only_digits(m), body)


def mod97(s: Column) -> Column:
    """The remainder by 97 of an account number read with A = 10 to Z = 35."""
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))))
    step = lambda r, c: F.when(c >= 65, F.pmod(r * 100 + c - 55, F.lit(97))).otherwise(F.pmod(r * 10 + c - 48, F.lit(97)))
    return F.aggregate(chars, F.lit(0), step)


def iban_fits(s: Column) -> Column:
    """Whether an account number without blanks has a length in range and the remainder 1."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.length(s).between(15, 34) & let(turned, lambda x: mod97(x) == 1)


def iban(m: Column, key: str) -> Column:
    def body(s: Column) -> Column:
        def made(bban: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(bban, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            whole = F.concat(F.substring(s, 1, 2), check, bban)
            at = lambda i: F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
            spaced = lambda w: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(w, at(i), F.lit(1)))), "")
            return let(whole, spaced)

        rest = F.substring(s, F.lit(5), F.length(s))
        new = let(let(permuted_long(only_digits(rest), key, "iban"), lambda d: refilled(rest, d)), made)
        return F.when(iban_fits(s), new)

    return let(F.replace(m, F.lit(" "), F.lit("")), body)


def permuted_long(digits: Column, key: str, label: str) -> Column:
    """permuted() for up to 34 digits: the first 16 and the others each by themselves, the others under the first."""
    first, others = F.substring(digits, 1, 16), F.substring(digits, F.lit(17), F.length(digits))
    return F.concat(permuted(first, key, label), F.when(F.length(others) > 0, permuted(others, key, f"{label}-others")).otherwise(""))


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    fits = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    image = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn")
    padded = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    text = lambda s: F.concat_ws("-", padded(s["l"] + 1 + (s["l"] >= 665).cast("int"), 3), padded(F.floor(s["r"] / 9999) + 1, 2), padded(F.pmod(s["r"], F.lit(9999)) + 1, 4))
    return F.when(fits, let(image, text))


def subscriber(digits: Column, key: str) -> Column:
    """Ten digits as an area of three and a number of seven. Each kind of area (2 to 9, 1 or 0 first) and of number
    (2 to 9 or lower first) is permuted within itself, so what a form asks of the first digits still holds."""
    area, rest = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 7).cast("long")
    low_area = F.when(area >= 200, 200).when(area >= 100, 100).otherwise(0).cast("long")
    low_rest = F.when(rest >= 2_000_000, 2_000_000).otherwise(0).cast("long")
    areas, rests = F.when(area >= 200, 800).otherwise(100).cast("long"), F.when(rest >= 2_000_000, 8_000_000).otherwise(2_000_000).cast("long")
    image = feistel(area - low_area, rest - low_rest, areas, rests, key, "phone")
    return let(image, lambda s: F.concat(F.lpad((s["l"] + low_area).cast("string"), 3, "0"), F.lpad((s["r"] + low_rest).cast("string"), 7, "0")))


def phone(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        tail = F.substring(d, keep + 1, F.lit(10))
        image = let(tail, lambda t: F.when(F.length(t) == 10, subscriber(t, key)).otherwise(permuted(t, key, "phone")))
        new = F.concat(F.substring(d, F.lit(1), keep), image)
        return F.when(F.length(d).between(7, 15), let(new, lambda x: refilled(m, x)))

    return let(only_digits(m), body)


def address(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        image = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
        byte = lambda x, by: F.pmod(F.shiftright(x, by), F.lit(256)).cast("string")
        return F.when(F.forall(o, lambda x: x < 256), let(image, lambda s: F.concat_ws(".", byte(s["l"], 8), byte(s["l"], 0), byte(s["r"], 8), byte(s["r"], 0))))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), body)


def permuted_day(day: Column, key: str) -> Column:
    """The image of a day of the years 1 to 9999 among the days of its window."""
    a, b = DAYS
    ring, epoch, first = WINDOWS * a * b, F.lit(EPOCH).cast("date"), F.lit("0001-01-01").cast("date")
    n = F.pmod(F.datediff(day, epoch), F.lit(ring))

    def back(s: Column, window: Column) -> Column:
        place = F.datediff(epoch, first) + window * (a * b) + s["l"] * b + s["r"]
        return F.date_add(first, F.pmod(place, F.lit(ring)).cast("int"))

    def body(n: Column) -> Column:
        within = F.pmod(n, F.lit(a * b))
        image = feistel(F.floor(within / b), F.pmod(within, F.lit(b)), F.lit(a).cast("long"), F.lit(b).cast("long"), key, "date")
        return let(image, lambda s: back(s, F.floor(n / (a * b))))

    return let(n, body)


def date(m: Column, key: str) -> Column:
    def as_(form: str, walk: bool = False) -> Column:
        # Only days that the format writes back as they were: four digits of the year.
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        day = F.when(day.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), day)

        def walked(day: Column) -> Column:
            start = F.struct(permuted_day(day, key).alias("d"))
            step = lambda s, _: F.when(F.dayofmonth(s["d"]) > 12, s).otherwise(F.struct(permuted_day(s["d"], key).alias("d")))
            return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)["d"]

        return let(day, lambda d: F.when(d.isNotNull(), F.date_format(walked(d) if walk else permuted_day(d, key), form)))

    slash = let(as_("dd/MM/yyyy"), lambda d: F.when(d.isNotNull(), d).otherwise(as_("MM/dd/yyyy", True)))
    return F.when(m.contains("-"), as_("yyyy-MM-dd")).when(m.contains("."), as_("dd.MM.yyyy")).otherwise(slash)


def email(m: Column, key: str) -> Column:
    hexed = lambda s, n: F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(s)), 256), 1, n)
    return F.concat(F.lit("u"), hexed(m, 12), F.lit("@d"), hexed(F.substring_index(m, "@", -1), 8), F.lit(".example"))


def secret(m: Column, key: str) -> Column:
    n = F.length(m)
    hexed = F.sha2(F.concat(F.lit(f"{key}|secret|"), m), 512)
    long = F.substring(F.repeat(hexed, F.ceil(n / 128).cast("int")), F.lit(1), n)
    return F.when(F.upper(m) == m, F.upper(long)).otherwise(long)


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a match: null if it does not validate."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    digits = m.rlike("^[0-9 \\-]+$") & (F.length(only_digits(m)) >= 13)
    other = (
        F.when(m.contains("@"), email(m, key))
        .when(whole(SSN), ssn(m, key))
        .when(whole(DATE), date(m, key))
        .when(whole(IP), address(m, key))
        .when(whole(SECRET) & ~digits, secret(m, key))
        .when(whole(PHONE), phone(m, key))
        .when(digits | whole(IBAN), F.lit(None).cast("string"))
        .otherwise(secret(m, key))
    )
    return F.coalesce(F.when(digits & (F.length(only_digits(m)) <= 19), card(m, key)), F.when(whole(IBAN), iban(m, key)), other)


def rank(span: Column, alone: Column) -> Column:
    """How well a span of groups reads as one value, 0 best; null if it does not.

    Account, printed card, social security number, date, card of one separator, card that is the whole
    run (alone) and holds none of these, phone, any other card. What is written as a number or a date is
    one, valid or not: its groups are no part of a phone.
    """
    shape = lambda p: span.rlike(f"^(?:{p})$")
    n = F.length(only_digits(span))
    other = F.when(shape(ONE_SEPARATOR), 4).when(alone & ~span.rlike(f"(?<![0-9\\-])(?:{SSN}|{DATE})(?![0-9])"), 5).when(shape(PHONE), 6).otherwise(7)
    as_card = F.when(shape(CARD) & let(only_digits(span), card_fits), F.when(shape(PRINTED), 1).otherwise(other))
    return (
        F.when(span.rlike("^[A-Z]"), F.when(shape(IBAN) & let(F.replace(span, F.lit(" "), F.lit("")), iban_fits), 0))
        .when((n < 7) | (n > 19), None)
        .when(n >= 13, F.coalesce(as_card, F.when(shape(PHONE), 6)))
        .when(shape(SSN), 2)
        .when(shape(DATE), 3)
        .when(shape(PHONE) & n.between(7, 15), 6)
    )


def told_apart(run: Column) -> Column:
    """The parts of a run, as struct(text, is_value): their concatenation is the run."""
    part = lambda text, is_value: F.struct(text.alias("text"), F.lit(is_value).alias("is_value"))

    def best(g: Column, i: Column) -> Column:
        n = F.least(F.lit(SPAN), F.size(g) - i)
        span = lambda k: F.regexp_replace(F.array_join(F.slice(g, i + 1, k), ""), "[ \\-]$", "")
        ranked = lambda k: let(span(k), lambda s: F.struct(rank(s, k == F.size(g)).alias("rank"), (-k).alias("less"), s.alias("span")))
        return F.array_min(F.filter(F.transform(F.sequence(F.lit(1), n), ranked), lambda x: x["rank"].isNotNull()))

    parts = F.array().cast("array<struct<text:string,is_value:boolean>>")

    def cover(g: Column, b: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            found, at = F.get(b, i), s["at"]
            last = F.get(g, i - found["less"] - 1)
            new = F.when(found.isNull(), F.array(part(F.get(g, i), False))).otherwise(F.array(part(found["span"], True), part(F.regexp_extract(last, "[ \\-]$", 0), False)))
            return F.struct(F.when(i < at, at).otherwise(i + F.coalesce(-found["less"], F.lit(1))).alias("at"), F.when(i < at, s["out"]).otherwise(F.concat(s["out"], new)).alias("out"))

        def block(s: Column, k: Column) -> Column:
            # Parts gather by blocks: what a step copies does not grow with the run.
            inner = F.aggregate(F.sequence(k, F.least(k + BLOCK, F.size(g)) - 1), F.struct(s["at"].alias("at"), parts.alias("out")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], x["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), parts.alias("out")), block, lambda s: s["out"])

    groups = F.regexp_extract_all(run, F.lit("[^ \\-]+[ \\-]?"), F.lit(0))
    return let(groups, lambda g: let(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: best(g, i)), lambda b: cover(g, b)))


def values(m: Column) -> Column:
    """The parts of a match: a run's own, else the match as one value."""
    run = m.rlike("^[0-9 \\-]+$") & (F.length(only_digits(m)) >= 13) | m.rlike(f"^{IBAN}(?![A-Za-z0-9])")
    return F.when(run & m.rlike("[ \\-]"), told_apart(m)).otherwise(F.array(F.struct(m.alias("text"), F.lit(True).alias("is_value"))))


def configured_key(spark: SparkSession) -> str:
    """The key in spark.conf; without one, a warning and the key that this file makes public."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: the pseudonyms are made with a public key", stacklevel=2)
    return key or UNSAFE_KEY


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = "n_found") -> DataFrame:
    """docs with the personal data in `text` replaced, and the number of replaced matches as `found`."""
    t = F.col(text)
    m, p = (f"__{x}{'_' * max(map(len, docs.columns))}" for x in "mp")  # longer than any name of docs
    none = F.array().cast("array<string>")
    matches = docs.withColumn(m, F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(ALL), F.lit(0))).otherwise(none))
    # Only rows with matches pay for the rest; the array is stored so that its use is not its definition.
    one = lambda v: let(F.when(v["is_value"], pseudonym(v["text"], key)), lambda p: F.struct(F.coalesce(p, v["text"]).alias("text"), p.isNotNull().cast("int").alias("n")))
    new = F.transform(m, lambda x: let(F.transform(values(x), one), lambda v: F.struct(F.array_join(v["text"], "").alias("text"), F.aggregate(v["n"], F.lit(0), lambda a, b: a + b).alias("n"))))
    matches = matches.withColumn(p, F.when(F.size(m) > 0, new).otherwise(F.array().cast("array<struct<text:string,n:int>>")))
    pieces = F.zip_with(F.split(t, ALL, -1), p, lambda gap, x: F.concat(gap, F.coalesce(x["text"], F.lit(""))))
    done = F.when(F.size(p) > 0, F.array_join(pieces, "")).otherwise(t)
    count = F.aggregate(p, F.lit(0), lambda a, x: a + x["n"])
    return matches.withColumns({text: done} | ({found: count} if found else {})).drop(m, p)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))


QUERIES = {"op1_pseudonyms": op1_pseudonyms}
ORACLES: dict[str, str] = {}
