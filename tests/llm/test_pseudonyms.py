import datetime
import hashlib
import random
import re
import time

import pytest

from auralake.llm import pseudonyms as ps


KEY = "a key of the tests"


def feistel(l, r, a, b, label, key=KEY):
    for i in range(ps.ROUNDS):
        h = lambda v: int(hashlib.sha256("|".join(map(str, (key, label, i, a, b, v))).encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        if i % 2 == 0:
            l = (l + h(r) % a) % a
        else:
            r = (r + h(l) % b) % b
    return l, r


def digits(d, label):
    a = len(d) // 2
    l, r = feistel(int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), label)
    return str(l).zfill(a) + str(r).zfill(len(d) - a)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def run(spark, *texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, other string")
    return sorted(ps.pseudonymise(df, KEY).collect())


def test_numbers_keep_their_format(spark):
    out = run(spark, "4417744280351547", "x 4417-7442-8035-1547, y", "4417 7442 8035 1547")
    plain = out[0].text
    inner = digits("74428035154", "card")
    assert plain[:15] == "4417" + inner and luhn(plain) and plain != "4417744280351547"
    assert re.sub(r"\D", "", out[1].text) == re.sub(r"\D", "", out[2].text) == plain
    assert re.fullmatch(r"x \d{4}-\d{4}-\d{4}-\d{4}, y", out[1].text)


def test_phones_addresses_and_numbers(spark):
    a, b, c = run(spark, "+1 (017) 555-7713!", "at 97.51.17.173.", "no 123-45-6789 no")
    l, r = feistel(17, 5557713 - 2_000_000, 100, 8_000_000, "phone")
    p = f"{l:03d}{r + 2_000_000:07d}"
    assert a.text == f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}!"
    l, r = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ip")
    assert b.text == f"at {l >> 8}.{l & 255}.{r >> 8}.{r & 255}."
    l, r = feistel(122, 44 * 9999 + 6788, 898, 99 * 9999, "ssn")
    area = l + 1 + (l >= 665)
    assert c.text == f"no {area:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d} no"


def test_dates(spark):
    epoch = datetime.date(1900, 1, 1)

    def image(d):
        n = (d - epoch).days % (51 * 101 * 709)
        window, within = divmod(n, 101 * 709)
        l, r = feistel(within // 709, within % 709, 101, 709, "date")
        return datetime.date.fromordinal((epoch.toordinal() - 1 + window * 101 * 709 + l * 709 + r) % (51 * 101 * 709) + 1)

    assert datetime.date.max.toordinal() == 51 * 101 * 709
    new = walk = image(datetime.date(2024, 2, 29))
    while walk.day <= 12:
        walk = image(walk)
    out = run(spark, "2024-02-29", "29.02.2024", "29/02/2024", "02/29/2024", "2023-02-29", "9999-12-30", "0001-01-02", "0000-01-02", "02/30/2024")
    assert [x.text for x in out[:3]] == [new.isoformat(), new.strftime("%d.%m.%Y"), new.strftime("%d/%m/%Y")]
    assert out[3].text == walk.strftime("%m/%d/%Y")
    assert [out[k].text for k in (5, 6)] == [image(datetime.date(9999, 12, 30)).isoformat(), image(datetime.date(1, 1, 2)).isoformat()]
    assert [out[k].text for k in (4, 7, 8)] == ["2023-02-29", "0000-01-02", "02/30/2024"] and [x.n_found for x in out] == [1, 1, 1, 1, 0, 1, 1, 0, 0]


def test_slash_dates_are_one_to_one(spark):
    """All of twenty years, in both orders; and the days at either end of the calendar keep four digits."""
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(k) for k in range(7300)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    ends = [datetime.date.fromordinal(k) for k in (*range(1, 300), *range(datetime.date.max.toordinal() - 300, datetime.date.max.toordinal() + 1))]
    df = spark.createDataFrame([(t,) for t in texts] + [(d.isoformat(),) for d in ends], "text string")
    got = [r.text for r in ps.pseudonymise(df.repartition(4), KEY).collect()]
    assert len(set(got)) == len(texts) + len(ends)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}", t) for t in got)


def test_accounts(spark):
    out = run(spark, "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "DE89370400440532013001")
    n = out[1].text
    assert re.fullmatch(r"DE\d{20}", n) and int(n[4:] + "1314" + n[2:4]) % 97 == 1 and n != "DE89370400440532013000"
    assert out[0].text.replace(" ", "") == n and out[2].text == "DE89370400440532013001"


def test_mail_and_secrets(spark):
    out = run(spark, "a.b+1@mail2.example.com and A.B+1@mail2.example.com", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" x', "password=dd93acb406f036cedd x", "TOKEN = 9233A8ECF7C5B09FE5949719B6B82BC439E9329B")
    first, second = out[0].text.split(" and ")
    assert first == second and "mail2" not in first and first.endswith(".example")
    assert "b44e15" not in out[1].text and len(out[1].text) == 52 and "dd93" not in out[2].text and out[2].text.endswith(" x")
    assert out[3].text == out[3].text.upper() and "9233A8" not in out[3].text


def test_permutations_are_one_to_one(spark):
    df = spark.range(100, 1000).selectExpr("id AS doc_id", "concat('10.0.', id DIV 250, '.', id % 250) AS text")
    assert ps.pseudonymise(df, KEY).select("text").distinct().count() == 900
    days = spark.range(0, 800).selectExpr("id AS doc_id", "cast(date_add(date'2099-01-01', cast(id AS int)) AS string) AS text")
    assert ps.pseudonymise(days, KEY).select("text").distinct().count() == 800


@pytest.mark.parametrize("s", ["", "plain words. Version 2.0 of 3", "4845168114407320 and 1234567890123456", "999.1.1.1 and 1.2.3", "666-12-3456 000-12-3456 123-00-4567", "Apache License, Version 2.0, January 2004", "a@b", "deadbeef", "12:30:45", "3.14159265358979"])
def test_clean_texts_stay(spark, s):
    assert run(spark, s)[0].text == s and run(spark, s)[0].n_found == 0


def test_forms_of_phones(spark):
    texts = ["(415)555-1234", "4155551234", "+14155551234", "415-555-1234", "+1 (415) 555-1234", "+1 415 555 1234", "+49 30 1234567", "06 12 34 56 78", "+33 6 12 34 56 78"]
    out = run(spark, *texts, "555-1234", "1700000000", "1.4155551234", "4155551234-2", "x4155551234", "+1 415 555 1234 2024-01-15")
    assert [r.n_found for r in out] == [1] * len(texts) + [0, 0, 0, 0, 0, 2]
    assert all(re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", t) and r.text != t for r, t in zip(out, texts, strict=False))
    assert len({re.sub(r"\D", "", r.text)[-10:] for r in out[:6]}) == 1


def test_ten_digits_keep_their_form_and_stay_apart(spark):
    form = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")
    rng = random.Random(1)
    numbers = sorted({f"{rng.randrange(200, 1000)}{rng.randrange(2_000_000, 10_000_000)}" for _ in range(600)} | {"2002000000", "9999999999", "2009999999", "9992000000"})
    images = [r.text for r in run(spark, *numbers)]
    assert all(form.fullmatch(i) for i in images) and len(set(images)) == len(numbers)
    grouped = [f"({n[:3]}) {n[3:6]}-{n[6:]}" for n in ("0175557713", "1234567890", "4151234567", "4155551234")]
    kinds = lambda t: (min(int(t[1]), 2), t[6] >= "2")
    out = [r.text for r in run(spark, *grouped)]
    assert [kinds(t) for t in out] == [kinds(t) for t in grouped] and len(set(out)) == 4
    assert all(r.text.startswith("0") for r in run(spark, "06 12 34 56 78", "01 99 34 56 78"))


@pytest.mark.parametrize("unit", [".c", "-c", "c.", "1", "1 ", "1-", "12.", "AB12 ", "AB12", "a", "F", "0f", "+1", "+1 ", "(415) ", "12/", "2024-01-", "token=", "=a", "415 555 ", "06 12 ", "a@", "a@b."])
def test_long_runs_of_any_alternative(spark, unit):
    long = unit * ((1_000_000 if unit in (".c", "-c", "c.", "1", "AB12", "a", "F", "0f", "=a", "a@", "a@b.") else 50_000) // len(unit))
    began = time.time()
    out = run(spark, f"a@b{long}", long, f"DE89 {long} x", f"token={long}")
    assert len(out) == 4 and time.time() - began < 60


def test_the_key_is_configured(spark):
    with pytest.warns(UserWarning, match=ps.KEY_SETTING):
        assert ps.configured_key(spark) == ps.UNSAFE_KEY
    spark.conf.set(ps.KEY_SETTING, "other")
    assert ps.configured_key(spark) == "other"
    spark.conf.unset(ps.KEY_SETTING)


def test_values_side_by_side(spark):
    card, ssn, day, phone, account = "4111 1111 1111 1111", "123-45-6789", "1980-01-15", "415-555-1234", "AT611904300234573201"
    alone = {v: r.text for v, r in zip((card, ssn, day, phone, account), run(spark, card, ssn, day, phone, account), strict=True)}
    assert all(v != p for v, p in alone.items())
    rows = [[ssn, day], ["2024-13-15", day], [day, day], [day, phone], [phone, day], [phone, phone], [day, "12345"], [card, "123"], [card, "12"], [ssn, card], [card, card], [day, phone, card], [card, ssn, day, phone] * 50, [account, "BIC"], [account, card], [account, account], ["7", ssn, "1234"]]
    for parts, got in zip(rows, run(spark, *map(" ".join, rows)), strict=True):
        assert got.text == " ".join(alone.get(p, p) for p in parts) and got.n_found == sum(p in alone for p in parts)
    solid = run(spark, "4111111111111111 123", "4111111111111111-123-45-6789x", "4111 1111 1111 1111 12/25")
    assert [r.n_found for r in solid] == [1, 1, 1] and all("1111 1111" not in r.text and "41111111" not in r.text for r in solid)


def test_long_runs_of_numbers(spark):
    got = run(spark, "17 " * 3000 + "123-45-6789", "1" * 100_000, "AB12 " * 3000)
    assert [r.n_found for r in got] == [1, 0, 0] and "123-45-6789" not in got[0].text


def test_cases(spark):
    long = "word " * 40_000 + "4417744280351547 " + "x" * 100_000
    df = spark.createDataFrame([(1, None), (None, "4417744280351547"), (2, long), (2, long), (3, "4417744280351547" * 100)], "doc_id long, text string").selectExpr("*", "1 AS n_found", "2 AS __x", "3 AS __m", "4 AS __p")
    got = ps.pseudonymise(df, KEY).collect()
    assert got[0].text is None and got[0].n_found == 0 and got[2].text == got[3].text and len(got[2].text) == len(long)
    assert got[0].asDict().keys() == set(df.columns) and got[0]['__m'] == 3 and got[0]['__p'] == 4
    assert got[1].text in got[2].text and got[4].n_found == 0
    assert ps.pseudonymise(df.limit(0), KEY).count() == 0


def test_no_python_runs(spark):
    plan = ps.op1_pseudonyms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


FOUND = re.compile(
    r"(?P<mail>(?<![\w.%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?P<hex>(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![A-Za-z0-9.\-/])[0-9]{13,19}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9]))"
    r"|(?P<phone>(?<![A-Za-z0-9+.\-/])\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![A-Za-z0-9]))"
)


def replaced(m):
    """The pseudonym of a match, or the match, written out anew."""
    s, kind = m.group(), m.lastgroup
    sha = lambda f, label, v: f(f"{KEY}|{label}|{v}".encode()).hexdigest()
    if kind == "mail":
        return f"u{sha(hashlib.sha256, 'email', s.lower())[:12]}@d{sha(hashlib.sha256, 'email', s.rsplit('@', 1)[1].lower())[:8]}.example"
    if kind == "hex":
        new = (sha(hashlib.sha512, "secret", s) * 2)[: len(s)]
        return new.upper() if s.upper() == s else new
    if kind == "card":
        issuer = re.match(r"4|5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-7]|30|38|39|6011|65|64[4-9]|62|35", s)
        if not issuer or not luhn(s):
            return s
        body = s[:4] + digits(s[4:-1], "card")
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "ip":
        a, b, c, d = map(int, s.split("."))
        if max(a, b, c, d) > 255:
            return s
        l, r = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    d = re.sub(r"\D", "", s)
    area, rest = int(d[1:4]), int(d[4:])
    low, size = (200, 800) if area >= 200 else (area // 100 * 100, 100)
    low_rest, rests = (2_000_000, 8_000_000) if rest >= 2_000_000 else (0, 2_000_000)
    l, r = feistel(area - low, rest - low_rest, size, rests, "phone")
    p = f"{l + low:03d}{r + low_rest:07d}"
    return f"+{d[0]} ({p[:3]}) {p[3:6]}-{p[6:]}"


def test_whole_texts_equal_brute_force(spark):
    """Finding and replacing, over all documents of a table and over texts that mix what they hold."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    values = [m.group() for _, t in docs for m in FOUND.finditer(t or "")]
    rng = random.Random(3)
    docs += [(-1 - k, ", ".join(rng.choice([rng.choice(values), "word", "12", "300.1.1.1", "1234567890123456", "x@y", "v1.2.3.4"]) for _ in range(12))) for k in range(300)]
    got = {r.doc_id: r for r in ps.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    for i, t in docs:
        new, n = FOUND.sub(replaced, t), sum(replaced(m) != m.group() for m in FOUND.finditer(t))
        assert got[i].text == new and got[i].n_found == n, (i, n, got[i].n_found)
    assert len(values) > 80
