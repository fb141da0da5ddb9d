"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validity test are permuted under a key within their own format: a payment card
stays a card with a right check digit, an account number (IBAN) keeps its country and gets right check digits, an IPv4
address stays one, a calendar date stays one between 1900 and 2099, in the order and with the signs and zeros it had.
Equal values get equal pseudonyms in every document, however they are punctuated, so records stay linked. The
permutation is a Feistel network over two moduli whose product is the size of the format; each round adds a keyed
SHA-256 value of the other half. A mail address has no number to permute: both its parts become keyed digests under
the reserved domain ``example.invalid``, so it stays an address and stays linked.

Cards are looked for between the other findings, in whole runs of digits with single blanks or hyphens: of a run's
groups, the leftmost that start a valid card are taken with as many more as still make one, and the search goes on
behind it. A phone number in brackets or after +1 may have any area code and exchange; numbers of each validity are
permuted among themselves, so that a number has one pseudonym in every form. After another country code in front of
2 to 4 groups the 6 to 12 digits behind the code are permuted. A date of two numbers and a year is day and month if that
is a date, else month and day.

The key is one row of a table that a scalar subquery reads: it stands in no plan, and so in no log of plans.

Only built-in functions are used. Defined results: null text stays null; what fails its validity test stays as it
is; texts without findings come back unchanged; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settled
from .common import fresh_name

ROUNDS = 10
#: The patterns, in the order in which they are tried at a place.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}(?:-[01]?[0-9]-[0-3]?[0-9]|/[01]?[0-9]/[0-3]?[0-9]|\.[01]?[0-9]\.[0-3]?[0-9])|[0-3]?[0-9](?:/[0-3]?[0-9]/|\.[0-3]?[0-9]\.|-[0-3]?[0-9]-)(?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9])(?:(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}|\+1[ .-]?[0-9]{3}[ .-][0-9]{3}|(?:1[ .-]?)?[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}(?![0-9])"
FOREIGN = r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]\(?[0-9]{2,8}\)?){2,4}(?![0-9]|[ .-][0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
ANY = "|".join((MAIL, IPV4, DATE, SSN, PHONE, IBAN, FOREIGN))
KINDS = (("mail", MAIL), ("ipv4", IPV4), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("iban", IBAN), ("foreign", FOREIGN), ("card", CARD))
#: Digits of a card number.
LEAST_CARD, MOST_CARD = 13, 19
#: Days from 1900-01-01 to 2099-12-31, and two factors of that number.
DAYS = (17, 4297)


def feistel(key: Column, tag: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct<a,b>: the permuted halves, a under ``left_size`` and b under ``right_size``."""

    def keyed(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(tag), i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        a = F.when(odd, F.pmod(acc["a"] + F.pmod(keyed(i, acc["b"]), acc["m"]), acc["m"])).otherwise(acc["a"])
        b = F.when(odd, acc["b"]).otherwise(F.pmod(acc["b"] + F.pmod(keyed(i, acc["a"]), acc["n"]), acc["n"]))
        return F.struct(a.alias("a"), b.alias("b"), acc["m"].alias("m"), acc["n"].alias("n"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"), left_size.cast("long").alias("m"), right_size.cast("long").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(marks, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _into(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, from the right, by those of ``digits``; a country code in front stays."""
    more = F.length(_digits(shape)) - F.length(digits)
    chars = F.split(shape, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]") & (F.length(_digits(F.substr(shape, F.lit(1), i + 1))) > more), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i + 1))) - more, F.lit(1))).otherwise(c)), "")


def _digit_string(digits: Column, key: Column, tag: str) -> Column:
    """The pseudonym of a string of 2 to 32 digits among those of its length; an account number has at most 31."""
    size = lambda n: F.element_at(F.array(*[F.lit(10**i) for i in range(1, 17)]), n)

    def whole(half: Column, rest: Column) -> Column:
        f = feistel(key, tag, F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"), size(half), size(rest))
        return _one(f, lambda r: F.concat(F.lpad(r["a"].cast("string"), half, F.lit("0")), F.lpad(r["b"].cast("string"), rest, F.lit("0"))))

    half = F.floor(F.length(digits) / 2).cast("int")
    return whole(half, F.length(digits) - half)


def _mod97(x: Column) -> Column:
    """The remainder of a string whose capitals stand for the numbers from 10 on."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _respaced(shape: Column, letters: Column) -> Column:
    """``letters`` with blanks where ``shape`` has them."""
    at = lambda i: F.length(F.replace(F.substr(shape, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(letters, at(i), F.lit(1)))), "")


def _one(value: Column, build) -> Column:
    """``build`` of a computed value that is used more than once: it is computed once."""
    return F.element_at(F.transform(F.array(value), build), 1)


def pseudonym(kind: str, piece: Column, key: Column) -> Column:
    """The pseudonym of a piece of this kind; null if it fails the validity test."""
    if kind == "mail":
        return F.concat(F.substring(F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(piece)), 256), 1, 16), F.lit("@example.invalid"))
    if kind == "ipv4":
        parts = F.transform(F.split(piece, r"\."), lambda x: x.cast("long"))

        def address(p: Column) -> Column:
            f = feistel(key, kind, F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), F.lit(65536), F.lit(65536))
            return F.when(F.forall(p, lambda x: x < 256), _one(f, lambda r: F.concat_ws(".", F.floor(r["a"] / 256).cast("string"), (r["a"] % 256).cast("string"), F.floor(r["b"] / 256).cast("string"), (r["b"] % 256).cast("string"))))

        return _one(parts, address)
    if kind == "date":
        first = F.lit("1900-01-01").cast("date")
        numbers = F.transform(F.split(piece, "[/.-]"), lambda x: x.cast("int"))
        made = lambda y, m, d: F.datediff(F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd"), first)
        # in front of a year at the end: day and month, else month and day
        year_first = F.get(F.split(piece, "[/.-]"), F.lit(0))
        orders = lambda n: F.when(F.length(year_first) == 4, F.struct(made(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2))).alias("n"), F.lit("ymd").alias("order"))).otherwise(F.coalesce(F.when(made(F.get(n, F.lit(2)), F.get(n, F.lit(1)), F.get(n, F.lit(0))).isNotNull(), F.struct(made(F.get(n, F.lit(2)), F.get(n, F.lit(1)), F.get(n, F.lit(0))).alias("n"), F.lit("dmy").alias("order"))), F.struct(made(F.get(n, F.lit(2)), F.get(n, F.lit(0)), F.get(n, F.lit(1))).alias("n"), F.lit("mdy").alias("order"))))
        sign = F.regexp_extract(piece, "[/.-]", 0)
        padded = ~piece.rlike("(?:^|[/.-])[0-9](?:[/.-]|$)")

        def written(day: Column, order: Column) -> Column:
            two = lambda pattern, short: F.when(padded, F.date_format(day, pattern)).otherwise(F.date_format(day, short))
            y, m, d = F.date_format(day, "yyyy"), two("MM", "M"), two("dd", "d")
            return F.when(order == "ymd", F.concat(y, sign, m, sign, d)).when(order == "dmy", F.concat(d, sign, m, sign, y)).otherwise(F.concat(m, sign, d, sign, y))

        def day(x: Column) -> Column:
            n = x["n"]
            f = feistel(key, kind, F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
            return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _one(f, lambda r: _one(F.date_add(first, (r["a"] * DAYS[1] + r["b"]).cast("int")), lambda d: written(d, x["order"]))))

        return _one(numbers, lambda n: _one(orders(n), day))
    digits = _digits(piece)
    if kind == "ssn":

        def number(d: Column) -> Column:
            area, group, serial = (F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long"))
            f = feistel(key, kind, F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
            valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
            return F.when(valid, _one(f, lambda r: F.concat_ws("-", F.lpad((F.when(r["a"] < 665, r["a"] + 1).otherwise(r["a"] + 2)).cast("string"), 3, "0"), F.lpad((F.floor(r["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((r["b"] % 9999 + 1).cast("string"), 4, "0"))))

        return _one(digits, number)
    if kind == "phone":

        def line(d: Column) -> Column:
            area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
            # area codes from 200 and exchanges from 200; lower area codes; lower exchanges: each is permuted within itself
            low_rest, low_area = rest < 2_000_000, area < 200
            area_from, areas = F.when(low_rest | low_area, 0).otherwise(200), F.when(low_rest, 1000).when(low_area, 200).otherwise(800)
            rest_from, rests = F.when(low_rest, 0).otherwise(2_000_000), F.when(low_rest, 2_000_000).otherwise(8_000_000)
            f = feistel(key, kind, area - area_from, rest - rest_from, areas, rests)
            return _one(f, lambda r: _into(piece, F.concat(F.lpad((r["a"] + area_from).cast("string"), 3, "0"), F.lpad((r["b"] + rest_from).cast("string"), 7, "0"))))

        return _one(F.substring(digits, -10, 10), line)
    if kind == "foreign":
        code = F.regexp_extract(piece, r"^\+[0-9]+", 0)
        return _one(F.substr(digits, F.length(code), F.lit(40)), lambda d: F.when(F.length(d).between(6, 12), _one(_digit_string(d, key, kind), lambda w: _into(piece, w))))
    if kind == "iban":

        def account(x: Column) -> Column:
            body = F.substring(x, 5, 40)
            number = _digits(body)
            whole = _one(_digit_string(number, key, kind), lambda w: _into(body, w))
            fresh = _one(whole, lambda w: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(F.concat(w, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0"), w))
            valid = (_mod97(F.concat(body, F.substring(x, 1, 4))) == 1) & (F.length(number) >= 2)
            return F.when(valid, _one(fresh, lambda w: _respaced(piece, w)))

        return _one(F.replace(piece, F.lit(" "), F.lit("")), account)
    assert kind == "card"

    def card(d: Column) -> Column:
        front = _digit_string(F.substr(d, F.lit(1), F.length(d) - 1), key, kind)
        whole = _one(front, lambda b: F.concat(b, (F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10))).cast("string")))
        return F.when(_luhn_sum(d) % 10 == 0, _one(whole, lambda w: _into(piece, w)))

    return _one(digits, card)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(LEAST_CARD, MOST_CARD) & (_luhn_sum(digits) % 10 == 0)


PART = "struct<gap:string,old:string,kind:string,new:string>"


def _part(gap: Column, old: Column | None = None, kind: Column | None = None, new: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(gap.alias("gap"), (null if old is None else old).alias("old"), (null if kind is None else kind).alias("kind"), (null if new is None else new).alias("new"))


def _run_parts(run: Column, key: Column) -> Column:
    """The parts of a run of digits: cards, and what stands between them."""

    def of_groups(groups: Column) -> Column:
        span = lambda i, n: F.array_join(F.slice(groups, i, n), "")
        sizes = lambda i: F.sequence(F.least(F.lit(MOST_CARD), F.size(groups) - i + 1), F.lit(1), F.lit(-1))
        longest = lambda i: F.coalesce(F.get(F.filter(sizes(i), lambda n: _one(_digits(span(i, n)), _is_card)), F.lit(0)), F.lit(0))
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<i:int,n:int>>").alias("found"))

        def step(acc: Column, i: Column) -> Column:
            n = F.when(i < acc["next"], 0).otherwise(longest(i)).cast("int")
            return _one(n, lambda n: F.when(n > 0, F.struct((i + n).alias("next"), F.concat(acc["found"], F.array(F.struct(i.alias("i"), n.alias("n")))).alias("found"))).otherwise(acc))

        def cut(found: Column) -> Column:
            end = lambda k: F.when(k == 0, 1).otherwise(F.get(found, k - 1)["i"] + F.get(found, k - 1)["n"])

            def card(x: Column, k: Column) -> Column:
                whole = span(x["i"], x["n"])
                # a group has the blank or hyphen before it
                number = F.regexp_replace(whole, "^[ -]", "")
                gap = F.concat(span(end(k), x["i"] - end(k)), F.substr(whole, F.lit(1), F.length(whole) - F.length(number)))
                return _part(gap, number, F.lit("card"), pseudonym("card", number, key))

            last = end(F.size(found))
            return F.concat(F.transform(found, card), F.array(_part(span(last, F.size(groups) - last + 1))))

        return _one(F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda acc: acc["found"]), cut)

    return _one(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), of_groups)


def _gap_parts(gap: Column, key: Column) -> Column:
    """The parts of a stretch between the findings of the other kinds."""
    pairs = F.zip_with(F.split(gap, CARD, -1), F.regexp_extract_all(gap, F.lit(CARD), F.lit(0)), lambda g, run: F.when(run.isNull(), F.array(_part(g))).otherwise(F.concat(F.array(_part(g)), _run_parts(run, key))))
    return F.when(gap.rlike(CARD), F.flatten(pairs)).otherwise(F.array(_part(gap)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """``docs`` with the text pseudonymised; ``counts_col``, if named, gets a struct of counts by kind (its name may get
    underscores, so that it is no column of ``docs``)."""
    text = F.col(text_col)
    names = list(docs.columns)
    key_col, parts_col = fresh_name(names, "pii_key"), fresh_name(names, "pii_parts")
    secret = docs.sparkSession.createDataFrame([(key,)], "k string")
    docs = settled(docs.withColumn(key_col, secret.scalar()), key_col)
    key = F.col(key_col)

    def replaced(piece: Column) -> Column:
        which = F.lit(None).cast("struct<kind:string,new:string>")
        for kind, pattern in reversed(KINDS[:-1]):
            exact = f"^(?:{pattern})$"
            new = F.struct(F.lit(kind).alias("kind"), pseudonym(kind, piece, key).alias("new"))
            which = F.when(piece.rlike(exact), new).otherwise(which)
        return _one(which, lambda w: F.array(_part(F.lit(""), piece, w["kind"], w["new"])))

    gaps = F.transform(F.split(text, ANY, -1), lambda g: _gap_parts(g, key))
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)
    parts = F.when(text.rlike(f"{ANY}|{CARD}"), F.flatten(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.array().cast(f"array<{PART}>"))))))
    rows = docs.withColumn(parts_col, parts)
    new_text = F.when(F.col(parts_col).isNull(), text).otherwise(F.array_join(F.transform(parts_col, lambda x: F.concat(x["gap"], F.coalesce(x["new"], x["old"], F.lit("")))), ""))
    out = []
    if counts_col:
        of_kind = lambda kind: lambda x: (x["kind"] == kind) & x["new"].isNotNull()
        counts = F.struct(*[F.size(F.filter(parts_col, of_kind(kind))).alias(kind) for kind, _ in KINDS])
        zero = F.struct(*[F.lit(0).alias(kind) for kind, _ in KINDS])
        out = [F.when(F.col(parts_col).isNull(), zero).otherwise(counts).alias(fresh_name(names, counts_col))]
    return rows.select(*[new_text.alias(c) if c == text_col else F.col(c) for c in names], *out)
