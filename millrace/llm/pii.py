"""PII: keyed format-preserving pseudonyms, built-in functions only.

Every validated value is replaced by another of the same format and length, by a keyed permutation of that format's
values, so equal values get equal pseudonyms in all documents and different values stay different:

* payment cards (13 to 19 digits, valid Luhn sum): the digits before the check digit are permuted, the check digit is
  made anew, so the pseudonym has a valid Luhn sum
* IBANs (valid check digits): country and length stay, the account part is permuted place by place, the check digits are
  made anew
* social security numbers (area 001 to 899 but 666, group and serial not zero): permuted within the valid ones
* IPv4 addresses: permuted among addresses whose parts are as wide and as zero-led
* dates of the calendar from 1630 to 2929 (ISO, or day and month with / or .): permuted among the dates of 100 years
  (from a year that ends in 30) that are written and read alike: parts as wide, and the month first only if that is the
  one reading of both
* telephone numbers: digit by digit places; the country code in front of a separator, punctuation and length stay
* e-mail addresses (the domain stays), access keys, passwords and tokens: letters stay letters of their case, digits
  stay digits

The permutation is a Feistel network of 8 rounds. Where a format is a string of places, a half is shifted place by
place, each within its own class (10 digits, 26 letters, 6 hexadecimal letters), by a key stream that SHA-512 derives
from the key, the kind, the length, the round and the other half. Where it is a number, it is split as a * M + b and
the two parts are shifted modulo their own ranges; where only some of the numbers belong to the format, the network is
walked until one does. All are undone by the same rounds backwards, given the key.

Defined cases: null stays null, empty stays empty; whole texts are scanned whatever their length, in linear time; rows
are handled one by one and ids are not looked at, so null ids, repeated rows and ties need no rule; values that fail
their check (an impossible date, an octet over 255, a wrong Luhn sum or check digit) are left alone, as are dotted
numbers that follow a letter or the word version; other columns are carried and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import unused

ROUNDS = 8
#: The key that the queries use. Real corpora need a secret one.
DEMO_KEY = "millrace-demo-key"
#: Steps of a walk at most. A format has a fifth of the numbers at least, so one is found long before.
WALK = 256

_LABEL = "(?:password|passwd|secret|pwd|api_key|apikey)[=:]"

#: Shapes that are looked for, in order of precedence; each is checked further before it is replaced.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": rf"(?<={_LABEL})[A-Za-z0-9]{{6,}}",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9.-])(?:1[6-9]|2[0-9])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "date": r"(?<![0-9./])[0-9]{1,2}([/.])[0-9]{1,2}\1(?:1[6-9]|2[0-9])[0-9]{2}(?![0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?<!ersion )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|\.[0-9])",
    "plus_phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9](?:[ .-]?[0-9]){6,12}(?![0-9])",
}
#: One pattern of all shapes; the only group is the date's separator.
ANY = "|".join(f"(?:{s})" for s in SHAPES.values())


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _stream(key: str, kind: str, length: Column, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), length.cast("string"), turn.cast("string"), half), 512)


def _shift(char: Column, by: Column, hex_letters: bool) -> Column:
    """A character moved by `by` places within its class; characters of no class stay."""
    code = F.ascii(char)
    size = F.lit(6 if hex_letters else 26)
    at = lambda first, n: F.char(F.lit(first) + (code - first + by) % n)
    return (
        F.when((code >= 48) & (code <= 57), at(48, F.lit(10)))
        .when((code >= 97) & (code <= 122), at(97, size))
        .when((code >= 65) & (code <= 90), at(65, size))
        .otherwise(char)
    )


def permute_places(value: Column, key: str, kind: str, hex_letters: bool = False) -> Column:
    """The Feistel network over a string of places. Halves swap roles, not places, so every place keeps its class."""
    n = F.length(value)
    cut = (n / 2).cast("int")

    def moved(half: Column, other: Column, turn: Column) -> Column:
        words = F.concat(_stream(key, kind, n, turn, other), _stream(key, kind + "+", n, turn, other))
        # two hexadecimal characters of the stream for each place, from the start again after 128 places
        by = lambda w, i: F.conv(F.substring(w, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return _bind(words, lambda w: F.array_join(F.transform(F.split(half, ""), lambda c, i: _shift(c, by(w, i), hex_letters)), ""))

    def step(s: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(moved(s["a"], s["b"], turn).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], turn).alias("b")))

    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, n).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, ma: Column, mb: Column, key: str, kind: str) -> Column:
    """The Feistel network over 0 .. ma * mb - 1."""

    def part(turn: Column, other: Column, size: Column) -> Column:
        return F.conv(F.substring(_stream(key, kind, size, turn, other.cast("string")), 1, 12), 16, 10).cast("bigint") % size

    def step(s: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(((s["a"] + part(turn, s["b"], ma)) % ma).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + part(turn, s["a"], mb)) % mb).alias("b")))

    start = F.struct(F.floor(value / mb).cast("bigint").alias("a"), (value % mb).cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * mb + s["b"])


def walk_number(value: Column, ma: Column, mb: Column, key: str, kind: str, fits: Callable[[Column], Column]) -> Column:
    """The same over those of the numbers that fit: the network is applied until one does, which permutes them."""
    once = lambda v: permute_number(v, ma, mb, key, kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(value), lambda v, _: F.when(fits(v), v).otherwise(once(v)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )


def mod97(text: Column) -> Column:
    """The remainder by 97 of the number that digits and capitals (A = 10 to Z = 35) spell."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _refill(value: Column, chars: Column, first: str = "0", last: str = "9") -> Column:
    """value with its characters from `first` to `last` replaced, one by one, by `chars`; everything else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = lambda s, c: F.when(
        c.between(first, last), F.struct(F.concat(s["out"], F.substring(chars, s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permute_places(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    made = _bind(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, _refill(value, made)).otherwise(value)


def _iban(value: Column, key: str) -> Column:
    flat = F.regexp_replace(value, " ", "")
    country, check, body = F.substring(flat, 1, 2), F.substring(flat, 3, 2), F.substring(flat, F.lit(5), F.length(flat))
    digits = lambda b: F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    made = _bind(permute_places(body, key, "iban"), lambda b: F.concat(country, digits(b), b))
    return F.when((F.length(flat) >= 15) & (check == digits(body)), _refill(value, made, "0", "Z")).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    p = F.transform(F.split(value, "-"), lambda x: x.cast("bigint"))
    area, group, serial = (F.get(p, F.lit(k)) for k in range(3))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    moved = permute_number(number, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn")

    def text(v: Column) -> Column:
        at = F.floor(v / (99 * 9999)).cast("bigint") + 1
        return F.concat_ws("-", F.lpad((at + F.when(at >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(v / 9999).cast("bigint") % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    return F.when(good, _bind(moved, text)).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    """Each part goes to one as wide, and zero-led as before or not."""
    part = F.split(value, r"\.")

    def ranged(o: Column) -> Column:  # the part's number, where its range starts and how many numbers are in it
        wide, led = F.length(o), o.startswith("0") & (F.length(o) > 1)
        least = F.when(led | (wide == 1), 0).when(wide == 2, 10).otherwise(100)
        size = F.when(led, F.when(wide == 2, 10).otherwise(100)).when(wide == 1, 10).when(wide == 2, 90).otherwise(156)
        return F.struct((o.cast("bigint") - least).alias("x"), least.cast("bigint").alias("low"), size.cast("bigint").alias("n"), wide.alias("w"))

    def moved(r: Column) -> Column:
        o = [F.get(r, F.lit(k)) for k in range(4)]
        ma, mb = o[0]["n"] * o[1]["n"], o[2]["n"] * o[3]["n"]
        number = (o[0]["x"] * o[1]["n"] + o[1]["x"]) * mb + o[2]["x"] * o[3]["n"] + o[3]["x"]

        def text(v: Column) -> Column:
            a, b = F.floor(v / mb).cast("bigint"), v % mb
            new = [F.floor(a / o[1]["n"]).cast("bigint"), a % o[1]["n"], F.floor(b / o[3]["n"]).cast("bigint"), b % o[3]["n"]]
            return F.concat_ws(".", *[F.lpad((n + x["low"]).cast("string"), x["w"], F.lit("0")) for n, x in zip(new, o, strict=True)])

        return _bind(permute_number(number, ma, mb, key, "ip"), text)

    return F.when(F.forall(part, lambda o: o.cast("bigint") <= 255), _bind(F.transform(part, ranged), moved)).otherwise(value)


def _date(value: Column, key: str, iso: bool) -> Column:
    """A date goes to another of the same 36525 or 36524 days from a year that ends in 30."""
    p = F.split(value, "[/.-]")
    one, two, year = (F.get(p, F.lit(k)) for k in range(3))
    read = lambda d, m: F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day = F.try_to_date(value, "yyyy-MM-dd") if iso else F.coalesce(read(one, two), read(two, one))
    month_first = F.lit(False) if iso else read(one, two).isNull()

    def moved(x: Column) -> Column:  # x: the date, and whether its month stands first
        first_year = (F.floor((F.year(x["day"]) - 30) / 100) * 100 + 30).cast("int")
        first = F.make_date(first_year, F.lit(1), F.lit(1))
        days = F.datediff(F.make_date(first_year + 100, F.lit(1), F.lit(1)), first)
        long = days == 36525  # 75 * 487; the other length is 92 * 397
        ma, mb = F.when(long, F.lit(75)).otherwise(F.lit(92)).cast("bigint"), F.when(long, F.lit(487)).otherwise(F.lit(397)).cast("bigint")
        number = F.datediff(x["day"], first).cast("bigint")
        if iso:
            return F.date_format(F.date_add(first, permute_number(number, ma, mb, key, "date").cast("int")), "yyyy-MM-dd")

        def fits(v: Column) -> Column:
            d, m = F.day(F.date_add(first, v.cast("int"))), F.month(F.date_add(first, v.cast("int")))
            a, b = F.when(x["month_first"], m).otherwise(d), F.when(x["month_first"], d).otherwise(m)
            narrow = ((F.length(one) == 2) | (a < 10)) & ((F.length(two) == 2) | (b < 10))
            return narrow & (~x["month_first"] | (d > 12))

        def text(new: Column) -> Column:
            d, m = F.day(new), F.month(new)
            a, b = F.when(x["month_first"], m).otherwise(d), F.when(x["month_first"], d).otherwise(m)
            sep = F.regexp_extract(value, "[/.]", 0)
            return F.concat(F.lpad(a.cast("string"), F.length(one), F.lit("0")), sep, F.lpad(b.cast("string"), F.length(two), F.lit("0")), sep, F.date_format(new, "yyyy"))

        return _bind(F.date_add(first, walk_number(number, ma, mb, key, "date", fits).cast("int")), text)

    good = day.isNotNull() & F.year(day).between(1630, 2929)
    return F.when(good, _bind(F.struct(day.alias("day"), month_first.alias("month_first")), moved)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """The part before the @ is permuted, the domain stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(permute_places(local, key, "email"), F.lit("@"), domain)


def pseudonym(value: Column, key: str, labelled: Column | None = None) -> Column:
    """The pseudonym of one match of ANY. labelled: whether it stands behind a label such as password=."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)  # stays; without a separator it cannot be told apart
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    phone = F.concat(country, _refill(rest, permute_places(digits_of(rest), key, "phone")))
    secret = F.lit(False) if labelled is None else labelled & value.rlike("^[A-Za-z0-9]{6,}$")
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(value.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$"), F.concat(F.substring(value, 1, 4), permute_places(F.substring(value, F.lit(5), F.length(value)), key, "access_key")))
        .when(value.rlike("^[0-9a-f]{32,128}$"), permute_places(value, key, "hex", hex_letters=True))
        .when(secret, permute_places(value, key, "secret"))
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(value, key, iso=True))
        .when(value.rlike(r"^[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}$"), _date(value, key, iso=False))
        .when(value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), _ip(value, key))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(value, key))
        .when(value.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), _card(value, key))
        .when(value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), _iban(value, key))
        .when(value.rlike(r"^[+(]|^[0-9]{3}[ .-]"), phone)
        .otherwise(permute_places(value, key, "secret"))
    )


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, column: str = "text", count: str | None = None) -> DataFrame:
    """docs with the values in `column` replaced; `count` names a further column for how many have changed."""
    text, matched, between, made = F.col(column), unused(docs, "matches"), unused(docs, "gaps"), unused(docs, "made")
    may = text.rlike("[0-9@]")  # every shape but a labelled one has a digit or an @
    labelled = text.rlike(_LABEL)
    matches = F.when(may | labelled, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    gaps, old, new = F.col(between), F.col(matched), F.col(made)
    out = docs.withColumn(matched, matches).withColumn(between, F.when(F.size(matched) > 0, F.split(text, ANY, -1)))
    out = out.withColumn(made, F.transform(old, lambda m, i: pseudonym(m, key, F.get(gaps, i).rlike(_LABEL + "$"))))
    put = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(new, lambda m, i: F.concat(m, F.get(gaps, i + 1))), ""))
    if count is not None:
        changed = F.size(F.filter(F.transform(new, lambda m, i: m != F.get(old, i)), lambda x: x))
        out = out.withColumn(count, F.when(F.size(matched) > 0, changed).otherwise(0).cast("bigint"))
    return out.withColumn(column, F.when(F.size(matched) > 0, put).otherwise(text)).drop(matched, between, made)
