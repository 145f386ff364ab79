"""Personal data under format-preserving pseudonyms from a keyed Feistel permutation.

Numbers and dates that pass their checks are permuted inside their own format: a card number
becomes another that passes the Luhn check, a date another date written alike, an address of a
host another address. The permutation depends on the key and the kind only, so equal values stay
equal in all documents, and different values different. A date that only reads month first moves among
dates that do, so that no two days share a pseudonym; it is not linked to the same day written otherwise. E-mail addresses and secrets are not
numbers; they get a keyed hash in their format. What fails its check is left alone.

Everything is DataFrame functions: a text is split at the matches of one pattern, each match is
replaced, and the parts are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, let

ROUNDS = 8
#: Alternatives in order of precedence, none inside a longer word or number.
EMAIL = "[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
NAMED = "(?i:token|secret|secret[_-]key|passwd|password|pwd|api[_-]?key|access[_-]?key) {0,3}[=:] {0,3}[\"']?"
SECRET = NAMED + "(?:[A-Za-z0-9+/_-]{16,256}|(?=[A-Za-z+/_-]{0,14}[0-9])[A-Za-z0-9+/_-]{8,15})(?![A-Za-z0-9])"
ACCESS_KEY = "(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = "(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})(?![A-Za-z0-9])"
IPV6 = "(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
IPV4 = "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?!\\.?[0-9])"
ISO_DATE = "(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DATE = "(?<![0-9./-])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4})(?![0-9/-])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = "(?<![0-9+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = "(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "access_key": ACCESS_KEY, "ipv6": IPV6, "iban": IBAN, "ip": IPV4, "iso_date": ISO_DATE, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: Days of a whole Gregorian cycle, from its first year: dates move inside their own cycle of 400 years, 189 x 773 days.
FIRST_DAY, CYCLE = "1800-01-01", (189, 773)
#: Whole cycles before and after that one in which years have three or four digits.
CYCLES = (-4, 19)
#: Country calling codes of one and two digits; the others have three.
SHORT_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def keyed(key: str, *parts: Column | str) -> Column:
    """Hex digits of a hash under the key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(key)), 256)


def feistel(value: Column, a: Column, b: Column, key: str, kind: Column | str) -> Column:
    """The image of ``value`` (long, in 0 .. a*b-1) under a keyed permutation of that range.

    The halves are the quotient and remainder by ``b``; rounds add a keyed function of one half to
    the other in turn, modulo its own size, which each undoes by subtracting again.
    """
    f = lambda i, x: F.conv(F.substring(keyed(key, kind, i, x), 1, 15), 16, 10).cast("long")
    halves = F.struct(((value - F.pmod(value, b)) / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(F.pmod(s["l"] + f(i, s["r"]), a).cast("long").alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + f(i, s["l"]), b).cast("long").alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda s: s["l"] * b + s["r"])


def power(n: Column) -> Column:
    """10**n for n in 0..18, as long."""
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), n + 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted(digits: Column, key: str, kind: Column | str) -> Column:
    """Another string of as many digits (at most 36: 18 at a time)."""
    # a value's length is part of its kind, so that 01 and 1 go their own ways
    part = lambda d, n: F.when(F.length(d) == 0, F.lit("")).otherwise(
        let(F.length(d), lambda k: F.lpad(feistel(d.cast("long"), power(F.floor(k / 2).cast("int")), power((k - F.floor(k / 2)).cast("int")), key, F.concat_ws("/", F.lit(kind) if isinstance(kind, str) else kind, F.lit(n), k.cast("string"))).cast("string"), k, "0"))
    )
    return F.concat(let(F.substring(digits, 1, 18), lambda d: part(d, "a")), let(F.substring(digits, 19, 18), lambda d: part(d, "b")))


def put_back(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced one by one by ``digits``."""
    return F.array_join(F.zip_with(F.split(template, "[0-9]", -1), F.split(digits, "", -1), lambda s, d: F.concat(F.coalesce(s, F.lit("")), F.coalesce(d, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last is a check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(let(c.cast("int") * (1 + i % 2), lambda x: F.floor(x / 10).cast("int") + x % 10)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def new_card(m: Column, key: str) -> Column:
    """Keeps the first digit and the length; the last digit makes the Luhn sum right."""

    def renewed(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permuted(F.substr(d, F.lit(2), n - 2), key, "card"))
        return let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return let(digits_of(m), lambda d: F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), put_back(m, renewed(d))))


def mod97(text: Column) -> Column:
    """Remainder by 97 of the number that an IBAN stands for, letters being 10 to 35."""
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def new_iban(m: Column, key: str) -> Column:
    """Keeps country, letters and spacing; the check digits follow from the new account digits."""

    def renewed(s: Column) -> Column:
        account = F.substr(s, F.lit(5))
        body = let(account, lambda x: put_back(x, permuted(digits_of(x), key, F.concat(F.lit("iban"), F.substring(s, 1, 2)))))
        check = lambda b: F.lpad((98 - mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return let(body, lambda b: F.concat(check(b), digits_of(b)))

    spaced = lambda s: F.when(F.length(s).between(15, 34) & (mod97(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))) == 1), put_back(m, renewed(s)))
    return let(F.upper(F.replace(m, F.lit(" "), F.lit(""))), spaced)


def new_ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    number = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    dotted = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])
    half = F.lit(1 << 16).cast("long")
    return let(octets, lambda o: F.when(F.array_max(o) <= 255, let(feistel(number(o), half, half, key, "ip"), dotted)))


def new_date(m: Column, key: str, formats: list[tuple[str, str]]) -> Column:
    """``formats``: (shape, format) pairs; the first whose shape and calendar fit is used."""
    a, b = (F.lit(x).cast("long") for x in CYCLE)
    first = F.lit(FIRST_DAY).cast("date")
    days = F.lit(CYCLE[0] * CYCLE[1])

    def one(shape: str, form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first)
        moved = lambda d: F.date_format(F.date_add(first, (d - F.pmod(d, days) + feistel(F.pmod(d, days).cast("long"), a, b, key, "date")).cast("int")), form)
        return let(F.when(m.rlike(shape), day), lambda d: F.when((d >= CYCLES[0] * days) & (d < (CYCLES[1] + 1) * days), moved(d)))

    return F.coalesce(*[one(*f) for f in formats])


def new_month_first(m: Column, key: str) -> Column:
    """A date that only reads month first, as another of that kind: with a day after the 12th, and inside its own block of 400 years.

    Days move in four sets, each numbered without a gap: the 13th to 28th of all months, the 29th or 30th and the 31st of
    the months that have them, and the 29th of February, of which 400 years have 97.
    """
    year, month, day = (F.regexp_extract(m, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", g).cast("long") for g in (3, 1, 2))
    n = lambda x: F.lit(x).cast("long")
    date = F.struct(year.alias("y"), month.alias("m"), day.alias("d"), F.pmod(year - 2000, n(400)).alias("o"))
    numbered = lambda index, a, b, kind: F.struct(index.alias("i"), n(a).alias("a"), n(b).alias("b"), F.lit(f"date/{kind}").alias("k"))
    month_of = lambda months, at: F.element_at(F.array(*[n(x) for x in months]), (at + 1).cast("int"))
    place_of = lambda months, x: F.array_position(F.array(*[n(k) for k in months]), x) - 1
    many, few = [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [1, 3, 5, 7, 8, 10, 12]

    def moved(t: Column) -> Column:
        feb = (t["m"] == 2) & (t["d"] == 29)
        # leap years since one of 400 begins: every fourth, but for the centuries after it
        leap = F.floor(t["o"] / 4) - F.floor(t["o"] / 100)
        at = F.when(t["d"] <= 28, numbered((t["o"] * 12 + t["m"] - 1) * 16 + t["d"] - 13, 320, 240, "28")).when(feb, numbered(leap, 97, 1, "leap"))
        at = at.when(t["d"] == 31, numbered(t["o"] * 7 + place_of(few, t["m"]), 70, 40, "31"))
        at = at.otherwise(numbered(t["o"] * 11 + place_of(many, t["m"]), 55, 80, "30")).alias("at")

        def image(v: Column) -> Column:
            new = lambda o, mm, dd: F.struct(o.cast("long").alias("o"), mm.cast("long").alias("m"), dd.cast("long").alias("d"))
            first = F.floor(v / 16)
            # the first century has 25 leap years, the others 24
            later = F.floor((v - 25) / 24) + 1
            leap_year = F.when(v < 25, 4 * v).otherwise(100 * later + 4 * (F.pmod(v - 25, n(24)) + 1))
            return (
                F.when(t["d"] <= 28, new(F.floor(first / 12), F.pmod(first, n(12)) + 1, F.pmod(v, n(16)) + 13))
                .when(feb, new(leap_year, n(2), n(29)))
                .when(t["d"] == 31, new(F.floor(v / 7), month_of(few, F.pmod(v, n(7))), n(31)))
                .otherwise(new(F.floor(v / 11), month_of(many, F.pmod(v, n(11))), t["d"]))
            )

        def written(x: Column) -> Column:
            month = F.when(m.rlike("^[0-9]{2}/"), F.lpad(x["m"].cast("string"), 2, "0")).otherwise(x["m"].cast("string"))
            return F.concat_ws("/", month, x["d"].cast("string"), F.lpad((t["y"] - t["o"] + x["o"]).cast("string"), 4, "0"))

        kind = F.concat_ws("/", F.lit(""), F.when(feb, "leap").otherwise(t["d"].cast("string")))
        return let(at, lambda w: let(let(feistel(w["i"], w["a"], w["b"], key, F.when(t["d"] <= 28, w["k"]).otherwise(F.concat(w["k"], kind))), image), written))

    known = F.try_to_timestamp(m, F.lit("M/d/yyyy")).isNotNull()
    return let(F.when(known, date), lambda t: F.when((t["d"] > 12) & (t["y"] >= 400) & (t["y"] < 9600), moved(t)))


def new_ssn(m: Column, key: str) -> Column:
    """Numbers that can be issued: area 001-899 but 666, group from 01, serial from 0001."""
    areas, groups, serials = 898, 99, 9999
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * groups + group - 1) * serials + serial - 1
    a, b = F.lit(areas * groups).cast("long"), F.lit(serials).cast("long")

    def written(v: Column) -> Column:
        top = F.floor(v / b).cast("long")
        n = F.floor(top / groups).cast("long")
        area = n + F.when(n + 1 >= 666, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), k, "0") for x, k in ((area, 3), (F.pmod(top, F.lit(groups)) + 1, 2), (F.pmod(v, b) + 1, 4))])

    return F.when(valid, let(feistel(index, a, b, key, "ssn"), written))


def new_phone(m: Column, key: str) -> Column:
    """Keeps the country code, punctuation and length; permutes the rest, without a + the last ten digits."""

    def renewed(d: Column) -> Column:
        code = F.when(d.rlike(f"^(?:{SHORT_CODES})"), F.length(F.regexp_extract(d, f"^(?:{SHORT_CODES})", 0))).otherwise(3)
        head = F.when(F.startswith(m, F.lit("+")), code).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
        return F.concat(F.substr(d, F.lit(1), head), permuted(F.substr(d, head + 1), key, "phone"))

    return let(digits_of(m), lambda d: F.when(F.length(d).between(7, 15), put_back(m, renewed(d))))


def new_email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(keyed(key, "email", F.lower(m)), 1, 16), F.lit("@example.com"))


def new_ipv6(m: Column, key: str) -> Column:
    """An address of the documentation range, by a keyed hash."""
    h = keyed(key, "ipv6", F.lower(m))
    return F.concat(F.lit("2001:0db8"), *[F.concat(F.lit(":"), F.substring(h, 4 * i + 1, 4)) for i in range(6)])


def new_access_key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), F.upper(F.substring(keyed(key, "access_key", m), 1, 16)))


def new_secret(m: Column, key: str) -> Column:
    """What names the secret, then as many hex digits as it has characters."""

    def renewed(value: Column) -> Column:
        long = F.concat(*[keyed(key, f"secret{i}", value) for i in range(4)])
        return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.substr(long, F.lit(1), F.length(value)))

    return let(F.regexp_extract(m, "[A-Za-z0-9+/_-]+$", 0), renewed)


def new_date_text(m: Column, key: str) -> Column:
    """Day first where a text reads so; what only reads month first never gets a pseudonym that reads day first."""
    dates = [("^[0-9]{2}/[0-9]{2}/", "dd/MM/yyyy"), ("^[0-9]{2}\\.[0-9]{2}\\.", "dd.MM.yyyy"), ("/", "d/M/yyyy"), ("\\.", "d.M.yyyy")]
    return let(m, lambda x: F.coalesce(new_date(x, key, dates), new_month_first(x, key)))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for the match ``m``: itself if it is no valid value of any kind."""
    whole = lambda p: f"^(?:{p})$"
    return F.coalesce(
        F.when(m.rlike(f"^{NAMED}"), new_secret(m, key))
        .when(F.instr(m, "@") > 0, new_email(m, key))
        .when(m.rlike(whole("(?:[0-9]{1,3}\\.){3}[0-9]{1,3}")), new_ip(m, key))
        .when(m.rlike(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}")), new_date(m, key, [("", "yyyy-MM-dd")]))
        .when(m.rlike(whole("[0-9]{1,2}([/.])[0-9]{1,2}\\1[0-9]{4}")), new_date_text(m, key))
        .when(m.rlike(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}")), new_ssn(m, key))
        .when(m.rlike(whole(ACCESS_KEY)), new_access_key(m, key))
        .when(m.rlike(whole(IPV6)), new_ipv6(m, key))
        .when(m.rlike("^[A-Za-z]{2}[0-9]{2}[A-Za-z0-9 ]+$"), new_iban(m, key))
        .when(m.rlike("^[0-9 -]{13,}$") & F.length(digits_of(m)).between(13, 19), new_card(m, key))
        .when(m.rlike("^[+0-9(][0-9() .-]{6,}$"), new_phone(m, key)),
        m,
    )


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its texts under pseudonyms of the secret ``key``, and n_replaced (long).

    * null text: null, 0. Empty table: empty result. Equal values get equal pseudonyms everywhere.
    * whole texts of any length; a column n_replaced of ``docs`` is replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.coalesce("text", F.lit(""))
    keep = [c for c in docs.columns if c != "n_replaced"]
    found = F.when(text.rlike("(?i)[0-9@]|token|secret|passw|pwd|key"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    matches, new_ones = free(docs, "found", "new")
    rows = docs.select(*keep, found.alias(matches))
    rows = rows.withColumn(new_ones, F.transform(matches, lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(F.split(F.col("text"), ANY, -1), F.col(new_ones), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    changed = F.aggregate(F.zip_with(matches, new_ones, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    new = F.when(F.size(matches) > 0, joined).otherwise(F.col("text"))
    return rows.select(*[new.alias("text") if c == "text" else F.col(c) for c in keep], changed.alias("n_replaced"))
