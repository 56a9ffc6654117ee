"""Format-preserving pseudonyms by keyed Feistel networks.

Addresses, numbers, dates and secrets are found in the text, validated (Luhn,
mod 97, ranges of octets and calendar dates), and permuted inside their own
format: a card number becomes another valid card number, a date another date
in the same notation, an address another address of the same shape.  The
permutation depends on the key and the value alone, so equal values get equal
pseudonyms in every document.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_ROUNDS = 8
TEXT_ROUNDS = 4
#: Calendar dates that are permuted: so many days (200 x 365) from 1900-01-01.
FIRST_DAY, YEARS, DAYS = "1900-01-01", 200, 365

# Notations.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_.~-]{8,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
ANY = "|".join((EMAIL, ACCESS_KEY, SECRET, IBAN, ISO_DATE, DAY_DATE, ADDRESS, SOCIAL, PHONE, CARD))
#: Every match of ANY has one of these; most texts have none.
HINT = r"[0-9@]|AKIA|ASIA|(?i:password|passwd|pwd|token|secret|api[_-]?key)"
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _number(digits: Column) -> Column:
    return F.coalesce(F.when(digits == "", F.lit(None)).otherwise(digits), F.lit("0")).cast("long")


def _prf(key: str, purpose: Column, round_: Column, value: Column) -> Column:
    """48 keyed bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), purpose, round_.cast("string"), value.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permute_pair(key: str, purpose: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Alternating Feistel network on [0, left_size) x [0, right_size): struct(l, r)."""

    def step(s: Column, r: Column) -> Column:
        even = F.struct(((s["l"] + _prf(key, purpose, r, s["r"])) % left_size).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), ((s["r"] + _prf(key, purpose, r, s["l"])) % right_size).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(NUMBER_ROUNDS - 1)), start, step)


def permute_digits(key: str, purpose: str, digits: Column) -> Column:
    """A digit string of 2 to 20 digits as another one of the same length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        rest = n - half
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")  # noqa: E731  10^10 at most
        tweak = F.concat(F.lit(purpose), n.cast("string"))
        out = permute_pair(key, tweak, _number(F.substr(d, F.lit(1), half)), _number(F.substr(d, half + 1, rest)), power(half), power(rest))
        return _let(out, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))

    return _let(digits, run)


def permute_text(key: str, purpose: str, value: Column) -> Column:
    """Letters stay letters of their case, digits digits, everything else itself; purpose ``hex``: hexadecimal."""

    def shifted(x: Column, other: Column, r: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(purpose), r.cast("string"), F.floor(i / 16).cast("string"), F.length(x).cast("string"), other, F.lit(key)), 256)
            shift = F.conv(F.substr(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            if purpose == "hex":
                alphabet = F.when(c.rlike("^[0-9a-f]$"), F.lit(_HEX))
            else:
                alphabet = F.when(c.rlike("^[0-9]$"), F.lit(_DIGITS)).when(c.rlike("^[a-z]$"), F.lit(_LOWER)).when(c.rlike("^[A-Z]$"), F.lit(_UPPER))
            return F.coalesce(_let(alphabet, lambda a: F.substr(a, (F.position(c, a) - 1 + shift) % F.length(a) + 1, F.lit(1))), c)

        return F.array_join(F.transform(F.split(x, ""), char), "")

    def step(s: Column, r: Column) -> Column:
        even = F.struct(shifted(s["l"], s["r"], r).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], r).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    def run(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), half).alias("l"), F.substr(v, half + 1, F.length(v)).alias("r"))
        return _let(F.aggregate(F.sequence(F.lit(0), F.lit(TEXT_ROUNDS - 1)), start, step), lambda p: F.concat(p["l"], p["r"]))

    return _let(value, run)


def _fill(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced by ``digits`` in their order."""

    def run(d: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            taken = F.struct(F.concat(s["s"], F.substr(d, s["k"], F.lit(1))).alias("s"), (s["k"] + 1).alias("k"))
            return F.when(c.rlike("^[0-9]$"), taken).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["k"].alias("k")))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda s: s["s"])

    return _let(digits, run)


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` for digits without their check digit."""
    flag = F.lit(1 if double_last else 0)

    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(F.when(c == "", F.lit("0")).otherwise(c)).cast("int")
        doubled = (i + flag) % 2 == 1
        return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _email(key: str, m: Column) -> Column:
    cut = F.length(m) - F.length(F.regexp_extract(m, r"\.[A-Za-z]+$", 0))
    return F.concat(permute_text(key, "email", F.substr(m, F.lit(1), cut)), F.substr(m, cut + 1, F.length(m)))


def _access_key(key: str, m: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), permute_text(key, "access", F.substring(m, 5, 16)))


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_.~-]{8,}$", 0)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(head, F.when(value.rlike("^[0-9a-f]+$"), permute_text(key, "hex", value)).otherwise(permute_text(key, "secret", value)))


def _mod97(text: Column) -> Column:
    """Remainder of the ISO 7064 number of an upper-case alphanumeric string."""

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", a).otherwise((a * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    """The longest valid number of 15 characters or more with which the match begins and which ends at a space."""
    compact = lambda p: F.replace(p, F.lit(" "), F.lit(""))

    def changed(p: Column) -> Column:
        def run(whole: Column) -> Column:
            country, body = F.substring(whole, 1, 2), F.substr(whole, F.lit(5), F.length(whole) - 4)

            def rebuilt(new: Column) -> Column:
                check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
                return _let(F.concat(country, check, new), lambda out: _spread(p, out))

            return _let(permute_text(key, "iban", body), rebuilt)

        return _let(compact(p), run)

    def valid(p: Column) -> Column:
        c = compact(p)
        return (F.length(c) >= 15) & (_mod97(F.concat(F.substr(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1)

    groups = F.split(m, " ")
    ends = F.reverse(F.sequence(F.lit(1), F.size(groups)))
    return _first_valid(F.transform(ends, lambda i: F.array_join(F.slice(groups, F.lit(1), i), " ")), valid, m, changed)


def _spread(shape: Column, chars: Column) -> Column:
    """``chars`` with the spaces of ``shape``."""

    def step(s: Column, c: Column) -> Column:
        taken = F.struct(F.concat(s["s"], F.substr(chars, s["k"], F.lit(1))).alias("s"), (s["k"] + 1).alias("k"))
        return F.when(c == " ", F.struct(F.concat(s["s"], c).alias("s"), s["k"].alias("k"))).otherwise(taken)

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda s: s["s"])


def _date(key: str, year: Column, month: Column, day: Column, m: Column, written) -> Column:
    """``written(date)`` of the permuted date, or the match where there is no such date."""
    date = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def run(index: Column) -> Column:
        p = permute_pair(key, F.lit("date"), F.floor(index / DAYS).cast("long"), index % DAYS, F.lit(YEARS), F.lit(DAYS))
        out = _let(p, lambda q: written(F.date_add(F.lit(FIRST_DAY).cast("date"), (q["l"] * DAYS + q["r"]).cast("int"))))
        return F.when(index.between(0, YEARS * DAYS - 1), out).otherwise(m)

    return F.coalesce(_let(F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long"), run), m)


def _iso_date(key: str, m: Column) -> Column:
    return _date(key, F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2), m, lambda d: F.date_format(d, "yyyy-MM-dd"))


def _day_date(key: str, m: Column) -> Column:
    """Day first, or month first where only that is a date; both parts get two digits where the match has them."""
    first, second, year = F.regexp_extract(m, r"^(\d+)", 1), F.regexp_extract(m, r"^\d+[./](\d+)", 1), F.regexp_extract(m, r"(\d+)$", 1)
    a, b = F.regexp_extract(m, r"^\d+([./])", 1), F.regexp_extract(m, r"([./])\d+$", 1)

    def put(x: Column, y: Column, z: Column) -> Column:
        pad = lambda v, like: F.when(F.length(like) == 2, F.lpad(v, 2, "0")).otherwise(v)
        return F.concat(pad(x.cast("string"), first), a, pad(y.cast("string"), second), b, z.cast("string"))

    day_first = _date(key, year, second, first, m, lambda d: put(F.dayofmonth(d), F.month(d), F.year(d)))
    month_first = _date(key, year, first, second, m, lambda d: put(F.month(d), F.dayofmonth(d), F.year(d)))
    return F.when(second.cast("int") <= 12, day_first).otherwise(month_first)


def _address(key: str, m: Column) -> Column:
    def run(octets: Column) -> Column:
        valid = ~F.exists(octets, lambda o: o > 255)
        p = permute_pair(key, F.lit("address"), octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536))
        out = _let(p, lambda q: F.concat_ws(".", F.floor(q["l"] / 256).cast("string"), (q["l"] % 256).cast("string"), F.floor(q["r"] / 256).cast("string"), (q["r"] % 256).cast("string")))
        return F.when(valid, out).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), run)


def _social(key: str, m: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = permute_pair(key, F.lit("social"), index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def out(q: Column) -> Column:
        n = F.floor(q["l"] / 99) + 1
        n = n + F.when(n >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(n.cast("string"), 3, "0"), F.lpad((q["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((q["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(p, out)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    """The last ten digits (or all of fewer) are permuted; a country code stays."""

    def run(d: Column) -> Column:
        cut = F.greatest(F.length(d) - 10, F.lit(0))
        return _fill(m, F.concat(F.substr(d, F.lit(1), cut), permute_digits(key, "phone", F.substr(d, cut + 1, F.length(d)))))

    return F.when(F.length(_only_digits(m)).between(7, 15), _let(_only_digits(m), run)).otherwise(m)


def _first_valid(candidates: Column, valid, m: Column, changed) -> Column:
    """``changed`` of the first valid candidate, a beginning of the match, and the rest of the match; or the match."""
    chosen = F.try_element_at(F.filter(candidates, valid), F.lit(1))
    return _let(chosen, lambda p: F.when(p.isNull(), m).otherwise(F.concat(changed(p), F.substr(m, F.length(p) + 1, F.length(m)))))


def _card(key: str, m: Column) -> Column:
    """The longest valid number of 13 to 19 digits with which the match begins and which ends at a separator."""

    def changed(p: Column) -> Column:
        def checked(new: Column) -> Column:
            return _fill(p, F.concat(new, ((10 - _luhn_sum(new, True) % 10) % 10).cast("string")))

        def run(d: Column) -> Column:
            return _let(permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1)), checked)

        return _let(_only_digits(p), run)

    lengths = F.sequence(F.lit(19), F.lit(13), F.lit(-1))
    candidates = F.transform(lengths, lambda k: F.regexp_substr(m, F.concat(F.lit(r"^\d(?:[ -]?\d){"), (k - 1).cast("string"), F.lit(r"}(?![^ -])"))))
    return _first_valid(candidates, lambda p: p.isNotNull() & (_luhn_sum(_only_digits(p), False) % 10 == 0), m, changed)


def pseudonym(key: str, m: Column) -> Column:
    """What a match of :data:`ANY` becomes; itself where it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), _email(key, m))
        .when(whole(ACCESS_KEY), _access_key(key, m))
        .when(whole(SECRET), _secret(key, m))
        .when(whole(IBAN), _iban(key, m))
        .when(whole(ISO_DATE), _iso_date(key, m))
        .when(whole(DAY_DATE), _day_date(key, m))
        .when(whole(ADDRESS), _address(key, m))
        .when(whole(SOCIAL), _social(key, m))
        .when(whole(PHONE), _phone(key, m))
        .when(whole(CARD), _card(key, m))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all rows and columns stay.

    Equal values get equal pseudonyms wherever they stand.  Text around them
    is untouched, null stays null, empty stays empty, repeated rows are
    treated alike, columns of any name pass, and an empty table gives an empty
    result.  With ``count`` a long column of that name (replaced if there)
    says how many values were changed.
    """
    kept = [c for c in docs.columns if c != count]
    has = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    body = docs.select(F.struct(*(F.col(c) for c in kept)).alias("_row"), F.col(text).alias("_text"), F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("_found"))
    found = body.withColumn("_between", F.when(F.size("_found") > 0, F.split("_text", ANY)))
    changed = found.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(key, m))))
    joined = F.array_join(F.transform("_between", lambda part, i: F.concat(part, F.coalesce(F.try_element_at("_new", i + 1), F.lit("")))), "")
    columns = [F.when(F.col("_between").isNotNull(), joined).otherwise(F.col("_text")).alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in kept]
    if count:
        different = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda z: z["_found"] != z["_new"]))
        columns.append(F.when(F.col("_new").isNotNull(), different).otherwise(0).cast("long").alias(count))
    return changed.select(*columns)
