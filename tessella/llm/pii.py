"""Format-preserving pseudonyms for personal numbers and dates, by a keyed Feistel permutation. Only DataFrame functions run.

A value is validated (check digits, octets, calendar), taken apart into a vector of small numbers, each with its radix, and
permuted: in each round one half of the vector is shifted, number by number and modulo its radix, by a keyed hash of the
other half. The result goes back into the same format, with new check digits, so a valid value becomes a valid value of the
same kind, and equal values become equal ones in every document, however they are punctuated. What is not valid stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import without

ROUNDS = 8
#: Days of 1600-01-01 to 2399-12-31, as a product of two radices.
DATE_RADICES = (378, 773)
DATE_START = "1600-01-01"

#: Candidates of each kind (Java regular expressions); a match is then validated.
CANDIDATES = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w.])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])|\(\d{3}\) ?)\d{3}|[2-9]\d{2}[ .-][2-9]\d{2})[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(CANDIDATES.values())


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each worked out once: an expression that a lambda uses twice, or for each element, would run each time."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(bound), lambda s: f(*[s[f"v{i}"] for i in range(len(values))])), 1)


def feistel(values: Column, radices: Column, key: str, tweak: str) -> Column:
    """Permute vectors of numbers, each below its radix. A bijection for every key, tweak and radices."""

    def rounds(start: Column, radix: Column, half: Column) -> Column:
        def one(v: Column, r: Column) -> Column:
            first = r % 2 == 0
            other = F.when(first, F.slice(v, half + 1, F.size(v) - half)).otherwise(F.slice(v, F.lit(1), half))
            seed = F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

            def shifted(s: Column) -> Column:
                draw = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", s, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
                return F.transform(v, lambda x, i: F.when((i < half) == first, ((x + draw(i)) % F.element_at(radix, i + 1)).cast("int")).otherwise(x))

            return let(shifted, seed)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)

    return let(lambda v, r: let(lambda h: rounds(v, r, h), (F.size(v) / 2).cast("int")), values, radices)


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return let(lambda d: F.transform(_chars(d), lambda c: c.cast("int")), F.regexp_replace(s, "[^0-9]", ""))


def _tens(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(10))


def _refill(form: Column, new: Column, kind: str = "[0-9]") -> Column:
    """Put the strings of `new`, in order, where the characters of `form` are of this kind; the last ones if there are fewer."""

    def fill(n: Column, skip: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), (1 - skip).alias("k"))

        def step(s: Column, c: Column) -> Column:
            hit = c.rlike(kind)
            put = F.when(hit & (s["k"] > 0), F.element_at(n, F.greatest(s["k"], F.lit(1)))).otherwise(c)
            return F.struct(F.concat(s["out"], put).alias("out"), (s["k"] + hit.cast("int")).alias("k"))

        return F.aggregate(_chars(form), start, step)["out"]

    return let(lambda n: let(lambda skip: fill(n, skip), F.length(F.regexp_replace(form, f"(?!{kind}).", "")) - F.size(n)), new)


def _strings(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("string"))


def _luhn(d: Column) -> Column:
    """Sum of a number's digits by the doubling rule, the last one counted once."""
    n = F.size(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, F.element_at(d, i) * 2 - F.when(F.element_at(d, i) > 4, 9).otherwise(0)).otherwise(F.element_at(d, i)))


def card(m: Column, key: str) -> Column:
    """Payment card numbers of 13 to 19 digits with a good check digit: the first digit stays, the check digit is made anew."""

    def made(d: Column) -> Column:
        n = F.size(d)
        new = F.concat(F.slice(d, 1, 1), feistel(F.slice(d, F.lit(2), n - 2), _tens(n - 2), key, "card"))
        check = lambda p: F.concat(p, F.array((10 - _luhn(F.concat(p, F.array(F.lit(0)))) % 10) % 10))
        return F.when((_luhn(d) % 10 == 0) & (F.element_at(d, 1) > 0), _refill(m, _strings(let(check, new))))

    return let(made, _digits(m))


def phone(m: Column, key: str) -> Column:
    """Ten-digit numbers. A country prefix stays. Without a prefix or brackets area and exchange start with 2 to 9; with either,
    which mark a telephone number, they may start with 0 or 1 too, and then so do the pseudonym's."""

    def made(d: Column) -> Column:
        v = F.slice(d, F.size(d) - 9, F.lit(10))
        low = F.transform(v, lambda x, i: F.when(i.isin(0, 3) & (x > 1), 2).otherwise(0))
        radices = F.transform(v, lambda x, i: F.when(i.isin(0, 3), F.when(x > 1, 8).otherwise(2)).otherwise(10))
        return F.when(F.size(d).between(10, 11), let(lambda w, b, r: _refill(m, _strings(F.zip_with(feistel(F.zip_with(w, b, lambda x, y: x - y), r, key, "phone"), b, lambda x, y: x + y))), v, low, radices))

    return let(made, _digits(m))


def ip(m: Column, key: str) -> Column:
    """Addresses of four octets."""
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    return let(lambda v: F.when(F.forall(v, lambda x: x < 256), F.array_join(_strings(feistel(v, F.array(*[F.lit(256)] * 4), key, "ip")), ".")), octets)


def ssn(m: Column, key: str) -> Column:
    """Social security numbers: area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def text(x: Column) -> Column:
        area, group, serial = (F.element_at(x, i) for i in (1, 2, 3))
        return F.concat_ws("-", F.lpad((area + F.when(area >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((group + 1).cast("string"), 2, "0"), F.lpad((serial + 1).cast("string"), 4, "0"))

    def made(v: Column) -> Column:
        area, group, serial = (F.element_at(v, i) for i in (1, 2, 3))
        good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(good, let(text, feistel(F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")))

    return let(made, F.transform(F.split(m, "-"), lambda x: x.cast("int")))


def date(m: Column, key: str) -> Column:
    """Calendar dates of the years 1600 to 2399: year-month-day, day.month.year or month/day/year."""
    form = F.when(m.contains("-"), "y-M-d").when(m.contains("."), "d.M.y").otherwise("M/d/y")
    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    start, (a, b) = F.lit(DATE_START).cast("date"), DATE_RADICES

    def text(s: Column) -> Column:
        return F.when(form == "y-M-d", s).when(form == "d.M.y", F.concat_ws(".", F.substring(s, 9, 2), F.substring(s, 6, 2), F.substring(s, 1, 4))).otherwise(F.concat_ws("/", F.substring(s, 6, 2), F.substring(s, 9, 2), F.substring(s, 1, 4)))

    def made(day: Column) -> Column:
        new = feistel(F.array((day / b).cast("int"), (day % b).cast("int")), F.array(F.lit(a), F.lit(b)), key, "date")
        return F.when(day.between(0, a * b - 1), let(text, let(lambda v: F.date_add(start, F.element_at(v, 1) * b + F.element_at(v, 2)).cast("string"), new)))

    return let(made, F.datediff(iso.try_cast("date"), start))


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def iban(m: Column, key: str) -> Column:
    """Account numbers with good check digits: country and letters stay, digits are permuted, check digits are made anew."""

    def made(s: Column, country: Column, body: Column, d: Column) -> Column:
        new = _refill(body, _strings(feistel(d, _tens(F.size(d)), key, "iban")))
        whole = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        good = F.length(s).between(15, 34) & (F.size(d) > 1) & (_mod97(F.concat(body, F.substring(s, 1, 4))) == 1)
        return F.when(good, let(lambda w: _refill(m, _chars(w), "[A-Z0-9]"), let(whole, new)))

    s = F.regexp_replace(m, " ", "")
    body = F.substring(s, F.lit(5), F.length(s))
    return let(made, s, F.substring(s, 1, 2), body, _digits(body))


def email(m: Column, key: str) -> Column:
    """Addresses: letters and digits before the at sign are permuted in their classes and lower case; the rest stays."""

    def made(local: Column, chars: Column, first: Column) -> Column:
        new = feistel(F.zip_with(chars, first, lambda c, b: F.ascii(c) - b), F.transform(first, lambda b: F.when(b == 48, 10).otherwise(26)), key, "email")
        filled = _refill(local, F.zip_with(new, first, lambda x, b: F.chr(x + b)), "[a-z0-9]")
        return F.when(F.size(chars) > 0, F.concat(filled, F.lit("@"), F.substring_index(m, "@", -1)))

    def parts(local: Column) -> Column:
        chars = F.filter(_chars(local), lambda c: c.rlike("[a-z0-9]"))
        return let(lambda c: let(made, local, c, F.transform(c, lambda x: F.when(x.rlike("[0-9]"), 48).otherwise(97))), chars)

    return let(parts, F.lower(F.substring_index(m, "@", 1)))


KINDS = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def _pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, as (kind, value); kind is null and the value unchanged if it is not valid."""
    kind = None
    for name, rule in KINDS.items():
        # A rule gives null for what is not valid, and is only worked out for strings of its own form.
        looks = m.rlike(f"^(?:{CANDIDATES[name]})$")
        this = F.when(looks, let(lambda v, name=name: F.when(v.isNotNull(), F.struct(F.lit(name).alias("kind"), v.alias("value"))), rule(m, key)))
        kind = this if kind is None else F.coalesce(kind, this)
    return F.coalesce(kind, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def pseudonymise(df: DataFrame, key: str, text: str = "text", out: str = "private_text", count: str = "n_private") -> DataFrame:
    """Add the text with every valid value replaced by its pseudonym, and the number of replaced values (long).

    Null texts stay null with none replaced; empty texts stay empty, texts of any length are read whole, and equal rows are
    treated alike. Columns with the new names are replaced, all others stay, whatever their names. An empty table gives an
    empty result. The key is the caller's secret and has no default.
    """
    if not key:
        raise ValueError("a key is needed")
    df = without(df, out, count)
    t = F.col(f"`{text}`")
    # A text without a digit or an at sign has nothing to find.
    able = t.rlike("[0-9@]")
    found = F.transform(F.when(able, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))), lambda m: _pseudonym(m, key))
    staged = df.select(F.struct("*").alias("row"), t.alias("t"), found.alias("found"), F.when(able, F.split(t, ANY, -1)).alias("gaps"))
    glued = F.array_join(F.flatten(F.zip_with("gaps", "found", lambda g, m: F.array(g, F.coalesce(m["value"], F.lit(""))))), "")
    n = F.coalesce(F.size(F.filter("found", lambda m: m["kind"].isNotNull())), F.lit(0)).cast("long")
    hit = F.size("found") > 0
    return staged.select("row.*", F.when(hit, glued).otherwise(F.col("t")).alias(out), F.when(hit, n).otherwise(F.lit(0).cast("long")).alias(count))
