"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

A value is found by its pattern, validated, and replaced by the value that a keyed permutation of its own format maps it to, so
that equal values get equal pseudonyms in every document, different values different ones, and separators stay as they are:

- card numbers (13 to 19 digits, Luhn): all digits but the first and last are permuted, the last is the new check digit;
- IBANs (mod 97): the digits after the check digits are permuted, the check digits are those of the new number;
- phone numbers (international with 8 to 15 digits, or 10 digits of the North American form): digits but the country code;
- social security numbers (areas, groups and serials that are given out): digits permuted until they are valid again;
- IPv4 addresses (octets up to 255): the 32 bits are permuted;
- e-mail addresses: letters and digits of the local part are permuted among strings of their length, in lower case; a local part
  with other letters becomes the permuted hexadecimal digits of its UTF-8;
- dates that exist (ISO, day.month.year, day/month/year; month/day/year where that alone exists): the day is permuted within its
  span of 65,536 days.

A Feistel network of ``ROUNDS`` rounds over two halves is a permutation whatever its round function; that is a hash of the key, the
format, the round and the other half. Where the format's valid values are fewer than the network's, it is applied again until
the value is valid, however often that is, which is a permutation of the valid ones.

A number beside another one may be matched with it. Of a match for cards and IBANs, the longest part between separators that is
valid is replaced, the first of equally long ones; the rest stays. Phones with country code 1 end after ten more digits, those of the
countries in ``PLAN`` after as many as it says. Of others the length isn't known: a phone ends with the unbroken run of five or more
digits after its area; only where all its groups are shorter, a group of two to four digits right after it counts as part of it.

The key is a secret that the caller gives: whoever has it can invert the pseudonyms. It is a literal of the plan, so event logs hold it.

All is SQL expressions on one row: texts are split at the matches and put together again, no row is moved.

Defined results: a null text stays null, an empty one empty; values that don't validate stay as they are; of overlapping
matches the first and longest kind listed counts; equal rows get equal results; an empty table gives no rows; other columns
pass through unread, and a column of the name given to the count of values is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import renamed

ROUNDS = 8
#: Times that a network is applied at first to reach a valid value again, which leaves fewer than one of 10^10 values to go on.
WALKS = 24
EPOCH = "1900-01-01"
#: Days that dates are permuted among.
SPAN = 1 << 16

# Country codes whose numbers all have so many digits after them.
PLAN = {"7": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "40": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "54": 10, "57": 10, "61": 9, "65": 8, "86": 11, "90": 10, "91": 10, "351": 9, "380": 9, "420": 9, "421": 9, "852": 8}
#: A phone of such a country: its digits, with a separator and parentheses before any of them.
_PLANNED = "|".join(rf"\+{code}(?:[ .-]?[()]?[ .-]?\d){{{n}}}" for code, n in PLAN.items())

_EDGE = r"(?![A-Za-z0-9@]|[.-]\d)"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?",
    "iso_date": r"\d{4}-\d{2}-\d{2}",
    "date": r"\d{1,2}([./])\d{1,2}\1\d{4}",
    "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|" + _PLANNED + r"|\+(?!1)\d{1,3}(?:[ .-]?\(\d{1,5}\)[ .-]?|[ .-]\d{1,5}[ .-])\d{5,10}|\+(?!1)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]\d{2,4}){2,4}|\+(?!1)\d{8,15}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
PATTERN = r"(?<![\p{L}\p{N}@.+%_-])(?:" + "|".join(PATTERNS.values()) + ")" + _EDGE


def _is(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def _lit(n: int) -> Column:
    return F.lit(n).cast("int")


def let(value: Column, then) -> Column:
    """``then(value)``, where ``value`` is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permuted(s: Column, alphabet: str, kind: str, key: str) -> Column:
    """A string over ``alphabet`` (at most 64 of its characters) under the keyed permutation of its kind and length."""
    radix, half = len(alphabet), F.floor(F.length(s) / 2).cast("int")

    def numbers(x: Column) -> Column:
        return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("int"))

    def moved(side: Column, other: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.size(side).cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)
        return let(h, lambda h: F.transform(side, lambda x, j: F.pmod(x + F.conv(F.substring(h, j * 2 + 1, F.lit(2)), 16, 10).cast("int"), _lit(radix))))

    def one(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        return F.when(i % 2 == 0, F.struct(moved(left, right, i).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), moved(right, left, i).alias("r")))

    start = F.struct(numbers(F.substring(s, F.lit(1), half)).alias("l"), numbers(F.substring(s, half + 1, F.length(s) - half)).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda acc: F.concat(acc["l"], acc["r"]))
    return F.array_join(F.transform(done, lambda v: F.substring(F.lit(alphabet), v + 1, F.lit(1))), "")


def walked(s: Column, step, valid) -> Column:
    """``step`` applied until the value is valid (once at least).

    The way back to a valid value is no longer than the network has values: 10^10 for ten digits. Two nested loops, which run only
    for values that aren't valid after ``WALKS`` steps, reach as far.
    """
    on = lambda x: F.when(valid(x), x).otherwise(step(x))
    far = F.sequence(F.lit(1), F.length(s.cast("string")) * 10_000)
    first = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), s, lambda x, i: F.when((i > 1) & valid(x), x).otherwise(step(x)))
    rest = lambda x: F.aggregate(far, x, lambda x, _: F.when(valid(x), x).otherwise(F.aggregate(far, x, lambda x, _: on(x))))
    return let(first, lambda x: F.when(x.isNull() | valid(x), x).otherwise(rest(x)))


def longest_valid(m: Column, separators: str, valid, new) -> Column:
    """``m`` with its longest part between separators that is valid, the first of equally long ones, replaced by ``new`` of it; null if none is."""
    cuts = F.filter(F.sequence(F.lit(0), F.length(m) + 1), lambda i: (i == 0) | (i == F.length(m) + 1) | F.substring(m, i, F.lit(1)).rlike(f"^[{separators}]$"))
    part = lambda at, n: F.substring(m, at + 1, n)
    spans = F.flatten(F.transform(cuts, lambda a: F.transform(F.filter(cuts, lambda b: b > a), lambda b: F.struct((b - a - 1).alias("n"), (-a).alias("back")))))
    best = F.array_max(F.filter(spans, lambda x: valid(part(-x["back"], x["n"]))))
    placed = lambda x: F.concat(F.substring(m, F.lit(1), -x["back"]), new(part(-x["back"], x["n"])), F.substring(m, -x["back"] + x["n"] + 1, F.length(m)))
    return let(best, lambda x: F.when(x.isNotNull(), placed(x)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def refilled(m: Column, new: Column, kind: str = "0-9") -> Column:
    """``m`` with its characters of a class replaced, in order, by those of ``new``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), f"[^{kind}]", ""))
    return let(new, lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)).rlike(f"[{kind}]"), F.substring(new, place(i), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))), ""))


def luhn(d: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits, as if a check digit 0 followed."""
    back = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    each = F.transform(back, lambda c, j: F.when(j % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, _lit(0), lambda a, x: a + x) % 10


def check_digit(d: Column) -> Column:
    return ((_lit(10) - luhn(d)) % 10).cast("string")


def _most(d: Column, drop: int = 1) -> Column:
    return F.substring(d, F.lit(1), F.length(d) - drop)


def _card(m: Column, key: str) -> Column:
    def valid(x: Column) -> Column:
        return let(digits(x), lambda d: F.length(d).between(13, 19) & (F.right(d, F.lit(1)) == check_digit(_most(d))))

    def new(x: Column) -> Column:
        body = let(digits(x), lambda d: F.concat(F.left(d, F.lit(1)), permuted(F.substring(d, F.lit(2), F.length(d) - 2), "0123456789", "card", key)))
        return let(body, lambda b: refilled(x, F.concat(b, check_digit(b))))

    return longest_valid(m, " -", valid, new)


def iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN."""
    letters = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(letters, _lit(0), lambda a, c: ((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))
    return F.lpad((_lit(98) - rest).cast("string"), 2, "0")


def _iban(m: Column, key: str) -> Column:
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    body = lambda p: F.substring(p, F.lit(5), F.length(p) - 4)

    def valid(x: Column) -> Column:
        return _is(x, "iban") & let(plain(x), lambda p: F.substring(p, 3, 2) == iban_check(F.left(p, F.lit(2)), body(p)))

    def new(x: Column) -> Column:
        def filled(p: Column) -> Column:
            fresh = refilled(body(p), permuted(digits(body(p)), "0123456789", "iban", key))
            return let(fresh, lambda f: refilled(x, F.concat(F.left(p, F.lit(2)), iban_check(F.left(p, F.lit(2)), f), f), "A-Z0-9"))

        return let(plain(x), filled)

    return longest_valid(m, " ", valid, new)


def _phone(m: Column, key: str) -> Column:
    d, plus = digits(m), m.startswith("+")
    first = F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))
    planned = F.length(F.regexp_extract(m, "^\\+(" + "|".join(sorted(PLAN, key=len, reverse=True)) + ")", 1))
    code = F.when(~plus, 0).when(m.startswith("+1"), 1).when(first > 0, first).when(planned > 0, planned).otherwise(2)
    abroad = F.concat(F.substring(d, F.lit(1), code), permuted(F.substring(d, code + 1, F.length(d) - code), "0123456789", "phone", key))
    american = lambda x: x.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    home = walked(d, lambda x: permuted(x, "0123456789", "phone", key), american)
    return F.when(plus & F.length(d).between(8, 15), refilled(m, abroad)).when(~plus & american(d), refilled(m, home))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda x: x.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    d = digits(m)
    return F.when(valid(d), refilled(m, walked(d, lambda x: permuted(x, "0123456789", "ssn", key), valid)))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    whole = F.array_join(F.transform(octets, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    new = permuted(whole, "0123456789ABCDEF", "ipv4", key)
    parts = lambda new: F.concat_ws(".", *[F.conv(F.substring(new, at, 2), 16, 10) for at in (1, 3, 5, 7)])
    return F.when(F.forall(octets, lambda x: x <= 255), let(new, parts))


def _email(m: Column, key: str) -> Column:
    local = F.lower(F.substring_index(m, "@", 1))
    plain = F.regexp_replace(local, "[^a-z0-9]", "")
    ascii = refilled(local, permuted(plain, "0123456789abcdefghijklmnopqrstuvwxyz", "email", key), "a-z0-9")
    other = F.lower(permuted(F.hex(F.encode(local, "utf-8")), "0123456789ABCDEF", "email", key))
    return F.concat(F.when(local.rlike("^[a-z0-9._%+-]+$"), ascii).otherwise(other), F.lit("@"), F.substring_index(m, "@", -1))


def _moved_day(day: Column, key: str) -> Column:
    n = F.datediff(day, F.lit(EPOCH).cast("date"))
    span, within = F.floor(n / SPAN), F.pmod(n, _lit(SPAN))
    new = F.conv(permuted(F.lpad(F.hex(within), 4, "0"), "0123456789ABCDEF", "date", key), 16, 10).cast("int")
    return F.date_add(F.lit(EPOCH).cast("date"), (span * SPAN + new).cast("int"))


def _date(m: Column, key: str) -> Column:
    """``m`` in the form that it has, by the first pattern that it is a date of."""
    mark, found = F.when(F.instr(m, "/") > 0, "/").when(F.instr(m, "-") > 0, "-").otherwise("."), F.split(m, "[./-]")
    a, b, c = (F.element_at(found, i) for i in (1, 2, 3))
    padded = (F.length(a) == 2) & (F.length(b) == 2)
    out = lambda day, one, two: F.concat(F.when(padded, F.lpad(one(day).cast("string"), 2, "0")).otherwise(one(day).cast("string")), mark, F.when(padded, F.lpad(two(day).cast("string"), 2, "0")).otherwise(two(day).cast("string")), mark, F.lpad(F.year(day).cast("string"), 4, "0"))
    known = lambda y, mo, d: F.when((y.cast("int") >= 1000) & (y.cast("int") < 9800), F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    iso, european, american = known(a, b, c), known(c, b, a), known(c, a, b)
    us = walked(american, lambda x: _moved_day(x, key), lambda x: F.day(x) > 12)
    return (
        F.when(mark == "-", F.when(iso.isNotNull(), F.date_format(_moved_day(iso, key), "yyyy-MM-dd")))
        .when(european.isNotNull(), let(_moved_day(european, key), lambda x: out(x, F.day, F.month)))
        .when((mark == "/") & american.isNotNull(), let(us, lambda x: out(x, F.month, F.day)))
    )


def pseudonym(m: Column, key: str) -> Column:
    """What a match becomes; null if it doesn't validate."""
    of = {"email": _email, "iban": _iban, "iso_date": _date, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card}
    kinds = list(of.items())
    out = F.when(_is(m, kinds[0][0]), kinds[0][1](m, key))
    for kind, f in kinds[1:]:
        out = out.when(_is(m, kind), f(m, key))
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str = "n_values") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and the number of values that were."""
    names = [c for c in docs.columns if c != found]
    plain, name = renamed(docs.select(*names))
    text = name[text]
    rows = plain.withColumn("_matches", F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0))
    rows = rows.withColumn("_new", F.transform("_matches", lambda m: pseudonym(m, key)))
    pieces = F.zip_with(F.split(F.col(text), PATTERN, -1), F.zip_with("_new", "_matches", lambda new, m: F.coalesce(new, m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    whole = F.when(F.size("_matches") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    count = F.coalesce(F.size(F.filter("_new", lambda x: x.isNotNull())), F.lit(0)).cast("long")
    out = {text: whole, "_found": F.when(F.col(text).isNull(), 0).otherwise(count).cast("long")}
    return rows.withColumns(out).select(*plain.columns, "_found").toDF(*names, found)
