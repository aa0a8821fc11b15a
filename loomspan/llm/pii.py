"""PII: validated numbers, dates and identifiers become format-preserving Feistel pseudonyms, in DataFrame functions only.

The digits of a value are read as one number and permuted by a keyed Feistel network on two halves, its letters
likewise, and both are set back between the marks of the value. So a pseudonym has the form of its value, equal values
stay equal in every document, and different values stay different: what is valid becomes something valid of the same
form, and what is not valid is left.

The round function is HMAC-SHA256. The key reaches the executors as the value of a scalar subquery, so neither plans
nor event logs hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

ROUNDS = 8
#: Forms that are looked for, in this order at each place. Each is bounded or possessive, so a long text takes linear time.
FORMS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,128}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[\"']?(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{8,64}(?![A-Za-z0-9])",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?\b",
    r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    r"(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\d.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|\.\d)",
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
    r"(?<![\w+])\+[1-9]\d{6,14}(?!\w)",
    r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]\d{2,5}){2,4}(?!\w)",
    r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)",
)
_ANY = "|".join(FORMS)
#: A text without any of these has none of the forms.
_HINT = r"[0-9@]|AKIA|(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:]"
_MARK = "\x01"
#: Days from 1900-01-01 to 2099-12-31.
_DAYS = 73049
#: Numbers of characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "AE": 23,
}
#: How card numbers of the large issuers begin.
ISSUERS = "^(4|5[0-8]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-9]|30|6)"


def _powers(base: int) -> Column:
    most = {10: 18, 16: 14, 26: 12}[base]
    return F.expr(f"cast(split('{','.join(str(base**i) for i in range(most + 1))}', ',') as array<bigint>)")


class Key:
    """The two padded halves of an HMAC key, as columns, and what its messages are about."""

    def __init__(self, inner: Column, outer: Column, kind: str = "", piece: Column | None = None):
        self.inner, self.outer, self.kind, self.piece = inner, outer, kind, F.lit(0) if piece is None else piece

    @staticmethod
    def pads(key: str) -> tuple[bytes, bytes]:
        raw = key.encode()
        raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        return bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)

    def of(self, kind: str) -> Key:
        return Key(self.inner, self.outer, f"{self.kind}{kind}", self.piece)

    def at(self, piece: Column) -> Key:
        return Key(self.inner, self.outer, self.kind, piece)

    def number(self, *fields: Column) -> Column:
        """56 bits of the MAC. Kinds are letters, all other fields are numbers, so that marks between them tell fields apart."""
        message = F.concat_ws("|", F.lit(self.kind), self.piece.cast("string"), *(f.cast("string") for f in fields)).cast("binary")
        inside = F.unhex(F.sha2(F.concat(self.inner, message), 256))
        return F.conv(F.substring(F.sha2(F.concat(self.outer, inside), 256), 1, 14), 16, 10).cast("bigint")


def _feistel(x: Column, base: int, key: Key) -> Column:
    """The string of digits of the base, permuted among all strings of its length; of 18 digits at most."""
    n = F.length(x)
    u = F.floor(n / 2).cast("int")
    read = (lambda s: s.cast("bigint")) if base == 10 else (lambda s: F.conv(s, base, 10).cast("bigint"))
    show = (lambda v, w: F.lpad(v.cast("string"), w, "0")) if base == 10 else (lambda v, w: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), w, "0"))
    start = F.struct(F.when(u == 0, F.lit(0).cast("bigint")).otherwise(read(F.substring(x, F.lit(1), u))).alias("l"), read(F.substring(x, u + 1, n)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        size = F.get(_powers(base), F.when(i % 2 == 0, u).otherwise(n - u))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + key.number(i, n, s["r"]), size).alias("r"))

    end = lambda s: F.concat(F.when(u == 0, F.lit("")).otherwise(show(s["l"], u)), show(s["r"], n - u))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, end)


def _walked(x: Column, step: Callable[[Column], Column], good: Callable[[Column], Column], times: int) -> Column:
    """The permutation is walked on until it comes to a good value, which permutes the good ones; times makes a miss rarer than 1e-15, and then it is null."""
    end = F.aggregate(F.sequence(F.lit(1), F.lit(times)), step(x), lambda v, _: F.when(good(v), v).otherwise(step(v)))
    return F.transform(F.array(end), lambda v: F.when(good(v), v))[0]


def permuted(x: Column, base: int, key: Key) -> Column:
    """A digit string of any length: pieces of up to 18 (10, 26: 18; 16: 24) digits, each under a key of its place."""
    most = {10: 18, 16: 24, 26: 18}[base]
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda j: _feistel(F.substring(x, j * most + 1, F.lit(most)), base, key.at(j)))
    return F.when(F.length(x) == 0, x).otherwise(F.array_join(pieces, ""))


def _fill(shape: Column, cls: str, chars: Column) -> Column:
    """shape with its characters of the class replaced, in order, by chars."""
    parts = F.split(F.regexp_replace(shape, cls, _MARK), _MARK, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substring(chars, i + 1, F.lit(1)))), "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _digits_permuted(x: Column, key: Key, kept: Column | int = 0) -> Column:
    """x with all its digits but the first kept ones permuted."""
    d = _digits(x)
    kept = F.lit(kept) if isinstance(kept, int) else kept
    return _fill(x, "[0-9]", F.concat(F.substring(d, F.lit(1), kept), permuted(F.substring(d, kept + 1, F.length(d)), 10, key)))


def _alnum_permuted(x: Column, key: Key) -> Column:
    """x with its digits permuted among digits and its letters among letters; the case of each place stays."""
    own = F.regexp_replace(x, "[^A-Za-z]", "")
    low = F.translate(F.lower(own), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop")
    new = F.translate(permuted(low, 26, key.of("letters")), "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz")
    cased = F.array_join(F.transform(F.split(own, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    return _fill(_digits_permuted(x, key.of("digits")), "[A-Za-z]", cased)


def luhn_sum(d: Column) -> Column:
    """Sum of a digit string by the rule of card numbers; a valid one is divisible by 10."""

    def add(a: Column, i: Column) -> Column:
        c = F.substring(d, i, F.lit(1)).cast("int")
        return a + F.when((F.length(d) - i) % 2 == 0, c).otherwise(F.pmod(2 * c, F.lit(10)) + F.floor(2 * c / 10).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(x: Column, key: Key) -> Column:
    """The four digits of the issuer stay, the last becomes the check digit of the new ones; null if the number is none of a card."""
    d = _digits(x)
    new = F.concat(F.substring(d, F.lit(1), F.lit(4)), permuted(F.substring(d, F.lit(5), F.length(d) - 5), 10, key))
    whole = F.transform(F.array(new), lambda c: F.concat(c, F.pmod(10 - luhn_sum(F.concat(c, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.when((F.pmod(luhn_sum(d), F.lit(10)) == 0) & d.rlike(ISSUERS), _fill(x, "[0-9]", whole))


def _remainder(x: Column) -> Column:
    """Of letters (as 10 to 35) and digits, read as one number, divided by 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(x, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))


def _iban(x: Column, key: Key) -> Column:
    """All but the country is permuted and gets its own check digits; null if country, length or check digits are wrong."""
    own = F.regexp_replace(x, " ", "")
    country, check, rest = F.substring(own, 1, 2), F.substring(own, 3, 2), F.substring(own, F.lit(5), F.length(own))
    lengths = F.create_map(*(F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv))
    good = (F.try_element_at(lengths, country) == F.length(own)) & check.between("02", "98") & (_remainder(F.concat(rest, country, check)) == 1)
    new = F.transform(F.array(_alnum_permuted(rest, key)), lambda r: F.concat(country, F.lpad((98 - _remainder(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), r))[0]
    return F.when(good, _fill(x, "[A-Z0-9]", new))


def _ssn(x: Column, key: Key) -> Column:
    """Permuted among the numbers that can be given out; null for any other."""
    good = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    d = _digits(x)
    return F.when(good(d), _fill(x, "[0-9]", _walked(d, lambda v: _feistel(v, 10, key), good, 64)))


def _local_phone(x: Column, key: Key) -> Column:
    """Ten digits without a country: area and exchange begin with 2 to 9, before and after; null for any other."""
    good = lambda d: d.rlike("^[2-9]..[2-9]")
    d = _digits(x)
    return F.when(good(d), _fill(x, "[0-9]", _walked(d, lambda v: _feistel(v, 10, key), good, 100)))


def _address(x: Column, key: Key) -> Column:
    """An address of four bytes, permuted as one number of 32 bits; null if a part is over 255."""
    parts = F.transform(F.split(x, "[.]"), lambda o: o.cast("int"))
    hexed = F.array_join(F.transform(parts, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), "")
    back = F.transform(F.array(_feistel(hexed, 16, key)), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.conv(F.substring(h, 2 * q + 1, F.lit(2)), 16, 10)), "."))[0]
    return F.when(F.forall(parts, lambda o: o <= 255), back)


def _date(x: Column, key: Key) -> Column:
    """The day, permuted among all days from 1900 to 2099 that the same form would write with as many digits; null if x is no such date.

    Of two numbers before and after a slash the first is the month, unless it is over 12. A form's texts are a set of
    their own, and days move within it: so no two texts, of whatever forms, get one pseudonym.
    """
    epoch = F.lit("1900-01-01").cast("date")
    part = lambda i: F.get(F.split(x, "[-/.]"), F.lit(i))
    iso, dots = x.rlike("^[0-9]{4}-"), F.contains(x, F.lit("."))
    swapped = ~iso & ~dots & (part(0).cast("int") > 12)  # day/month/year
    first_is_day = dots | swapped
    year, month = F.when(iso, part(0)).otherwise(part(2)), F.when(iso | first_is_day, part(1)).otherwise(part(0))
    day = F.when(iso, part(2)).when(first_is_day, part(0)).otherwise(part(1))
    number = F.date_diff(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"), epoch)

    def good(v: Column) -> Column:
        on = F.date_add(epoch, v)
        return (v >= 0) & (v < _DAYS) & ((F.length(month) == 2) | (F.month(on) < 10)) & ((F.length(day) == 2) | (F.dayofmonth(on) < 10)) & (~swapped | (F.dayofmonth(on) > 12))

    moved = _walked(number, lambda v: _feistel(F.lpad(v.cast("string"), 5, "0"), 10, key).cast("int"), good, 400)

    def written(v: Column) -> Column:
        on = F.date_add(epoch, v)
        m, d = F.lpad(F.month(on).cast("string"), F.length(month), "0"), F.lpad(F.dayofmonth(on).cast("string"), F.length(day), "0")
        return F.when(iso, F.date_format(on, "yyyy-MM-dd")).when(dots, F.concat_ws(".", d, m, F.year(on))).when(swapped, F.concat_ws("/", d, m, F.year(on))).otherwise(F.concat_ws("/", m, d, F.year(on)))

    # One form for each key: two that differ in it share no text.
    return F.when((number >= 0) & (number < _DAYS), F.transform(F.array(moved), written)[0])


def pseudonym(x: Column, key: Key) -> Column:
    """The pseudonym of a found value; the value itself where it proves to be no valid one."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    name, value = F.regexp_extract(x, r"^(.*?[=:] ?[\"']?)", 1), F.regexp_extract(x, r"([A-Za-z0-9]+)$", 1)
    out = (
        F.when(F.contains(x, F.lit("@")), F.concat(_alnum_permuted(local, key.of("email")), F.lit("@"), domain))
        .when(x.rlike("^AKIA"), F.concat(F.lit("AKIA"), _alnum_permuted(F.substring(x, F.lit(5), F.length(x)), key.of("aws"))))
        .when(x.rlike("[=:]"), F.concat(name, F.when(value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]"), permuted(value, 16, key.of("hex"))).otherwise(_alnum_permuted(value, key.of("secret")))))
        .when(x.rlike("^[A-Z]{2}"), _iban(x, key.of("iban")))
        .when(x.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), _address(x, key.of("ip")))
        .when(x.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})$"), _date(x, key.of("date")))
        .when(x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(x, key.of("ssn")))
        .when(x.rlike("^[0-9]([ -]?[0-9]){12,18}$"), _card(x, key.of("card")))
        .when(x.rlike(r"^\+"), _digits_permuted(x, key.of("phone"), F.when(x.rlike(r"^\+1"), 1).otherwise(2)))
        .otherwise(_local_phone(x, key.of("local")))
    )
    return F.coalesce(out, x)


def keyed(df: DataFrame, key: str) -> tuple[DataFrame, Key]:
    """df with the key's columns _ik and _ok, and the key that reads them."""
    pads = df.sparkSession.createDataFrame([Key.pads(key)], "i binary, o binary")
    return df.select("*", pads.select("i").scalar().alias("_ik"), pads.select("o").scalar().alias("_ok")), Key(F.col("_ik"), F.col("_ok"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", changed_col: str = "pii_changed") -> DataFrame:
    """docs with pseudonyms in the text, all columns kept, and changed_col: how many values were replaced.

    Found are emails, access keys, secrets after their name (with a digit), IBANs (country, length, check digits),
    addresses of four bytes, dates of 1900 to 2099, social security numbers, card numbers (issuer, check digit) and
    phone numbers. Bare hashes and version numbers are left. Null texts stay null with 0 changes, texts without a value
    and empty ones stay as they are, an empty table stays empty. Each text is its own row's work: no shuffle, whatever
    repeats. Values of one kind and key have one pseudonym in every document and run. A column of the name of
    changed_col, in whatever case, is replaced; other names can't clash.
    """
    names = [c for c in docs.columns if c.lower() != changed_col.lower()]
    # The row travels as one struct, so its names meet none of ours.
    rows, k = keyed(docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("_row"), F.col(quoted(text_col)).alias("_text")), key)
    t = F.col("_text")

    # Pieces at odd places are values. A text that has the mark itself is cut there first, and joined again.
    def parts(piece: Column) -> Column:
        cut = F.split(F.regexp_replace(piece, f"({_ANY})".replace(r"\1", r"\2"), f"{_MARK}$1{_MARK}"), _MARK, -1)
        return F.transform(cut, lambda v, i: F.when(i % 2 == 1, F.struct(v.alias("a"), pseudonym(v, k).alias("b"))).otherwise(F.struct(v.alias("a"), v.alias("b"))))

    pieces = F.transform(F.split(t, _MARK, -1), parts)
    both = F.transform(F.array(F.when(t.rlike(_HINT), pieces)), lambda p: F.struct(F.array_join(F.transform(p, lambda q: F.array_join(F.transform(q, lambda s: s["b"]), "")), _MARK).alias("text"), F.aggregate(F.flatten(p), F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["a"] != s["b"], 1).otherwise(0)).alias("n")))[0]
    out = rows.select("_row", "_text", both.alias("_pii"))
    kept = [(F.coalesce("_pii.text", "_text") if c.lower() == text_col.lower() else F.col("_row").getField(c)).alias(c) for c in names]
    return out.select(*kept, F.coalesce("_pii.n", F.lit(0)).cast("bigint").alias(changed_col))
