"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame operations only.

Found values are validated (card numbers by Luhn, IBANs by country, length and check digits, social-security numbers by
their reserved parts, IPv4 addresses by canonical parts up to 255, dates by the calendar from 1800 to 2199), then permuted by
a keyed Feistel network within their own format: letters stay letters of their case, digits stay digits, separators
stay, card numbers and IBANs keep valid check digits, social-security numbers and dates stay valid, an e-mail address keeps
its domain, a phone number its country code. The permutation depends on the key and the kind only, so equal values get equal
pseudonyms in every document, and ``invert`` with the same key gives back what was there.

The Feistel network works on a list of symbols in some radix: even rounds add a keyed function of the right half to the
left half, symbol by symbol; odd rounds the other way round. Where only part of a set of values is a format (dates that can only
be read month first; runs of digits in which the same card number is found), the permutation is applied again until
the result is in that part, as is usual for permutations of subsets.

Defined cases: null text stays null; empty texts and texts without a found value come back unchanged; values that fail
validation are left as they are; bare numbers of ten digits are phone numbers only behind a word that says so; repeated
rows get equal results; other columns keep their values whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsched.llm.shared import unused

KEY = "crawlsched-public-test-key"
ROUNDS = 8
WALK = 64
PER_HASH = 25

# What the formats look like, and the lengths of the public IBAN registry.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?i:\b(?:token|password|passwd|secret|api_?key)[ \t]{0,4}[=:][ \t]{0,4}\"?)[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])"
CUED = r"(?i:\b(?:phone|telephone|tel|mobile|cell|call|fax)[ \t.:]{1,4})[0-9]{10}(?![0-9A-Za-z]|[.-][0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
ISO = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"
DMY = r"(?<![0-9A-Za-z/.])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9A-Za-z/]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)  # the order in which runs of digits are tried

_BY_LENGTH = {n: "|".join(c[:2] for c in IBAN_LENGTHS.split() if int(c[2:]) == n) for n in sorted({int(c[2:]) for c in IBAN_LENGTHS.split()})}
IBAN = "(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _BY_LENGTH.items()) + ")(?![0-9A-Za-z])"
FOUND = "|".join((EMAIL, SECRET, CUED, IBAN, IP, ISO, DMY, SSN, ABROAD, PHONE, CARD))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(digest: Column, at: Column, radix: Column) -> Column:
    """The at-th number below ``radix`` from a hex string of 128 digits."""
    return F.pmod(F.conv(F.substring(digest, at * 5 + 1, F.lit(5)), 16, 10).cast("int"), radix)


class Keyed:
    """The permutations under one key; ``back`` turns all of them round."""

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = key, back
        self.turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def _hash(self, *parts: Column) -> Column:
        return F.sha2(F.concat_ws(",", F.lit(self.key), *parts), 512)

    def _moved(self, x: Column, by: Column, radix: Column) -> Column:
        return F.pmod(x - by if self.back else x + by, radix)

    def feistel(self, symbols: Column, radix: int, kind: str) -> Column:
        """A list of numbers below ``radix`` (a single symbol gets a keyed shift, never by 0)."""
        half, size, base = F.floor(F.size(symbols) / 2).cast("int"), F.size(symbols), F.lit(radix)

        def turn(state: Column, r: Column) -> Column:
            left = r % 2 == 0
            other = F.when(left, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half))
            text = F.concat_ws(",", F.lit(kind), size.cast("string"), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), "."))
            # One hash for every PER_HASH symbols, each worked out once for the round.
            hashes = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / PER_HASH).cast("int")), lambda b: self._hash(text, b.cast("string")))
            return bound(hashes, lambda h: F.transform(state, lambda x, i: F.when(left == (i < half), self._moved(x, number(F.get(h, F.floor(i / PER_HASH).cast("int")), i % PER_HASH, base), base)).otherwise(x)))

        one = F.transform(symbols, lambda x: self._moved(x, 1 + number(self._hash(F.lit(kind), F.lit("1")), F.lit(0), base - 1), base))
        return F.when(size >= 2, F.aggregate(self.turns, symbols, turn)).otherwise(one)

    def pair(self, a: Column, b: Column, kind: str, radices: tuple[int, int]) -> Column:
        """A struct (a, b) of one symbol in each radix."""

        def turn(state: Column, r: Column) -> Column:
            left = r % 2 == 0
            digest = self._hash(F.lit(kind), r.cast("string"), F.when(left, state["b"]).otherwise(state["a"]).cast("string"))
            move = lambda h, name, n: self._moved(state[name], number(h, F.lit(0), F.lit(n)), F.lit(n))
            return bound(digest, lambda h: F.struct(F.when(left, move(h, "a", radices[0])).otherwise(state["a"]).cast("int").alias("a"), F.when(~left, move(h, "b", radices[1])).otherwise(state["b"]).cast("int").alias("b")))

        return F.aggregate(self.turns, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")), turn)

    def walk(self, value: Column, step: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
        """``step`` applied until the result is ``good`` again; after WALK steps in vain (no more than 0.5 ** WALK of
        the keys for the sets in use) the value as it was."""
        start = F.struct(value.alias("v"), F.lit(False).alias("done"))
        one = lambda s: bound(step(s["v"]), lambda v: F.struct(v.alias("v"), good(v).alias("done")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(s["done"], s).otherwise(one(s)), lambda s: F.when(s["done"], s["v"]).otherwise(value))

    # Kinds

    def plain(self, text: Column, kind: str, letters: int = 26) -> Column:
        """Letters (the first ``letters`` of the alphabet) and digits permuted among themselves, all else as it is."""
        first = ord("a")
        lower = bound(symbols(text, f"[^a-{chr(first + letters - 1)}]", first), lambda s: F.when(F.size(s) > 0, self.feistel(s, letters, kind + "-letters")).otherwise(s))
        digit = bound(digits(text), lambda s: F.when(F.size(s) > 0, self.feistel(s, 10, kind)).otherwise(s))
        return bound(F.struct(lower.alias("l"), digit.alias("d")), lambda s: refill(text, s["l"], s["d"]))

    def address(self, text: Column) -> Column:
        parts = F.split(text, r"\.")
        valid = F.forall(parts, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        return F.when(valid, F.array_join(F.transform(self.feistel(F.transform(parts, lambda x: x.cast("int")), 256, "ip"), lambda x: x.cast("string")), ".")).otherwise(text)

    def ssn(self, text: Column) -> Column:
        """Areas 001 to 899 without 666 (898 of them), groups 01 to 99, serials 0001 to 9999."""
        area, group, serial = (F.substring(text, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - F.when(area > 666, 2).otherwise(1)

        def shown(s: Column) -> Column:
            r = F.floor(s["a"] / 99).cast("int") + 1
            own = F.when(r > 665, r + 1).otherwise(r)
            pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
            return F.concat_ws("-", pad(own, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

        return F.when(valid, bound(self.pair(rank * 99 + group - 1, serial - 1, "ssn", (898 * 99, 9999)), shown)).otherwise(text)

    def day(self, day: Column) -> Column:
        """A date's image. 1800 to 2199 are 146097 days = 189 * 773."""
        first = F.lit("1800-01-01").cast("date")
        return bound(F.datediff(day, first), lambda n: bound(self.pair(F.floor(n / 773), F.pmod(n, F.lit(773)), "date", (189, 773)), lambda s: F.date_add(first, s["a"] * 773 + s["b"])))

    def iso(self, text: Column) -> Column:
        return bound(dated(text), lambda d: F.when(in_range(d), F.date_format(self.day(d), "yyyy-MM-dd")).otherwise(text))

    def european(self, text: Column) -> Column:
        """Day first where that is a date; else month first, whose images can't be read day first either."""
        dmy = dated(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
        mdy = dated(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)))
        sep = F.substring(text, 3, 1)
        show = lambda d, x, y: F.concat(F.date_format(d, x), sep, F.date_format(d, y), sep, F.date_format(d, "yyyy"))
        late = lambda d: F.dayofmonth(d) > 12
        both = lambda a, b: F.when(in_range(a), bound(self.day(a), lambda d: show(d, "dd", "MM"))).when(in_range(b), bound(self.walk(b, self.day, late), lambda d: show(d, "MM", "dd"))).otherwise(text)
        return bound(dmy, lambda a: bound(mdy, lambda b: both(a, b)))

    def iban(self, text: Column) -> Column:
        compact = F.replace(text, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS.split() for x in (c[:2], int(c[2:]))])

        def own(c: Column) -> Column:
            valid = (F.length(c) == lengths[F.substring(c, 1, 2)]) & (check_digits(c) == F.substring(c, 3, 2))
            body = lambda: bound(self.plain(F.substring(text, F.lit(5), F.length(text)), "iban"), lambda b: F.concat(F.substring(c, 1, 2), check_digits(F.concat(F.substring(c, 1, 4), F.replace(b, F.lit(" "), F.lit("")))), b))
            return F.when(valid, body()).otherwise(text)

        return bound(compact, own)

    def card(self, text: Column) -> Column:
        """The image of the valid number that ``best_run`` finds in a run of digits."""

        def turned(t: Column) -> Column:
            own = digits(t)
            body = lambda o: F.slice(o, 1, F.size(o) - 1)
            return bound(own, lambda o: bound(self.feistel(body(o), 10, "card"), lambda b: refill(t, F.array().cast("array<int>"), F.concat(b, F.array(F.pmod(10 - luhn_sum(b, 1) % 10, F.lit(10)))))))

        def inside(t: Column, r: Column) -> Column:
            return F.concat(F.substring(t, F.lit(1), r["start"]), bound(F.substring(t, r["start"] + 1, r["size"]), turned), F.substring(t, r["start"] + r["size"] + 1, F.length(t)))

        chosen = lambda t: bound(F.split(t, "[ -]"), lambda p: best_run(t, p))
        moved = lambda r: self.walk(text, lambda v: inside(v, r), lambda v: chosen(v) == r)
        return bound(chosen(text), lambda r: F.when(r.isNull(), text).otherwise(moved(r)))

    def value(self, m: Column) -> Column:
        """The image of one found value."""
        before = lambda pattern, kind, letters=26: bound(F.regexp_extract(m, pattern, 0), lambda a: F.concat(a, self.plain(F.substring(m, F.length(a) + 1, F.length(m)), kind, letters)))
        at = lambda a: F.concat(self.plain(a, "email"), F.substring(m, F.length(a) + 1, F.length(m)))
        many = F.length(F.regexp_replace(m, "[^0-9]", ""))
        return (
            F.when(F.instr(m, "@") > 0, bound(F.regexp_extract(m, r"^[^@]*", 0), at))
            .when(m.rlike(r"^(?i:token|password|passwd|secret|api_?key)[ \t]*[=:]"), before(r"^(?i:[a-z_]+[ \t]*[=:][ \t]*\"?)", "secret", 6))
            .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), self.iban(m))
            .when(m.rlike(r"^[A-Za-z]"), before(r"^[^0-9]*[0-9]", "phone"))
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), self.address(m))
            .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), self.iso(m))
            .when(m.rlike(r"^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$"), self.european(m))
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), self.ssn(m))
            .when(m.startswith("+"), F.when(many.between(8, 15), before(r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9]{2})", "phone")).otherwise(m))
            .when(many >= 13, self.card(m))
            .otherwise(before(r"^\(?[0-9]", "phone"))
        )


def symbols(text: Column, others: str, first: int) -> Column:
    """Numbers of the characters that ``others`` does not match, in lower case."""
    kept = F.regexp_replace(F.lower(text), others, "")
    return F.when(kept == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(kept, ""), lambda c: F.ascii(c) - first))


def digits(text: Column) -> Column:
    return symbols(text, "[^0-9]", ord("0"))


def refill(text: Column, letters: Column, numbers: Column) -> Column:
    """``text`` with its letters (case kept) and digits replaced in order; a list that is empty replaces none."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    seen = lambda i, others: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), others, "")) - 1

    def char(c: Column, i: Column) -> Column:
        letter = lambda alphabet: F.substring(alphabet, F.get(letters, seen(i, "[^A-Za-z]")) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]") & (F.size(numbers) > 0), F.get(numbers, seen(i, "[^0-9]")).cast("string")).when(c.rlike("[a-z]") & (F.size(letters) > 0), letter(lower)).when(c.rlike("[A-Z]") & (F.size(letters) > 0), letter(upper)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), char), ""))


def luhn_sum(values: Column, shift: int) -> Column:
    """Luhn sum of a list of digits; ``shift`` 1 doubles the last, 0 the one before."""
    n = F.size(values)
    return F.aggregate(F.zip_with(values, F.sequence(F.lit(1), n), lambda d, i: F.when((n - i + shift) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, x: a + x)


def best_run(text: Column, parts: Column) -> Column:
    """The run of whole ``parts`` that is a valid card number: the first of the foremost of CARD_LENGTHS. Null if none."""
    n = F.size(parts)

    def run(i: Column, j: Column) -> Column:
        start = F.length(F.array_join(F.slice(parts, F.lit(1), i), "-")) + F.when(i > 0, 1).otherwise(0)
        many = F.length(F.array_join(F.slice(parts, i + 1, j - i + 1), ""))
        return F.struct(F.array_position(F.lit(list(CARD_LENGTHS)), many).cast("int").alias("n"), start.alias("start"), F.length(F.array_join(F.slice(parts, i + 1, j - i + 1), "-")).alias("size"))

    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: run(i, j))))
    return F.array_min(F.filter(F.filter(runs, lambda r: r["n"] > 0), lambda r: luhn_sum(digits(F.substring(text, r["start"] + 1, r["size"])), 0) % 10 == 0))


def check_digits(iban: Column) -> Column:
    """The two check digits that belong to an IBAN without blanks."""
    chars = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00")), "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def dated(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def in_range(day: Column) -> Column:
    return F.coalesce(day.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))


def _rewritten(docs: DataFrame, text: str, keyed: Keyed, found: str | None) -> DataFrame:
    if found is not None and found in docs.columns:
        raise ValueError(f"there is a column {found} already")
    t = F.col(text)
    matches_, new_, parts_ = unused(docs, "matches", "new", "parts")
    matches, new, parts = F.col(matches_), F.col(new_), F.col(parts_)
    d = docs.withColumn(matches_, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(FOUND), F.lit(0))))
    some = F.size(matches) > 0
    d = d.withColumn(new_, F.when(some, F.transform(matches, keyed.value)))
    d = d.withColumn(parts_, F.when(some, F.split(t, FOUND, -1)))
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(new, i - 1), p))), "")
    changed = F.size(F.filter(F.transform(new, lambda x, i: x != F.get(matches, i)), lambda x: x))
    cols = [F.when(some, whole).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns]
    return d.select(*cols, *([F.when(some, changed).otherwise(F.lit(0)).cast("long").alias(found)] if found else []))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, found: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rewritten; ``found`` names a new column for the number of rewritten values."""
    return _rewritten(docs, text, Keyed(key), found)


def invert(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """What ``pseudonymise`` was given."""
    return _rewritten(docs, text, Keyed(key, back=True), None)
