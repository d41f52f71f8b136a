r"""Pseudonyms for personal data by format-preserving Feistel permutations, with native operators only.

One pattern finds candidates; each is validated by its kind (Luhn, mod 97, octets, calendar, ranges) and, if valid,
replaced by its image under a keyed permutation of its own domain, written in the same format. A permutation maps
equal values to equal pseudonyms in every document, distinct ones to distinct ones, and whoever holds the key can undo it:

* card numbers: the digits before the check digit, which is then made anew, so the image passes Luhn too
* IBANs: every place of the account part in its own alphabet, 0-9 or A-Z, with new check digits
* phone numbers: the digits after the country code; separators stay
* social security numbers (ddd-dd-dddd): within the valid areas, groups and serials
* IPv4 addresses: within all 2**32; calendar dates: within 1900-01-01 .. 2099-12-31

Mail addresses keep their domain; their local part, whose domain has no fixed size, becomes a keyed hash, as do
credentials, which keep length and prefix. A balanced or unbalanced Feistel network runs on two halves (on a mixed-radix
pair, or on halves of characters), its round function is SHA-256 of key, kind, round and the other half, so it is fixed
everywhere.

Defined results: null texts stay null and count no hits, empty ones stay empty; texts in which nothing matches pass
through untouched; numbers that fail validation stay, and so does the rare value that the permutation maps to itself,
which is not counted. Texts are searched whole, however long, in time linear in their length: every pattern starts only
at a border of its own characters and is bounded or possessive from there. Mail domains have at most 127 labels of at
most 63 characters; what is longer is no address. Where patterns tie, the leftmost match counts and then the first
kind. Repeated rows are treated alike; no rows give no rows; columns beside doc_id and text, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exprs import let

ROUNDS = 10

_LABEL = r"[A-Za-z0-9][A-Za-z0-9\-]{0,62}+(?<!-)\."
#: A run of the characters of a local part is entered at its beginning only, and taken whole.
_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:" + _LABEL + r"){1,126}[A-Za-z]{2,63}"
_SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{16,}|[0-9A-Fa-f]{32,})(?![0-9A-Za-z])"
_CREDENTIAL = r'(?<![0-9A-Za-z])(?i:password|passwd|pwd|secret|api[_-]?key|token) ?[=:] ?"?[0-9A-Za-z_\-]{8,}'
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
_CARD = r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?!\d)"
_PHONE = r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ \-]\d{4}(?!\d)|(?<![\d.\-])\d{3}([.\-])\d{3}\2\d{4}(?!\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_IP = r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_DATE = r"(?<![\d/.\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/\-])"
#: All kinds; the leftmost match counts and, from one place, the first kind.
PATTERN = "|".join((_MAIL, _CREDENTIAL, _SECRET, _IBAN, _CARD, _PHONE, _SSN, _IP, _DATE))
#: Found in every text that PATTERN matches in, and quick: a digit or sign, or how a secret of letters alone begins.
_GATE = "[0-9@=:]|AKIA|gh[pousr]_|sk-|[A-Fa-f]{32}"

_LONG = "bigint"


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _keyed(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def feistel_pair(key: str, kind: Column | str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of pairs in [0, a) x [0, b), as struct<l, r>: the halves take turns adding a hash of the other."""

    def word(i: Column, other: Column) -> Column:
        return F.conv(F.substring(_keyed(key, kind, a, b, i, other), 1, 15), 16, 10).cast(_LONG)

    def turn(acc: Column, i: Column) -> Column:
        one = F.struct(F.pmod(acc["l"] + F.pmod(word(i, acc["r"]), a), a).alias("l"), acc["r"].alias("r"))
        two = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(word(i, acc["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, one).otherwise(two)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast(_LONG).alias("l"), right.cast(_LONG).alias("r")), turn)


def feistel_number(key: str, kind: str, x: Column, a: int, b: int) -> Column:
    """A keyed permutation of [0, a * b)."""
    out = feistel_pair(key, kind, F.floor(x / F.lit(b)).cast(_LONG), F.pmod(x, F.lit(b)), F.lit(a).cast(_LONG), F.lit(b).cast(_LONG))
    return let(out, lambda p: p["l"] * b + p["r"])


def feistel_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of digit strings of each length (up to 36 digits)."""
    n = F.char_length(digits)
    m = F.ceil(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast(_LONG)
    right = F.when(n > m, F.substr(digits, m + 1, n - m)).otherwise(F.lit("0"))
    out = feistel_pair(key, F.concat(F.lit(kind), n.cast("string")), F.substr(digits, F.lit(1), m).cast(_LONG), right.cast(_LONG), ten(m), ten(n - m))
    return let(out, lambda p: F.concat(F.lpad(p["l"].cast("string"), m, "0"), F.when(n > m, F.lpad(p["r"].cast("string"), n - m, "0")).otherwise("")))


def feistel_places(key: str, kind: str, text: Column) -> Column:
    """A keyed permutation of strings of 0-9 and A-Z (up to 32 of them) among those with digits and letters in the same places.

    The halves take turns: each of its places moves on, in its own alphabet, by 16 bits of a hash of the other half.
    """
    n = F.char_length(text)
    m = F.ceil(n / 2).cast("int")
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Z]", "A")

    def moved(half: Column, i: Column, other: Column) -> Column:
        def place(word: Column) -> Column:
            def one(ch: Column, k: Column) -> Column:
                by, v = F.conv(F.substr(word, 4 * k + 1, F.lit(4)), 16, 10).cast("int"), F.ascii(ch)
                return F.char(F.when(v >= 65, 65 + (v - 65 + by) % 26).otherwise(48 + (v - 48 + by) % 10))

            return F.array_join(F.transform(F.filter(F.split(half, ""), lambda ch: ch != ""), one), "")

        return let(_keyed(key, kind, shape, i, other), place)

    def turn(acc: Column, i: Column) -> Column:
        one = F.struct(moved(acc["l"], i, acc["r"]).alias("l"), acc["r"].alias("r"))
        two = F.struct(acc["l"].alias("l"), moved(acc["r"], i, acc["l"]).alias("r"))
        return F.when(i % 2 == 0, one).otherwise(two)

    zero = F.struct(F.substr(text, F.lit(1), m).alias("l"), F.substr(text, m + 1, n - m).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, turn, lambda p: F.concat(p["l"], p["r"]))


def refill(shape: Column, chars: Column, slot: str = "^[0-9]$") -> Column:
    """``shape`` with its digits, or what else ``slot`` matches, replaced, in order, by ``chars``."""
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, ch: Column) -> Column:
        open_ = ch.rlike(slot)
        return F.struct(F.concat(acc["s"], F.when(open_, F.substr(chars, acc["i"], F.lit(1))).otherwise(ch)).alias("s"), (acc["i"] + F.when(open_, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(shape, ""), zero, step, lambda acc: acc["s"])


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Luhn's sum, from the right; the check digit itself is not doubled."""
    odd = 0 if first_doubled else 1

    def value(ch: Column, i: Column) -> Column:
        v = F.coalesce(F.expr("1") * ch.try_cast("int"), F.lit(0))
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == odd, twice).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda acc, v: acc + v)


def _mod97(text: Column) -> Column:
    """Of letters (A = 10 ...) and digits."""

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(ch == "", acc).when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(key: str, x: Column) -> Column:
    def valid(d: Column) -> Column:
        image = feistel_digits(key, "card", F.substr(d, F.lit(1), F.char_length(d) - 1))
        made = let(image, lambda p: F.concat(p, F.pmod(-luhn_sum(p, True), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, False) % 10 == 0, let(made, lambda m: refill(x, m)))

    return let(_only_digits(x), valid)


def _iban(key: str, x: Column) -> Column:
    def valid(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.char_length(s) - 4)
        ok = _mod97(F.concat(account, F.substring(s, 1, 4))) == 1

        def image(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(x, F.concat(country, check, new), "^[0-9A-Z]$")

        return F.when(ok, let(feistel_places(key, "iban", account), image))

    return let(F.replace(x, F.lit(" "), F.lit("")), valid)


def _phone(key: str, x: Column) -> Column:
    code = F.regexp_extract(x, r"^\+\d{1,3}(?=[ .\-(])|^", 0)
    return let(code, lambda c: F.concat(c, let(F.substr(x, F.char_length(c) + 1, F.char_length(x)), lambda rest: refill(rest, feistel_digits(key, "phone", _only_digits(rest))))))


def _ssn(key: str, x: Column) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas

    def image(p: Column) -> Column:
        new = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    pair = feistel_pair(key, "ssn", rank, (group - 1) * 9999 + serial - 1, F.lit(898).cast(_LONG), F.lit(99 * 9999).cast(_LONG))
    return F.when(ok, let(pair, image))


def _ip(key: str, x: Column) -> Column:
    def valid(p: Column) -> Column:
        octets = [p.getItem(k).cast(_LONG) for k in range(4)]
        ok = (octets[0] < 256) & (octets[1] < 256) & (octets[2] < 256) & (octets[3] < 256)
        pair = feistel_pair(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast(_LONG), F.lit(65536).cast(_LONG))
        return F.when(ok, let(pair, lambda q: F.concat_ws(".", *(v.cast(_LONG).cast("string") for v in (F.floor(q["l"] / 256), q["l"] % 256, F.floor(q["r"] / 256), q["r"] % 256)))))

    return let(F.split(x, r"\."), valid)


def _date(key: str, x: Column) -> Column:
    """Days from 1900-01-01, 73,049 of them: 17 * 4297. Month-first is tried before day-first; unpadded parts stay so."""

    def moved(p: Column, kind: str) -> Column:
        if kind == "iso":
            day = F.try_to_date(x, "yyyy-MM-dd")
        else:
            first, second = (F.lpad(p.getItem(k), 2, "0") for k in (0, 1))
            text = lambda m, d: F.concat_ws("-", p.getItem(2), m, d)
            mdy, dmy = F.try_to_date(text(first, second), "yyyy-MM-dd"), F.try_to_date(text(second, first), "yyyy-MM-dd")
            day = F.coalesce(mdy, dmy) if kind == "slash" else dmy

        def written(new: Column) -> Column:
            if kind == "iso":
                return F.date_format(new, "yyyy-MM-dd")
            month, dom = F.month(new).cast("string"), F.dayofmonth(new).cast("string")
            month_first = mdy.isNotNull() if kind == "slash" else F.lit(False)
            parts = [F.when(month_first, month).otherwise(dom), F.when(month_first, dom).otherwise(month)]
            padded = [F.when(F.char_length(p.getItem(k)) == 2, F.lpad(v, 2, "0")).otherwise(v) for k, v in enumerate(parts)]
            return F.concat_ws("/" if kind == "slash" else ".", *padded, F.date_format(new, "yyyy"))

        since = F.datediff(day, F.lit("1900-01-01").cast("date"))
        ok = day.isNotNull() & (since >= 0) & (since < 17 * 4297)
        return F.when(ok, let(F.date_add(F.lit("1900-01-01").cast("date"), feistel_number(key, "date", since, 17, 4297).cast("int")), written))

    by_sep = lambda p: F.when(x.contains("-"), moved(p, "iso")).when(x.contains("/"), moved(p, "slash")).otherwise(moved(p, "dot"))
    return let(F.split(x, r"[/.\-]"), by_sep)


def _mail(key: str, x: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(_keyed(key, "mail", F.lower(x)), 1, 16), F.lit("@"), F.substring_index(x, "@", -1))


def _secret(key: str, x: Column) -> Column:
    head = F.regexp_extract(x, "^(?:AKIA|gh[pousr]_|sk-)|^", 0)
    want = F.char_length(x) - F.char_length(head)
    tape = F.repeat(_keyed(key, "secret", F.lower(x)), F.ceil(want / 64).cast("int"))
    body = F.substr(tape, F.lit(1), want)
    return F.concat(head, F.when(x == F.upper(x), F.upper(body)).otherwise(body))


def _credential(key: str, x: Column) -> Column:
    """Name and sign stay; the value is treated as any secret."""
    value = F.regexp_extract(x, r'[=:] ?"?([0-9A-Za-z_\-]+)$', 1)
    return let(value, lambda v: F.concat(F.substr(x, F.lit(1), F.char_length(x) - F.char_length(v)), _secret(key, v)))


KINDS = ("mail", "credential", "secret", "iban", "card", "phone", "ssn", "ip", "date")
_RULES = {"mail": (_MAIL, _mail), "credential": (_CREDENTIAL, _credential), "secret": (_SECRET, _secret), "iban": (_IBAN, _iban), "card": (_CARD, _card), "phone": (_PHONE.replace(r"\2", r"\1"), _phone), "ssn": (_SSN, _ssn), "ip": (_IP, _ip), "date": (_DATE, _date)}


def pseudonym(match: Column, key: str) -> Column:
    """The image of one candidate; null where no kind accepts it."""
    images = [F.when(match.rlike(_whole(pattern)), make(key, match)) for pattern, make in (_RULES[k] for k in KINDS)]
    return F.coalesce(*images)


def hide(text: Column, key: str) -> Column:
    """struct<text string, found int>: the text with every valid value replaced, and how many there were."""
    between, hits = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    images = let(hits, lambda h: F.struct(h.alias("was"), F.transform(h, lambda x: pseudonym(x, key)).alias("now")))

    def woven(v: Column) -> Column:
        shown = F.zip_with(v["was"], v["now"], lambda a, b: F.coalesce(b, a))
        whole = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        changed = F.zip_with(v["was"], v["now"], lambda a, b: F.coalesce(a != b, F.lit(False)))
        return F.struct(whole.alias("text"), F.size(F.filter(changed, lambda x: x)).alias("found"))

    plain = F.struct(text.alias("text"), F.lit(0).alias("found"))
    return F.when(text.rlike(_GATE), let(images, woven)).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text and n_found (values replaced) for every row."""
    out = docs.select("doc_id", hide(F.col("text"), key).alias("__tm_h"))
    return out.select("doc_id", F.col("__tm_h.text").alias("text"), F.col("__tm_h.found").cast("long").alias("n_found"))
