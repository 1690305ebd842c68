"""Operator 3: personal data replaced by format-preserving Feistel pseudonyms."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting that names the secret key of the pseudonyms.
KEY_CONF = "touchline.pii.key"
#: Key of the registered queries where the session names none: a public value, for
#: reproducible trial runs only.  Whoever knows the key can undo the permutations.
TRIAL_KEY = "pseudonym-key-1"
ROUNDS = 10
#: Dates from 1900-01-01 to 2099-12-31 are permuted among themselves.
FIRST_DAY, DAYS = "1900-01-01", 73_049
_LEFT, _RIGHT = 271, 270  # 271 * 270 >= DAYS; cycle-walking stays inside DAYS

_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Signs of an IBAN by country.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
_KNOWN = "|".join(names.replace(" ", "|") for names in IBAN_COUNTRIES.values())
#: What may be personal, by kind; each match is validated before it is replaced.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}[\p{L}]{2,24}",
    "iban": _EDGE + "(?:" + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}"
                                     for n, names in IBAN_COUNTRIES.items())
            + f"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)" + _END,
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
            + r"(?:(?![\p{L}\p{N}_])|(?=[Tt][0-9]{2}:?[0-9]{2}))",
    "ip": r"(?<![\p{L}\p{N}_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}_])",
    "ssn": r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[\p{L}\p{N}_])",
    "card": r"(?<![\p{L}\p{N}_-])[0-9](?:[ -]?[0-9]){12,18}(?!-?[\p{L}\p{N}_])",
    "phone": r"(?<![\p{L}\p{N}_])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}" + _END
             + r"|(?<![\p{L}\p{N}_])\+[0-9](?:[ .-]?\(?[0-9]\)?){7,14}" + _END
             + r"|(?<![\p{L}\p{N}_.-])(?<![0-9] )0[1-9]([ .-])[0-9]{2}(?:\1[0-9]{2}){3}(?![.-]?[\p{L}\p{N}_]| [0-9])",
    "secret": _EDGE + r"(?:AKIA[A-Z0-9]{16}|[A-Za-z]{2,4}_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|"
              r"(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[a-f0-9]{32,}|[A-F0-9]{32,}))" + _END,
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no match.
_QUICK = r"[0-9@]"


def _noise(key: str, *parts: Column) -> Column:
    """60 pseudo-random bits from the key and the parts (the round function)."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _power10(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def _rounds(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """The Feistel network on left < left_size, right < right_size: odd rounds add
    a hash of the right half to the left one, even rounds the other way round.
    Each round can be undone, so the whole is a permutation."""
    def step(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        noise = _noise(key, tweak, i, F.when(odd, state["r"]).otherwise(state["l"]))
        return F.struct(F.when(odd, (state["l"] + noise % left_size) % left_size).otherwise(state["l"]).alias("l"),
                        F.when(odd, state["r"]).otherwise((state["r"] + noise % right_size) % right_size).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of up to 36 digits to another of the same length, one to one."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    left = F.when(half > 0, F.substring(digits, F.lit(1), half)).otherwise("0").cast("long")
    right = F.substring(digits, half + 1, n).cast("long")
    out = _rounds(left, right, _power10(half), _power10(n - half), key, F.concat_ws(":", F.lit(kind), n.cast("string")))
    return F.transform(F.array(out), lambda s: F.concat(
        F.when(half > 0, F.lpad(s["l"].cast("string"), half, "0")).otherwise(""),
        F.lpad(s["r"].cast("string"), n - half, "0")))[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    def one(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substring(m, F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, nth, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(m, ""), one), "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn total; ``doubled_last``: the last digit given is one that doubles."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == (0 if doubled_last else 1)
        return acc + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _new_card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")

    def close(b: Column) -> Column:
        return F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string"))
    new = F.transform(F.array(body), close)[0]
    return F.transform(F.array(new), lambda x: _refill(m, x))[0]


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return (F.length(d) >= 13) & (_luhn_sum(d, False) % 10 == 0)


def _card(m: Column, key: str) -> Column:
    """The whole candidate if it is valid, else the longest valid run of its groups
    (of equal ones the first): other numbers may stand beside a card.  A candidate
    has at most 19 digits, so it holds one card."""
    at = F.sequence(F.lit(1), F.length(m))
    firsts = F.filter(at, lambda i: (i == 1) | F.substring(m, i - 1, F.lit(1)).isin(" ", "-"))
    lasts = F.filter(at, lambda i: (i == F.length(m)) | F.substring(m, i + 1, F.lit(1)).isin(" ", "-"))
    spans = F.flatten(F.transform(firsts, lambda i: F.transform(lasts, lambda j: F.struct(
        (i - j - 1).alias("order"), i.alias("first"), (j - i + 1).alias("n")))))
    spans = F.array_sort(F.filter(spans, lambda s: s["n"] >= 13))
    valid = F.filter(spans, lambda s: _valid_card(F.substring(m, s["first"], s["n"])))
    part = F.transform(F.slice(valid, 1, 1), lambda s: F.concat(
        F.substring(m, F.lit(1), s["first"] - 1), _new_card(F.substring(m, s["first"], s["n"]), key),
        F.substring(m, s["first"] + s["n"], F.length(m))))
    return F.when(_valid_card(m), _new_card(m, key)).otherwise(F.coalesce(F.get(part, F.lit(0)), m))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's number (letters as 10 to 35), a sign at a time."""
    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    d = _digits(body)
    new = F.transform(F.array(F.when(F.length(d) > 0, _refill(body, permute_digits(d, key, "iban"))).otherwise(body)), lambda b: F.concat(
        F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), _digits(b)))[0]
    valid = _mod97(F.concat(body, F.substring(plain, 1, 4))) == 1
    return F.when(valid, F.transform(F.array(new), lambda x: _refill(m, x))[0]).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = _rounds(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    new = F.transform(F.array(out), lambda s: F.concat_ws(
        ".", *[x.cast("string") for h in (s["l"], s["r"]) for x in ((h / 256).cast("int"), h % 256)]))[0]
    return F.when(F.forall(octets, lambda x: x < 256), new).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    return F.when(~m.rlike("^(000|666|9..)|-00-|-0000$"), F.transform(F.array(permute_digits(_digits(m), key, "ssn")), lambda x: _refill(m, x))[0]).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """All digits but a country code after ``+``."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]{2}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, F.transform(F.array(permute_digits(_digits(rest), key, "phone")), lambda x: _refill(rest, x))[0])


def _date(m: Column, key: str) -> Column:
    def day(fmt: str) -> Column:
        return F.to_date(F.try_to_timestamp(m, F.lit(fmt)))

    def moved(d: Column, fmt: str) -> Column:
        def walk(x: Column, _: Column) -> Column:
            out = _rounds((x / _RIGHT).cast("long"), x % _RIGHT, F.lit(_LEFT), F.lit(_RIGHT), key, F.lit("date"))
            stepped = F.transform(F.array(out), lambda s: s["l"] * _RIGHT + s["r"])[0]
            return F.when((x < DAYS) & (_ > 1), x).otherwise(stepped)
        start = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        end = F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, walk)
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), end.cast("int")), fmt)
        return F.when((start >= 0) & (start < DAYS), new)

    out = m
    for shape, formats in (("-", ["yyyy-MM-dd"]), ("/", ["dd/MM/yyyy", "MM/dd/yyyy"]), (".", ["dd.MM.yyyy"])):
        out = F.when(m.contains(shape), F.coalesce(*[moved(day(f), f) for f in formats], m)).otherwise(out)
    return out


def _letters(m: Column, key: str, kind: str) -> Column:
    """Each letter or digit by another of its kind, from a stream that the key and
    the whole value decide; other signs stay."""
    hexed = m.rlike("^(?:[a-f0-9]+|[A-F0-9]+)$")

    def one(c: Column, i: Column) -> Column:
        noise = _noise(key, F.lit(kind), i, m)
        digit = c.rlike("^[0-9]$")
        up = c.rlike("^[A-Z]$")
        size = F.when(digit, 10).when(hexed, 6).otherwise(26)
        first = F.when(digit, 48).when(up, 65).otherwise(97)
        return F.when(c.rlike(r"^[\p{L}0-9]$"), F.char(first + noise % size)).otherwise(c)
    return F.array_join(F.transform(F.split(m, ""), one), "")


def _email(m: Column, key: str) -> Column:
    """The part before @ becomes u and 15 hexadecimal signs, the host a reserved one."""
    short = F.lpad(F.conv(_noise(key, F.lit("email"), F.lower(m)).cast("string"), 10, 16), 15, "0")
    return F.concat(F.lit("u"), F.lower(short), F.lit("@example.invalid"))


def session_key(spark: SparkSession) -> str:
    """The key that the session names, else the trial key with a warning."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is not set: pseudonyms use a public trial key and can be undone")
    return key or TRIAL_KEY


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match: by its kind, if it is valid, else itself."""
    def is_a(kind: str) -> Column:
        return m.rlike("^(?:" + PATTERNS[kind] + ")$")
    return (F.when(m.contains("@"), _email(m, key))
            .when(is_a("iban"), _iban(m, key))
            .when(is_a("date"), _date(m, key))
            .when(is_a("ip"), _ip(m, key))
            .when(is_a("ssn"), _ssn(m, key))
            .when(is_a("card"), _card(m, key))
            .when(is_a("phone"), _phone(m, key))
            .when(is_a("secret"), _letters(m, key, "secret")).otherwise(m))


def pseudonymise(docs: DataFrame, text: str = "text", *, key: str, found: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; other columns unchanged.

    E-mail addresses, IBANs (mod 97), dates, IPv4 addresses, US social security
    numbers, payment cards (Luhn), telephone numbers and keys or tokens.  Numbers
    and dates are permuted by a keyed Feistel network inside their own format: the
    same value gives the same pseudonym in every document, different values give
    different ones, separators and length stay, and checksums still hold.  Numbers
    that fail validation are left.  ``key`` is a secret that the caller keeps; an
    empty one is an error.  ``found``: name of an array column to add
    with the values that were replaced (a column of that name is overwritten).

    Null text stays null, empty stays empty; rows are never added or dropped.  Row
    by row in the executors' JVM: no shuffle, any skew is harmless.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    column = F.col(text)
    parts = F.split(column, _ANY, -1)
    matches = F.regexp_extract_all(column, F.lit(_ANY), F.lit(0))
    new = F.transform(matches, lambda m: pseudonym(m, key))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), new.alias("m")), lambda z: F.array(
        z["p"], F.coalesce(z["m"], F.lit(""))))), "")
    hit = column.rlike(_QUICK) & column.rlike(_ANY)
    added = {text: F.when(hit, joined).otherwise(column)}
    if found:
        pairs = F.filter(F.arrays_zip(matches.alias("p"), new.alias("m")), lambda z: z["p"] != z["m"])
        values = F.when(hit, F.transform(pairs, lambda z: z["p"]))
        added[found] = F.coalesce(values, F.array().cast("array<string>"))
    return docs.withColumns(added)
