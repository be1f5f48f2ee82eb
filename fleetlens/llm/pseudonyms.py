"""Format-preserving pseudonyms for personal data, in built-in expressions only.

Found values are checked (card numbers by their check digit, IPv4 octets, dates by the calendar) and replaced by a keyed
permutation of all values of their format: an alternating Feistel network over Z_a x Z_b whose round function is the start
of SHA-256 of the key, the format, the round and the other half. Equal values get equal pseudonyms in all documents, and
different values of a format different ones. Cards keep their first digit and get a valid check digit; dates stay dates.
Telephone numbers are North American ones, with or without +1, numbers with any other country code and numbers of three
groups with a leading zero, of 8 to 15 digits; codes stay. Seven-digit local numbers are not told from other numbers. Dates
have the day first if they can, else the month.
Mail names and secret tokens, which are no numbers, get keyed digests in their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates of 73,000 days from here on are permuted among themselves.
EPOCH, DAYS = "1900-01-01", (292, 250)
_B, _E = r"(?<![\p{L}\p{N}.])", r"(?![\p{L}\p{N}])(?!\.\d)"
#: Between the digits of a number with a country code: a separator behind which no other value begins.
_GAP = r"(?:[ .-](?!\d{4}[-/]\d{2}[-/]|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{3}-\d{2}-\d{4}|(?:\d{1,3}\.){3}\d)|(?=[\d()])|(?<=\)))"
#: Kinds in the order of search. The pattern of a kind must match the whole value.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "phone": r"(?<![\p{L}\p{N}])(?:(?:\+?1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])|\(\d{3}\)[ .-]?|(?<![\d.][.-])\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"
             r"|\+[2-9]" + _GAP + r"(?:\(?\d\)?" + _GAP + r"){6,13}\(?\d|0\d{1,4}[ -]\d{3,4}[ -]\d{3,4})(?![\p{L}\p{N}@])(?![.-]\d)",
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "date": _B + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})" + _E,
    "card": _B + r"(?:\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{6}\1\d{4,5})|\d{6}[ -]\d{13}|\d{13,19})" + _E,
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}])(?!\.\d)",
    "token": r"(?<![\p{L}\p{N}])[0-9a-f]{40}(?![\p{L}\p{N}])",
}
_ANY = "|".join(p.replace(r"([ -])", r"(?<sep>[ -])", 1).replace(r"\1", r"\k<sep>") for p in KINDS.values())


def digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def permuted(value: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A permutation of 0 .. a*b - 1, fixed by key and kind."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        other = F.when(odd, s["l"]).otherwise(s["r"])
        add = F.conv(F.substring(digest(key, kind, a, b, i, other), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(odd, s["l"]).otherwise((s["l"] + add) % a).alias("l"), F.when(odd, (s["r"] + add) % b).otherwise(s["r"]).alias("r"))

    value = value.cast("long")
    start = F.struct(F.floor((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))
    halves = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return halves["l"] * b + halves["r"]


def _power(n: Column) -> Column:
    """10**n for n up to 18."""
    return F.element_at(F.array(*[F.lit(10**k) for k in range(19)]).cast("array<bigint>"), (n + 1).cast("int"))


def digits_permuted(digits: Column, key: str, kind: str) -> Column:
    """Digits of the same number."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    return F.lpad(permuted(digits.cast("long"), _power(n - low), _power(low), key, kind).cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the last but one on doubled and cast out by nines."""
    chars = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda s, x: s + x)


def _laid_out(layout: Column, digits: Column) -> Column:
    """The digits put one by one where ``layout`` has digits."""
    chars = F.filter(F.split(layout, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike("[0-9]"))), F.lit(1))).otherwise(c)), "")


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself if it proves to be none."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    payload = F.substring(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substring(digits, 1, 1), digits_permuted(payload, key, "card"))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    ip = permuted(number, 1 << 16, 1 << 16, key, "ip")
    parts = [F.floor(ip / (1 << 8 * k)).cast("long") % 256 for k in (3, 2, 1, 0)]
    first = F.substring(digits, 1, 1)
    code = F.when(~found.startswith("+"), F.when((F.length(digits) == 11) & (first == "1"), 1).otherwise(0)).when(first.isin("1", "7"), 1).otherwise(
        F.coalesce(F.nullif(F.length(F.regexp_extract(found, r"^\+(\d{1,3})(?!\d)", 1)), F.lit(0)), F.lit(2)))
    phone = F.concat(F.substring(digits, F.lit(1), code), digits_permuted(F.substring(digits, code + 1, F.length(digits) - code), key, "phone"))
    # a date is read and written in its own order; separators are put back
    iso, bare = found.rlike(r"^\d{4}[-/]"), F.regexp_replace(found, "[./-]", "/")
    padded = F.length(digits) == 8
    by_day = F.try_to_date(bare, "d/M/yyyy")
    date = F.when(iso, F.try_to_date(bare, "yyyy/MM/dd")).when(by_day.isNotNull(), by_day).otherwise(F.try_to_date(bare, "M/d/yyyy"))
    by_month = ~iso & by_day.isNull()
    to_day = lambda d: F.date_add(F.lit(EPOCH).cast("date"), d.cast("int"))
    day = F.datediff(date, F.lit(EPOCH).cast("date"))
    once = lambda d: permuted(d, *DAYS, key, "date")
    # dates with the month first, which only a day over 12 tells, are permuted among themselves
    again = F.aggregate(F.sequence(F.lit(1), F.lit(60)), once(day), lambda d, _: F.when(F.dayofmonth(to_day(d)) > 12, d).otherwise(once(d)))
    moved = to_day(F.when(by_month, again).otherwise(once(day)))
    written = F.when(iso, F.date_format(moved, "yyyyMMdd")).when(by_month, F.date_format(moved, "MMddyyyy")).otherwise(F.date_format(moved, "ddMMyyyy"))
    written = F.when(padded, _laid_out(found, written)).when(by_month, F.date_format(moved, "M/d/yyyy")).otherwise(F.date_format(moved, "d/M/yyyy"))
    at = F.length(found) - F.locate("@", F.reverse(found)) + 1
    is_kind = {k: found.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    return (
        F.when(is_kind["email"], F.concat(F.lit("u"), F.substring(digest(key, "email", F.lower(found)), 1, 12), F.substring(found, at, F.length(found))))
        .when(is_kind["phone"] & F.length(digits).between(8, 15), _laid_out(found, phone))
        .when(is_kind["ssn"], _laid_out(found, digits_permuted(digits, key, "ssn")))
        .when(is_kind["date"] & day.between(0, DAYS[0] * DAYS[1] - 1), written)
        .when(is_kind["card"] & (luhn_sum(digits) % 10 == 0), _laid_out(found, card))
        .when(is_kind["ip"] & F.forall(octets, lambda x: x < 256), F.concat_ws(".", *[p.cast("string") for p in parts]))
        .when(is_kind["token"], F.substring(digest(key, "token", found), 1, 40))
        .otherwise(found))


def replaced(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and, if ``count``, the number of values changed.

    A null text stays null with count 0; all else of a text stays as it is. Values that fail their check stay. Repeated
    rows stay. A column of ``docs`` with the name of ``count`` is replaced. The secret ``key`` is a part of the plan.
    """
    value = F.col(f"`{text}`")
    holds = value.rlike("[0-9@]")
    names = [c for c in docs.columns if c != count]
    found = docs.select(*[F.col(f"`{c}`") for c in names], F.when(holds, F.regexp_extract_all(value, F.lit(_ANY), F.lit(0))).alias("_found"))
    swapped = F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key)))
    found = found.withColumn("_swapped", swapped)
    joined = F.array_join(F.zip_with(F.split(value, _ANY, -1), F.concat("_swapped", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    new = F.when(F.col("_swapped").isNotNull(), joined).otherwise(value)
    changed = F.coalesce(F.size(F.filter(F.zip_with("_found", "_swapped", lambda a, b: a != b), lambda x: x)), F.lit(0))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return found.select(*columns, *([F.when(F.col("_swapped").isNull(), 0).otherwise(changed).cast("long").alias(count)] if count else []))
