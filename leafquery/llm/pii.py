"""PII: values are replaced by format-preserving Feistel pseudonyms. DataFrame functions only.

A value is found by its form, validated (Luhn digit, octets, calendar, area numbers) and permuted with a key
among the values of its form. The permutation is one to one, so equal values stay equal in all documents,
different ones stay different, and nothing has to be looked up or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafquery.llm.rules import bind

ROUNDS = 8
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, YEARS_A, YEARS_B = "1900-01-01", 184, 397  # 184 x 397 days, to 2099-12-30
#: Forms, tried in this order at each place.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9/.])[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{13,19})(?![0-9A-Za-z]|-[0-9])",
}
ANY = "|".join(FORMS.values())


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def feistel(x: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1: two digits of radix a and b take turns in masking each other."""
    def mask(turn: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), other.cast("string")), 256)
        return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("bigint")

    def round_(s: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        return F.struct(F.when(odd, F.pmod(s["l"] + F.pmod(mask(turn, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(mask(turn, s["l"]), b), b)).alias("r"))

    start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: s["l"] * b + s["r"])


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n.cast("double")).cast("bigint")


def permute_symbols(text: Column, alphabet: str, tweak: str, key: str) -> Column:
    """A string over ``alphabet`` as another of its length; long ones in chunks of what fits 64 bits."""
    base = len(alphabet)
    chunk = {10: 18, 16: 14, 26: 12}[base]

    def one(part: Column, number: Column) -> Column:
        def of(p: Column) -> Column:
            n = F.length(p)
            value = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"),
                                lambda acc, i: acc * base + F.instr(F.lit(alphabet), F.substr(p, i, F.lit(1))) - 1)
            low = _div(n.cast("bigint"), 2)
            new = feistel(value, _power(base, n - low), _power(base, low),
                          F.concat_ws("/", F.lit(tweak), n.cast("string"), number.cast("string")), key)
            return bind(new, lambda v: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(
                F.lit(alphabet), (_div(v, _power(base, n - i)) % base + 1).cast("int"), F.lit(1))), ""))
        return bind(part, of)

    parts = F.transform(F.sequence(F.lit(0), _div((F.length(text) - 1).cast("bigint"), chunk).cast("int")),
                        lambda k: one(F.substr(text, k * chunk + 1, F.lit(chunk)), k))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(parts, ""))


def refill(form: Column, pattern: str, symbols: Column) -> Column:
    """``form`` with the characters that match ``pattern`` replaced by ``symbols``, in order."""
    def of(pair: Column) -> Column:
        gaps = F.split(pair["f"], pattern, -1)
        return F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.substr(pair["s"], i + 1, F.lit(1)))), "")
    return bind(F.struct(form.alias("f"), symbols.alias("s")), of)


def _only(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"[^{pattern}]", "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` plus it valid."""
    def weight(i: Column) -> Column:
        d = F.substr(body, F.length(body) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), lambda acc, i: acc + weight(i))
    return F.pmod(-total, F.lit(10)).cast("string")


def _digits(value: Column, tweak: str, key: str) -> Column:
    return refill(value, "[0-9]", permute_symbols(_only(value, "0-9"), DIGITS, tweak, key))


def _card(value: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = bind(permute_symbols(body, DIGITS, "card", key), lambda b: F.concat(b, luhn_digit(b)))
        return F.when(luhn_digit(body) == F.substr(d, F.length(d), F.lit(1)), refill(value, "[0-9]", new))
    return bind(_only(value, "0-9"), of)


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("bigint"))

    def of(o: Column) -> Column:
        number = F.aggregate(o, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
        side = F.lit(65536).cast("bigint")
        new = bind(feistel(number, side, side, F.lit("ip"), key), lambda v: F.array_join(F.transform(
            F.array(*[F.lit(256 ** k).cast("bigint") for k in (3, 2, 1, 0)]), lambda p: (_div(v, p) % 256).cast("string")), "."))
        return F.when(F.forall(o, lambda x: x < 256), new)
    return bind(octets, of)


def _date(value: Column, pattern: str, key: str) -> Column:
    def of(day: Column) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        a, b = F.lit(YEARS_A).cast("bigint"), F.lit(YEARS_B).cast("bigint")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(number, a, b, F.lit("date"), key).cast("int"))
        return F.when(day.isNotNull() & (number >= 0) & (number < YEARS_A * YEARS_B), F.date_format(new, pattern))
    # through year, month and day, as a calendar check that returns null
    order = "3-2-1" if pattern.startswith("dd") else "1-2-3"
    parts = F.split(value, "[-/.]")
    text = F.concat_ws("-", *[F.get(parts, F.lit(int(k) - 1)) for k in order.split("-")])
    return bind(F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else text.try_cast("date"), of)


def _ssn(value: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(k)) for k in range(3))
        place = area - 1 - (area > 666).cast("bigint")
        number = (place * 99 + group - 1) * 9999 + serial - 1

        def back(v: Column) -> Column:
            at = _div(v, 9999 * 99)
            return F.concat(F.lpad((at + 1 + (at >= 665).cast("bigint")).cast("string"), 3, "0"), F.lit("-"),
                            F.lpad((_div(v, 9999) % 99 + 1).cast("string"), 2, "0"), F.lit("-"),
                            F.lpad((v % 9999 + 1).cast("string"), 4, "0"))
        new = bind(feistel(number, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), F.lit("ssn"), key), back)
        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new)
    return bind(F.transform(F.split(value, "-"), lambda x: x.cast("bigint")), of)


def _email(value: Column, key: str) -> Column:
    def of(local: Column) -> Column:
        letters = permute_symbols(_only(F.lower(_only(local, "A-Za-z")), "a-z"), LETTERS, "email", key)
        with_letters = bind(F.struct(local.alias("o"), refill(local, "[A-Za-z]", letters).alias("n")), lambda s: F.array_join(
            F.transform(F.sequence(F.lit(1), F.length(s["o"])), lambda i: F.when(
                F.substr(s["o"], i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substr(s["n"], i, F.lit(1))))
                .otherwise(F.substr(s["n"], i, F.lit(1)))), ""))
        new = _digits(with_letters, "email", key)
        other = F.concat(F.lit("u"), F.substr(F.sha2(F.concat_ws("|", F.lit(key), local), 256), F.lit(1), F.lit(16)))
        # a local part without ASCII letters or digits has no form to keep
        return F.when(local.rlike("[A-Za-z0-9]"), new).otherwise(other)
    return F.concat(bind(F.substring_index(value, "@", 1), of), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; null where it fails its validation."""
    whole = {name: value.rlike(f"^(?:{pattern})$") for name, pattern in FORMS.items()}
    out = F.when(whole["email"], _email(value, key))
    out = out.when(whole["secret"], permute_symbols(value, HEX, "secret", key))
    out = out.when(whole["iso_date"], _date(value, "yyyy-MM-dd", key))
    out = out.when(whole["day_date"] & value.contains("/"), _date(value, "dd/MM/yyyy", key))
    out = out.when(whole["day_date"], _date(value, "dd.MM.yyyy", key))
    out = out.when(whole["ssn"], _ssn(value, key))
    out = out.when(whole["phone"], _digits(value, "phone", key))
    out = out.when(whole["ip"], _ip(value, key))
    return out.when(whole["card"], _card(value, key))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """(row, text, n_pseudonyms): every text with its e-mail addresses, secrets (hexadecimal), dates, social
    security, telephone, card and IPv4 numbers replaced by pseudonyms of the same format under ``key``.

    Numbers that fail their check (Luhn digit, octet, calendar, area) stay, and so do all other characters.
    Dates are permuted within 1900-01-01 to 2099-12-30. Null texts stay null, empty ones empty; repeated rows
    are treated alike; other columns come back in ``row``.
    """
    text = F.col(text_col)

    def of(found: Column) -> Column:
        new = F.transform(found, lambda v: pseudonym(v, key))
        gaps = F.split(text, ANY, -1)

        def weave(n: Column) -> Column:
            filled = F.zip_with(found, n, lambda old, x: F.coalesce(x, old))
            joined = F.zip_with(gaps, filled, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
            return F.struct(F.array_join(joined, "").alias("text"), F.size(F.array_compact(n)).cast("long").alias("n"))
        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(bind(new, weave))

    # texts without a digit or an @ hold nothing of these forms and are passed over
    out = F.when(text.rlike("[0-9@]"), bind(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), of)).otherwise(
        F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    return (docs.select(F.struct("*").alias("row"), out.alias("out"))
            .select("row", F.col("out.text").alias("text"), F.col("out.n").alias("n_pseudonyms")))
