"""Numbers, amounts, dates, hashes and JSON as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"": 1.0, "thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9}


def parsed_number(raw: Column) -> Column:
    """A decorated number: thousands commas, footnotes, parentheses or triangles for minus; dashes and text: null."""
    plain = F.regexp_replace(F.trim(raw), r"\[[^\]]*\]|,| ", "")
    negative = plain.rlike(r"^\(.*\)$") | plain.rlike(r"^[△▲▵-]")
    digits = F.regexp_replace(plain, r"^[△▲▵+-]|[()]", "")
    value = F.when(digits.rlike(r"^[0-9]+(\.[0-9]+)?$"), digits.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def with_unit(value: Column, unit: Column, units: Mapping[str, float] = UNITS) -> Column:
    """Value times its unit; unknown and null units count as 1."""
    table = F.create_map(*(F.lit(x) for pair in units.items() for x in pair))
    return value * F.coalesce(F.try_element_at(table, F.lower(F.coalesce(unit, F.lit("")))), F.lit(1.0))


def amount_phrase(text: Column) -> Column:
    """First amount of a text as (value, unit): a percentage first, then billions, millions, a plain number of currency."""
    number = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"
    take = lambda tail: F.nullif(F.regexp_extract(text, f"(?i){number}{tail}", 1), F.lit(""))
    value = lambda found, k: F.regexp_replace(found, ",", "").try_cast("double") * k
    kinds = [(r"\s*%", 1.0, "%"), (r"\s*(?:billion|bn)", 1e9, "currency"), (r"\s*(?:million|mn)", 1e6, "currency"), (r"\s*(?:won|usd|eur|dollars?|euros?)", 1.0, "currency")]
    picks = [(take(tail), k, unit) for tail, k, unit in kinds]
    return F.struct(F.coalesce(*(value(f, k) for f, k, _ in picks)).alias("value"), F.coalesce(*(F.when(f.isNotNull(), unit) for f, _, unit in picks)).alias("unit"))


def years_in(text: Column) -> Column:
    """Distinct years 2000 to 2099, ascending."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])(20[0-9]{2})(?:$|[^0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def dates_in(text: Column, most: int = 5) -> Column:
    """Up to ``most`` distinct dates as yyyy-mm-dd, zero-padded, in order."""
    pattern = r"((?:19|20)[0-9]{2})[./-]([0-9]{1,2})[./-]([0-9]{1,2})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    iso = F.transform(found, lambda x: F.concat_ws("-", part(x, 1), F.lpad(part(x, 2), 2, "0"), F.lpad(part(x, 3), 2, "0")))
    return F.slice(F.array_distinct(iso), 1, most)


def any_date(raw: Column) -> Column:
    """A date from one of several layouts, else null."""
    text = F.trim(raw)
    return F.coalesce(*(F.try_to_date(text, layout) for layout in ("yyyy-MM-dd", "yyyyMMdd", "yyyy.MM.dd", "yyyy/MM/dd")))


def fiscal_year(filing: Column, annual: Column) -> Column:
    """Annual reports filed in the first half belong to the year before."""
    return F.year(filing) - F.when(annual & (F.month(filing) <= 6), 1).otherwise(0)


def token_estimate(text: Column, per_char: float | None = None, per_token: int | None = None) -> Column:
    """Estimated tokens: characters times a rate, rounded half to even, or characters by a whole number, at least 1."""
    if per_char is not None:
        return F.bround(F.length(text) * F.lit(per_char), 0).cast("long")
    return F.greatest(F.floor(F.length(text) / F.lit(per_token)), F.lit(1)).cast("long")


def digit_ratio(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit("[0-9]")), F.length(text)), F.lit(0.0))


_LIMB = 10**9


def whole_digits(value: Column) -> Column:
    """All digits of a double that is a whole number of 2**53 or more, in groups of three; ``format_number`` fills up with zeros after 17.

    The mantissa in limbs of nine digits, lowest first, is multiplied by powers of two of at most 29 until the exponent is used up.
    """
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    e = F.greatest(F.floor(F.log2(value)) - 54, F.lit(0)).cast("int")
    m = (value / F.pow(F.lit(2.0), e)).cast("long")
    start = F.array(m % _LIMB, div(m, _LIMB))
    none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("done"))

    def times(limbs: Column, power: Column) -> Column:
        product = lambda s, x: x * F.pow(F.lit(2.0), power).cast("long") + s["carry"]
        step = lambda s, x: F.struct(div(product(s, x), _LIMB).alias("carry"), F.concat(s["done"], F.array(product(s, x) % _LIMB)).alias("done"))
        return F.aggregate(limbs, none, step, lambda s: F.concat(s["done"], F.array(s["carry"])))

    powers = F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: F.least(F.greatest(e - 29 * i, F.lit(0)), F.lit(29)))
    limbs = F.aggregate(F.filter(powers, lambda p: p > 0), start, times)
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(F.regexp_replace(digits, "^0+", ""), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def _billions(value: Column) -> Column:
    """A number to one place, in groups of three, whatever its size."""
    a = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a >= 2.0**53, F.concat(sign, whole_digits(a), F.lit(".0"))).otherwise(F.format_number(value, 1))


def readable_amount(value: Column) -> Column:
    """1.5 billion, 20.0 million, or grouped digits; null stays null."""
    a = F.abs(value)
    return F.when(a >= 1e9, F.concat(_billions(value / 1e9), F.lit(" billion"))).when(a >= 1e6, F.concat(F.format_number(value / 1e6, 1), F.lit(" million"))).otherwise(F.format_number(value, 0))


NUMBERS = r"\([0-9,]+(?:\.[0-9]+)?\)|[0-9,]+(?:\.[0-9]+)?"


def annotated_numbers(text: Column, unit: Column, units: Mapping[str, float] = UNITS) -> Column:
    """The text with what each number means under a unit after it: ``(1,234)`` becomes ``(1,234)[=-1.2 million]``.

    Nothing is taken away. Without a unit, null or empty, the text stays as it is; lone commas are no numbers, ``,.5`` is a half.
    """
    plain = lambda raw: F.regexp_replace(raw, "[,()]", "").try_cast("double")
    number = lambda raw: F.when(raw.startswith("("), -plain(raw)).otherwise(plain(raw))
    read = lambda raw: F.coalesce(F.concat(raw, F.lit("[="), readable_amount(with_unit(number(raw), unit, units)), F.lit("]")), raw)
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), read)
    between = F.split(text, NUMBERS)
    both = F.zip_with(between, found, lambda b, n: F.concat(F.coalesce(b, F.lit("")), F.coalesce(n, F.lit(""))))
    return F.when(F.coalesce(unit, F.lit("")) == "", text).otherwise(F.array_join(both, ""))


def document_uid(name: Column) -> Column:
    return F.substring(F.sha2(name.cast("binary"), 256), 1, 16)


def chunk_uid(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 32)


def chunk_id(receipt: Column, role: Column, index: Column) -> Column:
    return F.format_string("%s-%s-%06d", receipt, role, index)


def receipt_number(name: Column) -> Column:
    """The 14-digit receipt number of a file name, else 14 characters of its md5."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9]{14})", 1), F.lit("")), F.substring(F.md5(name.cast("binary")), 1, 14))


def loaded_json(raw: Column) -> Column:
    """JSON parsed to a variant; a JSON string that itself holds JSON is parsed again."""
    once = F.try_parse_json(raw)
    return F.coalesce(F.try_parse_json(F.try_variant_get(once, "$", "string")), once)


def salvaged_json(raw: Column) -> Column:
    """JSON from a model's answer: as it is, inside a code fence, or between the outer braces; else null."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))
