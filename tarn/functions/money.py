"""Pay: parsing, the profile's floor, and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import let, strip

# What marks pay by the hour, day or week, and by the month.
SUB_MONTHLY = r"(?i)\b(per\s+hour|an\s+hour|hourly|/\s*hr|/\s*hour|per\s+day|daily|/\s*day|per\s+week|weekly|/\s*wk|/\s*week)\b"
MONTHLY = r"(?i)\b(per\s+month|a\s+month|monthly|/\s*mo|/\s*month|pm)\b"
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹"}
# Fixed value: an amount with its suffix.
_AMOUNT = r"(\d[\d,.]*)\s*([kKmM])?"


def currency(text: Column) -> Column:
    """The first of the four signs, else the first currency code."""
    code = F.upper(F.regexp_extract(F.lower(text), r"\b(usd|eur|gbp|inr)\b", 1))
    out = F.nullif(code, F.lit(""))
    for name, sign in reversed(SYMBOLS.items()):
        out = F.when(text.contains(sign), name).otherwise(out)
    return out


def amounts(text: Column, drop_decimals: bool) -> Column:
    """All amounts of a text, with k and m applied; what is no number is left out."""

    def value(match: Column) -> Column:
        digits = F.replace(F.regexp_extract(match, _AMOUNT, 1), F.lit(","), F.lit(""))
        suffix = F.lower(F.regexp_extract(match, _AMOUNT, 2))
        whole = F.regexp_replace(digits, r"\.\d*$", "") if drop_decimals else digits
        base = F.when(suffix == "", whole).otherwise(digits)
        # A second dot makes it no number; a last one does not.
        number = F.when(base.rlike(r"^\d+(\.\d*)?$"), F.regexp_replace(base, r"\.$", "").try_cast("double"))
        return number * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).otherwise(1.0)

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(0)), value), lambda x: x > 0)


def pay(raw: Column) -> Column:
    """struct<max_per_year, currency> of a posting's pay, or null if it states none that compares."""

    def stated(text: Column) -> Column:
        times, floor = (lambda of: F.when(of, 12.0).otherwise(1.0)), (lambda of: F.when(of, 100.0).otherwise(1000.0))
        top = lambda monthly: F.array_max(F.filter(amounts(text, True), lambda x: x >= floor(monthly))) * times(monthly)
        pays = let(let(text.rlike(MONTHLY), top), lambda x: F.when(x.isNotNull(), F.struct(x.alias("max_per_year"), currency(text).alias("currency"))))
        return F.when(~text.rlike(SUB_MONTHLY), pays)

    # Each part is evaluated once: Spark does not share what lambdas repeat.
    return let(strip(F.coalesce(raw, F.lit(""))), stated)


def floor_per_year(least: Column, period: Column) -> Column:
    """The profile's floor a year; null when there is none."""
    return F.when(least > 0, F.when(period == "month", least * 12).otherwise(least).cast("double"))


def legacy_range(value: Column) -> Column:
    """struct<min, max> from prose: one amount is a minimum, several span a range."""
    found = F.filter(amounts(strip(F.coalesce(value, F.lit(""))), False), lambda x: x >= 1000)
    return F.struct(F.array_min(found).alias("min"), F.when(F.size(found) > 1, F.array_max(found)).alias("max"))


def _tenths(amount: Column, unit: int) -> Column:
    """amount / unit with one decimal, ties up, a zero decimal dropped; in integers, so that it is exact."""
    tenths = F.floor((amount * 10 + unit // 2) / unit).cast("long")
    whole = F.floor(tenths / 10).cast("long").cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))


def compact(amount: Column, code: Column) -> Column:
    """$120K, €1.2M; rupees in lakh and crore. amount: a whole number."""
    sign = F.lit("$")
    for name, s in SYMBOLS.items():
        sign = F.when(code == name, s).otherwise(sign)
    a = amount.cast("long")
    western = F.when(a >= 1_000_000, F.concat(_tenths(a, 1_000_000), F.lit("M")))
    rupees = F.when(a >= 10_000_000, F.concat(_tenths(a, 10_000_000), F.lit("Cr"))).when(a >= 100_000, F.concat(_tenths(a, 100_000), F.lit("L")))
    thousands = F.when(a >= 1000, F.concat(_tenths(a, 1000), F.lit("K"))).otherwise(a.cast("string"))
    return F.concat(sign, F.coalesce(F.when(code == "INR", rupees).otherwise(western), thousands))


def range_text(low: Column, high: Column, code: Column, period: Column) -> Column:
    unit = F.when(period == "month", " / mo").otherwise(" / yr")
    has_low, has_high = F.coalesce(low > 0, F.lit(False)), F.coalesce(high > 0, F.lit(False))
    return (
        F.when(has_low & has_high, F.concat(compact(low, code), F.lit(" – "), compact(high, code), unit))
        .when(has_low, F.concat(F.lit("From "), compact(low, code), unit))
        .when(has_high, F.concat(F.lit("Up to "), compact(high, code), unit))
        .otherwise("")
    )


def positive_amount(value: Column) -> Column:
    """A positive number rounded half up, else null."""
    return F.when((value > 0) & (value < float("inf")), F.floor(value + 0.5).cast("long"))


def typed_amount(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\D", "").try_cast("long")


def grouped(amount: Column) -> Column:
    return F.coalesce(F.format_number(amount, 0), F.lit(""))


# What shows that a text states pay, what shows that it is a category, and the form of an amount.
_CATEGORY = r"(?i)\b(non-tech|tech|product|design|engineering|defi|crypto|marketing|sales|finance|operations|full-time|part-time|contract|remote)\b"
_TERMS = r"(?i)\b(\d+k|\d+k/yr|\d+/hr|hour|hourly|year|yearly|salary|month|monthly|usd|eur|gbp|\d{2,3},\d{3})\b"
_PRICE = r"([$€£¥₹]\s*\d+[\d,.]*\s*(?:[kK]|(?:/[a-zA-Z]+))?(?:\s*[-–—]\s*[$€£¥₹]?\s*\d+[\d,.]*\s*(?:[kK]|(?:/[a-zA-Z]+))?)?)"


def shown(raw: Column) -> Column:
    """The pay to show, or that none is disclosed."""
    text = strip(F.coalesce(raw, F.lit("")))
    sign, stated, span = text.rlike("[$€£¥₹]"), text.rlike(_TERMS), text.rlike(r"\b\d{2,3}\s*[-–—]\s*\d{2,3}\b")
    price = F.nullif(strip(F.regexp_extract(text, _PRICE, 1)), F.lit(""))
    return F.coalesce(F.when((sign | stated | span) & ~text.rlike(_CATEGORY), text), F.when(sign | stated, price), F.lit("Pay undisclosed"))


def looks_like_pay(value: Column) -> Column:
    v = strip(value)
    return v.rlike(r"[\d$€£¥₹₩]") & ~v.rlike(r"^[^\w$€£¥₹₩]") & ~v.rlike(r"(^|[^\d])\s*,\s*\d{3}\b")
