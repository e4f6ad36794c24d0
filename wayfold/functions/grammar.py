"""Opening hours and prices as people write them, read by built-in functions only.

Opening hours: rules parted by `;`, `|` or line ends; a rule is days (ranges may run over Sunday; none: all days) and spans of time,
or `closed`. A later rule replaces an earlier one for the days that it names. Prices: one amount, a range, "from", "up to" or free, with a
currency before or behind, and amounts that are shortened (200k, 1.5 triệu).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of days, Monday first
DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
DAYS_VI = ("t2", "t3", "t4", "t5", "t6", "t7", "cn")

_DAY = r"(?:mon(?:day)?s?|tue(?:s(?:day)?)?s?|wed(?:nesday)?s?|thu(?:r(?:s(?:day)?)?)?s?|fri(?:day)?s?|sat(?:urday)?s?|sun(?:day)?s?|t[2-7]|cn)"
_DAY_RANGE = rf"{_DAY}(?:\s*(?:-|–|to)\s*{_DAY})?"
_DAY_LIST = rf"{_DAY_RANGE}(?:\s*(?:,|&|and)\s*{_DAY_RANGE})*"
_TIME = r"(?:2[0-4]|[01]?[0-9])(?![0-9])(?:[:.h][0-5][0-9]|h)?\s*(?:am|pm)?"
_SPAN = rf"{_TIME}\s*(?:-|–|to)\s*{_TIME}"
_TIMES = rf"closed|off|24\s*h(?:ours)?|24/7|{_SPAN}(?:\s*(?:,|&|and)\s*{_SPAN})*"
_RULE = rf"^\s*(?:({_DAY_LIST})|daily|every\s*day)?\s*[:,]?\s*(?:open\s*)?({_TIMES})\s*$"
_CLOCK = r"^\s*([0-9]{1,2})(?:[:.h]([0-5][0-9])|h)?\s*(am|pm)?\s*$"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _day(name: Column) -> Column:
    two = F.left(name, F.lit(2))
    return F.greatest(F.array_position(F.array(*map(F.lit, DAYS)), two), F.array_position(F.array(*map(F.lit, DAYS_VI)), two)).cast("int") - 1


def _days(names: Column) -> Column:
    """Numbers of all days of a list; all seven where it is empty."""
    ends = F.transform(F.regexp_extract_all(names, F.lit(_DAY_RANGE), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(_DAY), F.lit(0)), _day))
    week = lambda e: F.transform(F.sequence(e[0], e[0] + F.pmod(F.element_at(e, -1) - e[0], F.lit(7))), lambda d: F.pmod(d, F.lit(7)))
    return F.when(names == "", F.sequence(F.lit(0), F.lit(6))).otherwise(F.flatten(F.transform(ends, week)))


def _minute(time: Column, half: Column) -> Column:
    """Minutes since midnight; half ('am', 'pm' or '') where the time itself doesn't say."""
    part = lambda g: F.regexp_extract(time, _CLOCK, g)
    own = F.when(part(3) != "", part(3)).otherwise(half)
    hour = part(1).cast("int")
    hour = F.when(own == "", hour).otherwise(hour % 12 + F.when(own == "pm", 12).otherwise(0))
    return hour * 60 + F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0))


def _span(text: Column) -> Column:
    """(open, close) of a span; close is on the next day, above 1440, if it is not after open. Where only the end says
    am or pm, the start is in the same half of the day, or in the other one if it would lie behind the end."""
    none = F.lit("")

    def of(ends: Column, half: Column, close: Column) -> Column:
        same = _minute(ends[0], half)
        other = _minute(ends[0], F.when(half == "pm", "am").when(half == "am", "pm").otherwise(""))
        start = F.when((half != "") & (same >= close), other).otherwise(same)
        return _with(start, lambda x: F.struct(x.alias("open_min"), F.when(close <= x, close + 1440).otherwise(close).alias("close_min")))

    ends = F.split(text, r"\s*(?:-|–|to)\s*")
    return _with(ends, lambda e: _with(F.regexp_extract(e[1], _CLOCK, 3), lambda half: _with(_minute(e[1], none), lambda close: of(e, half, close))))


def _spans(times: Column) -> Column:
    whole = F.array(F.struct(F.lit(0).alias("open_min"), F.lit(1440).alias("close_min")))
    none = F.filter(whole, lambda _: F.lit(False))
    return F.when(times.isin("closed", "off"), none).when(times.startswith("24/") | times.rlike(r"^24\s*h"), whole).otherwise(F.transform(F.regexp_extract_all(times, F.lit(_SPAN), F.lit(0)), _span))


def opening_hours(text: Column) -> Column:
    """array<struct<dow, open_min, close_min>>, dow 0 for Monday, in order; what open_at() takes. An empty array where all
    days are closed; null for a null or empty text and where any rule can't be read."""
    rules = F.filter(F.transform(F.split(F.lower(text), r"[;|\n]"), lambda r: F.trim(r)), lambda r: r != "")
    # text between the parts of a rule's days is fixed by _RULE, so the two groups say all
    read = lambda rules: F.transform(rules, lambda r: F.struct(_days(F.regexp_extract(r, _RULE, 1)).alias("days"), _spans(F.regexp_extract(r, _RULE, 2)).alias("spans")))

    def week(read: Column) -> Column:
        own = lambda d: F.filter(read, lambda r: F.array_contains(r["days"], d))
        of_day = lambda d, rules: F.when(F.size(rules) > 0, F.transform(F.array_sort(F.element_at(rules, -1)["spans"]), lambda s: F.struct(d.cast("int").alias("dow"), s["open_min"].alias("open_min"), s["close_min"].alias("close_min"))))
        days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: _with(own(d), lambda rules: of_day(d, rules)))
        return F.flatten(F.array_compact(days))

    readable = lambda rules: (F.size(rules) > 0) & F.forall(rules, lambda r: r.rlike(_RULE))
    return _with(rules, lambda x: F.when(readable(x), _with(read(x), week)))


# fixed values: currencies as they are written
CURRENCIES = {"USD": r"us\$|usd|\$|dollars?", "EUR": r"€|eur(?:os?)?", "GBP": r"£|gbp|pounds?", "JPY": r"¥|jpy|yen", "VND": r"₫|vnđ|vnd|đồng|dong|đ"}
THOUSAND, MILLION = ("k", "nghìn", "ngàn"), ("m", "tr", "triệu", "million")

_CURRENCY = "(?:" + "|".join(CURRENCIES.values()) + ")"
_SCALE = "(?:triệu|tr|million|m|nghìn|ngàn|k)"
_DIGITS = r"[0-9]+(?:[.,  ][0-9]{3})*(?:[.,][0-9]{1,2})?(?![0-9])"
_AMOUNT = rf"{_DIGITS}(?:\s*{_SCALE}(?![a-zà-ỹ]))?"
_BARE = rf"(?:{_CURRENCY}\s*)?({_AMOUNT})(?:\s*{_CURRENCY})?"
_TWO = rf"^\s*(?:from\s+|từ\s+|between\s+)?{_BARE}\s*(?:-|–|~|to|and|đến)\s*{_BARE}\s*$"
_ONE = rf"^\s*(from|từ|up to|under|đến|dưới|about)?\s*{_BARE}(?:\s*(\+))?\s*$"


def _scale(amount: Column) -> Column:
    own = F.regexp_extract(amount, rf"{_SCALE}$", 0)
    return F.when(own.isin(*THOUSAND), 1_000).when(own.isin(*MILLION), 1_000_000)


def _number(amount: Column) -> Column:
    """The digits of an amount. Of two kinds of separators the last parts decimals; one kind parts decimals only where
    one or two digits follow."""
    digits = F.regexp_replace(F.regexp_extract(amount, rf"^{_DIGITS}", 0), "[  ]", "")
    decimal = F.regexp_extract(digits, r"[.,]([0-9]{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(digits, r"[.,][0-9]{1,2}$", ""), "[.,]", "")
    return F.concat_ws(".", whole, F.nullif(decimal, F.lit(""))).cast("decimal(18,2)")


def price_range(text: Column) -> Column:
    """struct<min, max, currency>: decimal(18,2) amounts, null where the range is open; an ISO code, null where none is
    written. "free" is 0 to 0. In a range a missing scale or currency is that of the other amount, and amounts out of
    order are put in order. Null where the text is null or can't be read."""
    t = F.trim(F.lower(text))
    signs = F.regexp_replace(t, "đến|dưới", " ")
    code = F.coalesce(*[F.when(signs.rlike(p), n) for n, p in CURRENCIES.items()])
    one, a, b = F.regexp_extract(t, _ONE, 2), F.regexp_extract(t, _TWO, 1), F.regexp_extract(t, _TWO, 2)
    unit = lambda x, other: F.coalesce(_scale(x), _scale(other), F.lit(1))
    money = lambda x: x.cast("decimal(18,2)")
    low, high = money(_number(a) * F.coalesce(_scale(a), _scale(b), F.lit(1))), money(_number(b) * F.coalesce(_scale(b), F.lit(1)))
    value, word, plus = money(_number(one) * unit(one, one)), F.regexp_extract(t, _ONE, 1), F.regexp_extract(t, _ONE, 3)
    none = F.lit(None).cast("decimal(18,2)")
    made = lambda x, y, c: F.struct(x.alias("min"), y.alias("max"), c.alias("currency"))
    single = made(F.when(word.isin("up to", "under", "đến", "dưới"), none).otherwise(value), F.when(word.isin("from", "từ") | (plus != ""), none).otherwise(value), code)
    zero = F.lit(0).cast("decimal(18,2)")
    return F.when(t.isin("free", "miễn phí", "free of charge"), made(zero, zero, F.lit(None).cast("string"))).when(t.rlike(_TWO), made(F.least(low, high), F.greatest(low, high), code)).when(t.rlike(_ONE), single)
