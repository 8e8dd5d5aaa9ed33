"""Integer satoshi arithmetic as Column expressions. Amounts are BIGINT; coin age is DECIMAL(38, 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATS_PER_BTC = 100_000_000
MAX_SATS = 21_000_000 * SATS_PER_BTC


def cents(column: str | Column) -> Column:
    """A decimal amount as an integer of hundredths."""
    return F.round((F.col(column) if isinstance(column, str) else column) * 100).cast("bigint")


def parse_error(text: Column) -> Column:
    """Why a BTC amount written as text is not valid; null if it is."""
    t = F.trim(text)
    whole, frac = F.regexp_extract(t, r"^([^.]*)", 1), F.substring(F.regexp_extract(t, r"^[^.]*\.(.*)$", 1), 1, 8)
    digits = whole.rlike("^[0-9]*$") & frac.rlike("^[0-9]*$")
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.startswith("-"), "negative")
        .when(F.regexp_count(t, F.lit(r"\.")) > 1, "format")
        .when(~digits | (F.concat(whole, frac) == ""), "format")
        .when((F.length(F.ltrim(whole, F.lit("0"))) > 8) | (_value(t) > MAX_SATS), "over_supply")
    )


def _value(t: Column) -> Column:
    whole, frac = F.regexp_extract(t, r"^([0-9]*)", 1), F.substring(F.regexp_extract(t, r"^[0-9]*\.([0-9]*)", 1), 1, 8)
    number = F.concat(F.substring(F.concat(F.lit("00000000000"), whole), -11, 11), F.rpad(frac, 8, "0"))
    return F.expr("try_cast(0 AS bigint)") + number.cast("decimal(20,0)")


def btc_to_sats(text: Column) -> Column:
    """A BTC amount written as text, in satoshis; null where parse_error says why."""
    return F.when(parse_error(text).isNull(), _value(F.trim(text)).cast("bigint"))


def satoshi_days(value: Column, days: Column) -> Column:
    return (value.cast("decimal(20,0)") * days.cast("decimal(10,0)")).cast("decimal(38,0)")


def btc_days(satoshi_days: Column) -> Column:
    return satoshi_days.cast("double") / SATS_PER_BTC


def btc(sats: Column) -> Column:
    return sats.cast("double") / SATS_PER_BTC


def float_to_sats(amount: Column) -> Column:
    """A BTC amount that is a double, in satoshis of its eight decimals; null unless finite, not negative and within the supply."""
    fine = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount <= 21_000_000)
    return F.when(fine, btc_to_sats(F.format_string("%.8f", F.when(fine, amount).otherwise(F.lit(0.0)))))


def is_data_carrier(script_type: Column, script_hex: Column | None = None) -> Column:
    """Whether an output only carries data."""
    own = F.coalesce(script_type.isin("op_return", "nulldata"), F.lit(False))
    return own if script_hex is None else own | F.coalesce(F.lower(script_hex).startswith("6a"), F.lit(False))


def vsize_of_weight(weight: Column) -> Column:
    return F.floor((weight + 3) / 4).cast("bigint")


def fee_rate(fee: Column, vsize: Column) -> Column:
    return F.when(vsize > 0, fee.cast("double") / vsize)


def signals_replacement(inputs: Column) -> Column:
    """Whether any input's sequence opts in to replacement."""
    return F.exists(inputs, lambda x: x["sequence"] < 4294967294)


def halving_epoch(height: Column) -> Column:
    return F.floor(height / 210_000).cast("bigint")


def progress_percent(start: Column, end: Column, done: Column) -> Column:
    """Completed share of a height range, 0 to 100; an empty range is complete."""
    total = end - start + 1
    return F.when(total <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (done - start + 1) / total)))
