"""Exact integers of any size, given as decimal strings, in built-in expressions.

A value is five signed limbs of 18 digits, and for the rare number of more than 90 digits a list of such numbers as texts.
Limbs are added as decimals, so sums go through Spark's partial aggregation, and carried only when a result is printed; long
numbers are gathered by sums and added, limb by limb, then. A sum of limbs holds for up to 10^20 rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS, DIGITS = 5, 18
WIDE = "decimal(38,0)"


#: Characters that do not count around a number: all up to the space.
AROUND = "".join(map(chr, range(0x21)))
#: Decimal digits of other scripts, ten in a row each, with the ASCII digits that they mean.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
THEIR_VALUES = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def digits(text: Column) -> Column:
    """The number as text: blanks and control characters around it go, an optional minus and decimal digits of any script stay; all else is 0."""
    number = F.trim(text, F.lit(AROUND))
    return F.when(number.rlike(r"\A-?[0-9]+\z"), number).when(number.rlike(r"\A-?\p{Nd}+\z"), F.translate(number, OTHER_DIGITS, THEIR_VALUES)).otherwise(F.lit("0"))


def padded(text: Column) -> Column:
    """Sign and 90 digits; of a number that has more, 90 zeros and then all its digits. Kept as a column of its own, a number is
    parsed once for all its limbs."""
    number = digits(text)
    sign = F.when(F.startswith(number, F.lit("-")), F.lit("-")).otherwise(F.lit("+"))
    size = F.ltrim(F.translate(number, "-", ""), F.lit("0"))
    long = F.length(size) > LIMBS * DIGITS
    return F.concat(sign, F.lpad(F.when(long, "").otherwise(size), LIMBS * DIGITS, "0"), F.when(long, size).otherwise(""))


def split(number: Column) -> list[Column]:
    """Signed limbs of a padded number, the lowest first (0 of a long one), and a list of the number itself if it is long, else null."""
    sign = F.when(F.startswith(number, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    of_limbs = [(F.substring(number, DIGITS * (LIMBS - 1 - k) + 2, DIGITS).cast("long") * sign).cast(WIDE) for k in range(LIMBS)]
    most = LIMBS * DIGITS + 1
    return [*of_limbs, F.when(F.length(number) > most, F.array(F.concat(F.substring(number, 1, 1), F.substring(number, most + 1, 1 << 30))))]


def limbs(text: Column) -> list[Column]:
    """Signed limbs, the lowest first, and what is too long for them."""
    return split(padded(text))


def _none() -> Column:
    return F.array().cast("array<string>")


def plus(a: list[Column], b: list[Column]) -> list[Column]:
    return [*[(x + y).cast(WIDE) for x, y in zip(a[:-1], b[:-1], strict=True)], F.when(a[-1].isNotNull() | b[-1].isNotNull(), F.concat(F.coalesce(a[-1], _none()), F.coalesce(b[-1], _none())))]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    turned = F.transform(b[-1], lambda x: F.concat(F.when(F.startswith(x, F.lit("-")), F.lit("+")).otherwise(F.lit("-")), F.substring(x, 2, 1 << 30)))
    return plus(a, [*[(-x).cast(WIDE) for x in b[:-1]], turned])


def sums(values: list[Column], where: Column | None = None) -> Column:
    """An aggregate of the limbs, as one struct; rows outside `where` add nothing."""
    on = lambda x: x if where is None else F.when(where, x)
    long = F.flatten(F.collect_list(on(F.when(F.size(values[-1]) > 0, values[-1]))))  # nulls are not gathered
    return F.struct(*[F.coalesce(F.sum(on(x)), F.lit(0)).cast(WIDE).alias(f"l{k}") for k, x in enumerate(values[:-1])], long.alias("long"))


def of_struct(column: str) -> list[Column]:
    return [*[F.col(f"{column}.l{k}") for k in range(LIMBS)], F.col(f"{column}.long")]


def parsed(number: str) -> Column:
    """split() of a padded column, as one struct. Like what follows by column names, it is one SQL text: built function by function,
    the plans of windows take longer to write down than to run on little data."""
    sign = f"case when startswith({number}, '-') then -1L else 1L end"
    of_limbs = ", ".join(f"'l{k}', cast(cast(substring({number}, {DIGITS * (LIMBS - 1 - k) + 2}, {DIGITS}) as bigint) * {sign} as {WIDE})" for k in range(LIMBS))
    most = LIMBS * DIGITS + 1
    return F.expr(f"named_struct({of_limbs}, 'long', case when length({number}) > {most} then array(concat(substring({number}, 1, 1), substring({number}, {most + 1}))) end)")


def _joined(a: str, b: str, sign: str, long_b: str) -> Column:
    of_limbs = ", ".join(f"'l{k}', cast({a}.l{k} {sign} {b}.l{k} as {WIDE})" for k in range(LIMBS))
    none = "cast(array() as array<string>)"
    return F.expr(f"named_struct({of_limbs}, 'long', case when {a}.long is not null or {b}.long is not null then concat(coalesce({a}.long, {none}), coalesce({long_b}, {none})) end)")


def added(a: str, b: str) -> Column:
    """The sum of two struct columns of limbs."""
    return _joined(a, b, "+", f"{b}.long")


def less(a: str, b: str) -> Column:
    """The first of two struct columns of limbs less the second."""
    return _joined(a, b, "-", f"transform({b}.long, x -> concat(case when startswith(x, '-') then '+' else '-' end, substring(x, 2)))")


def total(column: str, where: str | None = None) -> Column:
    """sums() of a struct column of limbs, rows outside the SQL condition `where` adding nothing."""
    on = lambda x: x if where is None else f"case when {where} then {x} end"
    of_limbs = ", ".join(f"'l{k}', cast(coalesce(sum({on(f'{column}.l{k}')}), 0) as {WIDE})" for k in range(LIMBS))
    long = on(f"case when size({column}.long) > 0 then {column}.long end")
    return F.expr(f"named_struct({of_limbs}, 'long', flatten(collect_list({long})))")


def merged(column: str) -> Column:
    """The sum of sums."""
    return total(column).alias(column)


def _bound(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: SQL of the limbs of a struct v and of its long numbers (a sign and digits each), added.
_ADDED = f"""aggregate(coalesce(v.long, cast(array() as array<string>)), array({", ".join(f"v.l{k}" for k in range(LIMBS))}), (acc, x) -> zip_with(acc,
    {_bound("many", f"cast(ceil((length(x) - 1) / {DIGITS}) as int)", f"""transform(sequence(1, many), k -> cast(
        cast(substring(lpad(substring(x, 2), many * {DIGITS}, '0'), (many - k) * {DIGITS} + 1, {DIGITS}) as bigint) * case when startswith(x, '-') then -1L else 1L end as {WIDE}))""")},
    (a, b) -> cast(coalesce(a, cast(0 as {WIDE})) + coalesce(b, cast(0 as {WIDE})) as {WIDE})))"""


def _carried(parts: str, sign: str) -> str:
    """SQL of a number (or its negative) with all limbs but the highest in 0 to 10^18 - 1. A fold keeps the expression small."""
    base = f"cast({10**DIGITS} as {WIDE})"
    step = _bound("t", f"cast({sign} x + acc.c as {WIDE})", _bound("r", f"cast(pmod(t, {base}) as {WIDE})", f"named_struct('c', cast((t - r) / {base} as {WIDE}), 'o', concat(acc.o, array(r)))"))
    return f"""aggregate(slice({parts}, 1, size({parts}) - 1), named_struct('c', cast(0 as {WIDE}), 'o', cast(array() as array<{WIDE}>)), (acc, x) -> {step},
        acc -> concat(acc.o, array(cast({sign} element_at({parts}, -1) + acc.c as {WIDE}))))"""


def _printed(parts: str) -> str:
    # The highest limb may have more digits than the others.
    return f"regexp_replace(array_join(transform(reverse({parts}), (d, i) -> case when i = 0 then cast(d as string) else lpad(cast(d as string), {DIGITS}, '0') end), ''), '^0+(?=.)', '')"


def _quotient(parts: str, by: str) -> str:
    step = _bound("t", f"cast(acc.r * cast({10**DIGITS} as decimal(19,0)) + x as {WIDE})", _bound("r", f"cast(pmod(t, {by}) as {WIDE})", f"named_struct('r', r, 'o', concat(acc.o, array(cast((t - r) / {by} as {WIDE}))))"))
    return _printed(f"aggregate(reverse({parts}), named_struct('r', cast(0 as {WIDE}), 'o', cast(array() as array<{WIDE}>)), (acc, x) -> {step}, acc -> reverse(acc.o))")


def _signed(of_size: str, minus: str) -> str:
    """SQL of a number as text: of_size is made of the limbs p of its size, minus tells whether a text q of a negative one gets its sign."""
    negative = _bound("p", _carried("parts", "-"), _bound("q", of_size, f"case when {minus} then concat('-', q) else q end"))
    return _bound("parts", _ADDED, _bound("p", _carried("parts", "+"), f"case when element_at(p, -1) >= 0 then {of_size} else {negative} end"))


def _packed(values: list[Column] | Column | str) -> Column:
    if isinstance(values, list):
        return F.struct(*[x.alias(name) for x, name in zip(values, [*(f"l{k}" for k in range(LIMBS)), "long"], strict=True)])
    return F.col(values) if isinstance(values, str) else values


def _on(value: Column, body: str) -> Column:
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"v -> {body}")), 1)


_TEXT = _signed(_printed("p"), "true")
_DIVIDED = _bound("by", "v.by", _bound("v", "v.of", _signed(_quotient("p", "by"), "q <> '0'")))
_KEY = _bound("text", _TEXT, "concat(lpad(cast(length(text) as string), 10, '0'), ':', text)")


def to_text(values: list[Column] | Column | str) -> Column:
    """The number in decimal digits, exactly; it is given as limbs, a struct of them or the name of one."""
    return _on(_packed(values), _TEXT)


def divided(values: list[Column] | Column | str, by: Column) -> Column:
    """The number divided by a positive integer below 10^10, truncated toward zero, as text."""
    return _on(F.struct(_packed(values).alias("of"), by.cast(WIDE).alias("by")), _DIVIDED)


def signum(text: Column) -> Column:
    number = digits(text)
    zero = number.rlike(r"\A-?0+\z")
    return F.when(zero, F.lit(0)).when(F.startswith(number, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))


def sign_of(number: str) -> Column:
    """signum() of a padded column."""
    return F.expr(f"case when not rlike(substring({number}, 2), '[1-9]') then 0 when startswith({number}, '-') then -1 else 1 end")


def to_double(text: Column) -> Column:
    return digits(text).cast("double")


def sort_key(values: list[Column] | Column | str) -> Column:
    """Text that sorts as a non-negative number does; the number stands behind a colon."""
    return _on(_packed(values), _KEY)
