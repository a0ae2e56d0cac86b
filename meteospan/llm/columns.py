"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the white space of the word pattern [^\x20\x09-\x0D]+, as SQL and regular expression.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside the lambda functions of array operators an outer expression is evaluated for every
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, a null text being empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df_columns: list[str], name: str) -> str:
    """``name``, with underscores in front until it clashes with none of the columns."""
    taken = {c.lower() for c in df_columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_keys(df_columns: list[str], *parts: Column) -> dict[str, Column]:
    """128 bits that stand for the content of a row, in two columns without nulls. Equal rows share them."""
    marked = [F.struct(F.isnull(p), p) for p in parts]
    return {
        fresh(df_columns, "_k1"): F.xxhash64(*marked),
        fresh(df_columns, "_k2"): F.xxhash64(F.lit(0x5BD1E995), *marked[::-1]),
    }


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Sums of all elements before each one, in blocks, so that a long array costs no square."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")

    def of(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        sums = F.transform(starts, lambda b: F.aggregate(F.slice(v, b * block + 1, block), zero, add))
        before = lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), zero, add))
        return let(
            let(sums, before),
            lambda base: F.transform(
                v,
                lambda _, i: F.get(base, F.floor(i / block).cast("int"))
                + F.aggregate(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block), zero, add),
            ),
        )

    return let(lengths, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: str, around: int = 0) -> Column:
    """All matches from left to right as structs ``start, end, value`` in code points, and with
    ``around`` the text next to each match, up to the neighbouring match, as ``before, after``.

    The gaps that split() leaves and the matches come from the same scan of the pattern, so
    their lengths give the offsets.
    """

    def placed(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda x, i: F.char_length(F.get(gaps, i)).cast("bigint") + F.char_length(x))
        one = lambda p: lambda x, i: F.struct(
            (F.get(p, i) + F.char_length(F.get(gaps, i))).alias("start"),
            (F.get(p, i) + F.char_length(F.get(gaps, i)) + F.char_length(x)).alias("end"),
            x.alias("value"),
            *(
                [
                    F.right(F.concat(F.lit(" "), F.get(gaps, i)), F.lit(around + 1)).alias("before"),
                    F.left(F.concat(F.get(gaps, i + 1), F.lit(" ")), F.lit(around + 1)).alias("after"),
                ]
                if around
                else []
            ),
        )
        return let(prefix_sums(steps), lambda p: F.transform(found, one(p)))

    return let(
        F.struct(text.alias("t"), F.split(text, pattern).alias("g")),
        lambda s: let(
            F.when(F.size(s["g"]) > 1, F.regexp_extract_all(s["t"], F.lit(pattern), F.lit(0))).otherwise(
                F.array().cast("array<string>")
            ),
            lambda m: placed(s["g"], m),
        ),
    )
