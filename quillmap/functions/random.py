"""Counter-based random numbers as column expressions: the same key and counter give the same draw anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Philox 2x32 generator: multiplier, key increment, rounds.
MULTIPLIER, KEY_STEP, ROUNDS = 0xD256D193, 0x9E3779B9, 10
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF


def philox(counter: Column, key: Column) -> Column:
    """Philox 2x32-10 of a 64-bit counter under the low 32 bits of ``key``: struct ``(x0, x1)`` of two 32-bit words.

    Products are made of 16-bit halves, so nothing leaves the range of a signed bigint. Null arguments give null words.
    """
    as_long = lambda value: F.lit(value).cast("bigint")

    def turn(s: Column, _: Column) -> Column:
        low = (s["x0"].bitwiseAND(as_long(_LOW16))) * as_long(MULTIPLIER)
        upper = F.shiftright(s["x0"], 16) * as_long(MULTIPLIER) + F.shiftright(low, 16)
        return F.struct(
            F.shiftright(upper, 16).bitwiseXOR(s["k"]).bitwiseXOR(s["x1"]).alias("x0"),
            (F.shiftleft(upper.bitwiseAND(as_long(_LOW16)), 16)).bitwiseOR(low.bitwiseAND(as_long(_LOW16))).alias("x1"),
            (s["k"] + as_long(KEY_STEP)).bitwiseAND(as_long(_LOW32)).alias("k"),
        )

    start = F.struct(
        counter.cast("bigint").bitwiseAND(as_long(_LOW32)).alias("x0"),
        F.shiftrightunsigned(counter.cast("bigint"), 32).alias("x1"),
        key.cast("bigint").bitwiseAND(as_long(_LOW32)).alias("k"),
    )
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1")))


def uniform(counter: Column, key: Column) -> Column:
    """A double in [0, 1) of 53 random bits."""
    words = philox(counter, key)
    bits = F.shiftleft(words["x0"], 21) + F.shiftright(words["x1"], 11)
    return bits.cast("double") * F.lit(2.0**-53)


def seed_key(seed: Column, second: Column | None = None) -> Column:
    """A 32-bit key from one or two seeds; a null second seed counts as 0."""
    return philox(seed, F.coalesce(second, F.lit(0)) if second is not None else F.lit(0))["x0"]


def philox_sql(counter: str, key: str, source: str, keep: str, name: str = "draw", words: bool = False) -> str:
    """The same numbers as a SQL query over ``source``: ``keep`` and a column ``name`` (or the words ``x0``, ``x1``)."""
    sql = f"SELECT {keep}, (({counter})::BIGINT & {_LOW32}) AS x0, ((({counter})::BIGINT >> 32) & {_LOW32}) AS x1, (({key})::BIGINT & {_LOW32}) AS k FROM {source}"
    names = ", ".join(part.strip().split(" AS ")[-1].split(".")[-1] for part in keep.split(","))
    for _ in range(ROUNDS):
        sql = (
            f"SELECT {names}, xor(xor(u >> 16, k), x1) AS x0, (((u & {_LOW16}) << 16) | (l & {_LOW16})) AS x1, ((k + {KEY_STEP}) & {_LOW32}) AS k "
            f"FROM (SELECT *, (x0 >> 16) * {MULTIPLIER} + (l >> 16) AS u FROM (SELECT *, (x0 & {_LOW16}) * {MULTIPLIER} AS l FROM ({sql})))"
        )
    return f"SELECT {names}, x0, x1 FROM ({sql})" if words else f"SELECT {names}, ((x0 << 21) + (x1 >> 11))::DOUBLE * {2.0**-53!r} AS {name} FROM ({sql})"
