"""Synthetic contacts for scale tests, made in parallel and the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import ref

FIRST = ("Ada", "Ben", "Chloe", "Dan", "Elif", "Femi", "Gita", "Hugo", "Ines", "Jon", "Kira")
LAST = ("Abbott", "Baker", "Cohen", "Diaz", "Evans", "Fox", "Gray", "Hill", "Ito", "Khan")
HOSTS = ("example.com", "example.org", "mail.example.net", "corp.example.io")
JOINTS = (".", "_", "")
NOTES = (
    "call again on Monday", "key account", "asked for a quote", "renewal signed",
    "on a free trial", "nothing to report",
)

_PRIME = 1_000_003


def _draw(row: Column, seed: int, salt: int, bound: int) -> Column:
    """A number below ``bound`` fixed by row, seed and salt; stays far inside 64 bits."""
    mixed = ((row % _PRIME) * (7919 + 2 * salt) + (seed % _PRIME) * 31 + salt * 104_729) % _PRIME
    return (mixed * 48_271 % _PRIME) % bound


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def contacts_for(ids: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """One contact ``ID, Name, Email, Phone, Notes`` per id; map-only."""
    row = ref(id_column).cast("long")

    def draw(salt: int, bound: int) -> Column:
        return _draw(row, seed, salt, bound)

    first = _pick(FIRST, draw(1, len(FIRST)))
    last = _pick(LAST, draw(2, len(LAST)))
    joint, host = _pick(JOINTS, draw(3, len(JOINTS))), _pick(HOSTS, draw(4, len(HOSTS)))
    phone = F.concat(
        F.lit("("), (draw(5, 800) + 200).cast("string"),
        F.lit(") "), (draw(6, 800) + 200).cast("string"),
        F.lit("-"), (draw(7, 9000) + 1000).cast("string"),
    )
    return ids.select(
        row.cast("string").alias("ID"),
        F.concat_ws(" ", first, last).alias("Name"),
        F.concat(F.lower(first), joint, F.lower(last), F.lit("@"), host).alias("Email"),
        phone.alias("Phone"),
        _pick(NOTES, draw(8, len(NOTES))).alias("Notes"),
    )


def contacts(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` contacts numbered from 1."""
    return contacts_for(spark.range(1, rows + 1), "id", seed)
