"""Function pointers: where functions are assigned, and what the pointers are for.

Assignments are found with patterns over whole files, each read once. Null texts
give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.columns import col
from corvine.operators.extraction import per_text

# Words that mark a registration, and the purpose by the first that fits.
REGISTRATION = ["operations", "ops", "callbacks", "handlers", "hooks", "vtable", "dispatch"]
PURPOSE = [
    ("file_operations", "file_operations"), ("device_operations", "device_operations"), ("network_operations", "net_ops"), ("filesystem", "fs_ops"),
    ("driver", "driver_ops"), ("interrupt", "irq_handler"), ("timer", "timer_handler"), ("workqueue", "work_handler"),
]

_FIELD = re.compile(r"\.(\w+)\s*=\s*&?([A-Za-z_]\w*)\s*[,}\n]")
_MEMBER = re.compile(r"(?:->|\.)(\w+)\s*=\s*&?([A-Za-z_]\w*)\s*;")
_REGISTER = re.compile(r"\b(\w*(?:register|subscribe|add_handler|set_callback)\w*)\s*\([^;{}]*?\b&?([A-Za-z_]\w*(?:_cb|_callback|_handler|_fn|_func|_ops))\b")


def find_assignments(text: str) -> list[tuple[str, str, str]]:
    """(how, pointer, function), in one pass."""
    rules = (("initialiser", _FIELD), ("assignment", _MEMBER), ("registration", _REGISTER))
    return [(how, m.group(1), m.group(2)) for how, pattern in rules for m in pattern.finditer(text)]


def assignments(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, how, pointer, function``: initialised fields, assigned members, registered callbacks."""
    return per_text(df, key, text, find_assignments, "how string, pointer string, function string")


def known_functions(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Assignments beside the id of the function, null where no symbol has the name."""
    ids = symbols.filter("kind = 'function'").groupBy(F.col("name").alias("function")).agg(F.min("id").alias("function_id"))
    return found.join(ids, "function", "left")


def _either(pointer: Column | str, struct: Column | str, word: str) -> Column:
    return F.lower(pointer).contains(word) | F.coalesce(F.lower(struct).contains(word), F.lit(False))


def is_registration(pointer: Column | str, struct: Column | str) -> Column:
    """Whether a pointer's or its struct's name holds one of the words."""
    out = F.lit(False)
    for word in REGISTRATION:
        out = out | _either(col(pointer), col(struct), word)
    return out


def purpose(pointer: Column | str, struct: Column | str) -> Column:
    """The purpose by the first word that fits, else ``generic_callback``."""
    out = F
    for word, name in PURPOSE:
        out = out.when(_either(col(pointer), col(struct), word), name)
    return out.otherwise("generic_callback")


def pointer_statistics(found: DataFrame) -> DataFrame:
    """One row: pointers, distinct functions, those with a known function, registrations."""
    return found.agg(F.count(F.lit(1)).alias("n_pointers"), F.count_distinct("function").alias("n_functions"), F.count_if(F.col("function_id").isNotNull()).alias("n_known"), F.count_if(F.col("how") == "registration").alias("n_registrations"))
