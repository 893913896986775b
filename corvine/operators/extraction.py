"""Patterns of kernel sources to rows: exports, parameters, entry points.

Every text is read once: all wanted rules are tried on it in one pass, a rule
only where its fixed word occurs. Lines count from 1 and come from the offsets of
the line breaks. Null texts give no rows; the same pattern found twice gives two
rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed formats: kind, word that must occur, pattern, group of the name, group of the detail (0: none).
PATTERNS = [
    ("export", "EXPORT_SYMBOL", r"\bEXPORT_SYMBOL(_GPL)?\s*\(\s*(\w+)\s*\)", 2, 1),
    ("export_ns", "EXPORT_SYMBOL_NS", r"\bEXPORT_SYMBOL_NS(?:_GPL)?\s*\(\s*(\w+)\s*,\s*\"?(\w+)\"?\s*\)", 1, 2),
    ("module_param", "module_param", r"\bmodule_param(?:_named)?\s*\(\s*(\w+)\s*,\s*(?:\w+\s*,\s*)?(\w+)\s*,\s*[\w|]+\s*\)", 1, 2),
    ("module_param_array", "module_param_array", r"\bmodule_param_array\s*\(\s*(\w+)\s*,\s*(\w+)\s*,", 1, 2),
    ("param_description", "MODULE_PARM_DESC", r"\bMODULE_PARM_DESC\s*\(\s*(\w+)\s*,\s*\"([^\"]*)\"", 1, 2),
    ("boot_param", "_", r"\b(?:__setup|early_param|core_param)\s*\(\s*\"([^\"]+)\"\s*,\s*(\w+)", 1, 2),
    ("syscall", "SYSCALL_DEFINE", r"\bSYSCALL_DEFINE(\d)\s*\(\s*(\w+)", 2, 1),
    ("syscall", "asmlinkage", r"\basmlinkage\s+(long|int)\s+sys_(\w+)\s*\(", 2, 1),
    ("ioctl_command", "_IO", r"#\s*define\s+(\w+)\s+(_IO[RW]{0,2})\s*\(", 1, 2),
    ("ioctl_handler", "_ioctl", r"\.(?:unlocked_|compat_)ioctl\s*=\s*(\w+)", 1, 0),
    ("sysfs", "_ATTR", r"\b(?:DEVICE|DRIVER|BUS|CLASS)_ATTR(_RO|_RW|_WO)?\s*\(\s*(\w+)", 2, 1),
    ("sysfs", "sysfs_create_file", r"\bsysfs_create_file\s*\([^,;]+,\s*&(\w+)\.attr\s*\)", 1, 0),
    ("procfs", "proc_create", r"\bproc_create(?:_data|_single|_seq)?\s*\(\s*\"([^\"]+)\"[^;]*?&?(\w+)\s*(?:,\s*\w+\s*)?\)", 1, 2),
    ("debugfs", "debugfs_create_", r"\bdebugfs_create_(\w+)\s*\(\s*\"([^\"]+)\"", 2, 1),
    ("module_init", "_", r"\b(module_init|module_exit|late_initcall|subsys_initcall|device_initcall)\s*\(\s*(\w+)\s*\)", 2, 1),
    ("interrupt", "request_", r"\b(request_(?:threaded_)?irq)\s*\([^,;]+,\s*(\w+)\s*,", 2, 1),
    ("interrupt", "devm_request_", r"\b(devm_request_(?:threaded_)?irq)\s*\([^,;]+,[^,;]+,\s*(\w+)\s*,", 2, 1),
    ("interrupt_flag", "IRQF_", r"\b(?:request|devm_request)_(?:threaded_)?irq\s*\([^;]*?\b(IRQF_\w+)", 1, 0),
    ("netlink", "netlink_kernel_create", r"\bnetlink_kernel_create\s*\([^,]+,\s*(\w+)\s*,\s*&(\w+)", 1, 2),
    ("netlink_input", "netlink_kernel_cfg", r"\bstruct\s+netlink_kernel_cfg\s+(\w+)\s*=\s*\{[^}]*?\.input\s*=\s*(\w+)", 2, 1),
]
ENTRY_KINDS = ["syscall", "ioctl_handler", "sysfs", "procfs", "debugfs", "module_init", "interrupt", "netlink", "netlink_input"]
_COMPILED = [(kind, word, re.compile(pattern, re.S), name, detail) for kind, word, pattern, name, detail in PATTERNS]
_TABLE = re.compile(r"struct\s+(\w+(?:_operations|_ops))\s+(\w+)\s*=\s*\{([^}]*)\}", re.S)
_FIELD = re.compile(r"\.(\w+)\s*=\s*&?(\w+)")
_MAGIC = re.compile(r"#\s*define\s+(\w*MAGIC)\s+(?:'(.)'|(0x[0-9A-Fa-f]+|\d+))")
_COMMAND = re.compile(r"#\s*define\s+(\w+)\s+_(IO|IOR|IOW|IOWR)\s*\(\s*('.'|\w+)\s*,\s*(\w+)\s*(?:,\s*([^)]+?)\s*)?\)")


def per_text(df: DataFrame, key: str, text: str, find: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """``<key>`` and ``columns``: the rows that ``find`` gives of each text, in one pass over the table."""
    kind = df.schema[key].dataType.simpleString()
    names = ["k", *(c.strip().split()[0] for c in columns.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, t in zip(batch["k"], batch["t"]) if t for row in find(t)]
            yield pd.DataFrame(rows, columns=names)

    narrow = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    return narrow.mapInPandas(run, f"k {kind}, {columns}").withColumnRenamed("k", key)


def _liner(text: str) -> Callable[[int], int]:
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect.bisect_left(breaks, at) + 1


def find_patterns(text: str, kinds: list[str] | None = None) -> list[tuple[str, str, str | None, int]]:
    """(kind, name, detail, line) of all rules of the wanted kinds, in the order of the rules."""
    line = _liner(text)
    rows = []
    for kind, word, pattern, name, detail in _COMPILED:
        if (kinds is None or kind in kinds) and word in text:
            rows += [(kind, m.group(name), m.group(detail) or None if detail else None, line(m.start())) for m in pattern.finditer(text)]
    return rows


def find_tables(text: str) -> list[tuple[str, str, str, str, int]]:
    """(struct type, table, field, function, line of the field) of designated initialisers of *_operations and *_ops."""
    if "_op" not in text:
        return []
    line = _liner(text)
    return [(t.group(1), t.group(2), f.group(1), f.group(2), line(t.start(3) + f.start())) for t in _TABLE.finditer(text) for f in _FIELD.finditer(t.group(3))]


def find_ioctls(text: str) -> list[tuple[str, str, str, str, str | None, int]]:
    """(name, direction, magic, number, argument, line) of ioctl commands; a magic that is defined in the text is replaced by its value."""
    if "_IO" not in text:
        return []
    line = _liner(text)
    magic = {m.group(1): m.group(2) or m.group(3) for m in _MAGIC.finditer(text)}
    way = {"IO": "none", "IOR": "read", "IOW": "write", "IOWR": "both"}
    return [(m.group(1), way[m.group(2)], magic.get(m.group(3), m.group(3).strip("'")), m.group(4), m.group(5), line(m.start())) for m in _COMMAND.finditer(text)]


def patterns(df: DataFrame, key: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """``<key>, kind, name, detail, line`` of the wanted kinds, or of all."""
    return per_text(df, key, text, lambda t: find_patterns(t, kinds), "kind string, name string, detail string, line int")


def parameters_with_descriptions(found: DataFrame, key: str) -> DataFrame:
    """``<key>, name, type, description``: module parameters beside their descriptions, if any."""
    left = found.filter(F.col("kind").isin("module_param", "module_param_array")).select(key, "name", F.col("detail").alias("type"))
    right = found.filter("kind = 'param_description'").groupBy(key, "name").agg(F.min("detail").alias("description"))
    return left.join(right, [key, "name"], "left")


def operation_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, struct_type, table_name, field, function, line`` of designated initialisers of *_operations and *_ops."""
    return per_text(df, key, text, find_tables, "struct_type string, table_name string, field string, function string, line int")


def ioctl_commands(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, name, direction, magic, number, argument, line`` of each ioctl command."""
    return per_text(df, key, text, find_ioctls, "name string, direction string, magic string, number string, argument string, line int")


def entry_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """The kinds that enter the kernel from outside, operation tables included."""

    def find(t: str) -> list[tuple]:
        return find_patterns(t, ENTRY_KINDS) + [("file_operation", function, f"{table}.{field}", line) for _, table, field, function, line in find_tables(t)]

    return per_text(df, key, text, find, "kind string, name string, detail string, line int")


def syscall_names(symbols: DataFrame, name: str = "name") -> DataFrame:
    """Symbols that implement system calls by prefix, with the call's name."""
    pattern = r"^(?:__se_sys_|__do_sys_|ksys_|sys_)(\w+)$"
    return symbols.filter(F.col(name).rlike(pattern)).withColumn("syscall", F.regexp_extract(name, pattern, 1))
