"""C source text to rows: symbols, includes, macros, calls, guards.

The scanner blanks comments and strings (keeping line breaks), so braces,
parentheses and names are those of code. It is one pass per file, in Python;
everything that a pattern per file can express is a column expression instead.
Null and empty texts give no rows, broken code what can be read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are followed by parentheses without being calls.
KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "goto", "typeof", "__typeof__", "__attribute__", "defined", "alignof", "_Static_assert"}
# Attributes that are looked for in signatures.
ATTRIBUTES = [
    "__init", "__exit", "__user", "__kernel", "__iomem", "__percpu", "__rcu", "__must_check", "__deprecated", "__weak", "__always_inline", "noinline",
    "__cold", "__hot", "__pure", "__const", "__malloc", "__packed", "__aligned", "__section", "asmlinkage", "__visible",
]

_BLANK = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)
_DEFINITION = re.compile(r"^[A-Za-z_][\w \t*]*?\b([A-Za-z_]\w*)\s*\(", re.M)
_TYPE = re.compile(r"^\s*(?:typedef\s+)?(struct|union|enum)\s+([A-Za-z_]\w*)\s*\{", re.M)
_TYPEDEF = re.compile(r"^\s*typedef\b[^;{}]*?\b([A-Za-z_]\w*)\s*;", re.M)
_VARIABLE = re.compile(r"^(?:static\s+|extern\s+|const\s+|volatile\s+)*(?:struct\s+|enum\s+|union\s+)?[A-Za-z_]\w*[\s*]+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=|;)", re.M)
_CALL = re.compile(r"(->|\.)?\s*\b([A-Za-z_]\w*)\s*\(|\(\s*\*\s*([A-Za-z_]\w*)\s*\)\s*\(")
_BRACKETS = {"()": re.compile(r"[()]"), "{}": re.compile(r"[{}]")}
_TAIL = re.compile(r"[\s\w()]*?([;{])")
_GUARD = re.compile(r"^[ \t]*#[ \t]*(ifdef|ifndef|if|elif|else|endif)\b([^\n]*)", re.M)


def blanked(text: str) -> str:
    """The text with comments and literals replaced by blanks of the same length."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for m in _BRACKETS[opening + closing].finditer(text, at):
        depth += 1 if m.group() == opening else -1
        if depth == 0:
            return m.end()
    return -1


def functions(code: str) -> list[tuple[str, int, int, int, bool]]:
    """(name, start, end, start of the body, has a body) at the top level of blanked code."""
    out, end = [], 0
    for m in _DEFINITION.finditer(code):
        if m.start() < end or m.group(1) in KEYWORDS or m.group().lstrip().startswith(("return", "else", "#")):
            continue
        close = _close(code, m.end() - 1, "(", ")")
        if close < 0:
            continue
        tail = _TAIL.match(code, close)
        if not tail:
            continue
        if tail.group(1) == "{":
            stop = _close(code, tail.end() - 1, "{", "}")
            stop = len(code) if stop < 0 else stop
            out.append((m.group(1), m.start(), stop, tail.end() - 1, True))
        else:
            stop = tail.end()
            out.append((m.group(1), m.start(), stop, stop, False))
        end = stop
    return out


def parse(text: str) -> list[tuple[str, str, int, int, str, str]]:
    """(name, kind, first line, last line, signature, visibility) of each top-level symbol."""
    code = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda pos: bisect.bisect_right(starts, pos)
    seen = lambda head: "static" if re.search(r"\bstatic\b", head) else "extern" if re.search(r"\bextern\b", head) else "global"
    rows, taken = [], []
    for name, a, b, body, has in functions(code):
        head = " ".join(text[a:body].split()).rstrip("; {")
        rows.append((name, "function" if has else "declaration", line(a), line(b - 1), head, seen(head)))
        taken.append((a, b))
    spans: list[tuple[int, int]] = []

    def inside(pos: int) -> bool:
        """Whether a symbol that was already found covers the place; found ones don't overlap."""
        if len(spans) != len(taken):
            spans[:] = sorted(taken)
        i = bisect.bisect_right(spans, (pos, len(code))) - 1
        return i >= 0 and spans[i][0] <= pos < spans[i][1]

    for m in _TYPE.finditer(code):
        if not inside(m.start(2)):
            end = _close(code, m.end() - 1, "{", "}")
            end = len(code) if end < 0 else end
            rows.append((m.group(2), m.group(1), line(m.start(2)), line(end - 1), f"{m.group(1)} {m.group(2)}", "global"))
            taken.append((m.start(), end))
    for pattern, kind in ((_TYPEDEF, "typedef"), (_VARIABLE, "variable")):
        for m in pattern.finditer(code):
            if not inside(m.start(1)) and not (kind == "variable" and m.group().lstrip().startswith(("typedef", "return", "struct {", "goto"))):
                head = " ".join(text[m.start() : m.end()].split()).rstrip("=; ")
                rows.append((m.group(1), kind, line(m.start(1)), line(m.end() - 1), head, seen(head)))
    return sorted(rows, key=lambda r: (r[2], r[0]))


def calls(text: str) -> list[tuple[str, str, int, str, str | None, int]]:
    """(caller, callee, line, call type, guard, nesting of guards) of each call in a function."""
    code = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    marks, stack = [0], []
    states: list[tuple[str | None, int]] = [(None, 0)]
    for m in _GUARD.finditer(code):
        word, rest = m.group(1), m.group(2).strip()
        option = re.search(r"\bCONFIG_[A-Z0-9_]+\b", rest)
        name = option.group() if option else None
        if word in ("ifdef", "ifndef", "if"):
            negated = word == "ifndef" or bool(re.match(r"!\s*(?:defined|IS_ENABLED)?", rest)) and rest.startswith("!")
            stack.append(("!" if negated and name else "") + name if name else None)
        elif stack and word == "elif":
            stack[-1] = name
        elif stack and word == "else":
            top = stack[-1]
            stack[-1] = None if top is None else top[1:] if top.startswith("!") else "!" + top
        elif stack and word == "endif":
            stack.pop()
        marks.append(m.end())
        states.append((next((g for g in reversed(stack) if g), None), len(stack)))
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\[\s\S])*", lambda m: re.sub(r"[^\n]", " ", m.group()), code)
    out = []
    for caller, _, end, body, has in functions(code):
        if not has:
            continue
        for m in _CALL.finditer(code, body, end):
            name = m.group(2) or m.group(3)
            if name in KEYWORDS:
                continue
            at = m.start(2) if m.group(2) else m.start(3)
            guard, depth = states[bisect.bisect_right(marks, at) - 1]
            kind = "indirect" if m.group(1) or m.group(3) else "macro" if name.isupper() else "conditional" if guard else "direct"
            out.append((caller, name, bisect.bisect_right(starts, at), kind, guard, depth))
    return out


def _per_file(df: DataFrame, key: str, text: str, extract, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, t in zip(batch["k"], batch["t"]) if t for row in extract(t)]
            yield pd.DataFrame(rows, columns=names).astype({names[0]: "Int64"})

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, schema)


def symbol_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``file_id, name, kind, start_line, end_line, signature, visibility``."""
    return _per_file(df, key, text, parse, "file_id long, name string, kind string, start_line int, end_line int, signature string, visibility string")


def call_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``file_id, caller, callee, line, call_type, config_guard, guard_depth``."""
    return _per_file(df, key, text, calls, "file_id long, caller string, callee string, line int, call_type string, config_guard string, guard_depth int")


def includes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, pos, header, quoted`` of each #include."""
    found = F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"][^>"\n]+)[>"]'), F.lit(1))
    rows = df.select(key, F.posexplode(found).alias("pos", "h"))
    return rows.select(key, "pos", F.expr("substring(h, 2)").alias("header"), F.col("h").startswith('"').alias("quoted"))


def macros(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, pos, name, parameters`` of each #define; parameters null for object-like ones."""
    pattern = r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*(?:\([^)\n]*\))?)"
    rows = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("pos", "m"))
    inside = F.regexp_extract("m", r"\((.*)\)", 1)
    parameters = F.when(F.col("m").contains("("), F.filter(F.split(inside, r"\s*,\s*"), lambda p: p != ""))
    return rows.select(key, "pos", F.regexp_extract("m", r"^\w+", 0).alias("name"), parameters.alias("parameters"))


def attributes(signature: Column | str) -> Column:
    """The known attributes that a signature names, in the fixed order."""
    return F.filter(F.array(*map(F.lit, ATTRIBUTES)), lambda a: F.instr(F.col(signature) if isinstance(signature, str) else signature, a) > 0)


def macro_class(name: Column | str) -> Column:
    """The class of a macro by the first rule that fits its name."""
    n = F.lower(name)
    has = lambda *parts: n.rlike("|".join(parts))
    return (
        F.when(n.startswith("export_symbol") | n.startswith("module_"), "kernel_api")
        .when(has("debug", "^pr_", "^dev_", "printk", "warn", "bug_on", "trace"), "debug")
        .when(has("alloc", "free", "^mem"), "memory")
        .when(has("lock", "mutex", "rcu", "atomic"), "locking")
        .otherwise("function_like")
    )


def call_confidence(syntactic: Column, contextual: Column) -> Column:
    """high, medium or low by 0.6 syntactic + 0.4 contextual evidence."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * syntactic + 0.4 * contextual))
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")
