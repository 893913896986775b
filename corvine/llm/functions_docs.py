"""Functions and methods paired with their documentation.

One recursive pattern per language captures comment, signature and balanced
body together. Strings, character constants and comments are alternatives of
the same scan, so a brace or a ``def`` inside them is never taken for code.

C and C++ are first settled: preprocessor lines are blanked, and of #if/#else
branches that open or close braces unevenly only one is kept, so that bodies
balance as one configuration of the compiler would see them. Namespaces, classes
and ``extern "C"`` blocks of C++ are entered.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = regex.VERSION1 | regex.MULTILINE

# Parts that the C-like languages share. A body is braces in balance, a paren
# group parentheses in balance; strings and comments inside count as one item.
# What isn't closed reaches to the end; ``_matches`` then blanks what is never
# closed and goes on, so broken text is read twice at most.
_SHARED = r"""
(?<lin>//[^\n]*+)
(?<body>\{(?:[^{}"'/]++|(?&str)|(?&chr)|(?&blk)|(?&lin)|(?&body)|[/'"])*+(?:\}|\Z))
(?<paren>\((?:[^()"'/]++|(?&str)|(?&chr)|(?&blk)|(?&lin)|(?&paren)|[/'"])*+(?:\)|\Z))
(?<square>\[(?:[^\[\]"'/]++|(?&str)|(?&chr)|(?&blk)|(?&square)|[/'])*+\])
(?<run>(?&lin)(?:\r?\n[ \t]*+(?&lin))*+)
"""
_C_PARTS = r"""
(?<str>"(?:[^"\\\n]|\\[\s\S])*+")
(?<chr>'(?:[^'\\\n]|\\[\s\S])++')
(?<blk>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))
(?<lead>(?:[A-Za-z_]\w*+|\*|(?&paren)|\[(?&square)\]|\s|(?&blk)(?=[ \t]*[\w*]))*+)
(?<tail>(?:(?:(?&blk)|(?&lin))\s*+)*+)
(?<old>[A-Za-z_][\w\s*]*+\(\s*+[A-Za-z_]\w*+(?:\s*+,\s*+[A-Za-z_]\w*+)*+\s*+\)\s*+(?:[A-Za-z_][\w\s*\[\],]*+;\s*+)++)
"""
# C++: names with ::, templates, operators, and the initialisers of constructors.
_CPP_PARTS = r"""
(?<str>R"(?<mark>[^()\\\s"]*+)\([\s\S]*?\)(?P=mark)"|"(?:[^"\\\n]|\\[\s\S])*+")
(?<chr>(?<![0-9A-Fa-f])'(?:[^'\\\n]|\\[\s\S])++')
(?<blk>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))
(?<angle><(?:[^<>(){};"']++|(?&angle)|(?&paren))*+>)
(?<lead>(?:operator\s*+(?:\(\s*+\)|[^\s\w()]++)|[A-Za-z_~]\w*+|::|->|[*&,]|(?&angle)|(?&paren)|\[(?&square)\]|\s|(?&blk)(?=[ \t]*[\w*]))*+(?::(?!:)\s*+(?:[\w:]++(?&angle)?+\s*+(?:(?&paren)|(?&body))\s*+,?+\s*+)++)?+)
(?<tail>(?:(?:(?&blk)|(?&lin))\s*+)*+)
(?<old>(?!))
(?<scope>(?:(?:inline\s++)?+namespace\b[^{};()"'=]*+|(?:template\s*+(?&angle)\s*+)*+(?:class|struct|union)\b[^{};()"'=]*+|(?:public|private|protected)\s*+:(?!:)|extern\s*+"[^"\n]*+"\s*+)(?:\{|(?<=:)))
"""
_RUST_PARTS = r"""
(?<chr>r(?<hash>\#*)"[\s\S]*?"(?P=hash)|'(?:[^'\\\n]|\\(?:x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]+\}|.))')
(?<str>"(?:[^"\\]|\\[\s\S])*+(?:"|\Z))
(?<blk>/\*(?:[^*/]++|\*(?!/)|/(?!\*)|(?&blk))*+(?:\*/|\Z))
(?<attr>\#!?(?&square))
(?<head>(?:[^{};"'/()\[\]]++|(?&paren)|(?&square)|(?&str)|(?&chr)|(?&blk)|(?&lin)|['/])*+)
"""


def _define(*parts: str) -> str:
    return "(?(DEFINE)" + "".join(line.strip() for part in parts for line in part.strip().splitlines()) + ")"


_DOC = r"(?:^[ \t]*+(?<doc>(?&blk)|(?&run))[ \t]*+\r?\n[ \t]*+)?+"

# The scan of C: the signature may end in attributes and comments before the body.
def _c_pattern(parts: str, enter: str) -> str:
    return (
        _define(_SHARED, parts)
        + r"(?:^[ \t]*+\#(?:[^\n\\/\"]++|\\[\s\S]|(?&blk)|(?&str)|[/\"])*+"
        + "|" + enter
        + "|" + _DOC + r"(?<![\w*])(?<sig>(?&old)(?=\{)|(?=[A-Za-z_~])(?&lead)(?&tail))(?<code>(?&body))"
        + r"|(?&blk)|(?&run)|(?&str)|(?&chr)|(?&body)|(?=[A-Za-z_~])(?&lead))"
    )


C_PATTERN = _c_pattern(_C_PARTS, r"extern\s*+\"[^\"\n]*+\"\s*+\{")
CPP_PATTERN = _c_pattern(_CPP_PARTS, "(?&scope)")
RUST_PATTERN = (
    _define(_SHARED, _RUST_PARTS)
    + r"(?:macro_rules!\s*+\w*+\s*+(?:(?&body)|(?&paren))"
    + "|" + _DOC + r"(?:(?&attr)\s*+)*+(?<![\w])(?<sig>(?:(?:pub(?:\s*+(?&paren))?+|const|async|unsafe|default|extern(?:\s*+\"[^\"]*+\")?+)\s++)*+fn\s++(?:r\#)?+(?<name>\w++)(?&head))(?<code>(?&body))"
    + r"|(?&blk)|(?&run)|(?&chr)|(?&str)|\w++)"
)
PYTHON_PATTERN = (
    "(?(DEFINE)"
    r"(?<long>\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+''')"
    r"(?<short>\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+')"
    r"(?<text>(?&long)|(?&short))"
    r"(?<note>\#[^\n]*+)"
    r"(?<group>[(\[{](?:[^()\[\]{}\"'#]++|(?&text)|(?&note)|(?&group)|[\"'])*+[)\]}])"
    r")"
    r"(?:^(?<ind>[ \t]*+)(?<sig>(?:async[ \t]++)?+def[ \t]++(?<name>\w++)\s*+(?:\[(?:[^\[\]]++|(?&group))*+\])?+(?&group)(?:[^:\n#\"'()\[\]{}]++|(?&group)|(?&text))*+:)"
    r"(?:[ \t]*+(?:(?&note)?+\r?\n[ \t]*+)*+(?<doc>[rRuU]?+(?:(?&text)(?:[ \t]*+(?&text))*+))(?=[ \t]*+(?:\r?\n|;|\#|\Z)))?+"
    r"|[A-Za-z_0-9]*+(?&text)|(?&note)|\w++)"
)

# Fixed words. Lines that begin with one of these describe parameters or results.
PARAMETER_LINE = regex.compile(
    r"^(?:[@\\](?:param|arg|argument|return|returns|retval|ret|tparam|throws|exception|type|rtype)\b.*"
    r"|@\w[\w.\-\[\]]*\s*:.*|@\.\.\.\s*:.*"
    r"|:(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raises?|raise|except|exception)\b[^:]*:.*"
    r"|(?:Returns?|Return value|Returned value|Yields?|Args?|Arguments|Params?|Parameters|Raises|Context|Retval)\s*:.*"
    r"|\#+\s*(?:Returns?|Arguments|Parameters|Errors|Panics)\s*$)",
    regex.IGNORECASE,
)
# Fixed words: marks that say nothing.
MARKS = regex.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|NOTE|BUG|OPTIMIZE|WIP)\b")
_CONTROL = {"if", "for", "while", "switch", "do", "else", "return", "sizeof", "case", "defined", "struct", "union", "enum", "class", "namespace"}
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|[^\W_\p{Han}\p{Hiragana}\p{Katakana}](?:[\w'’\-]*[^\W_])?", regex.VERSION1)
_CALLED = regex.compile(r"(\w++)(?:\(\))?+")
LEAST_WORDS = 4


@lru_cache(maxsize=None)
def _compiled(language: str) -> regex.Pattern:
    return regex.compile({"c": C_PATTERN, "cpp": CPP_PATTERN, "rust": RUST_PATTERN, "python": PYTHON_PATTERN}[language], FLAGS)


def language_of(path: str | None, content_type: str | None) -> str | None:
    """By the extension of the path; C for C types whose path has none."""
    end = (path or "").rpartition("/")[2].rpartition(".")[2].lower() if "." in (path or "") else ""
    by_end = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "rs": "rust", "py": "python", "pyi": "python"}
    if end in by_end:
        return by_end[end]
    return "c" if not end and (content_type or "").lower() in ("c_source", "c_header") else None


@lru_cache(maxsize=None)
def _names(language: str) -> regex.Pattern:
    angle = "|(?&angle)" if language == "cpp" else ""
    parts = {"c": _C_PARTS, "cpp": _CPP_PARTS}[language]
    return regex.compile(_define(_SHARED, parts) + r"(?<word>~?+[A-Za-z_]\w*+)|(?<star>\*)|(?<args>(?&paren))|(?&blk)|(?&lin)|(?&square)" + angle, FLAGS)


_SINGLE_COLON = regex.compile(r"(?<!:):(?!:)[\s\S]*")
_SYSCALL = regex.compile(r"\b(?:COMPAT_)?SYSCALL_DEFINE\d\s*\(\s*(\w+)")


def _c_name(signature: str, language: str = "c") -> str | None:
    """The identifier that the body belongs to: one followed by parentheses.

    A candidate that follows another word or a star is preferred to attributes,
    which stand alone or behind parentheses; plain names to reserved ones. The
    definition of a system call is named by its first argument.
    """
    if language == "cpp":
        signature = _SINGLE_COLON.sub("", signature)  # initialisers of a constructor
    found: list[tuple[bool, bool, str]] = []
    before, last = "", ""
    for m in _names(language).finditer(signature):
        if m.group("word"):
            before, last = ("word" if last and last != ")" else last), m.group()
        elif m.group("star"):
            before, last = last, "*"
        elif m.group("args"):
            if last and last not in ("*", ")"):
                if last in _CONTROL:
                    return None
                found.append((not last.startswith("__"), before in ("word", "*"), last))
            before, last = last, ")"
    name = max(found, key=lambda f: f[:2])[2] if found else None
    if name and "SYSCALL_DEFINE" in name and (call := _SYSCALL.search(signature)):
        return call.group(1)
    return name


_BREAK = regex.compile("\n")
_LINES = regex.compile(r"\r?\n|\r")
_OPENING = regex.compile(r"[ \t]*(?:/\*+!?<?|\*+/|\*+(?!\w)|//+[!<]?)?")
_CLOSING = regex.compile(r"\**/?[ \t]*$")
_COMMAND = regex.compile(r"[@\\](?:brief|short|details|fn|note)\b")


def clean(doc: str, name: str) -> str:
    """The description without comment marks, parameter lines, marks and the name itself."""
    lines: list[str] = []
    skipping, indent = False, 0
    for raw in _LINES.split(doc):
        line = raw[_OPENING.match(raw).end() :].rstrip()
        if line.endswith("*/") or raw.rstrip().endswith("*/"):
            line = _CLOSING.sub("", line)
        text = line.strip()
        depth = len(line) - len(line.lstrip())
        if text[:1] and PARAMETER_LINE.match(text):
            skipping, indent = True, depth
            continue
        if skipping and text and depth > indent:
            continue
        skipping = False
        lines.append(text)
    text = "\n".join(lines)
    text = MARKS.sub("", _COMMAND.sub("", text))
    text = _CALLED.sub(lambda m: "" if m.group(1) == name else m.group(), text) if name in text else text
    return text.strip(" \t\n:-–—")


def is_trivial(description: str) -> bool:
    return sum(1 for _ in zip(range(LEAST_WORDS), _WORD.finditer(description))) < LEAST_WORDS


_LITERAL = regex.compile(r"\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)'''|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'")


def _docstring(literal: str) -> str:
    return "\n".join(next((x for x in groups if x), "") for groups in _LITERAL.findall(literal))


def _python_body(text: str, m: regex.Match) -> str:
    """The lines after the signature that are indented deeper than it."""
    end, depth = m.end("sig"), len(m.group("ind").expandtabs())
    line_end = text.find("\n", max(end, m.end()))
    stop = len(text) if line_end < 0 else line_end + 1
    while stop < len(text):
        nxt = text.find("\n", stop)
        nxt = len(text) if nxt < 0 else nxt + 1
        line = text[stop:nxt]
        if line.strip() and len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= depth and not line.lstrip().startswith("#"):
            break
        stop = nxt
    return text[end:stop].rstrip()


@lru_cache(maxsize=None)
def _marks(language: str) -> regex.Pattern:
    parts = {"c": _C_PARTS, "cpp": _CPP_PARTS, "rust": _RUST_PARTS}[language]
    return regex.compile(_define(_SHARED, parts) + r"(?:(?&str)|(?&chr)|(?&blk)|(?&lin)|(?<bracket>[{}()]))", FLAGS)


# Whatever can hide or be a brace or a preprocessor line; each begins with a fixed character, so the search is fast.
_SKIPPED = r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|(?P<line>#)|(?P<brace>[{}])"
_SETTLING = {"c": re.compile(_SKIPPED, re.S), "cpp": re.compile(r"R\"([^()\\\s\"]*)\(.*?\)\1\"|" + _SKIPPED, re.S)}
_LINE = re.compile(r"#(?:[^\n\\/\"]|\\.|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|[/\"])*", re.S)
_ALTERNATIVE = re.compile(r"^[ \t]*#[ \t]*el(?:se|if)", re.M)
_BRANCH = regex.compile(r"\#[ \t]*+(?:(?<open>if\w*+)|(?<next>el\w++)|(?<end>endif))(?<rest>[^\n]*+)")
_INK = regex.compile(r"[^\s]")


def settled(text: str, language: str = "c") -> str:
    """The text without preprocessor lines, of the same length; as it is where no #if has a second branch.

    Branches of one #if that each hold as many opened as closed braces all stay.
    Where one doesn't, the branches are alternatives for the same code: the first
    is kept (the second after ``#if 0``) and the others are blanked.
    """
    if not _ALTERNATIVE.search(text):
        return text
    blank: list[tuple[int, int]] = []
    # of each open #if: its branches as [start, end, opened - closed, lowest], whether the first is never taken
    open_ifs: list[tuple[list[list[int]], bool]] = []
    whole = [0, 0, 0, 0]

    def count(branch: list[int], by: int, low: int = 0) -> None:
        branch[3] = min(branch[3], branch[2] + low, branch[2] + by)
        branch[2] += by

    search, at = _SETTLING[language].search, 0
    while (m := search(text, at)) is not None:
        at = m.end()
        if brace := m.group("brace"):
            count(open_ifs[-1][0][-1] if open_ifs else whole, 1 if brace == "{" else -1)
            continue
        if not m.group("line") or text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t"):
            continue
        m = _LINE.match(text, m.start())
        at = m.end()
        blank.append(m.span())
        b = _BRANCH.match(m.group())
        if not b:
            continue
        if b.group("open"):
            open_ifs.append(([[m.end(), 0, 0, 0]], b.group("rest").split("/")[0].strip() == "0"))
        elif open_ifs:
            branches, never = open_ifs[-1]
            branches[-1][1] = m.start()
            if b.group("next"):
                branches.append([m.end(), 0, 0, 0])
                continue
            open_ifs.pop()
            outer = open_ifs[-1][0][-1] if open_ifs else whole
            if len(branches) > 1 and any(d or low < 0 for _, _, d, low in branches):
                kept = branches[1 if never else 0]
                blank += [(a, z) for a, z, _, _ in branches if a != kept[0]]
                count(outer, kept[2], kept[3])
            else:
                for _, _, d, low in branches:
                    count(outer, d, low)
    out, at = [], 0
    for a, z in sorted(blank):
        if z > at:
            out += [text[at:a], _INK.sub(" ", text[max(a, at) : z])]
            at = z
    return "".join([*out, text[at:]])


def unclosed(text: str, language: str) -> list[int]:
    """The places of braces and parentheses that are never closed, strings and comments left out.

    A brace closes the last open one, so of braces that are split over #ifdef and
    #else the first is left. Each brace here is a body that can't be told.
    """
    if language == "python":
        return []
    opened: list[int] = []
    never: list[int] = []
    braces = 0
    for m in _marks(language).finditer(text):
        mark = m.group("bracket")
        if mark in ("{", "("):
            opened.append(m.start())
            braces += mark == "{"
        elif mark == ")" and opened and text[opened[-1]] == "(":
            opened.pop()
        elif mark == "}" and braces:
            while text[opened[-1]] == "(":
                never.append(opened.pop())
            opened.pop()
            braces -= 1
    return sorted(never + opened)


def _matches(text: str, language: str) -> Iterator[tuple[regex.Match, int]]:
    """The functions in the text, those inside Rust bodies included, with the place of their text."""
    parts = [(text, 0)]
    while parts:
        part, base = parts.pop()
        scan = _compiled(language).finditer(part)
        whole = False
        while (m := next(scan, None)) is not None:
            if language != "python" and not whole and m.end() == len(part):
                whole = True
                if never := [x for x in unclosed(part, language) if x >= m.start()]:
                    pieces = [part[a + 1 : b] for a, b in zip([-1, *never], [*never, len(part)])]
                    part = ";".join(pieces)  # ends the signature before it
                    scan = _compiled(language).finditer(part, m.start())
                    continue
            if not m.group("sig"):
                continue
            yield m, base
            if language == "rust" and "fn" in (code := m.group("code")) and code.endswith("}"):
                parts.append((code[1:-1], base + m.start("code") + 1))


def extract(text: str, language: str) -> list[tuple[str, str, str, str, int]]:
    """(name, signature, description, code, first line) of each documented function, in the order of the text.

    Functions of one name, methods of different classes for example, all come
    out. A function whose own brace is never closed is left out (see
    ``unclosed``); those that follow it aren't.
    """
    found: list[tuple[str, str, str, str, int]] = []
    breaks: list[int] | None = None
    c_like = language in ("c", "cpp")
    for m, base in _matches(settled(text, language) if c_like else text, language):
        doc = m.group("doc")
        if doc is None or language != "python" and not m.group("code").endswith("}"):
            continue
        name = _c_name(m.group("sig"), language) if c_like else m.group("name")
        if not name:
            continue
        description = clean(_docstring(doc) if language == "python" else doc, name)
        if is_trivial(description):
            continue
        code = _python_body(text, m) if language == "python" else text[base + m.start("code") : base + m.end("code")]
        if breaks is None:
            breaks = [b.start() for b in _BREAK.finditer(text)]
        found.append((name, " ".join(m.group("sig").split()), description, code, bisect.bisect_left(breaks, base + m.start("sig")) + 1))
    return sorted(found, key=lambda f: f[4])


_PAIRS = "content_id long, func_name string, nth int, language string, signature string, description string, code string, line int"


def pairs(df: DataFrame, key: str, path: str, content_type: str, text: str) -> DataFrame:
    """``content_id, func_name, nth, language, signature, description, code, line``.

    One row per documented function or method of each source file; nth numbers
    those of one name in a file from 0. Files of other languages, null and empty
    texts give no rows; nor do functions whose own brace is never closed.
    Repeated rows are taken one by one. Other columns aren't read, whatever their
    names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for k, p, c, t in zip(batch["k"], batch["p"], batch["c"], batch["t"]):
                language = language_of(p, c)
                if not t or not language:
                    continue
                seen: dict[str, int] = {}
                for name, sig, doc, code, line in extract(t, language):
                    seen[name] = seen.get(name, -1) + 1
                    rows.append((k, name, seen[name], language, sig, doc, code, line))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PAIRS.split(", ")]).astype({"content_id": "Int64"})

    narrow = df.select(F.col(key).cast("long").alias("k"), F.col(path).alias("p"), F.col(content_type).alias("c"), F.col(text).alias("t"))
    return narrow.mapInPandas(run, _PAIRS)
