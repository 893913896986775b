"""Functions and documentation: literal cases for each language."""

from __future__ import annotations

import pytest

from corvine.llm import functions_docs as fd


def names(text: str, language: str) -> list[str]:
    return [f[0] for f in fd.extract(text, language)]


C = r'''
/* This file has four words at least. */

#define MACRO(x) do { \
	foo(); } while (0)

/* A macro that is documented with many words. */
#define OTHER(x) do { foo(); } while (0)

/* A structure that is documented with many words. */
struct thing {
	int a;
};

/* A declaration that is documented with many words. */
int declared(int a);

/** Documented well enough by these words. */
__attribute__((noinline))
static int
good(int a, const char *b)
{
	char *s = "} /* not a comment";	/* { */
	if (a == '}')
		return 1;
	/* Words that stand before a call in a body. */
	call(a) ;
	return 0;
}

// Two line comments
// that run together here
void __good2(void) {
}

/* Not directly above the function at all. */

int far(void)
{
}

/* TODO good3 */
int good3(void) { return 0; }

/**
 * good4() - Short.
 * @a: a parameter with a long description
 * Return: nothing that anybody would need
 */
int good4(int a) { return 0; }

extern "C" {
/* Inside a linkage block it counts. */
int good5(int a) __acquires(lock) { return 0; }
}

static const char *text = "/* Text in a string isn't code. */\
int fake(void) { }";

/*
int commented_out(void) { }
*/
/* Written over by a table, no function. */
static const struct ops table = { .a = good };
'''


def test_c():
    assert names(C, "c") == ["good", "__good2", "good5"]
    assert names(C.replace("\n", "\r\n"), "c") == ["good", "__good2", "good5"]


RUST = r'''
//! File comment of some words here.

/// Keeps a lifetime and a brace '{' apart.
#[inline]
pub(crate) fn one<'a>(x: &'a str) -> char {
    let _ = "}";
    '{'
}

impl T {
    /** Block documentation of a method counts. */
    pub async unsafe fn two(&self) -> Result<(), E> where E: X { /* } */ }
    /// A declaration in a trait has none.
    fn three(&self);
}
/// one two three
fn four() {}
'''


def test_rust():
    assert names(RUST, "rust") == ["one", "two"]


PYTHON = r'''
"""def nothing(): 'inside a module docstring'"""

class A:
    """A class with a docstring of words."""

    @deco("def x():")
    async def one(self, a: dict = {"k": ")"}) -> "int":
        # a comment first
        r"""The first docstring has enough words."""
        def inner():
            'The inner function also has words.'
        return 1

    def two(self):
        usage = """Only a string that is assigned."""

def three(): "One line with enough words here"

def four():
    """Args: nothing
    :param x: a long description of a parameter
    """

def five():
    """Not a docstring {} at all""".format(1)
'''


def test_python():
    assert names(PYTHON, "python") == ["one", "inner", "three"]
    code = {f[0]: f[3] for f in fd.extract(PYTHON, "python")}
    assert code["one"].rstrip().endswith("return 1") and "usage" not in code["one"]


def test_broken_input_ends():
    assert names("/* Some words that document it well */\nint f(void) { " + "{ \" ' /* " * 2000, "c") == []
    assert names("(" * 3000, "c") == [] and names("", "python") == []
    assert names("def f(" * 2000, "python") == []


def test_clean():
    assert fd.clean("/**\n * f() - Say it now, please, once.\n * @a: x\n *    more of a\n * Return: y\n */", "f") == "Say it now, please, once."
    assert fd.is_trivial("three words only") and not fd.is_trivial("now it is four")


def test_frame(spark):
    long = "/* Words that document it well here */\nint f%d(void) { return 0; }\n"
    rows = [
        (1, "a.c", "C_SOURCE", C, "clash"),
        (2, None, "c_source", C, None),
        (3, "b.txt", "C_SOURCE", C, None),
        (4, "c.c", None, None, None),
        (5, "d.c", None, "", None),
        (None, "e.py", None, PYTHON, None),
        (6, "f.c", "C_SOURCE", "".join(long % i for i in range(20_000)), None),
        (7, "g.rs", "source_file", RUST, None),
        (7, "g.rs", "source_file", RUST, None),
    ]
    df = spark.createDataFrame(rows, "id long, source_path string, content_type string, content string, func_name string")
    got = fd.pairs(df, "id", "source_path", "content_type", "content").groupBy("content_id").count().collect()
    assert {r.content_id: r["count"] for r in got} == {1: 3, 2: 3, None: 3, 6: 20_000, 7: 4}
    assert fd.pairs(df.limit(0), "id", "source_path", "content_type", "content").count() == 0
    lines = fd.pairs(df.filter("id = 6"), "id", "source_path", "content_type", "content").agg({"line": "max"}).first()[0]
    assert lines == 40_000


_G = "/** Adds two small numbers together. */\nint add(int a, int b) {\n  return a + b;\n}\n"
_FN = "/// Adds two small numbers together.\nfn add(a: u8) -> u8 {\n    a\n}\n"


@pytest.mark.parametrize(
    "language, broken, rest, n",
    [
        ("c", "/** Opens a thing and loses it. */\nint lost(int a) {\n  if (a) {\n    a++;\n}\n\n", _G, 1),
        ("c", "#ifdef A\nint two(int a) {\n#else\nint two(long a) {\n#endif\n  return 0;\n}\n\n", _G, 1),
        ("c", "int call = f(1, (2;\nint x[] = { 1, '{', \n\n", _G, 3),
        ("rust", "/// Opens a thing and loses it.\nfn lost(a: u8) {\n    if a {\n}\n\n", _FN, 1),
        ("c", "int f(void) {\n" * 20_000, _G, 20_000),
    ],
)
def test_functions_after_an_unclosed_brace_are_found(language, broken, rest, n):
    text = broken + rest
    assert len(fd.unclosed(text, language)) == n and fd.unclosed(rest, language) == []
    found = fd.extract(text, language)
    assert [(f[0], f[4]) for f in found] == [("add", broken.count("\n") + 2)]
    assert found[0][3] == rest[rest.index("{") : rest.rindex("}") + 1]


def test_rust_array_types_in_the_head():
    doc = "/// Gives a key of fixed length.\n"
    heads = ["fn a() -> [u8; 32]", "fn b<T>(x: [T; 2]) -> &'static [[u8; 4]; 2] where [T; 2]: Sized", "fn c() -> [u8; { 1 + 2 }]", "fn d(x: &[u8]) -> &[u8]"]
    text = "".join(f"{doc}{h} {{\n    todo()\n}}\n\n" for h in heads) + f"{doc}fn declared() -> [u8; 32];\n"
    assert [(f[1], f[3]) for f in fd.extract(text, "rust")] == [(h, "{\n    todo()\n}") for h in heads]


D = "/* This does a thing for real. */\n"


def places(text, language="c"):
    return [(f[0], f[4]) for f in fd.extract(text, language)]


def test_braces_split_over_branches():
    split = D + "int a(int x)\n{\n#ifdef FOO\n\tif (x) {\n#else\n\tif (!x) {\n#endif\n\t\treturn 1;\n\t}\n\treturn 0;\n}\n" + D + "int b(void) { return 1; }\n"
    assert places(split) == [("a", 2), ("b", 14)]
    assert fd.extract(split, "c")[0][3].count("#") == 3  # the code is that of the text
    heads = "#ifdef A\n" + D + "int a(int x)\n{\n#else\n" + D + "int a(long x)\n{\n#endif\n return 1;\n}\n" + D + "int b(void) { return 1; }\n"
    assert [n for n, _ in places(heads)] == ["a", "b"]
    both = "#ifdef A\n" + D + "int a(int x) { return 1; }\n#elif B\n" + D + "int c(long x)\n{ return 2; }\n#else\n#define c '{'\n#endif\n" + D + "int b(void) { return 1; }\n"
    assert [n for n, _ in places(both)] == ["a", "c", "b"]
    never = D + "int a(void)\n{\n#if 0 /* off */\n\tif (x) {\n\t{\n#else\n\t{\n#endif\n\t}\n}\n" + D + "int b(void) { }\n"
    assert [n for n, _ in places(never)] == ["a", "b"]
    nested = D + "int a(void)\n{\n#if A\n#if B\n\tif (x) {\n#else\n\t{\n#endif\n#else\n\t{\n#endif\n\t}\n}\n" + D + "int b(void) { }\n"
    assert [n for n, _ in places(nested)] == ["a", "b"]


def test_settling_keeps_the_length_and_what_is_quoted():
    text = "/*\n#else\n{ */\nchar *s = \"\n#else {\";\n#if A\n{\n#else /* two\nlines */ {\n#endif\n}\n  x #else {\n"
    out = fd.settled(text)
    assert len(out) == len(text) and out.count("\n") == text.count("\n")
    assert "/*\n#else\n{ */" in out and "#if A" not in out and "#endif" not in out
    assert fd.settled("#if A\n#else") == "     \n     " and fd.settled("#else\n#endif\n") == "     \n      \n"


def test_old_definitions_and_system_calls():
    text = D + "int a(x, y)\n\tint x;\n\tchar *y;\n{ return 1; }\n" + D + "SYSCALL_DEFINE2(open, const char __user *, name, int, flags)\n{ return 1;\n}\nDECLARE(x)\nint z;\n" + D + "int b(void) { }\n"
    assert places(text) == [("a", 2), ("open", 7), ("b", 13)]


def test_cpp_scopes():
    text = (
        "namespace n {\n" + D + "int a() { return 1'000; }\nclass Foo : public Bar {\npublic:\n" + D + "  Foo(int x) : x_{x}, y_(2) { go(); }\n" + D + "  int run() const override { return 1; }\n"
        + D + "  template <typename T> T get(T t) { return t; }\n};\nclass Other {\n" + D + "  int run() { return R\"x(}})x\"[0]; }\n};\n}\n" + D + "void Foo::sub(int a) { }\n" + D + "Foo::~Foo() { }\n"
    )
    assert [n for n, _ in places(text, "cpp")] == ["a", "Foo", "run", "get", "run", "sub", "~Foo"]
    assert fd.language_of("x/y.cpp", None) == "cpp"


def test_methods_of_one_name_all_come_out(spark):
    text = 'class A:\n    def run(self):\n        """Runs the thing a first time."""\n        return 1\n\nclass B:\n    def run(self):\n        """Runs the thing a second time."""\n        return 2\n'
    df = spark.createDataFrame([(1, "a.py", "source_file", text)], "id long, path string, kind string, content string")
    got = fd.pairs(df, "id", "path", "kind", "content").orderBy("line").collect()
    assert [(r.func_name, r.nth, r.line) for r in got] == [("run", 0, 2), ("run", 1, 7)] and "second" in got[1].description
