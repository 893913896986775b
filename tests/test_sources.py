"""C sources, configuration files, diffs and graph files on literal texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvine.operators import extraction as ex
from corvine.sources import config_files as cf
from corvine.sources import csource as cs
from corvine.sources import graph_files as gf

C = r'''#include <linux/fs.h>
#include "local.h"
#define MAX_SIZE 10
#define ADD(a, b) ((a) + (b))
static int helper(int x) { return x; }
int declared(int a);
struct thing { int a; };
typedef unsigned long word_t;
static const int value = 3;
/* int commented(void) { } */
#ifdef CONFIG_A
int __init main_function(void)
{
	helper(1); /* helper(9) */
	file->f_op->read(3);
#ifndef CONFIG_B
	CALL_HELPER(x);
#else
	helper(2);
#endif
	(*op)(1);
	if (x) foo("bar(");
}
#endif
static const struct file_operations fops = {
	.read = my_read,
	.write = &my_write,
};
EXPORT_SYMBOL_GPL(main_function);
module_param(debug, int, 0644);
MODULE_PARM_DESC(debug, "Level of talk");
SYSCALL_DEFINE3(read, int, fd)
module_init(start_up);
'''


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, content string, name string")


def test_parse():
    got = {(n, k, a) for n, k, a, *_ in cs.parse(C)}
    assert {("helper", "function", 5), ("declared", "declaration", 6), ("thing", "struct", 7), ("word_t", "typedef", 8), ("value", "variable", 9), ("main_function", "function", 12)} <= got
    assert "commented" not in {n for n, *_ in got}
    assert dict((r[0], r[5]) for r in cs.parse(C))["helper"] == "static"


def test_calls():
    got = [(callee, line, kind, guard, depth) for caller, callee, line, kind, guard, depth in cs.calls(C) if caller == "main_function"]
    assert got == [
        ("helper", 14, "conditional", "CONFIG_A", 1),
        ("read", 15, "indirect", "CONFIG_A", 1),
        ("CALL_HELPER", 17, "macro", "!CONFIG_B", 2),
        ("helper", 19, "conditional", "CONFIG_B", 2),
        ("op", 21, "indirect", "CONFIG_A", 1),
        ("foo", 22, "conditional", "CONFIG_A", 1),
    ]


def test_broken_sources_end(spark):
    texts = ["int f(void) { " * 500, '"' * 1000, "/* open", "", None, "#if\n#else\n#endif\n#endif\n"]
    df = frame(spark, *texts)
    assert cs.symbol_rows(df, "id", "content").count() >= 0 and cs.call_rows(df, "id", "content").filter("file_id > 0").count() == 0


def test_columns(spark):
    df = frame(spark, C, None, "")
    inc = [(r.header, r.quoted) for r in cs.includes(df, "id", "content").orderBy("pos").collect()]
    assert inc == [("linux/fs.h", False), ("local.h", True)]
    mac = [(r.name, r.parameters) for r in cs.macros(df, "id", "content").orderBy("pos").collect()]
    assert mac == [("MAX_SIZE", None), ("ADD", ["a", "b"])]
    assert df.select(cs.attributes(F.lit("int __init f(void) __must_check")).alias("a")).first().a == ["__init", "__must_check"]
    found = {(r.kind, r.name, r.detail, r.line) for r in ex.patterns(df, "id", "content").collect()}
    assert ("export", "main_function", "_GPL", 29) in found and ("syscall", "read", "3", 32) in found and ("module_init", "start_up", "module_init", 33) in found
    described = ex.parameters_with_descriptions(ex.patterns(df, "id", "content"), "id").collect()
    assert [(r.name, r.type, r.description) for r in described] == [("debug", "int", "Level of talk")]
    ops = {(r.table_name, r.field, r.function) for r in ex.operation_tables(df, "id", "content").collect()}
    assert ops == {("fops", "read", "my_read"), ("fops", "write", "my_write")}
    assert {r.kind for r in ex.entry_points(df, "id", "content").collect()} == {"syscall", "module_init", "file_operation"}
    names = spark.createDataFrame([("__se_sys_read",), ("sys_open",), ("vfs_read",)], "name string")
    assert sorted(r.syscall for r in ex.syscall_names(names).collect()) == ["open", "read"]


CONFIG = """#
# Linux/x86 6.1.0 Kernel Configuration
#
CONFIG_64BIT=y
CONFIG_HZ=1000
CONFIG_LOCALVERSION="-test"
CONFIG_BASE=0xff00
CONFIG_EXT4_FS=m
# CONFIG_MODULES is not set
CONFIG_HZ=250
"""


def test_config(spark):
    lines = cf.lines_of(frame(spark, CONFIG, None), "id", "content")
    got = {r.name: (r.type, r.value) for r in cf.config_options(lines).collect()}
    assert got == {"CONFIG_64BIT": ("tristate", "y"), "CONFIG_HZ": ("int", "250"), "CONFIG_LOCALVERSION": ("string", "-test"), "CONFIG_BASE": ("hex", "0xff00"), "CONFIG_EXT4_FS": ("module", "m"), "CONFIG_MODULES": ("not_set", None)}
    head = cf.config_header(lines).first()
    assert (head.arch, head.version) == ("x86", "6.1.0")
    context = cf.config_map(cf.config_options(lines)).first().context
    assert context["CONFIG_EXT4_FS"] and not context["CONFIG_MODULES"]


KCONFIG = """menu "Top"
config VFS
	bool "Virtual"
	default y
	help
	  The layer.
	  default n isn't read here.

config PROC_FS
	tristate "proc"
	depends on VFS && NET
	help
	  Text.
endmenu
config LAST
	int
"""


def test_kconfig(spark):
    got = {r.name: r for r in cf.kconfig_options(cf.lines_of(frame(spark, KCONFIG), "id", "content")).collect()}
    assert (got["VFS"].type, got["VFS"].default, got["VFS"].help) == ("bool", "y", "The layer.\ndefault n isn't read here.")
    assert got["PROC_FS"].depends == ["VFS", "NET"] and got["LAST"].type == "int" and got["LAST"].help == ""


DIFF = """diff --git a/fs/a.c b/fs/a.c
--- a/fs/a.c
+++ b/fs/a.c
@@ -10,4 +10,5 @@ int x
 context
-int old_name(int a)
+int old_name(int a, int b)
+int fresh(void)
 more
@@ -30,2 +31,2 @@
-#define GONE 1
+struct added {
"""


def test_diff(spark):
    rows = cf.diff_lines(cf.lines_of(frame(spark, DIFF), "id", "content"))
    got = [(r.path, r.sign, r.new_line) for r in rows.orderBy("n").collect()]
    assert got == [("fs/a.c", " ", 10), ("fs/a.c", "-", 11), ("fs/a.c", "+", 11), ("fs/a.c", "+", 12), ("fs/a.c", " ", 13), ("fs/a.c", "-", 31), ("fs/a.c", "+", 31)]
    changed = {(r.symbol, r.kind, r.change) for r in cf.changed_symbols(rows).collect()}
    assert changed == {("old_name", "function", "modified"), ("fresh", "function", "added"), ("GONE", "macro", "removed"), ("added", "struct", "added")}


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a<"&>', None), (2, "b", "Macro")], "id long, name string, type string")
    edges = spark.createDataFrame([(1, 2, None), (1, 9, "x"), (1, 2, None)], "source long, target long, type string")
    n, e = gf.read_json_lines(gf.json_lines(nodes, edges))
    assert {(r.id, r.name, r.type) for r in n.collect()} == {(1, 'a<"&>', "Function"), (2, "b", "Macro")}
    assert [(r.source, r.target, r.type) for r in e.collect()] == [(1, 2, "Direct")] * 2
    body = [r.value for r in gf.graphml_lines(nodes, edges).orderBy("part").collect()]
    (tmp_path / "g.graphml").write_text("<graphml><graph>\n" + "\n".join(body) + "\n</graph></graphml>")
    n, e = gf.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r.id, r.name, r.type) for r in n.collect()} == {(1, 'a<"&>', "Function"), (2, "b", "Macro")} and e.count() == 3
    assert '  n1 [label="a<\\"&>"];' in {r.value for r in gf.dot_lines(nodes, edges).collect()}
    assert sorted(r.weight for r in gf.edge_list(edges).collect()) == [1, 2]


def test_chunks_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(g, i, s) for g in ("a", None) for i, s in enumerate([5, 5, 1, 30, 4, 6, 1])], "grp string, pos int, size int")
    cut = gf.cut_by_size(rows, "grp", "pos", "size", 10)
    assert [r.chunk for r in cut.filter("grp = 'a'").orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3, 4] and cut.count() == 14
    made = gf.manifest(spark.createDataFrame([("fs/ext4", 1, "x"), ("fs/ext4", 2, "yy")], "grp string, n int, text string"), "grp", "n", "text").collect()
    assert [(r.chunk_id, r.size_bytes, len(r.checksum)) for r in made] == [("fs_ext4_001", 1, 64), ("fs_ext4_002", 2, 64)]
    declared = spark.createDataFrame([("a", 1, "F"), ("b", 2, "f"), ("c", 1, "f"), ("d", 1, "e")], "chunk_id string, size_bytes long, checksum string")
    there = spark.createDataFrame([("a", 1, "f"), ("b", 1, "f"), ("d", 1, "f")], "chunk_id string, size_bytes long, checksum string")
    assert {(r.chunk_id, r.problem) for r in gf.verify(declared, there).collect()} == {("b", "size"), ("c", "missing"), ("d", "checksum")}
    (tmp_path / "ok.json").write_text('{"chunk_id": "1", "symbols": [{"id": "s", "name": "n"}]}')
    (tmp_path / "bad.json").write_text('{"chunk_id": "2", /* no */ "symbols": [')
    good, bad = gf.read_chunks(spark, str(tmp_path), "chunk_id string, symbols array<struct<id: string, name: string>>")
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "a.c").write_text("int x;")
    assert gf.source_tree(spark, str(tmp_path)).first().text == "int x;" and gf.file_checksums(spark, str(tmp_path), "*.c").count() == 1


@pytest.mark.parametrize("score, level", [((1.0, 1.0), "high"), ((0.8, 0.6), "medium"), ((0.1, 0.2), "low")])
def test_confidence(spark, score, level):
    assert spark.range(1).select(cs.call_confidence(F.lit(score[0]), F.lit(score[1])).alias("c")).first().c == level
