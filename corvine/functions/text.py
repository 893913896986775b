"""Text expressions: tokens, overlap, query rewriting, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.columns import col

# Abbreviations, synonyms and stop words of the query rewriting.
ABBREVIATIONS = {
    "fs": "filesystem", "vfs": "virtual filesystem", "mm": "memory management", "vm": "virtual memory", "hw": "hardware", "drv": "driver", "dev": "device",
    "init": "initialize", "alloc": "allocate", "dealloc": "deallocate", "ref": "reference", "ptr": "pointer", "buf": "buffer", "ctx": "context",
    "cfg": "configuration", "msg": "message", "pkt": "packet", "req": "request", "resp": "response",
}
SYNONYMS = {
    "lock": ["mutex", "semaphore", "spinlock", "rwlock"], "security": ["vulnerability", "exploit", "cve", "overflow"],
    "error": ["bug", "fault", "panic", "oops", "warning"], "performance": ["optimization", "latency", "throughput", "bottleneck"],
    "driver": ["module", "device", "hardware"], "network": ["networking", "socket", "protocol", "packet"],
    "memory": ["heap", "stack", "cache", "swap", "page"], "file": ["inode", "dentry", "directory", "path"],
    "process": ["task", "thread", "pid", "scheduling"], "interrupt": ["irq", "handler", "bottom half", "softirq"],
}
USED_SYNONYMS = 2  # of each word, when a query is enriched
# What a word is replaced by when a query is expanded into several.
EXPANSIONS = {
    "fs": ["filesystem", "file_system"], "vfs": ["virtual_file_system", "virtual_fs"], "inode": ["index_node"], "dentry": ["directory_entry"],
    "syscall": ["system_call", "sys_call"], "ioctl": ["io_control", "device_control"], "mm": ["memory_management", "mem_mgmt"],
    "alloc": ["allocate", "allocation"], "kzalloc": ["kernel_zalloc", "zero_alloc"], "vmalloc": ["virtual_memory_alloc"],
    "pid": ["process_id", "process_identifier"], "tid": ["thread_id", "thread_identifier"], "sched": ["scheduler", "scheduling"],
    "netdev": ["network_device", "net_device"], "skb": ["socket_buffer", "sk_buff"], "drv": ["driver"], "hw": ["hardware"],
    "irq": ["interrupt_request", "interrupt"],
}
# Abbreviations that a question is enriched with, beside the word itself.
SPELT_OUT = {
    "mem": "memory", "alloc": "allocation allocate", "dealloc": "deallocate deallocation", "malloc": "memory allocation", "free": "memory free deallocation",
    "buf": "buffer", "ptr": "pointer", "addr": "address", "vm": "virtual memory", "fs": "filesystem", "proc": "process", "sched": "scheduler scheduling",
    "irq": "interrupt", "dma": "direct memory access", "pci": "peripheral component interconnect", "usb": "universal serial bus",
    "tcp": "transmission control protocol", "udp": "user datagram protocol", "ip": "internet protocol", "eth": "ethernet",
    "gpio": "general purpose input output", "i2c": "inter integrated circuit", "spi": "serial peripheral interface",
    "uart": "universal asynchronous receiver transmitter", "cpu": "central processing unit processor", "gpu": "graphics processing unit",
    "mmu": "memory management unit", "tlb": "translation lookaside buffer", "iommu": "input output memory management unit",
    "numa": "non uniform memory access", "smp": "symmetric multiprocessing", "rcu": "read copy update", "bh": "bottom half",
    "softirq": "software interrupt", "tasklet": "task", "workqueue": "work queue", "kthread": "kernel thread", "syscall": "system call",
    "vfs": "virtual file system", "bio": "block input output", "skb": "socket buffer", "netdev": "network device", "pdev": "platform device",
}
# Fixed patterns: what makes a question one about code, and the words of code that are kept as they are.
CODE_SIGNS = r"\b[a-z]+_[a-z]+\b|\b[A-Z]+_[A-Z]+\b|\bCONFIG_[A-Z_]+\b|\b0x[0-9a-fA-F]+\b|\b\w*\(\)|->[a-zA-Z_]|::[a-zA-Z_]|\b\w+\.\w+\b"
CODE_WORDS = r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]*)+|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+|0x[0-9a-fA-F]+|\d+\.\d+\.\d+|CONFIG_[A-Z_]+)\b"
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]


def tokens(text: Column | str, least: int = 2) -> Column:
    """Lower-case words of letters, digits and underscores of any script, at least ``least`` long, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) >= least)


def token_set(text: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def rewrite(query: Column | str, remove_stop_words: bool = True) -> Column:
    """Lower case, abbreviations spelt out once each as whole words, stop words removed, blanks normalised."""
    words = F.split(F.trim(F.regexp_replace(F.lower(query), r"(?U)\s+", " ")), " ")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    long = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    kept = F.filter(long, lambda w: ~w.isin(STOP_WORDS)) if remove_stop_words else long
    return F.trim(F.array_join(kept, " "))


def with_synonyms(query: Column | str) -> Column:
    """Each word with synonyms is followed by two of them."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(" ".join([k, *v[:USED_SYNONYMS]])))])
    return F.array_join(F.transform(F.split(query, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def enriched(query: Column | str) -> Column:
    """A question made ready for search: words of code kept, others in lower case with abbreviations spelt out and synonyms behind them.

    Blanks and repeated marks are folded first. In a question without any sign of
    code every word is taken as plain. Null and blank questions give an empty text.
    """
    text = F.trim(F.regexp_replace(col(query), r"\s+", " "))
    for mark, least in (("!", 2), ("?", 2), (".", 3)):
        text = F.regexp_replace(text, rf"[{mark}]{{{least},}}", mark * (3 if mark == "." else 1))
    code = text.rlike(CODE_SIGNS)
    long = F.create_map(*[F.lit(x) for kv in SPELT_OUT.items() for x in kv])
    more = F.create_map(*[F.lit(x) for k, v in SYNONYMS.items() for x in (k, " ".join(v[:USED_SYNONYMS]))])
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "")
    kept = lambda w: code & w.rlike(CODE_WORDS)
    follow = lambda table: lambda w: F.when(kept(w), w).otherwise(F.concat_ws(" ", w, F.element_at(table, bare(w))))
    words = F.split(F.array_join(F.transform(F.split(text, " "), follow(long)), " "), " ")
    cased = F.transform(words, lambda w: F.when(kept(w) | code & w.rlike("^[a-z]+[A-Z]"), w).otherwise(F.lower(w)))
    return F.coalesce(F.trim(F.array_join(F.transform(cased, follow(more)), " ")), F.lit(""))


def expansions(query: Column | str) -> Column:
    """The query, its variants with one word replaced by an expansion, and its parts at underscores; distinct, in order."""
    words = F.split(F.lower(query), r"\s+")
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    at = F.sequence(F.lit(1), F.size(words))
    variants = F.flatten(F.transform(at, lambda i: F.transform(F.coalesce(F.element_at(table, F.element_at(words, i)), F.array().cast("array<string>")), lambda s: F.array_join(F.transform(words, lambda w, j: F.when(j + 1 == i, s).otherwise(w)), " "))))
    parts = F.when(col(query).contains("_"), F.array(F.array_join(F.split(query, "_"), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(col(query)), variants, parts))


def keywords(query: Column | str) -> Column:
    return F.filter(F.split(rewrite(query), " "), lambda w: F.length(w) > 2)


def exact_boost(score: Column | str, name: Column | str, query: Column | str, factor: float = 1.5) -> Column:
    """Times ``factor`` where the name holds the query, and again times 1.5 ``factor`` where it equals it."""
    n, q = F.lower(name), F.lower(query)
    return col(score) * F.when(n.contains(q), factor).otherwise(1.0) * F.when(n == q, factor * 1.5).otherwise(1.0)


def citation(path: Column | str, start: Column | str, end: Column | str, sha: Column | str) -> Column:
    """``path:start-end@sha``: a single line has no end, the hash is cut to eight places."""
    span = F.when(col(start) == col(end), F.format_string("%d", start)).otherwise(F.format_string("%d-%d", start, end))
    return F.concat(col(path), F.lit(":"), span, F.lit("@"), F.substring(sha, 1, 8))


def parse_citation(text: Column | str) -> Column:
    """struct<path, start, end, sha>, null where the text is no citation; the hash is filled up to 40 places."""
    pattern = r"^(.+):(\d+)(?:-(\d+))?@([0-9a-f]{8,40})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    end = F.when(part(3) == "", part(2)).otherwise(part(3)).try_cast("int")
    whole = F.struct(part(1).alias("path"), part(2).try_cast("int").alias("start"), end.alias("end"), F.rpad(part(4), 40, "0").alias("sha"))
    return F.when(col(text).rlike(pattern), whole)


def context_lines(text: Column | str, query: Column | str, k: int = 5) -> Column:
    """The ``k`` lines that share most words with the query, in the order of the text; ties to earlier lines."""
    wanted = F.array_distinct(tokens(query))
    lines = F.split(text, r"\r?\n")
    scored = F.transform(lines, lambda line, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(line)), wanted))).alias("s"), i.alias("i"), line.alias("line")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), 1, k)
    return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line")))), lambda x: x["line"])
