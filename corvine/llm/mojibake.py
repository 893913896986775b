"""Garbled text from wrong character encodings.

The noisy channel: a text was written as bytes in one encoding and read in
another; bytes the reader had no character for were lost, with or without a mark.
For every distinct token with characters beyond ASCII and every pair of encodings
the bytes are laid out as a lattice, lost ones as wildcards, and Viterbi's
algorithm finds its best readings. Readings and the token itself then compete by
what the corpus says of them: words by their frequency, words it doesn't know by
its characters. A token that loses is garbled; records that hold one are found.

The word list stays distributed: a lattice with wildcards is intersected with it
by a join on the mask of the word, other readings look their word up by a join.

All frequencies are counted over the whole corpus. Copies of one text count as
one text, and tokens that are valid UTF-8 behind a reader don't count towards the
frequencies of characters, so a garbled text doesn't hide itself by being
frequent. The work per token is done once per distinct token, not once per record.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import checkpoint_dir

LOST = "�"

# Pairs (read as, written in) that occur in practice.
_READERS = ("cp1252", "latin_1", "cp1250", "cp1251", "iso8859_2", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "cp1253", "cp1254", "cp932", "gbk", "big5", "euc_jp")
UTF8_PAIRS = [(r, "utf_8") for r in _READERS]
BYTE_PAIRS = [
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("iso8859_2", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp437", "cp1251"), ("cp1252", "iso8859_5"), ("cp437", "cp866"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1251", "cp1250"), ("mac_roman", "cp1250"), ("cp437", "cp1250"), ("cp1252", "cp852"), ("cp1250", "cp852"),
    ("cp1252", "cp1254"), ("cp1252", "iso8859_9"),
    ("cp1252", "cp932"), ("mac_roman", "cp932"), ("cp1252", "euc_jp"), ("cp932", "euc_jp"), ("gbk", "cp932"), ("gbk", "euc_jp"),
    ("cp1252", "gbk"), ("cp1252", "big5"), ("gbk", "big5"), ("big5", "gbk"), ("cp1251", "gbk"), ("cp932", "gbk"), ("mac_roman", "gbk"), ("cp437", "gbk"),
    ("gbk", "cp1252"), ("cp932", "cp1252"),
]
_PAIRS: dict[str, list[str]] = {}
for _reader, _writer in UTF8_PAIRS + BYTE_PAIRS:
    _PAIRS.setdefault(_reader, []).append(_writer)
_MULTIBYTE = {"cp932", "gbk", "big5", "euc_jp"}

_CYRILLIC = {"cp1251", "koi8_r", "cp866", "iso8859_5"}  # read wrong only where there are such letters

# Runs of letters with at least one character beyond ASCII. The possessive
# parts and the look-behind keep the scan linear.
_TOKEN = r"(?<![A-Za-z])[A-Za-z]*+[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*+"
_QUOTED = r"``[^`]*+``|`[^`\n]*+`"


@lru_cache(maxsize=None)
def _byte_of(reader: str) -> dict[str, bytes]:
    """The byte behind each character of a single-byte reader; control characters stand for themselves."""
    table = {chr(b): bytes([b]) for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(reader)] = bytes([b])
        except UnicodeDecodeError:
            pass
    return table


def to_bytes(token: str, reader: str) -> list[int | None] | None:
    """The bytes that ``reader`` read as the token, None for lost ones; None if it couldn't have."""
    if reader in _MULTIBYTE:
        out: list[int | None] = []
        for part in token.split(LOST):
            try:
                out += [*part.encode(reader), None]
            except UnicodeEncodeError:
                return None
        return out[:-1]
    table = _byte_of(reader)
    out = []
    for c in token:
        if c == LOST:
            out.append(None)
        elif c < "\x80":
            out.append(ord(c))
        elif c in table:
            out.append(table[c][0])
        else:
            return None
    return out


@lru_cache(maxsize=None)
def _kind(c: str) -> str:
    """The class of a character: its category and, for letters, its block."""
    category, o = unicodedata.category(c), ord(c)
    if o < 0x80:
        return category
    if category[0] == "L":
        block = o >> 7 if o < 0x2E80 else "kana" if 0x3040 <= o < 0x3100 else "wide"
        return f"{category if category in ('Lu', 'Ll') else 'L'}{block}"
    return category[0] + ("wide" if o >= 0x3000 else "")


@dataclass
class Language:
    """What the corpus says of words it doesn't know: characters by class, classes by the class before.

    Characters are at most 1.1 million and classes some hundreds, whatever the corpus.
    """

    chars: Counter = field(default_factory=Counter)
    steps: Counter = field(default_factory=Counter)
    n_words: int = 1  # different tokens, the unit of ``exists``

    def add(self, token: str, weight: int) -> None:
        before = "^"
        for c in token:
            self.chars[c] += weight
            kind = _kind(c)
            self.steps[before, kind] += weight
            before = kind
        self.steps[before, "$"] += weight

    def prepare(self) -> Language:
        self.of_kind, self.out_of, self.into = Counter(), Counter(), Counter()
        for c, n in self.chars.items():
            self.of_kind[_kind(c)] += n
        for (a, b), n in self.steps.items():
            self.out_of[a] += n
            self.into[b] += n
        self.total = sum(self.into.values()) + 1
        # a lost character is any of those that the corpus holds
        self.lost = -math.log(1 + sum(c > "\x7f" for c in self.chars)) - 2
        self.known = frozenset(c for c in self.chars if c > "\x7f")
        self.made: dict = {}
        return self

    def step(self, before: str | None, kind: str) -> float:
        """Smoothed log probability of a class behind another, or of the class alone behind a lost character."""
        key = before, kind
        if key not in self.made:
            base = (self.into[kind] + 0.1) / self.total
            self.made[key] = math.log(base if before is None else (self.steps[key] + 2 * base) / (self.out_of[before] + 2))
        return self.made[key]

    def char(self, before: str | None, c: str) -> tuple[float, str | None]:
        if c == LOST:
            return self.lost, None
        kind = _kind(c)
        return self.step(before, kind) + math.log((self.chars[c] or 0.1) / (self.of_kind[kind] + 1)), kind

    def word(self, text: str) -> float:
        before, p = "^", 0.0
        for c in text:
            q, before = self.char(before, c)
            p += q
        return p + self.step(before, "$")


def _never_written(c: str) -> bool:
    """Replacement marks and control characters, which no encoding gives on purpose."""
    return c == LOST or "\x80" <= c <= "\x84" or "\x86" <= c <= "\x9f"


@lru_cache(maxsize=None)
def _encoded(writer: str, known: frozenset) -> list[tuple[bytes, str]]:
    out = []
    for c in sorted(known):
        try:
            out.append((c.encode(writer), c))
        except UnicodeEncodeError:
            pass
    return out


@lru_cache(maxsize=4096)
def _by_mask(writer: str, part: tuple, known: frozenset) -> list[str]:
    """The corpus' characters whose bytes fit, wildcards fitting any."""
    return [c for e, c in _encoded(writer, known) if len(e) == len(part) and all(p is None or p == x for p, x in zip(part, e))]


def _readings(data: list[int | None], i: int, writer: str, known: frozenset) -> Iterator[tuple[int, str]]:
    """The characters that can start at byte i, with the next position; wildcards may stand for any byte, or stay lost."""
    for n in (1, 2, 3, 4):
        part = tuple(data[i : i + n])
        if len(part) < n:
            return
        if None not in part:
            try:
                c = bytes(part).decode(writer)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                yield i + n, c
        elif part.count(None) < n or n == 1 and writer not in _MULTIBYTE and writer != "utf_8":
            for c in _by_mask(writer, part, known):
                yield i + n, c


def viterbi(data: list[int | None], writer: str, language: Language, best_of: int = 4) -> list[tuple[float, str]]:
    """The ``best_of`` most probable readings of the bytes with their log probabilities; none if there is no path.

    Wildcards are bytes the reader lost; one that nothing fits stays lost.
    """
    n = len(data)
    beams: list[dict[str, tuple[float, str | None]]] = [{} for _ in range(n + 1)]  # text -> log probability, class of its end
    beams[0][""] = (0.0, "^")
    for i in range(n):
        beam = sorted(beams[i].items(), key=lambda x: -x[1][0])[: 2 * best_of]
        if not beam:
            continue
        arcs = list(_readings(data, i, writer, language.known))
        if data[i] is None:
            arcs.append((i + 1, LOST))
        for text, (p, before) in beam:
            for j, c in arcs:
                q, kind = language.char(before, c)
                if (old := beams[j].get(text + c)) is None or old[0] < p + q:
                    beams[j][text + c] = (p + q, kind)
    ends = sorted(((p + language.step(before, "$"), text) for text, (p, before) in beams[n].items()), reverse=True)
    return ends[:best_of]


def _decoded(data: list[int | None], writer: str, language: Language) -> list[tuple[float, str, bool]]:
    """The readings of a lattice, and whether its ends were cut; without wildcards there is one path at most.

    UTF-8 may begin within a character or end before its last byte, where bytes
    went missing without a mark; these are lost characters.
    """
    head = tail = 0
    if writer == "utf_8" and None not in data:
        while head < min(3, len(data)) and 0x80 <= data[head] <= 0xBF:
            head += 1
        for back in range(1, min(3, len(data) - head) + 1):
            if (b := data[-back]) >= 0xC2:
                tail = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
            if b < 0x80:
                break
    inner = data[head : len(data) - tail]
    if None in inner:
        found = [(p, text, False) for p, text in viterbi(inner, writer, language)]
        if found and writer != "utf_8" and writer not in _MULTIBYTE:
            # the reading whose wildcards stay open, for the words of the corpus
            open_ = "".join(LOST if b is None else bytes([b]).decode(writer, "replace") for b in inner)
            found += [(language.word(open_), open_, False)] * (open_ not in (text for _, text, _ in found))
        return found
    try:
        text = bytes(inner).decode(writer)
    except UnicodeDecodeError:
        return []
    if (head or tail) and not any(c > "\x7f" for c in text):
        return []  # nothing whole speaks for it
    text = LOST * bool(head) + text + LOST * bool(tail)
    return [(language.word(text), text, bool(head or tail))]


def candidates(token: str, language: Language, twice: bool = True) -> list[tuple[str, str, float]]:
    """(pair, reading, log probability of its characters) for each pair of encodings that gives another reading."""
    found: dict[str, tuple[str, float]] = {}
    done: set[tuple] = set()  # lost marks and ASCII are the same bytes behind many readers
    for reader, writers in _PAIRS.items():
        data = to_bytes(token, reader)
        if not data or all(b is not None and b < 0x80 for b in data):
            continue
        for writer in writers:
            lattice = (writer, *data)
            if lattice in done:
                continue
            done.add(lattice)
            for p, reading, cut in _decoded(data, writer, language):
                if reading == token or writer in _CYRILLIC and not any("\u0400" <= c <= "\u04ff" for c in reading):
                    continue
                if writer == "utf_8" and twice and len(reading) < len(token) and LOST not in reading and any(c > "\x7f" for c in reading):
                    for pair, deeper, q in candidates(reading, language, False):
                        if pair.endswith("utf_8") and LOST not in deeper and deeper not in found:
                            found[deeper] = (f"{reader}>utf_8+{pair}", q)
                if any(_never_written(c) and c != LOST for c in reading):
                    continue
                if reading not in found or found[reading][1] < p:
                    found[reading] = (f"{reader}>{writer}" + " cut" * cut, p)
    return [(pair, reading, p) for reading, (pair, p) in found.items()]


def reads_as_utf8(token: str) -> bool:
    """Whether some reader's bytes of the token are valid UTF-8 of several bytes, lost ones not counted."""
    beyond = sum(c > "\x7f" for c in token)
    for reader, _ in UTF8_PAIRS:
        data = to_bytes(token, reader)
        if not data or None in data:
            continue
        try:
            reading = bytes(data).decode("utf_8")
        except UnicodeDecodeError:
            continue
        if LOST in reading:
            return True  # the bytes of a replacement mark
        left = sum(c > "\x7f" for c in reading)
        # in multi-byte readers a short token is valid by chance
        if 0 < left < beyond and (reader not in _MULTIBYTE or beyond >= 4 and left >= 2):
            return True
    return False


def strip_quoted(text: Column | str) -> Column:
    """Samples in backquotes are quoted on purpose."""
    return F.regexp_replace(text, _QUOTED, " ")


def document_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, a, b, tokens``: the distinct tokens beyond ASCII of each record that has any, and two hashes of its text."""
    beyond = df.filter(F.col(text).rlike(r"[\x{80}-\x{10FFFF}]"))
    tokens = F.array_distinct(F.regexp_extract_all(strip_quoted(text), F.lit(_TOKEN), F.lit(0)))
    return beyond.select(F.col(key).alias("key"), F.xxhash64(F.lit("a"), text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"), tokens.alias("tokens")).filter(F.size("tokens") > 0)


def token_counts(tokens: DataFrame) -> DataFrame:
    """``token, texts, n``: the number of different texts that hold it, and of records; copies of a text are folded first."""
    once = tokens.groupBy("a", "b").agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    return once.select(F.explode("tokens").alias("token"), "copies").groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n"))


def learn(counts: DataFrame) -> Language:
    """The characters of the tokens that aren't garbled at first sight: no lost mark, not valid UTF-8 behind a reader.

    Counters are added up per batch and then by Spark; what comes to the driver
    is bounded by the number of characters and classes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = Language()
            for token, texts in zip(batch["token"], batch["texts"]):
                if not any(map(_never_written, token)) and not reads_as_utf8(token):
                    part.add(token, int(texts))
            rows = [(c, None, n) for c, n in part.chars.items()] + [(a, b, n) for (a, b), n in part.steps.items()]
            yield pd.DataFrame(rows, columns=["x", "y", "n"])

    out = Language(n_words=max(1, counts.count()))
    for r in counts.mapInPandas(run, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect():
        if r.y is None:
            out.chars[r.x] = r.n
        else:
            out.steps[r.x, r.y] = r.n
    return out.prepare()


# Before anything is learnt: the share of a word's occurrences that a pair of encodings garbles. UTF-8 is the
# usual writer and, unlike single bytes, isn't valid by chance.
_PRIOR = {"utf_8": 1e-3, "other": 1e-5}
_SURE = 5.0  # log odds from which a token counts when the shares of pairs are learnt
_ENOUGH = 3  # tokens that a share is learnt from
_SPREAD = 20.0  # texts are garbled whole, so counts spread wider than independent ones would


def _log_odds(texts: int, own: float, believed: bool, read: float, reading_texts: int, rate: float, expected: float, n_words: int) -> float:
    """Log odds that a token is a garbled form of the reading.

    ``own`` and ``read`` are log probabilities of the characters. Against it: a
    word of such characters exists (as many tries as there are words) and occurs
    as often as seen, by Zipf's law. For it: the reading exists, as seen or by its
    characters, and the pair garbles it. The readings must also account for the
    number of texts, by a negative binomial around at most what is ``expected`` of
    all known ones together (of half a text for one that was never seen); only ``believed`` ones, whole UTF-8 that is never valid by
    chance, may stand against the counts.
    """
    log_words = math.log(n_words)
    exists = min(0.0, own + log_words)
    certain = 0.0 if reading_texts else min(0.0, read + log_words)
    mean = min(expected if reading_texts else rate / 2, texts)  # fewer than expected is no evidence
    p = _SPREAD / (_SPREAD + mean)
    seen = math.lgamma(texts + _SPREAD) - math.lgamma(_SPREAD) - math.lgamma(texts + 1) + _SPREAD * math.log(p) + texts * math.log1p(-p)
    by_count = seen + math.log(texts * (texts + 1)) + certain - exists
    return max(by_count, math.log(min(rate, 1.0)) + certain - exists) if believed else by_count


def _masks(c: Column | str) -> Column:
    """A word as it looks if every character beyond ASCII is lost: with one mark each, and with one mark for each of its UTF-8 bytes."""
    by_char = F.regexp_replace(c, r"[\x{80}-\x{10FFFF}]", LOST)
    by_byte = c if isinstance(c, Column) else F.col(c)
    for characters, n in ((r"[\x{80}-\x{7FF}]", 2), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{10000}-\x{10FFFF}]", 4)):
        by_byte = F.regexp_replace(by_byte, characters, "\x01" * n)
    return F.array_distinct(F.array(by_char, F.translate(by_byte, "\x01", LOST)))


def garbled_tokens(counts: DataFrame) -> DataFrame:
    """``token, reading``: garbled tokens, the reading null where it can't be restored."""
    language = learn(counts)
    shared = counts.sparkSession.sparkContext.broadcast(language)
    n_words = language.n_words

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for token, texts, n in zip(batch["token"], batch["texts"], batch["n"]):
                # a mark or control character can't have been written: the token itself is no hypothesis
                own = -1e9 if any(map(_never_written, token)) else shared.value.word(token)
                found = candidates(token, shared.value)
                if own == -1e9:
                    left = "".join(LOST if _never_written(c) else c for c in token)
                    found = [f for f in found if f[1] != left] + [("any>lost", left, shared.value.word(left))]
                rows += [(token, texts, n, own, pair, reading, p) for pair, reading, p in found]
            yield pd.DataFrame(rows, columns=["token", "texts", "n", "own", "pair", "reading", "read"])

    proposed = counts.mapInPandas(propose, "token string, texts long, n long, own double, pair string, reading string, read double")
    word = counts.filter(~F.col("token").contains(LOST)).select(F.col("token").alias("reading"), F.col("texts").alias("reading_texts"), F.col("n").alias("reading_n"))
    # a form as frequent as its reading isn't garbled from it, by texts or else by records; whole UTF-8 may be
    fits = F.col("pair").endswith("utf_8") | (F.struct("texts", "n") < F.struct("reading_texts", "reading_n"))
    judged = proposed.join(word, "reading", "left").withColumn("reading_texts", F.when(fits, F.col("reading_texts")).otherwise(0)).fillna(0, ["reading_texts", "reading_n"]).drop("n").checkpoint()

    def odds() -> Column:
        @F.pandas_udf("double")
        def score(texts: pd.Series, own: pd.Series, pair: pd.Series, read: pd.Series, reading_texts: pd.Series, rate: pd.Series, expected: pd.Series) -> pd.Series:
            believed = [p.endswith("utf_8") for p in pair]
            return pd.Series([_log_odds(*x, n_words) for x in zip(texts, own, believed, read, reading_texts, rate, expected)], dtype="float64")

        return score("texts", "own", "pair", "read", "reading_texts", "rate", "expected")

    # The share of a word's texts that each pair garbles, from the tokens that are sure by their characters and long
    # enough not to be chosen by chance; from the most frequent words, as rare ones are only seen if they are garbled
    # more often than usual. Pairs with few of these have the share of all. There are some hundred pairs.
    by_chars = F.log(F.lit(_PRIOR["other"])) - F.least(F.lit(0.0), F.col("own") + math.log(n_words))
    sure = judged.filter((F.col("reading_texts") >= 20) & (F.col("texts") < F.col("reading_texts")) & (F.col("own") > -1e9) & (by_chars > _SURE))
    sound = judged.join(sure.select(F.col("token").alias("reading")).distinct(), "reading", "left_anti").checkpoint()
    kind = F.when(F.col("pair").contains("utf_8"), "utf_8").otherwise("other")
    known = sound.join(sure.select("token").distinct(), "token", "left_semi").filter((F.col("reading_texts") >= 20) & (F.col("texts") < F.col("reading_texts")) & (F.length("token") >= 3))

    def shares(by: Column) -> dict[str, float]:
        most = known.groupBy(by.alias("by")).agg((F.max("reading_texts") / 2).alias("half"))
        top = known.withColumn("by", by).join(F.broadcast(most), "by").filter(F.col("reading_texts") >= F.col("half"))
        rows = top.groupBy("by").agg((F.sum("texts") / F.sum("reading_texts")).alias("share"), F.count(F.lit(1)).alias("n")).collect()
        return {r.by: r.share for r in rows if r.n >= _ENOUGH}

    rates, usual = shares(F.col("pair")), _PRIOR | shares(kind)
    learnt = F.lit(None).cast("double") if not rates else F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("pair"))
    rated = sound.withColumn("rate", F.coalesce(learnt, F.when(kind == "utf_8", usual["utf_8"]).otherwise(usual["other"])))
    # some dozen readings a token
    rated = rated.withColumn("expected", F.sum(F.col("rate") * F.col("reading_texts")).over(Window.partitionBy("token")))
    scored = rated.withColumn("odds", odds()).filter("odds > 0").checkpoint()
    bad = scored.select("token").distinct()

    # Wildcards that are left: the words of the corpus that fit the mask, if one is by far the most frequent.
    # Without a letter that was kept there is nothing to go by. Garbled words are no readings.
    beyond = r"[\x{80}-\x{10FFFF}]"
    masked = scored.filter(F.col("reading").contains(LOST) & F.col("reading").rlike("[A-Za-z]")).select("token", F.col("reading").alias("mask"), "odds")
    right = counts.filter(~F.col("token").contains(LOST)).join(bad, "token", "left_anti")
    words = right.select(F.explode(_masks("token")).alias("mask"), F.struct("texts", "n", "token").alias("w"))
    best = words.groupBy("mask").agg(F.max("w").alias("w"), F.sum("w.texts").alias("all"))
    filling = masked.join(best, "mask").select("token", "odds", "w", "all")
    # where other characters beyond ASCII were read, the word must also have these
    partly = masked.filter(F.regexp_replace("mask", LOST, "").rlike(beyond)).select("token", "odds", F.col("mask").alias("pattern"), F.regexp_replace("mask", beyond, LOST).alias("mask"))
    agreeing = partly.join(words, "mask").filter(F.regexp_like("w.token", F.concat(F.lit("^"), F.replace("pattern", F.lit(LOST), F.lit(".")), F.lit("$"))))
    filling = filling.unionByName(agreeing.groupBy("token", "pattern").agg(F.max("odds").alias("odds"), F.max("w").alias("w"), F.sum("w.texts").alias("all")).drop("pattern"))
    filling = filling.filter((F.col("w.n") >= 3) & (F.col("w.texts") >= 0.6 * F.col("all")))
    filled = filling.select("token", F.col("w.token").alias("reading"), F.col("w.n").alias("known"), "odds")
    whole = scored.filter(~F.col("reading").contains(LOST)).select("token", "reading", F.when(F.col("reading_texts") > 0, F.col("reading_n")).otherwise(0).alias("known"), "odds")
    ranked = whole.withColumn("mask", F.lit(0)).unionByName(filled.withColumn("mask", F.col("token").contains(LOST).cast("int")))
    # Lost bytes are only filled in by words the corpus knows, first by those that fit the mask. Otherwise a
    # reading that the corpus knows comes before one it doesn't, then the likelier one.
    ranked = ranked.filter((F.col("reading") != F.col("token")) & (~F.col("token").contains(LOST) | (F.col("known") >= 3)))
    order = F.struct("mask", F.col("known") > 0, F.col("odds") + F.log1p("known"), "reading")
    restored = ranked.groupBy("token").agg(F.max_by("reading", order).alias("reading"))
    return bad.join(restored, "token", "left")


def garbled(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The garbled records and what is known of their tokens.

    First: ``<key>``, each once. Second: ``<key>, token, reading``, the reading
    null where the original can't be told.

    Null and empty texts, ASCII texts and samples in backquotes are never
    garbled. Keys may repeat; a key is reported once. Texts are read whole, and
    once: their tokens are written.
    """
    checkpoint_dir(df.sparkSession)
    tokens = document_tokens(df, key, text).checkpoint()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the work is done per token in Python, so tokens are spread again after small partitions were joined
    counts = token_counts(tokens).repartition(parts, "token").checkpoint()
    bad = garbled_tokens(counts)
    pairs = tokens.select("key", F.explode("tokens").alias("token")).join(bad, "token").select(F.col("key").alias(key), "token", "reading")
    return pairs.select(key).distinct(), pairs


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, restored, n_restored, n_lost`` of the garbled records.

    Every garbled token outside backquotes is replaced by its reading; tokens
    without one stay and are counted in n_lost. Keys must be unique.
    """
    _, pairs = garbled(df, key, text)
    changes = pairs.groupBy(key).agg(F.collect_list(F.struct("token", "reading")).alias("changes"))  # tokens of one record

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        scan = regex.compile(r"(?<quoted>``[^`]*+``|`[^`\n]*+`)|(?<![A-Za-z])[A-Za-z]*+[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*+", regex.VERSION1)
        for batch in batches:
            rows = []
            for k, t, c in zip(batch["k"], batch["t"], batch["changes"]):
                to = {x["token"]: x["reading"] for x in c}
                done = lost = 0

                def swap(m):
                    nonlocal done, lost
                    if m.group("quoted") or m.group() not in to:
                        return m.group()
                    if to[m.group()] is None:
                        lost += 1
                        return m.group()
                    done += 1
                    return to[m.group()]

                out = scan.sub(swap, t)
                rows.append((k, out, done, lost))
            yield pd.DataFrame(rows, columns=[key, "restored", "n_restored", "n_lost"])

    joined = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(changes.withColumnRenamed(key, "k"), "k")
    return joined.mapInPandas(run, f"`{key}` long, restored string, n_restored long, n_lost long")
