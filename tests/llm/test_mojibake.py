"""Garbled text: known pairs of encodings, proper accents, lost bytes."""

from __future__ import annotations

import pytest

from corvine.llm import mojibake as m

CLEAN = ["That’s the naïve café in Žofka’s größere Straße", "Крутомирко измерил время загрузки", "It runs at 4 °C ± 2 without trouble — isn’t it", "příliš žluťoučký kůň úpěl ďábelské ódy"]
DECOYS = ["L’ÂGE DE LA PÂTE, NÃO, AÇÃO, Â, Ê, Ô", "√2 ≈ 1.41, ∂x/∂t", "shown as `Ã©` or ``â€™`` or `�`", "&eacute; %C3%A9 stay", "├── src │ └── docs", "Æ, Ø and Å sort after Z", "", None, "plain"]


def garble(text: str, writer: str, reader: str) -> str:
    return text.encode(writer, "ignore").decode(reader, "replace")


GARBLED = [
    (garble(CLEAN[0], "utf_8", "latin_1"), CLEAN[0]),
    (garble(CLEAN[2], "utf_8", "cp1251"), None),
    (garble(CLEAN[1], "utf_8", "cp1251"), CLEAN[1]),
    (garble(CLEAN[1], "koi8_r", "cp1251"), CLEAN[1]),
    (garble(CLEAN[0], "cp1252", "mac_roman"), None),
    (garble(CLEAN[3], "cp1250", "cp1252"), CLEAN[3]),
    (garble(garble("naïve", "utf_8", "cp1252"), "utf_8", "cp1252"), "naïve"),
    (garble("That’s a naïve café", "cp1252", "utf_8"), "That’s a naïve café"),
    ("That锟斤拷s all", None),
    ("so nicht " + "größere".encode().decode("cp1252")[:4], None),
]


def test_found_and_restored(spark):
    rows = [(i, CLEAN[i % 4], "x") for i in range(400)]
    rows += [(1000 + i, t, "x") for i, t in enumerate(DECOYS)]
    rows += [(2000 + i, t, "x") for i, (t, _) in enumerate(GARBLED)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string")
    found = {r.doc_id for r in m.garbled(df, "doc_id", "text")[0].collect()}
    assert found == {2000 + i for i in range(len(GARBLED))}
    restored = {r.doc_id: r.restored for r in m.restore(df, "doc_id", "text").collect()}
    for i, (_, original) in enumerate(GARBLED):
        if original:
            assert restored[2000 + i] == original
    assert m.garbled(df.limit(0), "doc_id", "text")[0].count() == 0


def test_a_garbled_text_that_a_third_of_the_rows_repeat_is_found(spark):
    texts = [f"{i} {CLEAN[i % 4]}" for i in range(400)]
    copied = [garble(CLEAN[0], "utf_8", "cp1252"), garble(CLEAN[1], "koi8_r", "cp1251"), garble(CLEAN[0], "cp1252", "mac_roman")]
    for bad in copied:
        rows = list(enumerate(texts)) + [(1000 + i, bad) for i in range(200)] + [(2000 + i, t) for i, t in enumerate(DECOYS)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id for r in m.garbled(df, "doc_id", "text")[0].collect()} == {1000 + i for i in range(200)}
    # the same where every garbled text is a different one
    rows = list(enumerate(texts)) + [(1000 + i, f"{i} {copied[0]}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in m.garbled(df, "doc_id", "text")[0].collect()} == {1000 + i for i in range(200)}


def language(*words):
    out = m.Language(n_words=len(words))
    for w in words:
        out.add(w, 10)
    return out.prepare()


def test_lattice_fills_lost_bytes():
    known = language("isn’t", "’", "’", "é", "—", "größer", "字")
    assert m.viterbi([0xE2, 0x80, None], "utf_8", known)[0][1] == "’"
    assert m.viterbi([None, 0x80, 0x94], "utf_8", known)[0][1] == "—"
    assert m.viterbi([0xC3, 0x28], "utf_8", known) == []
    # every writer has wildcards; what nothing fits stays lost
    assert m.viterbi(list(b"gr") + [None] + list(b"\xdfer"), "cp1252", known)[0][1] in ("größer", "gréßer")
    assert "größer" in [t for _, t in m.viterbi(list(b"gr") + [None] + list(b"\xdfer"), "cp1252", known)]
    assert "字" in [t for _, t in m.viterbi(["字".encode("gbk")[0], None], "gbk", known)]
    assert m.viterbi([None], "ascii", language("a"))[0][1] == m.LOST
    assert m.to_bytes("Ã©", "cp1252") == [0xC3, 0xA9] and m.to_bytes("字", "cp1252") is None


def test_bytes_missing_without_a_mark():
    known = language("déjà", "isn’t", "个")
    assert (True, "déj" + m.LOST) in [(cut, t) for _, t, cut in m._decoded(m.to_bytes("dÃ©jÃ", "cp1252"), "utf_8", known)]
    assert (True, m.LOST + "个") in [(cut, t) for _, t, cut in m._decoded([0xA4, *"个".encode()], "utf_8", known)]
    assert m._decoded([0x41, 0xC3, 0x41], "utf_8", known) == []


def test_counts_speak_against_a_reading():
    odds = lambda texts, own, believed, known: m._log_odds(texts, own, believed, -20.0, known, 0.003, 0.003 * known, 5_000)
    assert odds(15, -18.0, False, 5_000) > 0 > odds(80, -18.0, False, 5_000)  # as often as expected, and far more often
    assert odds(1, -18.0, False, 5_000) > 0 > odds(1, -5.0, False, 100)  # rarer is no evidence, a likely word is
    assert odds(200, -60.0, True, 100) > 0 > odds(200, -60.0, False, 100)


def test_very_long_text_is_read_to_its_end(spark):
    text = "x" * 300_000 + " " + "naïve " * 20_000 + garble("naïve", "utf_8", "cp1252")
    rows = [(i, "so naïve") for i in range(10)] + [(99, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in m.garbled(df, "doc_id", "text")[0].collect()] == [99]
    assert m.restore(df, "doc_id", "text").first().restored.endswith(" naïve")


@pytest.mark.parametrize("token", ["naïve", "größere", "Щукотин", "—", "’", "字", "é"])
def test_plain_tokens_have_bytes_or_none(token):
    for reader, _ in m.UTF8_PAIRS:
        m.to_bytes(token, reader)
