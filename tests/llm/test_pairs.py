import pytest

from convoloom.llm import pairs as p

DOCS = [("en", "The quick brown fox jumps over the lazy dog. We should check the cache before the next release. Nothing else has changed since last week."), ("de", "Der schnelle braune Fuchs springt über den faulen Hund. Wir sollten den Speicher vor der nächsten Ausgabe prüfen. Sonst hat sich seit letzter Woche nichts geändert."), ("fr", "Le renard brun saute par-dessus le chien paresseux. Nous devrions vérifier la mémoire avant la prochaine version. Rien d'autre n'a changé depuis la semaine dernière.")]


def test_view_pairs(spark):
    rows = [(1, "v", 1, "user", "q1"), (2, "v", 5, "assistant ", "a1"), (3, "v", 6, "Assistant", "more"), (4, "v", 7, "user", "q2"), (5, "v", 8, "user", "q3"), (6, "v", 9, "AI", None), (7, "w", 1, "user", "last"), (8, "x", 1, "assistant", "first"), (9, None, 1, "user", "q"), (10, None, 2, "assistant", "a"), (11, "y", None, "user", "q"), (12, "z", 1, "odd", "q"), (13, "z", 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, view_id string, msg_no int, role string, content string, next string")
    assert sorted(map(tuple, p.view_pairs(df).collect()), key=str) == [(1, "q1", "a1"), (5, "q3", None)]


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "﻿", "…", ".", "---", "```\n```", "``````", "<response></response>", "\xa0 "])
def test_nothing_said(text):
    assert p.nothing_said(text)


@pytest.mark.parametrize("text", ["42", "No.", "是", "a", "✓", "`x`"])
def test_something_said(text):
    assert not p.nothing_said(text)


def test_copies():
    q = "How do I stop `a.py` from opening twice?"
    for a in (q, q.upper(), f"> {q}", f"You asked: {q}", f"“{q}”", q + "\n\n" + q, q.rstrip("?") + "…", q.replace(" ", "  ")):
        assert p.is_copy(q, a), a
    for a in (f"> {q}\n\nMove it out.", "Move it out.", f"{q} Yes.", "", "twice"):
        assert not p.is_copy(q, a), a
    assert not p.is_copy("", "x")


@pytest.mark.parametrize(
    "text",
    ["I can't help with that request.", "I'm sorry, but I am unable to assist with this. Please ask something else.", "As an assistant I cannot provide that, since it may be unsafe.", "That is something I have to decline.", "Unfortunately, this falls outside what I'm allowed to do.", "Tut mir leid, aber hier kann ich dabei nicht helfen.", "Leider muss ich das ablehnen.", "Désolé, je ne peux pas répondre à cette demande.", "Malheureusement, je ne suis pas en mesure de vous aider.", "Lo siento, tengo que rechazar esa petición.", "Lamentablemente, no me está permitido responder.", "Infelizmente, não posso ajudar com isso.", "Lamento, mas tenho de recusar esse pedido.", "抱歉，我无法协助完成这个请求。请换一个问题。", "很遗憾，我不能回答这个问题。"],
)
def test_refusals(text):
    assert p.is_refusal(text)


@pytest.mark.parametrize("text", ["I can't see any other caller, so this is safe to merge.", 'The server then prints "I cannot help with that" and exits.', "The prompt filter refuses such input on purpose.", "Sorry, I was wrong: the cache is warm.", "I can't help with that request. " + "But here is how it works in detail, step by step. " * 8, "No puedo reproducir el fallo en mi rama."])
def test_no_refusals(text):
    assert not p.is_refusal(text)


def test_asked_languages():
    assert p.asked_language("What? Answer in German.") == "de" and p.asked_language("I need the text in Chinese.") == "zh" and p.asked_language("Bitte antworte auf Englisch.") == "en"
    assert p.asked_language("Responde en inglés.") == "en" and p.asked_language("请用中文回答") == "zh" and p.asked_language("Is the German branch merged?") is None


def test_stops():
    assert p.stops_short("text\n```py\nx = (", None, False) and not p.stops_short("text\n```py\nx\n```", None, False)
    assert p.stops_short("see `src/a", None, False) and p.stops_short("- `a`\n- `b", None, False) and not p.stops_short("- `a`\n- `b`", None, False)
    assert p.stops_short("Then we have to,", "unknown", False) and not p.stops_short("It is done.", None, False) and not p.stops_short("42", "unknown", False)
    assert p.stops_short("It is done and the rest of it wa", "shortened", False) and not p.stops_short("It is done and the rest is fine", "finished", False) and not p.stops_short("whatever ends like others do here", "tail", False) and p.stops_short("whatever ends like others do here", "tail", True)
    assert p.stops_short("[Tool: Read File]\nFile: /a", None, False) and not p.stops_short("[Tool: Read File]\nFile: /a\nStatus: ✓ completed", None, False)


@pytest.mark.parametrize("text", ["1. Open the file.\n2. Read it.\n3.", "1) Open it.\n2)", "The steps are these.\n1.", "- Open it.\n-", "- Open it.\n* ", "9. Open it.\n\n10. "])
def test_bare_list_marks_stop_short(text):
    assert p.stops_short(text, None, False) and p.parts(text)[1] is not None


@pytest.mark.parametrize("text", ["42.", "How many rows are there:\n42.", "1. Open it.\n2. Read it.", "It is done.\n---", "It starts at version\n3."])
def test_no_bare_list_marks(text):
    assert not p.open_mark(text)


def test_frames(spark):
    docs = spark.createDataFrame(DOCS * 5, "lang string, text string")
    full = "We should check the cache before the next release. Nothing else has changed since last week."
    q = "Should we check the cache before the next release of this?"
    rows = [(1, q, full), (2, q, full[:-1]), (3, q, full[:-20]), (4, q, None), (5, q, q), (6, q, "I can't help with that request."), (7, q, "Wir sollten den Speicher vor der nächsten Ausgabe prüfen."), (8, q + " Answer in German.", "Wir sollten den Speicher vor der nächsten Ausgabe prüfen."), (9, q + " Answer in German.", full), (10, None, "42"), (11, q, full), (11, q, full)]
    df = spark.createDataFrame(rows, "row_id bigint, question string, answer string")
    got = sorted(map(tuple, p.defects(df, docs, "text", "lang").collect()))
    assert got == [(3, "truncated"), (4, "empty"), (5, "copy"), (6, "refusal"), (7, "other_language"), (9, "other_language")]
    assert p.defects(df.limit(0), docs, "text", "lang").count() == 0
    assert p.defects(df.where("row_id = 5"), docs.limit(0), "text", "lang").first()["defect"] == "copy"


def test_length_limits(spark):
    df = spark.createDataFrame([(i, None, "x" * (50 if i < 40 else 40 + i % 20)) for i in range(60)], "row_id bigint, question string, answer string")
    known = df.selectExpr("row_id", "'shortened' as known")
    assert [r[0] for r in p.length_limits(df, known).collect()] == [50]


def test_archive(spark, sf):
    got = p.p7_found(spark, sf)
    assert got.dtypes == [("row_id", "bigint"), ("defect", "string")] and got.count() > 0
