from __future__ import annotations

import pytest

from docmill.llm.quality import FLOOR, STATS, batch_statistics, known_languages, sketches, statistics, text_kinds, text_statistics

PROSE = {
    "en": "This is a sentence that we wrote for the test, and it is followed by another one. You can read it when you have the time, but there is no need to do so.",
    "de": "Das ist ein Satz für den Test, und er wird von einem anderen gefolgt. Man kann ihn lesen, wenn man die Zeit dazu hat, aber es ist nicht nötig.",
    "fr": "Ceci est une phrase pour le test, et elle est suivie par une autre. On peut la lire quand on a le temps, mais il ne faut pas le faire.",
    "es": "Esta es una frase para la prueba, y después hay otra. Se puede leer cuando se tiene el tiempo, pero no es necesario que lo haga.",
    "ja": "これは試験のための文です。そして次の文が続きます。時間があれば読むことができますが、その必要はありません。",
}


def test_language_and_statistics():
    for lang, text in PROSE.items():
        found, values = statistics(text)
        assert found == lang and len(values) == len(STATS)
    assert statistics("zzz qqq", "DE ")[0] == "de"
    v = dict(zip(STATS, statistics("a b\nc d.\na b")[1]))
    assert v["n_words"] == 6 and v["repeat_share"] == pytest.approx(1 / 3) and v["end_share"] == pytest.approx(1 / 3)


def test_kinds(spark):
    rows, want = [], {}

    def add(text, kind, lang="en"):
        want[len(rows)] = kind
        rows.append((len(rows), text, lang))

    for n in range(30):
        for lang, text in PROSE.items():
            add(f"{text} {text[:20]} {n}.", "prose", lang.upper() if n % 3 else lang)
    add("- first item\n- second item\n- third item\n- fourth item", "list")
    add("1. Cut the rope\n2. Tie the knot\n3. Wait for rain", "list")
    add("a;b;c\n1;2;3\n4;5;6\n7;8;9", "table")
    add("| name | size |\n| --- | --- |\n| rope | 12 |\n| knot | 34 |", "table")
    add("QmFzZTY0IGVuY29kZWQgZGF0YSBvZiBhIGZpbGU" * 8, "junk")
    add("window pool " * 60, "junk")
    add("#$%&*@! ^^ ~~ {}[] <> /\\ " * 10, "junk")
    add("T h i s   i s   s p a c e d   o u t   t e x t   o f   l e t t e r s", "junk")
    add(PROSE["en"].replace("sentence", "sÃ©ntÃ©nÃ§Ã©").replace("time", "tÃ®mÃ©"), "junk")
    gone = len(rows)
    rows += [(gone, None, "en"), (gone + 1, "", "en"), (gone + 2, " \n ", None), (None, PROSE["en"], "en"), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, kind string")
    got = {r.doc_id: r.kind for r in text_kinds(df).collect()}
    assert got == want
    assert text_kinds(df.limit(0)).count() == 0


def test_sketches(spark):
    df = spark.createDataFrame([(i, PROSE["en"] + " word" * i, None) for i in range(50)], "doc_id long, text string, lang string")
    s = sketches(text_statistics(df)).collect()
    assert len(s) == 1 and s[0].texts == 50
    base = statistics(PROSE["en"])[1][0]
    assert s[0].q_n_words[2] == pytest.approx(base + 24.5, abs=1)
    assert set(FLOOR) == set(STATS)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, (PROSE["en"] + "\n") * 20_000, "en")], "doc_id long, text string, lang string")
    assert text_statistics(df).first().n_words > 500_000


OTHER = {
    "it": "Questa è una frase che abbiamo scritto per la prova, e la frase che segue è più lunga di quella che viene prima. La si può leggere quando si ha il tempo, ma non è una cosa che si deve fare.",
    "nl": "Dit is een zin die we voor de proef hebben geschreven, en de zin die er op volgt is langer dan de zin die er voor staat. Je kunt de zin lezen als je er de tijd voor hebt, maar het is niet nodig.",
    "pl": "To jest zdanie, które napisano na próbę, a po nim jest inne zdanie, które nie jest tak długie. Można je czytać, kiedy się ma czas, ale nie jest to coś, co się musi robić, a więc się tego nie robi.",
}


def test_other_languages_are_no_junk(spark):
    rows = [(i, f"{PROSE[k]} {i}", k) for i, k in enumerate(list(PROSE) * 20)]
    few = [(1000 + i, t, k) for i, (k, t) in enumerate(OTHER.items())] + [(2000 + i, t, None) for i, t in enumerate(OTHER.values())]
    junk = [(3000, "xq zvk trw bnm plk jhg fds qwz vbn mlp okj uhy tgb rfv edc wsx qaz plm okn ijb", "it")]
    got = {r.doc_id: r.kind for r in text_kinds(spark.createDataFrame(rows + few + junk, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i, _, _ in few} == {"prose"} and got[3000] == "junk"


def test_common_words_of_a_language_are_learnt(spark):
    df = spark.createDataFrame([(i, f"{OTHER['it']} numero {i}", "IT") for i in range(40)] + [(100, PROSE["en"], "en")], "doc_id long, text string, lang string")
    assert {r.fits for r in text_statistics(df).filter("doc_id < 100").collect()} == {"it"}


def test_a_batch_is_its_texts():
    texts = [*PROSE.values(), "", " \n", "a b\nc d.\na b", "x" * 300, "word " * 250, *OTHER.values(), "Ã©tÃ© 12 34", "| a | b |\n| - | - |"]
    langs, columns = batch_statistics(texts, [None] * len(texts), known_languages())
    for i, t in enumerate(texts):
        lang, values = statistics(t)
        assert (lang, values) == (langs[i], pytest.approx(columns[:, i].tolist()))
