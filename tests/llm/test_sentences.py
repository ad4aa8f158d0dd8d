"""Sentence boundaries by example, in nine languages."""

import numpy as np
import pytest

from pathloom.llm import sentences as S

#: Each text as the list of its sentences; what stands between them is a blank, or nothing where marked.
CASES = [
    ["It works.", "No. 3 in the set, i.e. the red one, broke after 1.5 min. of use!", "Why?"],
    ["Mr. Fix-it came at 9 a.m. on a Tuesday.", "According to J. Q. Brontle's post it is fine.", "See fig. 4 on p. 12 of the manual."],
    ["“It just works. No fuss at all,” was the verdict.", "Support said 'Wait.' and then closed my ticket.", "Great!!! :-)", "Next one."],
    ["“Send a photo.” “Which photo?” went our chat for a week.", "It arrived."],
    ["Honestly... it is fine, and that is rare.", "Get yours before they are gone...", "The valve is fine."],
    ["The olive one (size M, not L. Check the chart!) fits well.", "Works in the car, on the train, etc.", "The box says 3.5 l, the manual says 4.0 l.", "My dad likes it."],
    ["Wt. 3.5 lb. instead of 8.99 lb., no reply so far.", "Model no. XL 274, batch 0.75.", "Broken on 03.11. and again on 17.11. of the same year.", "Yes, really (!), said my dad."],
    ["i would buy it again!", "nope.", "their manual.pdf will not open.", "sent it back at 9 a.m. on a tuesday.", "dr. owl-style lamps... no."],
    ["I wrote to help@shop.example.invalid on the 4th.", "Version v2.0.3 changed it."],
    ["Passt z. B. in jede Küche, ins Büro usw.", "Am 3. Mai bestellt, am 19. Juni geliefert.", "Der Dienst, d. h. ein Band, half nicht.", "Loba GmbH & Co. KG antwortet nicht."],
    ["„Der läuft einfach. Punkt“, sagte meine Tante.", "Meine Schwester (5. Stock, kein Lift) trägt ihn allein.", "Maße: 3,5 mal 1.250,50 cm.", "Nr. 2 im Haushalt."],
    ["Livré à 10 h. 30 par M. Le Facteur.", "Merci Zily !", "« Il marche. C'est tout », dit ma voisine.", "Le no. 7 de la série, p. ex., ne ferme pas."],
    ["«Funciona. Y ya está», dice mi vecino.", "¡¡Nunca más!!", "¿Por qué es así?", "Lo trajo el Sr. Cartero a las 10.30 a. m.", "La caja dice 3,5 litros."],
    ["यह पंखा बहुत सुंदर है।", "वज़न 3.5 कि.ग्रा. है और यह हल्का है।", "माँ ने कहा, “अच्छा है। ले लो।” और हम ले आए।", "क्यों?"],
    ["قالت جارتي: «رائع. اشتره.» ثم اشترت مثله.", "لماذا الزر ضعيف هكذا؟", "دفعت 99.9 بلا فائدة!!", "الطراز DS-32 من Kequa."],
    ["หนักแค่ 3.5 กก. เท่านั้นครับ", "ใช้มา ครึ่งปี แล้ว ฝายังเหมือนใหม่ครับ 👍", "รุ่น KS 810.2 ของ Nulo ค่ะ"],
]
SOLID = [
    ["我买的是蓝色的保温杯。", "客服只说“等一下。”就没有下文了。", "厨房、办公室……哪里都能用。", "用了三个月，还是新的！！", "重量只有3.5公斤。"],
    ["二度と買いません！！", "母は「とても良い。気に入った。」と言っていました。", "台所でも、職場でも……どこでも使えます。", "なぜですか？"],
    ["I have used it for a week.", "The handle never lets us down!", "Do NOT buy.", "Mr. Smith agrees."],
]


@pytest.fixture(scope="module")
def words():
    counts = np.zeros((4, S.BUCKETS))
    for (kind, w), n in S.word_counts(["\n".join(c) for c in CASES + SOLID] * 5).items():
        counts[kind, w] = n
    opens = np.clip(np.log((counts[0] + 0.5) / (counts[1] + 0.5)), -3, 3) * (counts[0] + counts[1] > 0)
    return S.Lexicon(opens, np.zeros(S.BUCKETS))


def parts(text, words):
    return [text[a - 1 : b] for a, b in S.sentences(text, words)]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_spaced(words, case):
    assert parts(" ".join(case), words) == case
    assert parts("  " + "\r\n".join(case) + " \n\n", words) == case


@pytest.mark.parametrize("case", SOLID, ids=range(len(SOLID)))
def test_without_spaces(words, case):
    assert parts("".join(case), words) == case


def test_lists_marks_and_lines(words):
    assert parts("1. do not buy.\n2) Fine\n- Nope. <3 Yes.\n   \n:)", words) == ["1. do not buy.", "2) Fine", "- Nope. <3", "Yes.", ":)"]
    assert parts("\n \t ", words) == [] and parts("", words) == [] and parts("no mark at all", words) == ["no mark at all"]
    assert parts("(Copied from my homework.) The rest is mine.", words) == ["(Copied from my homework.)", "The rest is mine."]


def test_positions_are_code_points(words):
    assert S.sentences(" 👍 Fine. 𝒳 is it.", words) == [(2, 8), (10, 17)]


def test_long_and_hostile_texts(words):
    long = "It works. " * 20_000
    assert len(S.sentences(long, words)) == 20_000
    for text in ("." * 50_000, "(" * 5_000, "“a. " * 800, "a" * 200_000, "!?" * 3000 + "x", "\x00.\ud800. X."):
        got = S.sentences(text, words)
        assert all(1 <= a <= b <= len(text) for a, b in got) and all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_operator(spark):
    rows = [(1, "One. Two."), (2, None), (3, " "), (None, "Three."), (1, "One. Two."), (4, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, text string, _doc string, sentence int")
    got = sorted(((r.id or 0), r.sentence, r.sent_start, r.sent_end, r.sentence_text) for r in S.sentence_units(df, "id", "text").collect())
    assert got == sorted([(1, 1, 1, 4, "One."), (1, 2, 6, 9, "Two.")] * 2 + [(0, 1, 1, 6, "Three.")])
    assert S.sentence_units(df.limit(0), "id", "text").count() == 0


def test_a_sentence_may_hold_many_inner_marks(words):
    text = "The list (" + ", ".join(f"no. {i}.5 mm" for i in range(400)) + ") is long. It ends."
    assert parts(text, words) == [text[:-9], "It ends."]
