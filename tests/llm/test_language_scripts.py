"""Many scripts beside each other, and languages with long texts only."""

import random

from tidewell.llm import language

from .test_language import longest_match_phrases


def prose(seed, alphabet, n=4000):
    """Words of a small vocabulary of their own: two seeds over one alphabet are two languages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(60)]
    return lambda k: " ".join(random.Random(f"{seed} {k}").choices(vocabulary, k=n // 5))


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
HAN = "".join(map(chr, range(0x4E00, 0x4E00 + 600)))
KANA = "".join(map(chr, range(0x3041, 0x3091)))


def languages():
    return {"la": prose(1, LATIN), "lb": prose(2, LATIN), "ra": prose(3, CYRILLIC), "rb": prose(4, CYRILLIC), "ha": prose(5, HAN), "hb": prose(6, HAN), "ka": prose(7, KANA), "kb": prose(8, KANA)}


def test_letters_stay_apart():
    model = language.Model({k: f(0) for k, f in languages().items()})
    seen = sorted({c for f in languages().values() for c in f(0) if c.isalpha()})
    assert len({language.letters(c, model.place).tobytes() for c in seen}) == len(seen) > 62
    texts = [f(1)[:60] for f in languages().values()]
    names, _ = model.predict(texts)
    assert names == list(languages())


def test_phrases_with_spelled_letters():
    samples = {k: languages()[k](0)[:300] for k in ("ha", "lb", "rb")}
    model = language.Model(samples)
    codes = [language.letters(languages()[k](1)[:80], model.place) for k in ("ha", "hb", "ra", "la")]
    shown = ["".join(chr(65 + c) for c in x) for x in codes]
    grown = ["".join(chr(65 + c) for c in language.letters(samples[x], model.place)) for x in model.names]
    assert language.phrases(codes, model.table, model.roots).tolist() == [[longest_match_phrases(t, g) for g in grown] for t in shown]


def test_long_texts_are_learned(spark):
    rows = [("la", prose(1, LATIN, 300)(k)) for k in range(5)] + [("lb", prose(2, LATIN, 9000)(k)) for k in range(3)]
    assert min(len(t) for lang, t in rows if lang == "lb") > 4000
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.names == ["la", "lb"]
    assert model.predict([prose(2, LATIN, 300)(9), prose(1, LATIN, 300)(9)])[0] == ["lb", "la"]
