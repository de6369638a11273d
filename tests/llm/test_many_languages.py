"""A text is held against every language, however many there are."""

import random

from tablelab.llm import language


def test_language_with_fewer_runs_of_letters_wins_by_size():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)]
    data = language.normalise(" ".join(words))
    runs = list({data[i : i + 3] for i in range(len(data) - 2)})
    # Ten languages have all runs of the text in some order; its own one has most of its words in a row.
    dictionaries = {f"l{i}": b"#".join(draw.sample(runs, len(runs))) for i in range(10)}
    dictionaries["own"] = data[: len(data) * 9 // 10]
    found = language.classifier(dictionaries)([None, " ".join(words), "12", " ".join(words)])
    assert [f[0] for f in found] == [language.UNKNOWN, "own", language.UNKNOWN, "own"]
    assert found[1] == found[3] and not found[1][3]


def test_more_languages_than_stay_ready():
    dictionaries = {f"l{i}": language.normalise(f"{chr(97 + i % 26)}{chr(97 + i // 26)}xyz" * 30) for i in range(language.READY + 9)}
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}xyz" * 30 for i in range(language.READY + 9)]
    found = language.classifier(dictionaries)(texts)
    alone = [language.classifier(dictionaries)([t])[0] for t in texts]
    assert found == alone and [f[0] for f in found] == list(dictionaries)
