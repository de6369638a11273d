"""Lines with what follows them, across pages, against a plain walk."""

import random

from tablelab.operators import extract as ex


def walk(pages, wanted, after):
    """(doc, page, line number, text, following) of every wanted line; pages without lines are passed over."""
    out = []
    for doc in {d for d, _, _ in pages}:
        lines = [(p, i, t) for _, p, text in sorted((d, p, t or "") for d, p, t in pages if d == doc) for i, t in enumerate(text.split("\n") if text else [], start=1)]
        for k, (p, i, t) in enumerate(lines):
            if wanted in t:
                out.append((doc, p, i, t, [tuple(x) for x in lines[k + 1 : k + 1 + after]]))
    return sorted(out)


def test_following_lines_across_pages(spark):
    rng = random.Random(6)
    pages = []
    for doc in range(25):
        for page in range(rng.randint(1, 9)):
            pages.append((doc, page, "\n".join(rng.choice(["anchor here", "x", "y 1", "-", "z"]) for _ in range(rng.randint(0, 6))) or None))
    pages += [(99, p, "anchor here") for p in range(30)]
    df = spark.createDataFrame(pages, "doc long, page int, text string")
    found = ex.lines_with_following(df, "doc", "text", "page", "anchor", after=4).collect()
    got = sorted((r["doc_id"], r["page"], r["line_no"], r["text"], [(x["page"], x["line_no"], x["text"]) for x in r["following"]]) for r in found)
    assert got == walk(pages, "anchor", 4)


def test_look_ahead_ends_with_the_document(spark):
    df = spark.createDataFrame([(1, 1, "a\nlast"), (1, 2, "c\nlast")], "doc long, page int, text string")
    opened = ex.lines_with_following(df, "doc", "text", "page", "last", after=2).collect()
    assert sorted(len(r["following"]) for r in opened) == [0, 2]
