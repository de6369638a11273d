"""Periodic runs, licence scans and token alignment beside brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelab.llm import alignment, licences, repetitions

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, texts, ids=None, **more):
    ids = ids if ids is not None else range(len(texts))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", " \n\t ", "Word", "Ünï cödé, wörds Ａ", "x " * 5000, "same text", "same text", "tab\tand\x1fodd\x0bspace", "a▁b", "😀 <s> <|endoftext|> 's  two"]
#: Names that the operators use for columns of their own.
CLASHES = ("_row", "_found", "_best", "_lines", "word", "at", "links", "rest", "template", "share", "pair", "runs")


# --- periodic runs --------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            stretch = w[i : i + size]
            if size >= max(least, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    w = planted(doc_id, [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x])
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_random_words_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        rows = []
        for _ in range(rng.randint(1, 4)):
            letters, w = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrst"]), []
            while len(w) < 100 and rng.random() < 0.8:
                part = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
                w += (part * rng.randint(1, 9))[: rng.randint(1, 70)]
            rows.append(w)
        distinct, numbers, offsets = repetitions.word_numbers(pa.array([" ".join(w) for w in rows]))
        starts, lengths, periods = repetitions.runs_of(numbers, offsets)
        for k, w in enumerate(rows):
            here = [(int(s - offsets[k]), int(n), int(q)) for s, n, q in zip(starts, lengths, periods, strict=True) if offsets[k] <= s < offsets[k + 1]]
            assert here == brute_runs(w)


def test_splitting_leaves_no_word_that_its_segment_holds_once():
    _, numbers, offsets = repetitions.word_numbers(pa.array(["a b c d e f " * 3 + "only " + "g h i j k l m n o p q r", None, "x " * 30]))
    places, segment = repetitions.surviving(numbers, offsets)
    assert len(places) == 18 + 30 and len(set(segment.tolist())) == 2
    assert all(n >= 2 for n in Counter(zip(segment.tolist(), numbers[places].tolist(), strict=True)).values())


def test_runs_of_a_long_text_take_little_work(spark):
    texts = ["x " * 200_000, " ".join(str(i % 777) for i in range(200_000))]
    found = repetitions.find_runs(docs(spark, texts)).orderBy("doc_id").collect()
    assert [[tuple(r) for r in row["runs"]] for row in found] == [[(0, 200_000, 1)], [(0, 200_000, 777)]]
    assert found[0]["collapsed"] == "x" and found[1]["collapsed"] == " ".join(str(i) for i in range(777))


def test_runs_report_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in table.collect() if len(r["text"] or "") < 20_000]
    # Ids of the rule's tenth, with odd texts too.
    tenth = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += list(zip(tenth, [*ODD, "a b c d e f g " * 9, "one two " * 40], strict=False)) + [(None, "same " * 20), (None, "same " * 20)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows], **dict.fromkeys(CLASHES, "x"))
    found = [tuple(r)[:8] for r in repetitions.report(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(found, key=key) == sorted((expected_runs(*r) for r in rows), key=key)


def test_runs_of_an_empty_table(spark):
    assert repetitions.report(docs(spark, [])).collect() == []


# --- licences -------------------------------------------------------------------------------------------------


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected_licences(texts):
    """Every start of every text, judged word by word."""
    all_words = [split(t) for t in texts]
    df = Counter(w for ws in all_words for w in set(ws))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    out = []
    for ws in all_words:
        places = []
        for t in licences.TEMPLATES:
            parts = t.words()
            whole = sum(idf(w) for _, w, _ in parts)
            for o in range(len(ws)):
                stands = [o + at < len(ws) and ws[o + at] == w for at, w, _ in parts]
                if all(s for s, (_, _, key) in zip(stands, parts, strict=True) if key):
                    share = sum(idf(w) for s, (_, w, _) in zip(stands, parts, strict=True) if s) / whole
                    if share >= licences.LEAST_SHARE:
                        places.append((o, t, share))
        base = [o for o, t, _ in places if t.base]
        names = lambda it: ",".join(sorted({t.label for t in it}))
        out.append((len(ws), len(base), min(base, default=None), max(base, default=None), names(t for _, t, _ in places if t.base),
                    names(t for _, t, _ in places), pytest.approx(max((s for *_, s in places), default=0.0), abs=1e-6)))
    return out


LICENCES = [
    "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "ALL RIGHTS RESERVED all rights reserved, all rights", "the GNU General Public License, version 3",
    "general public licence", "General\nPublic  LICENSE", "mit license", "MIT licence", "Apache License Version 2", "apache license, version 2.0", "lİcense all righTs reserved",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following", "Redistribution and use in source forms",
    "all rights reserved " * 3000, "Permission is hereby granted, free of charge, to any person obtaining a copy", "worK and all rights reserved",
]


def test_licences_equal_a_word_by_word_search(spark):
    texts = [*ODD, *LICENCES, *LICENCES[:3]]
    df = docs(spark, texts, **dict.fromkeys(CLASHES, "x"))
    found = [tuple(r)[1:] for r in licences.report(df).orderBy("doc_id").collect()]
    assert found == expected_licences(texts)
    assert {"cc-by,cc-by-nc-4.0", "cc-by", "reserved", "gpl,gpl-3.0", "gpl", "mit", "apache-2.0", "bsd"} <= {r[5] for r in found}


def test_licences_of_null_ids_and_of_an_empty_table(spark):
    rows = licences.report(docs(spark, ["cc by", "cc by", None], [None, None, None])).collect()
    assert sorted(r["n_base"] for r in rows) == [0, 1, 1]
    assert licences.report(docs(spark, [])).collect() == []


def test_licence_templates_and_their_bound(spark):
    assert licences.Template("x", "A b, C", ("b c",)).words() == [(0, "a", False), (1, "b", True), (2, "c", True)]
    with pytest.raises(ValueError):
        licences.Template("x", "a b", ("c",)).words()
    with pytest.raises(ValueError):
        licences.scan(docs(spark, []), templates=[licences.Template("x", "a " * 100_001)])
    rows, places = licences.scan(docs(spark, ["so free to use", "free"]), templates=[licences.Template("own", "free to use it", ("free to use",))])
    assert [(r["label"], r["start"], r["share"] < 1) for r in places.collect()] == [("own", 1, True)]


def test_licence_plan_has_no_python(spark):
    plan = licences.report(docs(spark, ["cc by"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- alignment ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    both = alignment.Both(*alignment.default_tokenizers())
    return both.sides


def brute_alignment(sides, text):
    """(a ids, b ids, groups, overlaps) by walking both token lists."""
    if not text:
        return [], [], [], []
    made = [side([text])[0] for side in sides]
    if any(b"".join(side.bytes[i] for i in ids) != (" " + text).encode() for side, ids in zip(sides, made, strict=True)):
        return [], [], [], []
    spans = []
    for side, ids in zip(sides, made, strict=True):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(side.bytes[i])))
        spans.append(out)
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for end in common:
        groups.append(tuple([i for i, (_, e) in zip(ids, s, strict=True) if low < e <= end] for ids, s in zip(made, spans, strict=True)))
        low = end
    overlaps = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b] if len(text) < 2000 else None
    return *made, groups, overlaps


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected_alignment(sides, texts):
    made = [brute_alignment(sides, t) for t in texts]
    counts = Counter((a[-1], b[-1]) for *_, groups, _ in made for a, b in groups)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, groups, _ in made:
        links = [(x[-1], y[-1]) for x, y in groups]
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""))
    return out


TEXTS = [*ODD, " lead", "trail ", "  two  spaces ", "line\nline \n x\ttab", "中文 テスト ไทย", "é è́  nbsp a　b", "\x01 \x1c a", "it's 's '", "a <0x41> b", "ÀÉ ɏ 12 3.4 -- - x", "unhappily " * 40]


def test_alignment_report_equals_brute_force(spark, sides):
    texts = [*TEXTS, *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    df = docs(spark, texts, **dict.fromkeys(CLASHES, "x"))
    found = [tuple(r)[1:] for r in alignment.report(df).orderBy("doc_id").collect()]
    assert found == expected_alignment(sides, texts)


def test_alignment_outputs(spark, sides):
    rows = alignment.align(docs(spark, TEXTS), outputs=("n_a", "n_b", "n_overlaps", "overlaps", "links", "groups")).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, rows, strict=True):
        a, b, groups, overlaps = brute_alignment(sides, text)
        assert row["groups"] == written(groups) and (row["n_a"], row["n_b"]) == (len(a), len(b))
        assert [tuple(x) for x in row["links"]] == [(x[-1], y[-1]) for x, y in groups]
        if overlaps is not None:
            assert [tuple(x) for x in row["overlaps"]] == overlaps and row["n_overlaps"] == len(overlaps)


def test_alignment_counts_without_hot_pairs_are_the_same(spark):
    rows = alignment.align(docs(spark, [*TEXTS, *TEXTS[:4]]), outputs=("packed_links",))
    figures = [sorted(tuple(r) for r in alignment.link_figures(rows, ["doc_id"], hot=h).collect()) for h in (0, 50, alignment.HOT)]
    assert figures[0] == figures[1] == figures[2]


def test_pieces_are_remembered_within_a_bound(sides, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 5)
    both = alignment.Both(*alignment.default_tokenizers())
    for text in ("one two three four", "five six seven a▁b eight nine", "one a▁b", "one"):
        a, b = both([text])
        whole = brute_alignment(sides, text)
        assert (a[0].tolist(), b[0].tolist()) == (whole[0], whole[1])
        assert len(both.number) <= max(5, len(text.split()))


def test_alignment_of_an_empty_table_and_of_null_ids(spark):
    assert alignment.report(docs(spark, [])).collect() == []
    rows = alignment.report(docs(spark, ["a b", "a b"], [None, None])).collect()
    assert [r["n_groups"] for r in rows] == [2, 2] and all(r["count_sum"] == 4 for r in rows)
