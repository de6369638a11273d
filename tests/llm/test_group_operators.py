"""Operators that compare texts with each other: near duplicates, substrings, n-gram scores, quotes, the pipeline."""

import hashlib
import importlib.util
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablelab.llm import backoff, chunks, components, language, neardups, quotes, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def docs(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def classes_of(pairs, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- near duplicates ------------------------------------------------------------------------------------------


def multiset(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(texts):
    sets = {i: multiset(t) for i, t in texts.items() if t is not None}
    pairs = [(i, j) for i in sets for j in sets if i < j and (similarity(sets[i], sets[j]) >= 0.8 if sets[i] else texts[i] == texts[j])]
    return classes_of(pairs, texts)


def near_copies(n=60):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop") + str(rng.randrange(30))
    base = [word() for _ in range(120)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out + [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["a b c", "A, b; c!", "", "", "!!", None, "rep " * 200, "rep " * 190]


def test_signatures_are_unbiased():
    a = " ".join(f"w{i}" for i in range(300))
    texts = [a, " ".join(a.split()[:240] + [f"z{i}" for i in range(60)]), " ".join(a.split()[:100] * 3 + a.split()[100:]), "x y", ""]
    times = neardups.signatures(*neardups.multisets(pa.array(texts)), len(texts), 4096)
    for i in range(3):
        for j in range(i):
            assert abs((times[i] == times[j]).mean() - similarity(multiset(texts[i]), multiset(texts[j]))) < 0.035
    assert np.isinf(times[4]).all() and np.isfinite(times[3]).all()


@pytest.mark.parametrize("small,block", [(24, 2048), (1, 8)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardups, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardups, "BLOCK", block)
    texts = dict(enumerate(near_copies()))
    df = docs(spark, list(texts.values()), class_id="clash", weight=1, id=3)
    found = neardups.report(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(texts)
    kept = neardups.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(brute_classes(texts).values())


def test_candidates_lose_less_than_bands():
    n, p = neardups.SLOTS, neardups.SIMILARITY
    unlikely = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(neardups.LIKELY * n)))
    assert unlikely < 0.01 * (1 - p**neardups.ROWS) ** neardups.BANDS


def test_near_duplicates_of_odd_tables(spark):
    df = docs(spark, ["one two three four five six"] * 3)
    twice = df.union(df)
    assert {r["class_id"] for r in neardups.report(twice).collect()} == {0} and neardups.drop_near_duplicates(twice).count() == 1
    unnamed = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert neardups.drop_near_duplicates(unnamed).count() == 3
    assert neardups.report(df.limit(0)).count() == 0 and neardups.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 150)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 150: 150, 200: 150}


# --- substrings -----------------------------------------------------------------------------------------------


def test_gear_hash_and_cuts():
    text = "hello wörld this is a test of the rolling hash, and its cuts \n" * 4 + "é" * 900
    data, offsets = words.utf8(pa.array(["", text, "x " + text]))
    starts, ends, digests, counts = chunks.cut(data, offsets)
    raw, h, cuts = text.encode(), 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        blank = b in b" \n\t\r\x0b\x0c" and h < 2**32 / 5
        begins = i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        if blank or begins and h < 2**32 / 256 or i + 1 == len(raw):
            cuts.append(i + 1)
    assert [int(x) for x in ends if x <= len(raw)] == cuts
    assert counts.sum() == len(text.split()) * 2 + 1
    # An insertion moves no cut beyond the window.
    shared = set(digests[: len(cuts)].tolist()) & set(digests[len(cuts) :].tolist())
    assert len(shared) >= len(set(digests[: len(cuts)].tolist())) - 8


def test_passages_are_cut_once(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = text(80)
    texts = [f"{text(60)} {passage} {text(50)}" for _ in range(10)] + [text(200) for _ in range(10)] + [None, "", "short", passage, passage]
    df = docs(spark, texts, starts="clash", n_chunks=1)
    out = {r["doc_id"]: r for r in chunks.report(df).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_repeated"] > 0
    inner = passage[len(passage) // 3 : -len(passage) // 3]
    for i in range(1, 10):
        assert inner not in out[i]["text"] and out[i]["words_removed"] >= 50
        raw, kept, at = texts[i].encode(), b"", 0
        for a, b in zip(out[i]["starts"], out[i]["ends"], strict=True):
            kept, at = kept + raw[at:a], b
        assert (kept + raw[at:]).decode() == out[i]["text"]
    for i in (*range(10, 20), 20, 21, 22):
        assert out[i]["text"] == texts[i] and out[i]["words_removed"] == 0
    kept = chunks.drop_repeats(df)
    assert kept.columns == df.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) >= set(range(23)) and all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    assert chunks.drop_repeats(df.limit(0)).count() == 0


def test_no_long_repeat_is_left(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")

    def repeats(rows):
        first, out = {}, set()
        for i, t in sorted(rows):
            w = (t or "").split()
            for k in range(len(w) - 49):
                owner = first.setdefault(tuple(w[k : k + 50]), i)
                out |= {i} if owner != i else set()
        return out

    before = repeats([tuple(r) for r in table.collect()])
    out = chunks.report(table).collect()
    assert before and not repeats([(r["doc_id"], r["text"]) for r in out])
    assert before <= {r["doc_id"] for r in out if r["words_removed"]}


def test_passages_without_blanks_are_cut(spark):
    rng = random.Random(8)
    scripts = {
        "chinese": lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
        "thai": lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n)),
        "rare": lambda n: "".join(chr(rng.randrange(0x20000, 0x2A000)) for _ in range(n)),
        "latin": lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(10 * n)),
        **{f"blank {ord(b):x}": lambda n, b=b: b.join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n // 4)) for b in "\u00a0\u3000"},
    }
    for name, text in scripts.items():
        passage = text(400)
        texts = [text(100) + passage + text(100) for _ in range(3)] + [passage, passage, text(400)]
        out = {r["doc_id"]: r for r in chunks.report(docs(spark, texts)).collect()}
        assert out[0]["text"] == texts[0] and out[0]["n_repeated"] > 0 and out[5]["text"] == texts[5], name
        for i in (1, 2, 3, 4):
            assert passage[len(passage) // 3 : -len(passage) // 3] not in out[i]["text"] and out[i]["starts"], name
        if name != "latin":
            assert all(out[i]["words_removed"] >= 50 for i in (1, 2, 4)), name
        assert {r["doc_id"] for r in chunks.drop_repeats(docs(spark, texts)).collect()} >= {0, 1, 2, 5}


def test_rows_of_one_or_no_id(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(80))] * 3
    same = docs(spark, texts).withColumn("doc_id", F.lit(1).cast("long"))
    assert {r["words_removed"] for r in chunks.report(same).collect()} == {0}
    none = same.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["words_removed"] for r in chunks.report(none).collect()} == {0}


# --- n-gram scores --------------------------------------------------------------------------------------------


def brute_scores(texts, alpha=0.4):
    lists = {i: split(t) for i, t in texts.items()}
    ones, twos = Counter(), Counter()
    for w in lists.values():
        ones.update(w)
        twos.update(zip(w, w[1:], strict=False))
    total = sum(ones.values())
    out = {}
    for i, w in lists.items():
        s = math.log(ones[w[0]] / total) if w else 0.0
        for a, b in zip(w, w[1:], strict=False):
            s += math.log(twos[a, b] / ones[a]) if twos[a, b] >= 2 else math.log(alpha * ones[b] / total)
        out[i] = (len(w), s)
    return out


@pytest.mark.parametrize("size,heavy", [(32 << 20, 2000), (2000, 20)])
def test_backoff_is_brute_force(spark, monkeypatch, size, heavy):
    monkeypatch.setattr(backoff, "HEAVY", heavy)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "x", "Y"] + [f"w{k}" for k in range(200)]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts = dict(enumerate([*texts, None, "", "!!", "the", "the of " * 2000]))
    out = {r["doc_id"]: r for r in backoff.report(docs(spark, list(texts.values()), n_words="clash", id=1, value=2), part_bytes=size).collect()}
    for i, (n, s) in brute_scores(texts).items():
        assert out[i]["n_words"] == n and out[i]["log_score"] == pytest.approx(s, rel=1e-9)
        assert (out[i]["mean_log_score"] is None) == (n == 0)


def brute_orders(texts, order, least, own, alpha=0.4):
    lists = {i: split(t) for i, t in texts.items()}
    grams = Counter(tuple(w[j : j + n]) for w in lists.values() for n in range(1, order + 1) for j in range(len(w) - n + 1))
    total = sum(map(len, lists.values()))
    out = {}
    for i, w in lists.items():
        s = 0.0
        for j in range(len(w)):
            longest = min(order, j + 1)
            for n in range(longest, 0, -1):
                c = grams[tuple(w[j - n + 1 : j + 1])] - own
                if n == 1:
                    s += math.log(max(c, 1) / (total - own)) + (longest - 1) * math.log(alpha)
                elif c >= least:
                    s += math.log(c / (grams[tuple(w[j - n + 1 : j])] - own)) + (longest - n) * math.log(alpha)
                    break
        out[i] = (len(w), s)
    return out


@pytest.mark.parametrize("size,heavy,order,least,own", [(32 << 20, 2000, 5, 1, 1), (2000, 20, 5, 1, 1), (4000, 5, 3, 2, 0), (4000, 20, 4, 1, 0)])
def test_backoff_of_long_orders_is_brute_force(spark, monkeypatch, size, heavy, order, least, own):
    monkeypatch.setattr(backoff, "HEAVY", heavy)
    rng = random.Random(9)
    phrases = [" ".join(rng.choice(["the", "of", "x"] + [f"w{k}" for k in range(60)]) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts = [" ".join(rng.choice(phrases) for _ in range(rng.randrange(12))) for _ in range(80)]
    texts = dict(enumerate([*texts, None, "", "once", "the of x the of " * 300]))
    found = backoff.report(docs(spark, list(texts.values())), part_bytes=size, order=order, least=least, leave_out=bool(own)).collect()
    out = {r["doc_id"]: r for r in found}
    for i, (n, s) in brute_orders(texts, order, least, own).items():
        assert out[i]["n_words"] == n and out[i]["log_score"] == pytest.approx(s, rel=1e-9)


@pytest.mark.parametrize("heavy", [2000, 5])
def test_shares_of_a_part_are_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(backoff, "HEAVY", heavy)
    monkeypatch.setattr(backoff, "SHARE_WORDS", 40)
    rng = random.Random(11)
    texts = dict(enumerate(" ".join(rng.choice(["the", "of"] + [f"w{k}" for k in range(40)]) for _ in range(30)) for _ in range(40)))
    for order, least, own in ((2, 2, 0), (4, 1, 1)):
        found = backoff.report(docs(spark, list(texts.values())), order=order, least=least, leave_out=bool(own)).collect()
        out = {r["doc_id"]: r["log_score"] for r in found}
        for i, (_, s) in brute_orders(texts, order, least, own).items():
            assert out[i] == pytest.approx(s, rel=1e-9)


def test_memory_of_a_part(spark):
    """A part of 800,000 words is not sorted in memory at once."""
    import tracemalloc
    from types import SimpleNamespace

    rng = random.Random(12)
    text = pa.array([" ".join(f"w{rng.randrange(100_000)}" for _ in range(20_000)) for _ in range(40)])
    table, codes, offsets = backoff._ngrams(text, 2)
    none = np.zeros(0, np.uint64)
    heavy = SimpleNamespace(value={"words": none, "keys": none, "counts": np.zeros(0)})
    packed = backoff._packed(table, np.zeros(len(table), np.int64), 0, codes)
    part = backoff._rows([(3, 0, np.arange(40), np.diff(offsets).astype("<u4"), packed)])
    score = backoff._scorer(heavy, 1, 2, backoff._Rule(800_000, backoff.ALPHA, 2, False))
    tracemalloc.start()
    out = score(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows and peak < 90 * 800_000, peak


def test_columns_of_a_part_are_short(spark):
    """Ids and numbers come back as they were, near ones in a byte or two each."""
    least, most = -(1 << 63), (1 << 63) - 1
    rng = np.random.default_rng(13)
    for values in ([], [7], [least, most], [most, least, 0, -1], [5, 5, 5], range(40), rng.integers(least, most, 50), np.sort(rng.integers(0, 10**6, 5000))):
        for kind in (np.int64, np.int32, np.uint32):
            column = np.array(list(values), np.int64).astype(kind)
            raw = backoff._bytes(column)
            assert (backoff._numbers(pa.scalar(raw)) == column).all()
    assert len(raw) < 2.1 * 5000 + 13


def test_rows_of_a_part_are_small(spark):
    """Frequent words travel as codes, and what a part makes leaves in rows of at most 512 KB."""
    rng = random.Random(14)
    texts = [" ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(60)) for _ in range(4000)]
    df = docs(spark, texts).select(F.col("doc_id").alias("id"), "text").repartition(2)
    total, heavy = backoff._heavy_counts(df, 2)
    shared, rule = spark.sparkContext.broadcast(heavy), backoff._Rule(240_000, backoff.ALPHA, 2, False)
    assert total == 240_000 and len(heavy["keys"]) <= 2 * 2 * backoff.HEAVY and len(heavy["words"]) <= backoff.CODED + 2 * backoff.HEAVY
    made = backoff._explode(df, shared, 20, 2, rule).filter("kind = 3").toArrow()
    size = sum(pa.compute.sum(pa.compute.binary_length(made.column(c))).as_py() for c in ("ids", "a", "b"))
    assert size < 10 * 240_000, size
    part = backoff._rows([(0, 0, *[np.zeros(0)] * 3)]).slice(0, 0)
    out = backoff._scorer(shared, 20, 2, rule)(pa.concat_tables([part, made]))
    assert max(len(x[c].as_buffer()) for x in out.to_struct_array() for c in ("ids", "a", "b")) <= 1 << 19


def test_pairs_of_a_small_corpus_need_two_places(spark):
    rng = random.Random(10)
    texts = dict(enumerate(" ".join(rng.choice([f"w{k}" for k in range(30)]) for _ in range(20)) for _ in range(15)))
    out = {r["doc_id"]: r["log_score"] for r in backoff.report(docs(spark, list(texts.values()))).collect()}
    for i, (_, s) in brute_scores(texts).items():
        assert out[i] == pytest.approx(s, rel=1e-9)


def test_backoff_of_odd_tables(spark):
    df = docs(spark, ["a b a b"] * 2)
    assert backoff.report(df.limit(0)).count() == 0
    one = backoff.report(df.withColumn("doc_id", F.lit(1).cast("long"))).collect()
    assert len(one) == 2 and {r["n_words"] for r in one} == {8}
    assert {r["n_words"] for r in backoff.report(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()} == {8}
    assert backoff.report(docs(spark, [None, ""])).filter("n_words = 0").count() == 2


# --- quotes ---------------------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "How do I sort a list? I need it fast.\n\nAlso a second thing here."),
    (1, 1, "assistant", "On Monday, A wrote:\n> How do I sort a\n> list? I need it fast.\n\nUse sorted."),
    (1, 2, "user", "B wrote:\n>> How do I sort a list? I need it fast.\n> Use sorted.\n\nThanks a lot for it."),
    (1, 3, "assistant", "> Also a second thing here.\nWhat second thing?"),
    (1, 4, "user", "> nobody said this at all\nhm"),
    (2, 0, None, None), (2, 1, "user", ""), (None, 1, "user", "> Use sorted.\nx"), (1, None, "user", "> Use sorted."), (1, 2, "user", "again the same turn"),
]


def test_quotes_link_messages(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1)).withColumn("c", F.lit(2))
    out = defaultdict(list)
    for r in quotes.report(df).collect():
        out[r["conv_id"], r["turn"]].append(r)
    links = {k: (v[0]["reply_to"], v[0]["thread"], v[0]["depth"]) for k, v in out.items()}
    assert links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2) and links[1, 3] == (0, 0, 1) and links[1, 4] == (None, 4, 0)
    assert links[1, 0] == (None, 0, 0) and links[None, 1][0] is None and links[1, None] == (None, None, 0)
    assert out[1, 1][0]["text"] == "Use sorted." and out[1, 2][0]["text"] in ("Thanks a lot for it.", "again the same turn") and len(out[1, 2]) == 2
    assert out[2, 0][0]["text"] is None and out[1, 3][0]["chat"] == "<|assistant|>\nWhat second thing?<|end|>\n"
    assert sum(map(len, out.values())) == len(MESSAGES) and quotes.report(df.limit(0)).count() == 0


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "message number zero")] + [(1, i, "user", f"> message number {'zero' if i == 1 else i - 1}\nmessage number {i}") for i in range(1, 40)]
    out = quotes.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["depth"], r["thread"]) for r in out) == [(i, i, 0) for i in range(40)]


def test_replies_stand_in_the_order_of_the_tree(spark):
    """Random trees of replies against a recursive walk; several turns quote the same message."""
    rng = random.Random(8)
    rows, order = [], {}
    for conv in range(6):
        parent = {i: rng.randrange(i) if i and rng.random() < 0.85 else None for i in range(40)}
        says = lambda i, conv=conv: f"conversation {conv} message number {i} here"
        rows += [(conv, i, "user", (f"> {says(p)}\n" if (p := parent[i]) is not None else "") + says(i)) for i in range(40)]
        children = defaultdict(list)
        for i, p in parent.items():
            children[p].append(i)

        def walk(i):
            return [i, *(x for c in sorted(children[i]) for x in walk(c))]

        for top in children[None]:
            order[conv, top] = walk(top)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_text", F.lit("x")).withColumn("_c", F.lit("x"))
    linked = quotes.link_quotes(df)
    found = defaultdict(list)
    for r in linked.collect():
        found[r["conv_id"], r["thread"]].append((r["position"], r["turn"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: list(enumerate(v)) for k, v in order.items()}
    pieces = defaultdict(str)
    for r in quotes.conversations(linked, piece=5).orderBy("conv_id", "thread", "piece").collect():
        assert r["n_messages"] <= 5
        pieces[r["conv_id"], r["thread"]] += r["chat"]
    for (conv, top), turns in order.items():
        assert pieces[conv, top] == "".join(f"<|user|>\nconversation {conv} message number {i} here<|end|>\n" for i in turns)


def test_every_conversation_keeps_its_messages(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert quotes.report(table).count() == table.count()


@pytest.mark.parametrize("names", [("earlier", "later", "_id", "_text"), ("id", "words_removed", "starts", "_key", "_kept", "_others", "_left")])
def test_repeats_are_cut_whatever_other_columns_are_called(spark, names):
    passage = " ".join(f"word{i}" for i in range(80))
    texts = [f"first of all {passage} and an end", f"second to begin {passage} with another", "short", None]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    plain = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(df).collect()}
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    found = chunks.drop_repeats(df)
    assert found.columns == df.columns
    for r in found.collect():
        assert r["text"] == plain[r["doc_id"]] and all(r[n] == f"{n}{r['doc_id']}" for n in names)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert "word40" in plain[0] and "word40" not in plain[1]


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages_hold_what_they_promise(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    at = corpus_pipeline.checkpointed(corpus_pipeline.identify_language(spark, table, SF))
    sure = {r["doc_id"] for r in language.report(table).collect() if not r["rejected"]}
    assert {r["doc_id"] for r in at.collect()} == sure and at.columns == table.columns
    before = {r["doc_id"]: r["text"] for r in at.collect()}
    at = corpus_pipeline.checkpointed(corpus_pipeline.remove_near_duplicates(spark, at, SF))
    assert {r["doc_id"] for r in at.collect()} == set(brute_classes(before).values())
    at = corpus_pipeline.checkpointed(corpus_pipeline.remove_repeated_passages(spark, at, SF))
    assert at.columns == table.columns
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for i, t in texts.items():
        w, hit = split(t), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    at = corpus_pipeline.checkpointed(corpus_pipeline.remove_contaminated(spark, at, SF))
    assert {r["doc_id"] for r in at.collect()} == clean and at.columns == table.columns
    packed = corpus_pipeline.pack(spark, at, SF).collect()
    assert {r["doc_id"] for r in packed} == clean
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert len(run) == len(packed) and {k[0] for k in key(run)} == clean


def test_digest_of_no_items_is_that_of_the_empty_text():
    from tablelab.llm import decontaminate

    assert decontaminate.digest([]) == hashlib.sha256(b"").hexdigest()
    assert importlib.util.find_spec("tablelab.llm.queries") is not None
