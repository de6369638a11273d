"""Operators that judge each text by itself: language, packing, main text, decontamination, toxicity, fingerprints."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelab.llm import decontaminate, language, maintext, merkle, packing, toxicity, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", " \n\t ", "Word", "Ünï cödé, wörds Ａ", "x" * 5000, "same text here", "same text here", "á b. C! d?\n\n\ne", "tab\tand\x1fodd\x0bspace"]


def test_words_and_hashes():
    data, offsets = words.utf8(pa.array(ODD, pa.string()))
    hashes, starts, ends, word_offsets = words.word_hashes(data, offsets)
    found = [bytes(words.LOWER[data[a:b]]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in ODD for w in split(t)]
    assert np.diff(word_offsets).tolist() == [len(split(t)) for t in ODD]
    by_word = dict(zip(found, hashes.tolist(), strict=True))
    assert [by_word[w] for w in found] == hashes.tolist() and len(set(by_word.values())) == len(by_word)


def test_steps_cover_the_rows():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    assert list(words.steps(column, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(words.steps(column.slice(1, 3), 1)) [0][0] == 0
    assert list(words.steps(pa.array([], pa.string()))) == []


# --- language -------------------------------------------------------------------------------------------------


def test_language_learns_and_rejects(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in language.report(table).collect()}
    rows = table.collect()
    assert len(out) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r["held_out"]} == {r["doc_id"] for r in held}
    right = sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_cases(spark):
    base = ["the cat sat on the mat with the other cat and the dog"] * 3
    df = docs(spark, [*ODD, *base, "123 456 !!"], lang_pred="clash", score=1.0, margin=2)
    out = {r["doc_id"]: r for r in language.report(df).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and out[len(ODD) + 3]["lang_pred"] == "und"
    assert out[6]["lang_pred"] == out[7]["lang_pred"] == "en"
    kept = language.drop_rejected(df)
    assert kept.columns == df.columns and 0 not in {r["doc_id"] for r in kept.collect()}
    assert language.report(df.limit(0)).count() == 0
    unlabelled = language.report(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_many_labels_give_results(spark):
    """600 label values, each with words of its own; every text goes to its own value."""
    rng = random.Random(4)
    words_of = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(600)}
    rows = [(i, " ".join(rng.choice(words_of[lang]) for _ in range(30)), lang, "s", 1) for lang in words_of for i in range(2)]
    table = spark.createDataFrame(rows, SCHEMA)
    dictionaries = language.learn(table)
    assert set(dictionaries) == set(words_of)
    sample = table.filter("doc_id = 0 AND lang < 'l040'")
    found = language.identify(sample, dictionaries, keep=["lang"]).collect()
    assert len(found) == 40 and all(r["lang"] == r["lang_pred"] for r in found)


def test_language_is_the_smallest_of_plain_compressions(spark):
    import zstandard

    table = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    dictionaries = language.learn(table)
    found = {r["doc_id"]: r for r in language.identify(table, dictionaries).collect()}
    for row in table.collect():
        letters = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (row["text"] or "").lower())
        data = (" " + " ".join(letters.split(" ")) + " ").encode()
        data = b" " + b" ".join(data.split()) + b" "
        if not any(map(str.isalpha, row["text"] or "")):
            assert found[row["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = []
        for strategy in (zstandard.STRATEGY_FAST, zstandard.STRATEGY_LAZY2):
            of = {}
            for k, (name, raw) in enumerate(dictionaries.items()):
                parameters = zstandard.ZstdCompressionParameters(
                    window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=16, strategy=strategy, write_content_size=0, write_checksum=0, write_dict_id=0
                )
                made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
                of[name] = (sum(len(made.compress(data[a : a + 4096])) for a in range(0, len(data), 4096)), k)
            sizes.append(sorted((v, n) for n, v in of.items()))
        margin = lambda s: (s[1][0][0] - s[0][0][0]) / s[1][0][0]
        best = sizes[0] if margin(sizes[0]) >= language.NARROW else sizes[1]
        assert found[row["doc_id"]]["lang_pred"] == best[0][1] and found[row["doc_id"]]["margin"] == pytest.approx(margin(best))


# --- packing --------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    at = dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(v) for i, v in want.items()}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and (n & (n - 1)) == 0 for n in sequences.values())


def test_packing_is_an_exact_round_trip(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_packing(packing.report(table).collect(), [(r["doc_id"], r["text"]) for r in table.collect()])


def test_packing_cases(spark):
    texts = [*ODD, "a, b. c., d.. 'tis don't <|endoftext|> İstanbul ΣΑΣ straße ²3", "copy " * 3000, "copy " * 3000]
    df = docs(spark, texts, start=1, length="clash", sequence_id=3)
    check_packing(packing.report(df).collect(), list(enumerate(texts)))
    assert packing.report(df.limit(0)).count() == 0


def test_cached_tokenizer_forgets_nothing(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 5)
    tokenizer, cached = Tokenizer.from_file(packing.default_tokenizer()), packing.CachedTokenizer(packing.default_tokenizer())
    for _ in range(3):
        texts = ["one two three, four five six.", "seven eight; nine\nten"]
        assert [np.frombuffer(x, "<u2").tolist() for x in cached(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_curve_visits_every_cell_once():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


# --- main text ------------------------------------------------------------------------------------------------


def test_main_text_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        html = r["html"]
        article = html[html.index("<article>") + 9 : html.index("</article>")].replace("<br>", " ")
        import html as entities

        blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert maintext.main_text(html) == "\n\n".join(b for b in blocks if b)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="wrap"><div class="sidebar"><p>A, b, c, d, e, f, a
 text that is long, indeed, long.</p></div><div id="content"><h2>Title</h2><p>First para, with commas, and more text to score.<p>Second
one &amp; a <a href=x>link</a> in&nbsp;it, fine.<ul><li>One item, here<li>Two</ul><div class="comments"><p>I like it, really, very much.</p></div>
<form><p>Sign up, now</p></form></div></div><footer>(c) foo</footer><div class="cookie-notice"><p>We use cookies, yes, we do, a lot.</p></div>
<script>if (a<b) { x("<p>no</p>") }</script></body></html>"""


def test_main_text_cases(spark):
    want = "Title\n\nFirst para, with commas, and more text to score.\n\nSecond one & a link in it, fine.\n\nOne item, here\n\nTwo"
    pages = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", "plain"), (5, "x", "<p>a"), (6, "x", "<div>" * 20000 + "deep"), (7, "x", "<!-- open"), (7, "x", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    out = maintext.report(df).collect()
    assert [r["text"] for r in sorted(out, key=lambda r: r["page_id"])] == [want, "", "", "plain", "a", "deep", "", want]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert maintext.report(df.limit(0)).count() == 0


def test_comments_and_notices_beside_an_article_go():
    text = "<p>Some running text, with commas, in a longer sentence here.</p>"
    page = f"""<body><p>We use cookies here, as we like them, and so do you.</p><article><h1>Head</h1>{text * 4}
    <aside><p>Aside, with commas, and more.</p></aside></article><article class="comment"><p>Great, really great, thanks, all of you.</p></article>
    <section id="comments"><ol><li><p>First, of course, as ever, I am.</p></li></ol></section></body>"""
    assert maintext.main_text(page) == "\n\n".join(["Head", *["Some running text, with commas, in a longer sentence here."] * 4])


def test_siblings_of_the_best_container_stay():
    part = "<div class='part'>" + "<p>Some running text, with commas, in a longer sentence here.</p>" * 3 + "</div>"
    page = f"<body><div class='menu'><a href=a>One</a><a href=b>Two</a></div>{part}{part}<div class='ad'><p>Buy, buy, buy, buy, buy, now, please.</p></div></body>"
    assert maintext.main_text(page).count("Some running") == 6 and "Buy" not in maintext.main_text(page)


# --- decontamination ------------------------------------------------------------------------------------------


def brute_hits(text, items, width=13):
    ws, hit, named = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            window = w[k : k + width]
            for p in range(len(ws) - len(window) + 1):
                if ws[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    named.add(str(item))
    return len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("block", [200_000, 4])
def test_decontamination_is_brute_force(spark, block):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["the", "a", "Cat", "dög", "x1", "of"]) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (10, text(5)), (3, None), (4, ""), (5, "the"), (6, text(14)), (2, text(9))]
    items.append((7, items[0][1]))
    texts = [*ODD, text(300), items[0][1], "prefix " + items[0][1].upper().replace(" ", "--") + " suffix " + text(40), items[2][1], text(5000), *[text(30) for _ in range(20)]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    df = docs(spark, texts, n_words="clash", contaminated=True, item_ids=1)
    out = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(df, bench, max_windows=block).collect()}
    assert out == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_cases(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = docs(spark, ["one two three", None, "", "nothing of the kind", "one two three"])
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 5
    assert decontaminate.report(df.limit(0), bench).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------


def toxic_table(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(9)) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(6)] += " grubbel" + rng.choice("abcdefgh")
        rows.append((i, ". ".join(sentences) + ".", "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_documents_and_sentences(spark):
    table, labels = toxic_table(spark)
    out = {r["doc_id"]: r for r in toxicity.report(table, labels).collect()}
    held = [i for i, r in out.items() if r["held_out"]]
    assert held and set(held) == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.95
    model = toxicity.learn(table, labels)
    for r in toxicity.score(table, model, keep=["doc_id", "text"]).filter("score >= 0.5").collect():
        marked = [r["text"].encode()[a:b].decode() for a, b in zip(r["starts"], r["ends"], strict=True)]
        assert any("grubbel" in s for s in marked)
        assert all("." not in s for s in marked)


def test_toxicity_is_the_noisy_or_of_its_sentences(spark):
    table, labels = toxic_table(spark, 200)
    model = toxicity.learn(table, labels)
    weight, used = model.table(), set(model.features.tolist())
    for row in toxicity.score(table, model, keep=["text"]).collect():
        clear, weak = 1.0, 0.0
        for sentence in re.split("[.!?\n]", row["text"]):
            found = toxicity.features(*words.utf8(pa.array([sentence])))[0].ravel()
            own = [f for f in found.tolist() if f in used]
            p = 1 / (1 + np.exp(-(model.bias + sum(weight[f] for f in own)))) if own else 0.0
            if p < toxicity.LEAST_SCORE:
                weak = max(weak, p)
            else:
                clear *= 1 - p
        assert row["score"] == pytest.approx(1 - clear * (1 - weak), abs=1e-9)


def test_long_clean_texts_are_not_toxic(spark):
    table, labels = toxic_table(spark)
    model = toxicity.learn(table, labels)
    clean = [r["text"] for r in table.filter("doc_id % 4 <> 0").collect()]
    joined = " ".join(clean * (3_000_000 // sum(map(len, clean)) + 1))
    assert len(joined) >= 3_000_000
    found = toxicity.score(docs(spark, [joined, joined + " grubbela grubbelb."]), model).orderBy("doc_id").collect()
    assert found[0]["score"] < 0.1 and found[0]["starts"] == []
    assert found[1]["score"] > 0.5 and len(found[1]["starts"]) == 1


def test_toxicity_sample_is_bounded_by_bytes_alone(spark):
    table, labels = toxic_table(spark, 200)
    # Texts of any length are learned from as long as they fit together.
    long = table.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.lit("alpha1 beta2. "), 8000), "text")).otherwise(F.col("text")))
    assert len(toxicity.learn(long, labels).features)
    assert not len(toxicity.learn(table, labels, sample_bytes=10).features)


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    table, labels = toxic_table(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(toxicity.report(table, labels)) == key(toxicity.report(table, flipped))


def test_toxicity_cases(spark):
    table, labels = toxic_table(spark, 100)
    odd = docs(spark, ODD, score="clash", starts=1)
    out = toxicity.score(odd, toxicity.learn(table, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert [r["score"] for r in out if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    empty = toxicity.report(table, labels.limit(0)).collect()
    assert {r["predicted"] for r in empty} == {0}
    nulls = labels.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "quality", F.when(F.col("doc_id") > 5, F.col("toxic")).alias("toxic"))
    assert toxicity.report(table, nulls).count() == 100


# --- fingerprints ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    node = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tree = [
        [[node(x) for x in re.findall(merkle.SENTENCE, p) if x] for p in re.split(r"(?<=\n)(?!\n)", s)] for s in re.split(r"(?<=\n\n)(?!\n)", text or "")
    ]
    root = node("".join(node("".join(node("".join(p)) for p in s)) for s in tree))
    return root + ":" + ";".join("|".join(",".join(x[:8] for x in p) for p in s) for s in tree)


def test_fingerprints_are_brute_force(spark):
    texts = [t for t in ODD] + ["One. Two!\nThree?\n\nFour. " * 5, "One. Two!\nThree?\n\nFour. " * 5, "𝔘nicode 𝔴ide " * 20]
    df = docs(spark, texts, fingerprint="clash", _next=1)
    out = {r["doc_id"]: r for r in merkle.report(df).collect()}
    order = sorted(out, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if not text.endswith("\n"):
            assert r["fingerprint"] == brute_fingerprint(text)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert out[6]["fingerprint"] == out[7]["fingerprint"] and len({r["fingerprint"] for r in out.values()}) == len({t or "" for t in texts})
    assert merkle.report(df.limit(0)).count() == 0
    assert merkle.report(df.limit(1)).head()["near_next"] == 1.0
    assert merkle.report(docs(spark, ["a", "b"]).withColumn("doc_id", F.lit(None).cast("long"))).count() == 2


def test_edits_are_located(spark):
    a, b = "One. Two.\nThree. Four.\n\nFive. Six.\n", "One. Two.\nThree. 4.\n\nFive. Six.\n"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = df.select(merkle.edited_paragraphs(F.col("a"), F.col("b")).alias("at"), merkle.likeness(F.col("a"), F.col("b")).alias("near")).head()
    assert r["at"] == [1] and 0.5 < r["near"] < 1


def test_states_in_names_do_not_cut_an_article():
    text = "<p>Some running text, with commas, in a longer sentence here.</p>" * 4
    want = "\n\n".join(["Some running text, with commas, in a longer sentence here."] * 4)
    for name in ("article class='post comments-open'", "div class='entry-content has-related'", "main class='page nav-open'", "article class='post category-social'", "div class='social-box'"):
        tag = name.split()[0]
        assert maintext.main_text(f"<body><div class='menu'><p>Home, and more.</p></div><{name}>{text}</{tag}></body>") == want, name
    for name in ("article class='comment-body'", "div class='comments wrapper'", "div class='post-comments'", "div class='ad'"):
        tag = name.split()[0]
        assert maintext.main_text(f"<body><article>{text}</article><{name}>{text.replace('Some', 'Other')}</{tag}></body>") == want, name


def test_long_paragraphs_beside_an_article_stay():
    text = "<p>Some running text, with commas, in a longer sentence here.</p>" * 4
    intro = "An introduction of the article that stands before it, and that is a long enough sentence to be running text."
    assert maintext.main_text(f"<body><p>{intro}</p><article>{text}</article></body>").startswith(intro)


LONG = "Some running text, with commas, in a longer sentence here."


@pytest.mark.parametrize(
    "page,want",
    [
        # a short closing section beside a long one
        (f"<body><section>{f'<p>{LONG}</p>' * 6}</section><section><p>A short closing word, to end with.</p></section></body>", [LONG] * 6 + ["A short closing word, to end with."]),
        # a list of two linked references in the article
        (f"<article>{f'<p>{LONG}</p>' * 4}<ul><li><a href=a>First reference</a></li><li><a href=b>Second reference</a></li></ul></article>", [LONG] * 4 + ["First reference", "Second reference"]),
        # names that only hold a word of such parts
        (f"<article>{f'<p>{LONG}</p>' * 4}<p class='market share'>Of the market, a half.</p><div class='related-work'><p>Work of others.</p></div><p class='top-note'>A note.</p></article>",
         [LONG] * 4 + ["Of the market, a half.", "Work of others.", "A note."]),
        # whole names of such parts
        (f"<article>{f'<p>{LONG}</p>' * 4}<div class='share-buttons'><p>Tell your friends.</p></div><div id='related'><p>Read this.</p></div><div class='newsletter'>Mail me</div></article>", [LONG] * 4),
        # formulas
        (f"<article>{f'<p>{LONG}</p>' * 3}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", [LONG] * 3 + ["So x=2 holds."]),
        # a headline before the container, and one in the article's own header
        (f"<body><nav><a href=a>Menu</a></nav><h1>The headline</h1><article>{f'<p>{LONG}</p>' * 3}</article></body>", ["The headline"] + [LONG] * 3),
        (f"<body><header><h1>Site</h1></header><article><header><h1>The headline</h1><p>By someone</p></header>{f'<p>{LONG}</p>' * 3}</article></body>", ["The headline"] + [LONG] * 3),
        # a second, short article in main
        (f"<main><article>{f'<p>{LONG}</p>' * 5}</article><article><p>A second article, short as it is.</p></article></main>", [LONG] * 5 + ["A second article, short as it is."]),
    ],
)
def test_what_belongs_to_the_article_stays(page, want):
    assert maintext.main_text(page) == "\n\n".join(want)
