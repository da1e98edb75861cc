"""Operators over single texts: quality rules, tokens, licences, toxicity, language model, pages."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from glyphlake.llm import bpe, html, licences, lm, quality, toxicity

WS = " \t\n\r\x0b\x0c"


def frame(spark, rows, columns="doc_id bigint, text string, lang string, source string, n_words string"):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, repeated rows and clashing columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "one two three four five six", "en", "a", "x"), (1, "one two three four five six", "en", "a", "x"), (2, None, None, None, None), (None, "no id here but words", "en", "a", ""), (3, "", "de", None, ""), (4, long_text, "en", "a", ""), (5, " \n\n\t ", "en", "b", ""), (6, "　\xa0é ퟿", "fr", "b", "")]
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 0, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "u", None, "k"), (2, None, "", "k"), (2, None, "", "k"), (3, "u", "<p>a&amp;b\n c<p>d", "k")], "page_id bigint, url string, html string, text string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    frame(spark, []).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def names():
    from glyphlake.llm import registry

    return list(registry.QUERIES)


@pytest.mark.parametrize("name", names())
def test_odd_rows(spark, odd, name):
    from glyphlake.llm import registry

    rows = registry.QUERIES[name](spark, odd).collect()
    assert len(rows) == (4 if "html" in name else 8)


@pytest.mark.parametrize("name", names())
def test_empty_tables(spark, empty, name):
    from glyphlake.llm import registry

    assert registry.QUERIES[name](spark, empty).collect() == []


# Operator 5


def reference_encoding():
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    return data, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})


def test_tokens_equal_tiktoken():
    data, enc = reference_encoding()
    codec = bpe.Codec(data, P.PATTERN)
    r = random.Random(5)
    letters = "ab éß 　\n\t ' .,1２x!$😀\0\x1ćñ"
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + ["", " ", "  a", " a", "a ", "x" * 3000, "it's we'll  go\n\n b", "hello world " * 50, "!" * 500]
    ids = codec.encode([t.encode() for t in texts])
    for t, i in zip(texts, ids):
        assert list(memoryview(i).cast("I")) == enc.encode_ordinary(t), repr(t)
        assert codec.decode(i) == t.encode()


def test_both_segment_trees_agree():
    data, _ = reference_encoding()
    codec = bpe.Codec(data, P.PATTERN)
    r = random.Random(6)
    for _ in range(300):
        piece = bytes(r.choices(b"etaoinshr ,.\xc3\xa9", k=r.randint(2, 60)))
        if piece not in codec.ranks:
            one = b"".join(i.to_bytes(4, "little") for i in bpe.merge_piece(piece, codec.ranks))
            assert bpe.merge_pieces([piece], codec.pairs, codec.byte_ids) == [one]


# Operator 8


def brute_counts(t):
    words = [w for w in "".join(" " if c in WS else c for c in t).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts():
    r = random.Random(8)
    texts = ["", " ", "a", "a b c d e f g h a b c d e f g h", "é ü # $$ <b>\nx\nx\n\n \n"]
    for _ in range(200):
        texts.append("".join(r.choice(["ab ", "c\n", "é\t", "# ", "dd dd ", "a b c d e f g h i\n"]) for _ in range(r.randint(0, 60))))
    got = quality.count_texts([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def test_quality_thresholds_follow_the_group(spark):
    r = random.Random(9)

    def prose(n, symbol):
        return " ".join(r.choice("abcdefghij") * r.randint(1, 5) + (symbol if r.random() < 0.5 else "") for _ in range(n))

    rows = [(k, prose(60, "#"), "xx", "code", "") for k in range(60)] + [(100 + k, prose(60, ""), "xx", "news", "") for k in range(60)] + [(999, prose(60, "#"), "xx", "news", "")]
    out = {r["doc_id"]: r["_q_kept"] for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert sum(out[k] for k in range(60)) > 50 and sum(out[100 + k] for k in range(60)) > 50 and not out[999]


def test_quality_limits_come_from_the_sketch(spark):
    names = list(quality.RULES)
    rows, k = [], 0
    for source, scale in (("low", 1), ("high", 3)):
        for i in range(100):
            rare = (i % 40 + 10) * scale if i % 2 else 0
            shares = {"symbol": i % 5 * scale, "capital": (10 + i % 10) * scale, "dup_line": rare, "repeat": rare // 2, "stutter": i % 10 * scale}
            rows.append(("xx", source, k := k + 1, shares))
        for r in names:  # one outlier a rule, below the fixed rule on repeats
            rows.append(("xx", source, k := k + 1, {n: (290 if n == r else 0) for n in names}))
    part = {"symbol": "n_symbols", "capital": "n_capitals", "dup_line": "n_dup_lines", "repeat": "n_repeat_words", "stutter": "n_stutters"}
    counted = [(lang, source, i, *[{"n_words": 1000, "word_chars": 1000, "n_lines": 1000}.get(c, 0) or s[next(n for n in names if part[n] == c)] for c in quality.COUNTS]) for lang, source, i, s in rows]
    df = spark.createDataFrame(counted, "_lang string, _source string, doc_id bigint, " + ", ".join(f"_q_{c} bigint" for c in quality.COUNTS))
    limits = quality.thresholds(quality.sketches(df)).cache()
    by = {r["_source"]: r for r in limits.collect()}
    out = {r["doc_id"]: r for r in quality.judge(df, limits).collect()}
    for r in names:
        assert by["low"][f"_limit_{r}"] < by["high"][f"_limit_{r}"] < 300, r
    for _, source, i, s in rows:
        assert not out[i]["_q_base_failed"] and out[i]["_q_kept"] == (max(s.values()) < 290)


# Operator 1


def test_licence_scores(spark):
    rows = [(1, "Intro words here.\nReleased under the MIT License.", "", "", ""), (2, "licensed UNDER the apache license version 2.0", "", "", ""), (3, "Nothing of the kind is said here at all.", "", "", ""), (4, "Licensed under\nthe Apache License,\nVersion 2.0.", "", "", "")]
    got = {r["doc_id"]: r["_hits"] for r in licences.licence_hits(frame(spark, rows)).collect()}
    assert [(h["licence"], h["unit"]) for h in got[1]] == [("mit", 1)] and got[2][0]["licence"] == "apache-2.0" and got[2][0]["score"] == 1.0 and got[3] == [] and got[4][0]["unit"] == -1


def test_licence_scores_equal_brute_force(spark):
    r = random.Random(4)
    texts = []
    for _ in range(150):
        words = licences.normal_words(r.choice(list(licences.TEMPLATES.values())))
        for _ in range(r.randint(0, 4)):
            words.insert(r.randrange(len(words) + 1), r.choice(["the", "new", "under", "x"]))
        texts.append(" ".join(words))
    want = []
    for t in texts:
        a = set(licences.bigrams(t.split()))
        scores = {k: 2 * len(a & (b := set(licences.bigrams(licences.normal_words(v))))) / (len(a) + len(b)) for k, v in licences.TEMPLATES.items()}
        want.append({k: s for k, s in scores.items() if s >= licences.THRESHOLD})
    got = licences.licence_hits(frame(spark, [(k, t, "", "", "") for k, t in enumerate(texts)])).collect()
    for r in got:
        assert {h["licence"]: pytest.approx(h["score"]) for h in r["_hits"]} == want[r["doc_id"]]


def test_wrapped_licences_are_passages(spark):
    import textwrap

    r = random.Random(3)
    other = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    texts = []
    for v in licences.TEMPLATES.values():
        words = v.split()
        for _ in range(r.randrange(len(words) // 12 + 1)):
            words[r.randrange(len(words))] = "x"
        texts.append(f"{other(40)} {textwrap.fill(' '.join(words), 60)} {other(50)}")
    texts += [other(30), "", None, texts[0], "the software " * 3000, list(licences.TEMPLATES.values())[0] + "\n" + list(licences.TEMPLATES.values())[1]]
    got = {x["doc_id"]: x["_passages"] for x in licences.licence_hits(frame(spark, [(k, t, "", "", "") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        words, want = licences.normal_words(t or ""), {}
        for name, body in licences.TEMPLATES.items():
            b = set(licences.bigrams(licences.normal_words(body)))
            n = len(licences.normal_words(body))
            windows = [set(licences.bigrams(words[p : p + n])) for p in range(max(1, len(words) - 1)) if " ".join(words[p : p + 2]) in b]
            score = max((2 * len(a & b) / (len(a) + len(b)) for a in windows), default=0)
            if score >= licences.THRESHOLD:
                want[name] = pytest.approx(score)
        assert {h["licence"]: h["score"] for h in got[k]} == want
    assert all(name in [h["licence"] for h in got[k]] for k, name in enumerate(licences.TEMPLATES))


def test_licence_scan_refuses_clashing_columns(spark):
    df = frame(spark, [(1, licences.TEMPLATES["mit"], "", "", "")])
    with pytest.raises(ValueError):
        licences.licence_hits(df.withColumnRenamed("source", "_hits"))
    row = licences.licence_hits(df.withColumnRenamed("source", "_words0")).first()
    assert row["_words0"] == "" and [h["licence"] for h in row["_hits"]] == ["mit"]


# Operator 9


def test_folding_undoes_disguise():
    assert toxicity.fold("You 1D1OT, ѕсum!".encode()) == " you idiot scum "


def test_exceptions_take_back(spark):
    lex = toxicity.Lexicon({" clown ": 3.0, " idio": 2.0}, {" clown fish "})
    assert lex.features(toxicity.fold(b"a clown idiot"))[0] == 5.0
    assert lex.features(toxicity.fold(b"a clown fish swims"))[0] == 0.0
    assert lex.features(toxicity.fold(b"clown fish clown"))[0] == 3.0


def test_toxicity_on_held_out_rows(spark, tmp_path):
    r = random.Random(2)
    common = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone"]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        words = r.choices(common, k=30)
        if toxic:
            for w in r.sample(["brute", "vermin", "fiend"], 2):
                words.insert(r.randrange(30), r.choice([w, w.upper(), w.replace("i", "1").replace("e", "3")]))
        rows.append((k, " ".join(words), "en", "a", ""))
        labels.append((k, 1, int(toxic)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("n", [50, 100, 1000])
def test_the_curve_fits_small_and_separable_samples(n):
    r = np.random.default_rng(n)
    y = (r.random(n) < 0.15).astype(float)
    y[:2] = 1, 0
    x = np.zeros((n, 4))
    found = (y > 0) & (r.random(n) < 0.9)
    x[found] = r.uniform(4, 30, (found.sum(), 4))
    curve = toxicity.fit_curve(x, y)
    p = 1 / (1 + np.exp(-toxicity.design(x) @ curve))
    assert toxicity.design(np.array([[9.0, 6, 12, 6]])) @ curve > toxicity.design(np.zeros((1, 4))) @ curve
    assert p[found].min() > p[~found].max() and p[found].mean() > 0.5


def test_toxicity_takes_repeated_ids_and_clashing_names(spark, tmp_path):
    rows = [(k % 200, "you vile fiend go away" if k % 4 == 0 else "a quiet walk by the river", "en", "a", "") for k in range(400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k % 200, 1, int(k % 4 == 0)) for k in range(400)] + [(1, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == 400
    mean = lambda k: np.mean([x["score"] for x in out if (x["doc_id"] % 4 == 0) == k])
    assert mean(True) > mean(False)
    df = frame(spark, rows[:3]).withColumnRenamed("n_words", "_score").withColumn("toxic", F.lit("x"))
    assert toxicity.score(df, {" fiend ": 3.0}, set(), np.ones(6)).columns == ["doc_id", "text", "lang", "source", "toxic", "_score"]


# Operator 10


def test_base_scores_equal_brute_force(spark, tmp_path):
    r = random.Random(10)
    rows = [(k, " ".join(r.choices(["The", "the", "cat", "dog", f"w{k}", "é"], k=r.randint(0, 30))) or None, "en", "a", "") for k in range(120)]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    old, lm.HEAD_TOKENS = lm.HEAD_TOKENS, 4  # most tokens go through the join
    try:
        out = {x["doc_id"]: x for x in lm.op10_lm_scoring(spark, str(tmp_path)).collect()}
    finally:
        lm.HEAD_TOKENS = old
    low = lambda t: (t or "").replace("T", "t").split() + ["\0end"]
    train = Counter(w for k, t, *_ in rows if zlib.crc32(str(k).encode()) % 7 != 2 for w in low(t))
    n, v = sum(train.values()), len(train)
    for k, t, *_ in rows:
        w = low(t)
        assert (out[k]["n_tokens"], out[k]["n_known"], out[k]["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert out[k]["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert out[k]["score"] < 0


def test_language_model_predicts_and_sums_to_one():
    r = random.Random(11)
    text = " ".join(r.choices(["river", "stone", "under", "the", "bridge"], k=4000)).encode()
    u, n = np.unique(lm.windows_of([text])[0], return_counts=True)
    zeros, ones = np.zeros(lm._STARTS[-1]), np.zeros(lm._STARTS[-1])
    for bit in range(8):
        y = (u >> bit & 1).astype(bool)
        for s in lm.slots(u, bit):
            np.add.at(ones, s[y], n[y])
            np.add.at(zeros, s[~y], n[~y])
    model = lm.Model(lm.log_odds(zeros, ones).astype(np.float32), *lm.learn_mixing(zeros, ones, np.repeat(u, n)[:20000]))
    other = " ".join(r.choices(["river", "stone", "under", "the", "bridge"], k=500)).encode()
    w, _ = lm.windows_of([other])
    assert -model.log10(w).sum() / math.log10(2) / len(other) < 1.0
    assert np.allclose(model.score(w), model.log10(w)) and np.allclose(model.score(w), model.log10(w))
    context = w[100] & ~255
    assert (10 ** model.log10(context | np.arange(256))).sum() == pytest.approx(1.0)


def test_language_model_counts_are_exact(spark, tmp_path, monkeypatch):
    r = random.Random(12)
    texts = [" ".join("".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(r.randint(0, 40))) for _ in range(60)]
    u, n = np.unique(lm.windows_of([t.encode() for t in texts])[0], return_counts=True)
    low = [[lm.tally(u, n, order, bit)[:3] for bit in range(8)] for order in (1, 2)]
    shard = (u >> 8 & 0xFFFFFF) % 3 == 0
    got = lm.counts_of(u[shard], n[shard], low)
    for bit in range(8):
        for order in range(1, lm.WIDTH):
            want = Counter()
            for w, c in zip(u.tolist(), n.tolist()):
                want[w >> 8 & (1 << 8 * order) - 1, (w & 255) >> (bit + 1), w >> bit & 1] += c
            for k, w in enumerate(u[shard].tolist()):
                at = w >> 8 & (1 << 8 * order) - 1, (w & 255) >> (bit + 1)
                assert (got[bit][0][k, order - 1], got[bit][1][k, order - 1]) == (want[*at, 0], want[*at, 1])
    frame(spark, [(k, t, "en", "a", "") for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    whole = {x["doc_id"]: x["score"] for x in lm.op10_lm_scoring(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(lm, "HEAD_WINDOWS", 50)  # most windows go through the join
    assert {x["doc_id"]: x["score"] for x in lm.op10_lm_scoring(spark, str(tmp_path)).collect()} == pytest.approx(whole)


def test_most_frequent_takes_equal_counts_all_or_none(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([5, 5, 5, 9, 70_000, 1, 1])], "key bigint, n bigint")
    got = lambda most: sorted(r["n"] for r in lm.most_frequent(df, most).collect())
    assert got(0) == [] and got(1) == [70_000] and got(4) == [9, 70_000] and got(5) == [5, 5, 5, 9, 70_000] and len(got(7)) == 7


def test_language_model_beats_unigrams_on_held_out_rows(spark):
    both = lm.op10_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert both["model"] > both["base"]


def test_language_model_learns_from_every_window(spark, monkeypatch):
    often = [(0x616263646561 + k, 10**9) for k in range(4)]
    rare = [(0x61626364C861 + k, 1) for k in range(20)]
    monkeypatch.setattr(lm, "SHARD", 8)
    _, (weights, table_) = lm.fit(spark.createDataFrame(often + rare, "key bigint, n bigint"))
    cells = slice(0xC8 * (lm._CELLS + 1), 0xC9 * (lm._CELLS + 1))
    assert not np.allclose(table_[cells], lm.untrained()[1][cells])
    gates = slice(0xC8 // 16 * lm.WIDTH, (0xC8 // 16 + 1) * lm.WIDTH)
    assert not np.allclose(weights[gates], lm.untrained()[0][gates])


# Operator 7


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav>
    <div class="ad">Buy now this thing.</div><article><h1>Title &amp; more</h1><p><b>First   line
    goes on.<br><p>Second &eacute; paragraph, with a <a href="x">link</a>.</p><script>var x = "</p>";</script><ul><li>One<li>Two</ul></article>
    <div class="comments"><div class="comment"><p>Nice post!</p></div></div><footer>&copy; 2020 Someone</footer>"""
    assert html.extract_texts([page, "", "plain words only"], html.trained())[0] == "Title & more\nFirst line goes on.\nSecond é paragraph, with a link.\nOne\nTwo"


def test_generated_pages_are_told_apart():
    rng = random.Random(123)
    wrong = total = 0
    trees = html.trained()
    for _ in range(150):
        page = html.Page(html._generated(rng))
        kept = html.decode(page, trees.log_odds(html.features(page)))
        main = [t for t in page.text if any(w.rstrip(".,!#&").lower().endswith("q") for w in t.split())]
        wrong += len(set(main) ^ set(kept))
        total += sum(map(bool, page.text))
    assert wrong <= 0.01 * total


def test_no_node_is_kept_without_its_parent():
    page = html.Page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    odds = np.full(len(page.tag), 1.0)
    first = page.tag.index("div")
    odds[first] = -9
    assert html.decode(page, odds) == ["c"]


def test_digest_columns(spark, odd):
    r = {x["doc_id"]: x for x in bpe.op5_byte_bpe(spark, odd).collect()}
    assert r[3]["n_tokens"] == 0 and r[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[1]["decoded_sha256"] == hashlib.sha256(b"one two three four five six").hexdigest()
    assert {x["kept"] for x in quality.op8_quality_rules(spark, odd).where(F.col("doc_id") == 2).collect()} == {False}


def test_pages_keep_formulas_drawings_and_fallbacks():
    words = "This paragraph goes on for a while, as the text of an article does, and then it ends."
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{words}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold. {words}</p><svg><text>Label</text></svg><noscript><p>{words} Plain.</p></noscript><p>{words} <object>Fallback</object></p><p title='a > b' data-x=\"it's\">{words} don't</p></article></body>"
    got = html.extract_texts([page], html.trained())[0]
    assert all(x in got for x in ("Let x=2 hold.", "Label", f"{words} Plain.", f"{words} Fallback", f"{words} don't")) and "Menu" not in got


@pytest.mark.parametrize("page", ["<b " * 350_000 + '"', "<p a='x " * 120_000, "<div>" * 100_000 + "x", "<div>" * 100_000 + "<li>x" * 50_000, "<b>" * 100_000 + "x</b>" * 100_000, "<script></script " * 60_000, "<!-- " * 200_000, "< a " * 200_000, "<svg><x " * 100_000])
def test_hostile_pages_take_linear_time(page):
    import time

    trees = html.trained()
    began = time.perf_counter()
    html.extract_texts([page], trees)
    assert time.perf_counter() - began < 10
