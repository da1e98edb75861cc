"""Operators that compare documents, against brute force; and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from glyphlake.llm import contamination, linededup, neardup, registry, repeats
from glyphlake.llm.common import Words

SF = "/root/testdata/sf0.001"
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def write(spark, path, texts):
    spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def words_of(t):
    return (t or "").encode().translate(LOW).split()


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_word_kernel():
    r = random.Random(0)
    texts = ["".join(r.choices("ab \n\té", k=r.randint(0, 30))).encode() for _ in range(200)]
    w = Words(texts)
    seen = {}
    for k, t in enumerate(texts):
        got = w.hash[w.offset[k] : w.offset[k + 1]].tolist()
        assert len(got) == len(t.split())
        for a, b in zip(t.split(), got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


# Operator 3


def brute_repeats(texts):
    n = repeats.LENGTH
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [repeats.MAX_GROUP, 1])
def test_repeats_equal_brute_force(spark, tmp_path, monkeypatch, largest):
    monkeypatch.setattr(repeats, "MAX_GROUP", largest)
    r = random.Random(3)
    passage, other = prose(r, 60), prose(r, 45)
    texts = [prose(r, r.randint(0, 150)) for _ in range(12)]
    texts += [prose(r, 30) + passage + prose(r, 30), passage + prose(r, 5), prose(r, 9) + passage, passage, passage, other + " x " + other, "a" * 450, "a" * 199, "a" * 200, "ab" * 300, "é" * 150, None, "", prose(r, 40) + other[:199], prose(r, 3) + other[1:201] + prose(r, 3)]
    d = write(spark, tmp_path, texts)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.op3_suffix_array_dedup(spark, d).collect()}
    for k, want in enumerate(brute_repeats(texts)):
        assert got[k] == want, k


def test_repeats_on_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in registry.QUERIES["op3_suffix_array_dedup"](spark, SF).collect()}
    assert [got[r["doc_id"]] for r in rows] == brute_repeats([r["text"] for r in rows])


# Operator 6


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in held[g])
        for g in s:
            held[g].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_texts(r):
    base = [prose(r, n) for n in (6, 30, 80, 200)]
    texts = [prose(r, r.randint(0, 60)) for _ in range(20)] + ["", None, "one two", "One TWO", "one two three", " \n"]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    shared = prose(r, 40)
    texts += [shared + " " + prose(r, 30) for _ in range(60)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("crowd", [neardup.CROWD, 3])
def test_near_duplicates_equal_brute_force(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CROWD", crowd)
    texts = near_texts(random.Random(6))
    got = {x["doc_id"]: x for x in neardup.op6_minhash_near_dedup(spark, write(spark, tmp_path, texts)).collect()}
    for k, (n, c) in enumerate(brute_components(texts)):
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (n, c, c == k), k


def test_index_meets_every_pair_within_its_radius():
    r = np.random.default_rng(1)
    sig = r.integers(0, 1 << 16, (1, neardup.VALUES), dtype=np.uint16).repeat(400, 0)
    for k in range(1, 400):
        at = r.choice(neardup.SIGNATURE, r.integers(0, neardup.RADIUS + 1), replace=False)
        sig[k, at] = r.integers(0, 1 << 16, len(at), dtype=np.uint16)
    keys = neardup.index_keys(sig)
    first = set(keys[0].tolist())
    assert all(first & set(keys[k].tolist()) for k in range(1, 400))


def test_similar_sets_meet_under_a_key():
    r = np.random.default_rng(2)
    met = total = 0
    for _ in range(400):
        n = int(r.integers(20, 400))
        both = -(-75 * 2 * n // 175)  # two sets of n with just this many in common reach the threshold
        common, x, y = (r.integers(0, 1 << 62, k, dtype=np.uint64) for k in (both, n - both, n - both))
        sets = [np.unique(np.concatenate([common, z])) for z in (x, y)]
        a, b = neardup.index_keys(neardup.signatures(sets))
        met += bool(set(a.tolist()) & set(b.tolist()))
        total += 1
    assert met >= total - 1


def test_prefixes_of_similar_sets_meet():
    r = random.Random(5)
    known = sorted(r.sample(range(200), 60))
    frequent = np.array(known, np.uint64), np.array([r.randint(2, 9) for _ in known])
    met = 0
    for _ in range(3000):
        a = set(r.sample(range(200), r.randint(1, 40)))
        b = set(r.sample(sorted(a), r.randint(len(a) * 2 // 3, len(a)))) | set(r.sample(range(200), r.randint(0, 6)))
        if not b:
            continue
        x, y = (neardup.prefix(np.array(sorted(s), np.uint64), frequent).tolist() for s in (a, b))
        first = [(i, y.index(v)) for i, v in enumerate(x) if v in y][:1]
        may = first and neardup.may_reach(*(np.array([v]) for v in (len(a), first[0][0], len(b), first[0][1])))[0]
        if 100 * len(a & b) >= 75 * len(a | b):
            met += 1
            assert may
    assert met > 300


# Operator 2


def test_line_dedup_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r for r in duck.sql(f"SELECT doc_id, n_lines, n_removed, n_runs, kept_sha256 FROM ({registry.ORACLE_SQL['op2_line_dedup']})").fetchall()}
    got = {x["doc_id"]: (x["doc_id"], x["n_lines"], x["n_removed"], x["n_runs"], x["kept_sha256"]) for x in registry.QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, least):
    r = random.Random(least)
    texts = ["\n".join(r.choices(["a", "b", "c", "", " "], k=r.randint(0, 14))) for _ in range(30)]
    seen, want = set(), {}
    for k, t in enumerate(texts):
        lines = t.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for p in range(len(full) - least + 1):
            run = tuple(lines[i] for i in full[p : p + least])
            if run in seen:
                gone.update(full[p : p + least])
            seen.add(run)
        want[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    out = linededup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), min_lines=least)
    assert {x["doc_id"]: x["_kept_text"] for x in out.collect()} == want


def test_long_lines_are_runs_in_the_stage(spark):
    long, short = prose(random.Random(1), 60), "two words"
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", long, f"e\n{short}\nf", f"g\n{short}\nh"]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    out = {x["doc_id"]: x["text"] for x in linededup.stage(spark, df, "").collect()}
    assert out == {0: texts[0], 1: "c\nd", 3: texts[3], 4: texts[4]}


# Operator 4


def test_contamination_equals_brute_force():
    r = random.Random(4)
    items = [(k, prose(r, r.choice([2, 5, 9, 14, 30, 60])).encode()) for k in range(40)]
    texts = []
    for k in range(250):
        w = items[k % 40][1].decode().split()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            if len(w) > 20:
                w[r.randrange(len(w))] = f"new{k}"
        texts.append((prose(r, r.randint(0, 60)) + " " + " ".join(w) + " " + prose(r, r.randint(0, 60))) if k % 3 else prose(r, 80))
    got = contamination.Items(items).hits([t.encode() for t in texts])
    found = missed = 0
    for t, hits in zip(texts, got):
        w = words_of(t)
        want = set()
        for item, body in items:
            iw = words_of(body.decode())
            n = len(iw)
            mine = Counter(tuple(iw[i : i + 5]) for i in range(max(1, n - 4)))
            for a in range(max(1, len(w) - n + 1)):
                part = w[a : a + n]
                theirs = Counter(tuple(part[i : i + 5]) for i in range(max(1, len(part) - 4)))
                both = sum((mine & theirs).values())
                if 100 * both >= 75 * (sum(mine.values()) + sum(theirs.values()) - both) and (n >= 5 or part == iw):
                    want.add(item)
        assert hits <= want
        found += len(want)
        missed += len(want - hits)
    assert found > 100 and missed <= 0.02 * found


def test_benchmark_texts_are_found_in_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    whole = {r["doc_id"]: {i["item_id"] for i in items if i["text"] in (r["text"] or "")} for r in rows}
    got = {x["doc_id"]: set(x["item_ids"]) for x in registry.QUERIES["op4_benchmark_decontamination"](spark, SF).collect()}
    assert any(whole.values()) and all(whole[k] <= got[k] for k in whole)


def test_pieces_of_long_texts_find_what_whole_texts_do():
    r = random.Random(8)
    items = [(k, prose(r, r.choice([3, 5, 20, 60]), 10**6).encode()) for k in range(60)]
    text = " ".join(prose(r, r.randint(20, 400), 10**6) + " " + t.decode() for _, t in items).encode()
    index = contamination.Items(items)
    parts = list(contamination.pieces(text, 4000, index.reach))
    assert len(parts) > 5 and max(map(len, parts)) < 20_000
    assert set().union(*index.hits(parts)) == index.hits([text])[0] == {k for k, _ in items}
    assert list(contamination.pieces(b"x" * 50_000, 1000, 10)) == [b"x" * 50_000] and list(contamination.pieces(b"", 10, 10)) == [b""]


# The pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            now = {r["doc_id"]: r["text"] for r in rows}
            assert set(now) <= set(before), name
            if name == "minhash_near_dedup":
                order = sorted(before)
                want = {order[c] for _, c in brute_components([before[i] for i in order])}
                assert set(now) == want
            if name != "line_dedup":
                assert all(now[i] == before[i] for i in now)
            before = kept = now
        else:
            assert {r["doc_id"] for r in rows} == set(kept)
            assert all(r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, tmp_path, k):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, _row string"
    rows = [(1, None, None, None, None, "", ""), (None, "x " * 50, "en", "a", 1, "", ""), (2, "", "en", "a", 0, "", ""), (3, "a b c\nd e f\n" * 30, "en", "a", 1, "", ""), (3, "a b c\nd e f\n" * 30, "en", "a", 1, "", "")]
    for part in (rows, []):
        df = spark.createDataFrame(part, schema)
        out = pipeline.STAGES[k][1](spark, df, str(tmp_path))
        out.collect()
        if k < 4:
            assert out.columns == df.columns

