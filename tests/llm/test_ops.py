"""Each operator against brute force, an exact round trip or held-out labels."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wordloom.llm import cotrain, entries, licences, mixing, neardup_text, neardup_vec, packing, pseudolik, ring, rules, secret_scan

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tick int, __stage string, cls string, `a.b` string, hash long, measures string, __bad long, __hash string, __id int"
MORE = (7, 1, "s", "c", "dot", 5, "m", 3, "h", 9)


def odd_rows():
    """Nulls in every column, blank, very long, tied and repeated rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))
    base = " ".join(word() for _ in range(300))
    long = "\n".join(" ".join(word() for _ in range(20)) for _ in range(1500))
    near = base.replace(base.split()[100], "changed", 1)
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s0"), (3, near, None, None), (4, None, "en", "s1"), (5, "", "fr", "s1"), (6, " \n\t ", None, "s2"),
        (7, long, "en", "s3"), (8, "one", "en", "s0"), (9, "one", "en", "s0"), (None, base, "en", "s0"), (None, "lonely text of null id", None, None), (11, "Zeile 😀 mit Σ İ token='abcDEF123456'", "de", "s"),
        (12, "AKIA" + "Q1W2E3R4T5Y6U7I8 and " + "0f" * 20, "en", "s"), (12, "same id, another text", "en", "s"), (8, "one", "en", "s0"),
    ]
    return [(*r, len(r[1]) if r[1] else None, *MORE) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


# Sharding


def test_ring_law_and_slots(spark, odd, docs):
    for df, n in ((docs, 200), (odd, 15), (odd.limit(0), 0)):
        got = ring.shard(df, shards=8).collect()
        assert len(got) == n
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert not n or max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(8)) <= 1
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in ring.shard(docs).collect()}
    assert sizes == {r["doc_id"]: (len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode())) for r in docs.collect()}


def placed(keys, shards, room):
    """One key after another on the ring, as the plan defines it."""
    ring_ = ring.virtual_nodes(shards)
    tick = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % ring.TICKS
    used, out, late = Counter(), {}, []
    for k in sorted(keys, key=lambda k: (tick(k), k)):
        at = next((i for i, (t, _) in enumerate(ring_) if t >= tick(k)), 0)
        s = ring_[at][1]
        if used[s] < room[s]:
            used[s] += 1
            out[k] = s
        else:
            late.append((k, at))
    for k, at in late:
        s = next(s for s in (ring_[(at + i) % len(ring_)][1] for i in range(len(ring_))) if used[s] < room[s])
        used[s] += 1
        out[k] = s
    return out


def test_ring_equals_brute_force_and_moves_little(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r["doc_id"]: r["shard"] for r in ring.shard(df, shards=8).collect()}
    assert got == placed(range(5000), 8, ring.capacities(5000, 8))
    loose = [{r["doc_id"]: r["shard"] for r in ring.shard(df, shards=n, spare=0.25).collect()} for n in (8, 9)]
    assert max(Counter(loose[0].values()).values()) <= 5000 * 1.25 / 8 + 1
    assert sum(loose[0][k] != loose[1][k] for k in got) < 5000 * 0.3


def test_ring_hot_id_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ring, "RANKED", 100)
    df = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    by = defaultdict(list)
    for r in ring.shard(df, shards=7).collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {428, 429}


# Secrets


def spans_of(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, text, re.A) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, text) if m.end() - m.start() >= 24]
    return sorted(found)


def test_secret_base_spans(spark, odd, docs):
    texts = ["token=abc token:token=secret=abcdef", "API_KEY = 'x1y2z3' apikey:\"123456", "AKIAAKIA" + "A" * 16 + " AKIA" + "A" * 15, "😀 " + "ab" * 12 + "AKIA" + "0" * 20, "password  :  hunter22,token=token:abcdefgh", "token=" + "ab12" * 10, "=" * 50 + "secret=======" + "a" * 9]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), many):
        want = Counter()
        for r in df.collect():
            s = spans_of(r["text"])
            joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
            n = Counter(k for _, k, _ in s)
            want[(r["doc_id"], n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest())] += 1
        got = secret_scan.digest(df).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        assert all(len([x for x in r["spans"].split(",") if x and not x.startswith("random")]) == r["n_assign"] + r["n_access"] + r["n_hex"] for r in got)


def test_secret_models_hold_on_fresh_samples(spark):
    fresh = secret_scan.default_samples(seed=99, each=200)
    rows = [(i, t, r) for i, (t, r) in enumerate(fresh) if len(t) >= 20]
    df = spark.createDataFrame(rows, "i int, text string, y boolean")
    got = secret_scan.find_secrets(df, "text", "s").select("y", (F.size("s") > 0).alias("hit")).collect()
    hit = lambda y: np.mean([r["hit"] for r in got if r["y"] == y])
    assert hit(True) > 0.95 and hit(False) < 0.02


def test_secret_spans_in_very_long_texts(spark):
    text = "é ".join(f"{'0f' * 13}{'_AKIA' + 'Q1' * 9 if i % 3 else ''}" for i in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    got = secret_scan.digest(df).first()
    base = [x for x in got["spans"].split(",") if not x.startswith("random")]
    assert base == [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans_of(text)] and len(base) == 10_000
    assert secret_scan.redact(df).first()["text"] == re.sub(r"0f[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", "[SECRET]", text)


def test_secret_redaction(spark, docs):
    text = "a 😀 token = 'Zx9Qw8Er7Ty6' b " + "0a" * 20 + " end"
    df = spark.createDataFrame([(1, text), (2, "plain text stays"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert out == {1: "a 😀 [SECRET]' b [SECRET] end", 2: "plain text stays", 3: None}
    assert secret_scan.redact(docs).columns == docs.columns


def test_redaction_reaches_within_runs(spark):
    key, path = "wJ9rXUt7FEMIq3K7MDbPxRfiCYzV8Lm2Qa5Td0Ke", "internal/documents/services/responsibilities/configuration/management/application/"
    texts = ["AKIA" + "Q1W2E3R4T5Y6U7I8" + "/" + key + " end", "0f" * 12 + "_" + key, path + key, f"{path}{key}/{path}{key}", path * 2 + "handler"]
    out = [r["text"] for r in secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()]
    assert not any(key[a : a + 8] in t for t in out for a in range(len(key) - 7))
    assert out[2] == path + "[SECRET]" and out[3] == f"{path}[SECRET]/{path}[SECRET]" and out[4] == texts[4]


# Quality rules


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    covered = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_measures(spark, odd, docs):
    texts = ["x y z x y z", "a a a a a", "a\nb\na\n\n \na", "# $ x|y", "one two", "\x0bword\x0c", "a b c d a b c e d a b c"]
    many = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for df in (docs, odd, many):
        got = Counter(tuple(r) for r in rules.measures(df.select("doc_id", "text")).select("doc_id", *(F.col("measures")[m] for m in rules.MEASURES[:5])).collect())
        assert got == Counter((r["doc_id"], *measured(r["text"])) for r in df.collect())


def test_rules_keep_the_promise(spark, docs, labels):
    for df in (docs, docs.limit(0)):
        got = rules.quality_rules(df, labels).collect()
        assert len(got) == df.count()
        assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)
    rows = [(i, ("word " if i % 10 else "# ") * 10 + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(4000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, int(i % 10 != 0 or i == 0)) for i in range(4000)], "doc_id long, quality int")
    got = rules.quality_rules(many, good).collect()
    bad = {r["doc_id"] for r in got if r["failed_rules"]}
    assert bad and not any(i % 10 for i in bad)


def test_rules_take_equal_texts_as_one_trial_and_pool_small_strata(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, words(i, 60), f"l{i % 4}") for i in range(480)] + [(1000 + i, words(0, 60), "l9") for i in range(600)]
    rows += [(2000 + i, words(i, 50) + " ####" * 20, f"l{i % 5}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i in range(1600)], "doc_id long, quality int")
    got = rules.quality_rules(df, good).collect()
    # 120 texts in each of four strata and one text, 600 times, in another: together enough for a cutoff.
    assert {r["doc_id"] for r in got if not r["kept"]} == {r[0] for r in rows if r[0] >= 2000}
    few = rules.quality_rules(df.where("lang = 'l9' or doc_id >= 2000"), good).collect()
    assert all(r["kept"] for r in few)


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.2), (5, 1000, 0.02), (150, 10_000, 0.02), (4, 21, 0.4), (30, 20, 0.5)]
    for k, n, p in cases[:5]:
        exact = duckdb.sql(f"SELECT sum(exp(lgamma({n}+1) - lgamma(i+1) - lgamma({n}-i+1) + i*ln({p}) + ({n}-i)*ln(1-{p}))) FROM range({k}+1) r(i)").fetchall()[0][0]
        got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(exact if k <= n * p else 1.0, rel=1e-8)


def test_rules_without_labels_and_drop(spark, odd, labels):
    verdict = rules.quality_rules(odd, labels.limit(0)).cache()
    assert not any(r["failed_rules"] for r in verdict.collect())
    left = rules.without(odd, verdict, "doc_id", "text")
    assert left.columns == odd.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in verdict.where("kept").collect())


# Near duplicates of texts


def brute_groups(rows, size, percent):
    words = neardup_text._Words()
    sets = [(i, set(neardup_text.shingle_set(t, words, size).tolist())) for i, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(rows[a][0])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return Counter((rows[a][0], len(sets[a][1]), least[find(a)]) for a in range(len(rows)))


@pytest.mark.parametrize("size", [2, 5])
def test_near_dups_equal_brute_force(spark, odd, docs, size):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = neardup_text.near_duplicates(df, shingle=size).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows, size, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup_text.near_duplicates(odd.limit(0)).count() == 0


def test_near_dups_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup_text, "BLOCK", 20)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup_text.near_duplicates(df, shingle=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows, 2, 80)


def test_near_dup_stage_keeps_one(spark, odd, docs):
    left = neardup_text.without_near_duplicates(odd)
    assert left.columns == odd.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[1] == ids[8] == 1 and not ids[2] and not ids[3] and not ids[9] and ids[4] == ids[5] == ids[6] == 1 and ids[12] == 2 and ids[None] == 1
    assert neardup_text.without_near_duplicates(docs).count() == len({x[2] for x in brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)})


def test_bayes_bounds_fall_with_misses():
    strict, loose = neardup_text.least_matches(0.8, 1e-6), neardup_text.least_matches(0.8, 1e-2)
    assert [n for n, _ in strict] == [32, 64, 96, 128, 160]
    assert all(a <= b for (_, a), (_, b) in zip(strict, loose, strict=True)) and strict[-1][1] / 160 < 0.8


# Near duplicates of vectors


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vs = [list(map(float, v + 0.12 * rng.standard_normal(16))) for v in base for _ in range(4)] + [list(map(float, base[0]))] * 30
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 8, [2.0] * 8, [1e300] * 16, [1e-300] * 16]
    rows = list(enumerate(vs + odd)) + [(None, vs[0]), (3, vs[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit(1))
    got = neardup_vec.near_duplicates(df, threshold=0.9).collect()
    good = [(i, np.array(v, float) / np.max(np.abs(np.array(v, float)))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    top, links = list(range(len(good))), [0] * len(good)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            u, v = good[a][1], good[b][1]
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.9:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(good)):
        groups[find(a)].append(good[a][0])
    want = Counter((good[a][0], links[a], min(i for i in groups[find(a)] if i is not None)) for a in range(len(good)))
    want += Counter((len(vs) + i, 0, len(vs) + i) for i in range(6))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert neardup_vec.near_duplicates(df.limit(0)).count() == 0


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup_vec, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, list(map(float, base + 0.01 * rng.standard_normal(8)))) for i in range(120)]
    got = neardup_vec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}


# Mixing


def test_mixing_meets_targets(spark, docs, labels):
    rows = [(i, f"clean good word{i % 7} prose " * 20 if i % 3 else f"junk bad spam{i % 5} offer " * 20) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dom = spark.createDataFrame([(i, "clean" if i % 3 else "junk") for i in range(0, 1200, 2)], "id long, domain string")
    got = mixing.report(df, dom, {"clean": 0.5, "junk": 0.5}).cache()
    assert got.where("(p_clean > 0.5) = (doc_id % 3 <> 0)").count() == 1200
    t = got.agg(*(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in ("clean", "junk")), F.sum("tokens").alias("all")).first()
    assert t["clean"] == pytest.approx(t["all"] / 2, rel=0.001) and t["junk"] == pytest.approx(t["all"] / 2, rel=0.001)
    keep = mixing.mixed(df, dom, {"clean": 0.9, "junk": 0.1}, budget="clean")
    n = Counter(bool(r["doc_id"] % 3) for r in keep.collect())
    assert n[True] == pytest.approx(800, abs=8) and 60 < n[False] < 120
    scarce = mixing.report(df, dom, {"clean": 0.2, "junk": 0.8}, budget="clean", at_most=("junk",))
    assert scarce.agg(F.max("copies")).first()[0] <= 2 and scarce.where("doc_id % 3 = 0").agg(F.sum("copies")).first()[0] <= 420
    grown = mixing.report(df, dom, {"clean": 0.9, "junk": 0.1}, budget="clean", growth=1.25).where("doc_id % 3 <> 0")
    assert grown.where("copies = 0").count() == 0 and grown.agg(F.sum("copies")).first()[0] == pytest.approx(1000, rel=0.02)


def test_mixing_equals_brute_force(spark, docs, labels):
    """Posteriors from the classifier word by word, and a projected gradient over documents."""
    from wordloom.llm.common import Scratch

    dom, names = mixing.labelled_domains(labels), tuple(sorted(entries.TARGETS))
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    mixer = mixing.fit_classifier(rows, dom, names, Scratch(spark, "test"))
    got = {r["doc_id"]: r for r in mixing.report(docs, dom, entries.TARGETS, **entries.MIX).collect()}
    words = {r["id"]: [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"].lower()) if w] for r in rows.collect()}
    distinct = sorted({w for v in words.values() for w in v})
    known = dict(zip(distinct, (r[0] for r in spark.createDataFrame(list(enumerate(distinct)), "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()), strict=True))
    place = {h: i for i, h in enumerate(mixer.words)}
    assert place
    tokens, p = [], []
    for i in sorted(words):
        hits = [place[known[w]] for w in set(words[i]) if known[w] in place]
        z = np.array([mixer.bias[k] + sum(mixer.weights[k][j] for j in hits) for k in range(3)])
        q = 100 * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        whole = np.floor(q)
        for k in np.argsort(-(q - whole), kind="stable")[: int(100 - whole.sum())]:
            whole[k] += 1
        assert [got[i][f"p_{d}"] for d in names] == pytest.approx((whole / 100).tolist(), abs=0.0101) and sum(got[i][f"p_{d}"] for d in names) == pytest.approx(1)
        tokens.append(len(words[i]))
        p.append([got[i][f"p_{d}"] for d in names])
    tokens, p = np.array(tokens, float), np.array(p)
    have = tokens @ p
    goal = np.array([entries.TARGETS[d] for d in names]) * have[names.index("clean")] / entries.TARGETS["clean"] * entries.MIX["growth"]
    goal = np.where([d in entries.MIX["at_most"] for d in names], np.minimum(goal, have), goal)
    weight, r = np.linalg.pinv(p.T @ (tokens[:, None] * p)), np.ones(len(tokens))
    for _ in range(60):
        off = (tokens * r) @ p - goal
        if np.all(np.abs(off) <= 1e-4 * goal):
            break
        r = np.clip(r - p @ (weight @ off), 0, 8)
    assert [got[i]["rate"] for i in sorted(words)] == pytest.approx(r.tolist(), abs=1e-6)
    assert all(got[i]["copies"] in (math.floor(x), math.floor(x) + 1) for i, x in zip(sorted(words), r, strict=True))


def test_softmax_regression_is_at_its_least():
    rng = np.random.default_rng(3)
    at = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    y = np.array([(int(x[0]) if len(x) else 0) % 3 for x in at])
    rows = np.repeat(np.arange(300), [len(x) for x in at])
    w, bias = mixing.softmax_regression(rows, np.concatenate(at), y, 6, 3)
    loss = lambda w, b: -np.log(mixing._chances(rows, np.concatenate(at), 300, w, b)[np.arange(300), y]).mean() + mixing.RIDGE / 600 * ((w**2).sum() + (b**2).sum())
    least = loss(w, bias)
    assert all(loss(w + e * rng.standard_normal(w.shape), bias + e * rng.standard_normal(3)) > least for e in (0.3, 1.0) for _ in range(20))


def test_mixing_odd_rows(spark, odd, labels):
    dom = mixing.labelled_domains(labels)
    how = entries.MIX
    assert mixing.report(odd, dom, entries.TARGETS, **how).count() == 15
    out = mixing.mixed(odd, dom, entries.TARGETS, **how)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert mixing.report(odd.limit(0), dom, entries.TARGETS, **how).count() == 0
    assert mixing.report(odd, dom.limit(0), entries.TARGETS, **how).where("rate < 0").count() == 0


# Packing


def test_tokens_equal_the_library(docs, odd):
    from tokenizers import Tokenizer

    inner, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    texts = [r["text"] for r in docs.collect()] + [r["text"] for r in odd.collect()]
    rng = random.Random(7)
    chars = "abcDEF'stldvm 019²¼½ªº×÷ßÿÀ\x85\xa0\x1c\x00_-!?.,\n\t’é́Σİ<|>"
    texts += ["".join(rng.choices(chars, k=rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> x", "it's IT'S ''s we'll</w>"]
    want = [np.array(inner.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want


def test_packing_round_trip(spark, odd, docs):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(TOKENIZER)
    for df, cap in ((docs.repartition(5), 4096), (odd, 512), (odd.limit(0), 64)):
        got = packing.pack(df, tokenizer=TOKENIZER, capacity=cap, with_ids=True, max_items=50).collect()
        want = Counter()
        for r in df.collect():
            ids = [*inner.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), cap):
                want[(r["doc_id"], k // cap, k, zlib.crc32(np.array(ids[k : k + cap], "<u4").tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= cap
        total = sum(r["length"] for r in got)
        assert len(bins) <= 1.05 * total / cap + 2


def test_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


# Classifier, licences, language model


def test_quality_on_held_out_labels(spark):
    rows = [(i, ("plain prose about things %d " % (i % 13)) * 15 if i % 2 else ("BUY## now$$ %d!! " % (i % 11)) * 15, "en", f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    some = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, quality int")
    got = cotrain.quality(df, some).collect()
    assert np.mean([r["kept"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] >= 200]) > 0.98


def test_quality_odd_rows(spark, odd, labels):
    assert cotrain.quality(odd, labels).count() == 15
    assert {r["score"] for r in cotrain.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert cotrain.quality(odd.limit(0), labels).count() == 0


def test_quality_beats_chance_on_the_tables(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = y.where("doc_id % 4 <> 0"), y.where("doc_id % 4 = 0")
    got = cotrain.quality(d, train).join(test, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_learns_from_every_unlabelled_text(spark):
    rng = random.Random(9)
    words = lambda k: " ".join(f"{k}{rng.randrange(40)}" for _ in range(12))
    rows = [(i, words("g") if i % 2 else words("b") + " ## $$", "en", f"s{i % 2}") for i in range(13_000)] + [(99_999, "xtr", "fr", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).cache()
    some = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    # Good texts that a hash sample of about 6000 rows leaves out get a word of their own.
    left_out = F.pmod(F.xxhash64("doc_id", F.lit("cotrain")), F.lit(1_000_000)) >= 500_000
    more = df.withColumn("text", F.when(left_out & (F.col("doc_id") >= 400) & (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 99_999), F.regexp_replace("text", "g1[0-9]", "xtr")).otherwise(F.col("text")))
    a, b = (cotrain.quality(d, some).where("doc_id = 99999").first()["text_score"] for d in (df, more))
    assert b > a + 0.05


def test_licences(spark):
    rows = [
        (1, "https://x.org/a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        (2, "https://x.org/a/b/page?q=1#t", "<p>no statement here</p>"),
        (3, "https://x.org/a/c/page", "<p>Licensed under the Apache License, Version 2.0.</p><p>more</p>"),
        (4, "https://x.org/z/page", "<p>nothing</p>"),
        (5, "https://x.org/a/b/", "<p>This work is licensed under the GNU General Public License, version 3.</p>"),
        (6, "https://x.org/a/b/deep/er", "words"), (7, None, None), (8, "", ""), (6, "https://x.org/a/b/deep/er", "words"), (None, "https://x.org/a/q", "words"),
        (9, "https://y.org/p", "<p>Licensed under CC BY-NC 4.0.</p>"), (10, "https://y.org/q", "my driving licence was renewed last week by the office in town"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("dir", F.lit("x"))
    got = Counter((r["page_id"], r["licence"], r["how"]) for r in licences.licences(df).collect())
    assert got == Counter([
        (1, "MIT", "file"), (2, "GPL-3.0", "inherited"), (3, "Apache-2.0", "header"), (4, None, None), (5, "GPL-3.0", "header"), (6, "GPL-3.0", "inherited"),
        (6, "GPL-3.0", "inherited"), (7, None, None), (8, None, None), (None, "MIT", "inherited"), (9, "CC-BY-NC-4.0", "header"), (10, None, None),
    ])
    assert licences.licences(df.limit(0)).count() == 0


def test_licence_cosine_equals_brute_force():
    texts = ["Licensed under the MIT License by Foo", "all about bananas", "free software under the GNU General Public License version 2 as published"]
    seen = np.zeros(licences.HASHED)
    for t in texts:
        seen[list({licences.bucket(x) for x in licences.terms(t)})] += 1
    matcher = licences.Matcher(seen, 3)

    def weights(words):
        idf = lambda w: math.log(4 / (seen[licences.bucket(w)] + 1)) + 1
        return {w: (1 + math.log(n)) * idf(w) for w, n in Counter(words).items()}

    def cosine(a, b):
        u, v = weights(a), weights(b)
        return sum(u[w] * v.get(w, 0) for w in u) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))

    words = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    for t in texts:
        w = words(t)
        spans = [w] + [w[i : i + n] for n in licences.SPANS if n < len(w) for i in range(0, len(w) - n // 2, n // 2)]
        want = max(cosine(s, words(x)) for s in spans for xs in licences.TEMPLATES.values() for x in xs)
        assert matcher.best(t)[1] == pytest.approx(want)


def test_licence_windows_of_very_long_pages():
    page = "<script " * 300_000 + "<p>Licensed under the MIT License</p>" + "licence " * 100_000
    began = time.process_time()
    assert licences.windows(page, False)
    assert time.process_time() - began < 20


def test_licence_statements_across_lines_and_tags(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    rows = [
        (1, "u.org/a", '<p>Licensed under <a href="/x">CC BY 4.0</a>.</p>'), (2, "u.org/b", f"<pre>{gpl.format(3)}</pre>"),
        (3, "u.org/c", '<a rel="license" href="https://creativecommons.org/licenses/by-sa/4.0/"><img src="i.png"></a>'),
        (4, "u.org/d", '<p>Text</p><link rel="license" href="https://www.gnu.org/licenses/gpl-3.0.html">'),
        (5, "u.org/e", '<a rel="license" href="/legal">terms</a>'),
    ]
    got = {r["page_id"]: r["licence"] for r in licences.licences(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "CC-BY-4.0", 2: "GPL-3.0", 3: "CC-BY-SA-4.0", 4: "GPL-3.0", 5: None}


def test_pseudo_likelihood(spark, odd):
    rng = random.Random(2)
    order = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(order[(i + j) % 12] for j in range(240))) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(order) for _ in range(240))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudolik.pseudo_likelihood(df).collect()}
    assert np.mean([v for k, v in got.items() if k < 1000]) > np.mean([v for k, v in got.items() if k >= 1000]) + 1
    out = pseudolik.pseudo_likelihood(odd).collect()
    assert Counter(r["n_words"] for r in out)[0] == 3 and all(r["mean_log_likelihood"] is None for r in out if not r["n_words"])
    assert pseudolik.pseudo_likelihood(odd.limit(0)).count() == 0


def ascii_words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def test_pseudo_likelihood_finds_the_words(odd, monkeypatch):
    rng = random.Random(1)
    texts = [r["text"] for r in odd.collect()] + ["".join(rng.choices("abCÉ \n\t\x1c\x0b.é0", k=rng.randint(0, 300))) for _ in range(200)] + ["x" * 5000, "y" * 3000 + " z"]
    for size in (64, 1 << 16):
        monkeypatch.setattr(pseudolik, "SCAN", size)
        hashes, tails, n = pseudolik._scanned(pa.array(texts))
        words = [w for t in texts for w in ascii_words(t)]
        assert n.tolist() == [len(ascii_words(t)) for t in texts] and len(hashes) == len(words)
        assert len(set(zip(hashes.tolist(), words, strict=True))) == len(set(words)) == len(set(hashes.tolist())) and hashes.min() >= 0
        assert [t.to_bytes(4, "little").rstrip(b"\0") for t in tails.tolist()] == [w[-3:][::-1] for w in words]


def test_pseudo_likelihood_equals_brute_force(spark, docs, tmp_path):
    """The query's rows, each word's chance computed alone from its own settings."""
    from wordloom.llm.common import Scratch

    counts, vocabulary, theta = pseudolik.fit(docs.select("text"), Scratch(spark, "test"))
    m, rows = pseudolik.parts(theta, pseudolik.layout_of(vocabulary.seen)), docs.collect()
    n = Counter(w for r in rows for w in ascii_words(r["text"]))
    assert Counter(r["n"] for r in counts.collect()) == Counter(n.values())
    names = sorted(n)
    hashes, tails, _ = pseudolik._scanned(pa.array([w.decode("utf-8", "surrogatepass") for w in names]))
    token = dict(zip(names, vocabulary.find(hashes, tails)[0].tolist(), strict=True))
    total = Counter()
    for w in names:
        total[token[w]] += n[w]

    def chances(around):
        a = sum(m["tables"][k][t].astype(float) for k, t in enumerate(around)) + m["bias"]
        h = a / (1 + np.abs(a))
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p = soft(h @ m["w1"] + m["b1"])
        within = [soft(h @ m["w2"][g] + m["b2"][g]) for g in range(pseudolik.GROUPS)]
        return lambda t: p[m["group"][t]] * within[m["group"][t]][m["member"][t]]

    got = {r["doc_id"]: r for r in pseudolik.pseudo_likelihood(docs).collect()}
    for r in sorted(rows, key=lambda r: len(r["text"]))[:60]:
        words = ascii_words(r["text"])
        line = [pseudolik.EDGE] * 2 + [token[w] for w in words] + [pseudolik.EDGE] * 2
        sums = sum(math.log(chances([line[i + 2 + o] for o in pseudolik.SIDES])(token[w])) + math.log(n[w] / total[token[w]]) for i, w in enumerate(words))
        assert got[r["doc_id"]]["n_words"] == len(words) and got[r["doc_id"]]["log_likelihood"] == pytest.approx(sums, rel=1e-4, abs=1e-3)
    one = chances([3, 700, pseudolik.EDGE, 5])
    assert sum(one(token[w]) * n[w] / total[token[w]] for w in names) + sum(one(t) for t in range(pseudolik.TOKENS) if t not in total) == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood_beats_word_frequency(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = Counter(w for r in docs.select("text").collect() for w in ascii_words(r["text"]))
    total = sum(n.values())
    alone = sum(c * math.log(c / total) for c in n.values()) / total
    got = pseudolik.pseudo_likelihood(docs).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    assert got[1] == total and got[0] / total > alone + 0.5


def test_pseudo_likelihood_trains_on_every_word(spark):
    rng = random.Random(6)
    order = [f"w{i}" for i in range(12)]
    lines = [["first", *(order[(s + j) % 12] for j in range(7))] for s in (rng.randrange(12) for _ in range(9000))]
    df = spark.createDataFrame([(i, " ".join(sum(lines[30 * i : 30 * i + 30], []))) for i in range(300)], "doc_id long, text string").repartition(2)
    got = np.mean([r["mean_log_likelihood"] for r in pseudolik.pseudo_likelihood(df).collect()])
    # Each word's frequency alone gives -2.55; a network that met only every eighth place knows "first" alone.
    assert got > -1.5


def test_pseudo_likelihood_tells_rare_words_apart(spark, monkeypatch):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(200)], [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(200)) + " " + " ".join(rng.choice(rare) for _ in range(100))) for i in range(200)]
    rows += [(1000, " ".join(rare)), (1001, " ".join(f"once{i}" for i in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudolik.pseudo_likelihood(df).collect()}
    # A rare word occurs 67 times on average, the others once.
    assert got[1000] > got[1001] + 3
    monkeypatch.setattr(pseudolik, "FREQUENT", 400)
    few = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudolik.pseudo_likelihood(df).collect()}
    assert few == {k: pytest.approx(v, abs=1e-5) for k, v in got.items()}


def test_network_slopes_equal_differences():
    rng = np.random.default_rng(4)
    seen = rng.integers(1, 1000, pseudolik.TOKENS + 1).astype(float)
    layout = pseudolik.layout_of(seen)
    assert sorted(zip(*(x.tolist() for x in layout), strict=True)) == [(g, m) for g in range(pseudolik.GROUPS) for m in range(pseudolik.MEMBERS)]
    theta = (rng.standard_normal(pseudolik.SIZE) * 0.3).astype(np.float32)
    line, at = pseudolik.line_of(rng.integers(0, pseudolik.TOKENS, 50).astype(np.int16), np.array([20, 0, 30]))
    loss = lambda t: -pseudolik.score_line(pseudolik.parts(t, layout), line, at).sum()
    slopes, _ = pseudolik.gradients(pseudolik.parts(theta, layout), line, at)
    for name in ("w1", "b1", "w2", "b2", "bias"):
        way = rng.standard_normal(pseudolik.SHAPES[name]).astype(np.float32)
        ends = []
        for e in (1e-2, -1e-2):
            moved = theta.copy()
            pseudolik.parts(moved)[name][...] += e * way
            ends.append(loss(moved))
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float((slopes[name] * way).sum()), rel=2e-2, abs=0.05)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    line, at = pseudolik.line_of(np.tile(np.arange(8), 4000).astype(np.int16), np.array([32_000]))
    seen = np.zeros(pseudolik.TOKENS + 1)
    seen[:8] = 4000
    layout = pseudolik.layout_of(seen)
    own = pseudolik.Trainer(pseudolik.initial(seen, layout), None, layout)
    before = pseudolik.score_line(own.model, line, at).mean()
    own.line(line, at)
    assert own.seen == 32_000 and pseudolik.score_line(own.model, line, at).mean() > before + 0.5


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(entries.ORACLES[name]).df(), entries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r["doc_id"] for r in rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    kept = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    assert {r["doc_id"] for r in kept.collect()} == verdict and kept.columns == docs.columns
    one = corpus_pipeline.near_dedup_stage(spark, kept, SF).cache()
    groups = brute_groups([tuple(r) for r in kept.select("doc_id", "text").collect()], 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {g for _, _, g in groups}
    clean = corpus_pipeline.secrets_stage(spark, one, SF).cache()
    assert clean.columns == docs.columns and not any(spans_of(r["text"]) for r in clean.collect())
    mix = corpus_pipeline.mixing_stage(spark, clean, SF).cache()
    assert mix.columns == docs.columns and {r["doc_id"] for r in mix.collect()} <= {r["doc_id"] for r in clean.collect()}
    packed = corpus_pipeline.packing_stage(spark, mix, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mix.collect()}
    assert corpus_pipeline.run(spark, SF).columns == packed.columns


def test_pipeline_of_empty_and_null_tables(spark, docs, labels, tmp_path):
    import corpus_pipeline

    for name, rows in (("empty", docs.limit(0)), ("null", docs.limit(7).select(*(F.lit(None).cast(k).alias(c) for c, k in docs.dtypes)))):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").count() == 0


def test_mixing_reads_a_text_once_by_pattern(spark):
    mixer = mixing.Mixer(("a", "b"), (3, 70000), ((0.5, 1.0), (-0.5, 0.0)), (0.0, 0.1))
    rows = [(0, " \n\x0b one  two\tone \r\n"), (1, " \t "), (2, None), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = mixing.scored(df, mixer, "text", "x")
    # The ends of a text need no pattern, and known words are found by compiled code.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "array_intersect" in plan
    assert {r["doc_id"]: r["x"]["tokens"] for r in out.collect()} == {0: 3, 1: 0, 2: 0, 3: 1}
    hits = spark.createDataFrame([([9, 70000, 3, 70000, 3 + mixing.SLOTS],), ([],)], "h array<long>")
    assert [r[0] for r in hits.select(mixing._hits(F.col("h"), (3, 70000))).collect()] == [[3, 2], []]
    assert [r[0] for r in hits.select(mixing._hits(F.col("h"), ())).collect()] == [[], []]
