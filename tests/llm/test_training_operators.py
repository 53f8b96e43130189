"""The ten operators against brute-force versions, and on odd tables."""

import hashlib
import heapq
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA, connection, difference

from tidewell.llm import decontamination, license_scan, lm_scoring, mixing, ngram_join, pii, quality_classifier, quality_rules, sharding, token_output
from tidewell.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "the quick brown fox jumps over the lazy dog and runs far away from here today"
ODD = [
    (0, LINE, "en", "a", 1), (1, LINE, "en", "a", 1), (1, LINE, "en", "a", 1), (2, LINE.upper() + "!", "en", "b", 1), (3, None, None, None, None), (4, "", "", "", 0), (5, "   \n\t ", "en", "a", 3), (6, "one two", "fr", "a", 7), (7, "one two", "fr", "a", 7),
    (8, "x" * 50_000, "en", "b", 50_000), (9, "w " * 30_000, "en", "b", 60_000), (10, "Été 日本 😀 ñ\n" * 60, "es", "c", 1), (None, "no id at all but some words here", "en", "a", 1), (11, "under the MIT license. Apache License, Version 2.0; CC BY-NC", "en", "c", 1), (12, "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (234) 555-6789", "en", "c", 1),
    (13, "$$$ ### " * 40, "en", "c", 1), (14, "same line\nsame line\nother\nsame line", "en", "c", 1), (15, "<|endoftext|> 's  ll x", "en", "c", 1),
]


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    extra = ["words", "node", "mix", "row", "g", "part", "quality_metrics", "at", "raw", "f", "spans"]
    extra += ["mix_source", "mix_n", "mix_copy", "mix_row", "text_key", "want", "want_id", "hit_key", "drop_id", "own_id", "first_id", "quality_kept", "quality_lang", "quality_key", "text_in", "lang_in", "group_in", "band_lang", "low", "l", "deal", "ids", "within", "key", "copies", "shard", "held_out", "score"]
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({x: F.lit(1) for x in extra}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LINE), (2, "one two"), (3, None), (4, ""), (5, LINE), (6, "w " * 12)], "item_id long, text string")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- 1 ----


def test_classifier_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_classifier.quality_scores(*d).join(d[1], "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert labels.count() > 0


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (8, 0), (9, 0), (10, 1), (13, 0), (None, 1), (3, None), (6, 7)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({round(r.score, 12) for r in got if r.doc_id in (0, 1)}) == 1
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(none, labels.limit(0)).collect() == []


def test_rules_compile_to_what_numpy_says(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality_classifier.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    found, w, b = quality_classifier.fit(x, y)
    z = b + sum(wi * quality_classifier.holds(x, r) for r, wi in zip(found, w, strict=True))
    assert ((z > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], quality_classifier.NAMES).select(F.struct(*quality_classifier.NAMES).alias("f"))
    got = [r.s for r in df.select(quality_classifier.compiled(found, w, b, F.col("f")).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z[:50])))


def slow_statistics(text):
    t = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
    n, few = max(1, len(words)), max(1, len(set(words)))
    share = lambda pattern: len(re.findall(pattern, t)) / n
    return [
        np.log1p(len(words)), len(t) / n, len(set(words)) / n, len(words) / few, n / len(lines), len(lines) / len(set(lines)), share("[A-Z]{2,}"), share(r"[#*$%&|<>]+"), share(r"[!?]{2,}"), share(r"\x20\|\x20"), share(r"[.,;:]+"), share("[0-9]+")
    ]


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_statistics_against_plain_python(request, table):
    df = request.getfixturevalue(table)
    f = F.col("f")
    got = quality_classifier.with_features(df.select("doc_id", "text"), ["doc_id", "text"]).select("text", *(f[n].alias(n) for n in quality_classifier.NAMES)).collect()
    for r in got:
        assert np.allclose([r[n] for n in quality_classifier.NAMES], slow_statistics(r.text)), r.text


def test_scores_are_those_of_the_rules(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found, w, b = quality_classifier.learn(docs, labels)
    rows = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        x = np.array([slow_statistics(r.text)])
        z = b + sum(wi * quality_classifier.holds(x, rule)[0] for rule, wi in zip(found, w, strict=True))
        assert abs(rows[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9 and rows[r.doc_id].predicted == (rows[r.doc_id].score >= 0.3)


# ---- 2 ----


def test_lm_learns_and_scores(spark, docs, odd, none):
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs).collect()}
    assert len(got) == docs.count()
    classes, whole = (sum(r[c] for r in got.values()) / sum(r.n_tokens for r in got.values()) for c in ("class_log_likelihood", "log_likelihood"))
    assert classes > -np.log(lm_scoring.VOCABULARY) + 0.5  # better than no model of classes, and of all ids
    assert classes > whole > -np.log(lm_scoring.SHAPES << lm_scoring.ID_BITS) + 4
    rows = lm_scoring.pseudo_likelihood(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 0 and by[3].log_likelihood == 0 and by[3].mean_log_likelihood is None
    assert by[0].log_likelihood == by[1].log_likelihood and by[9].n_tokens == 30_000
    assert lm_scoring.pseudo_likelihood(none).collect() == []


def test_lm_probabilities_sum_to_one():
    net = lm_scoring.Network(32, 2, 8)
    context = np.random.default_rng(0).integers(0, 32, (5, 4)).astype(np.int32)
    total = sum(np.exp(net.logs(context, np.full(5, t))) for t in range(32))
    assert np.allclose(total, 1, atol=1e-4)
    assert lm_scoring.contexts(np.array([1, 2, 3, 4]), np.array([0, 3, 4]), np.arange(4), 2).tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 0, 0]]


def test_lm_training_predicts_every_token_once():
    ids = np.random.default_rng(0).integers(0, 256, 5000).astype(np.int32)
    for rounds, mask in ((lm_scoring.ROUNDS, lm_scoring.MASK), (3, 7)):
        found = [p for turn in range(rounds) for part in lm_scoring.targets(ids, np.array([0, 1200, 1200, 5000]), turn, rounds, mask) for p in part.tolist()]
        assert sorted(found) == list(range(5000))


def slow_scores(rows, model):
    """doc_id -> (tokens, log-likelihood), token by token; word hashes are looked up, all else is plain Python."""
    net = lm_scoring.Network(lm_scoring.VOCABULARY, lm_scoring.WINDOW, lm_scoring.WIDTH).load(model.weights)
    e, b, w, c = (p.astype(np.float64) for p in net.parts)
    known, out = {h: 1 + i for i, h in enumerate(sorted(model.known.tolist()))}, {}
    for i, text in rows:
        words = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        ids, within = [], 0.0
        for x in words:
            h = int(lm_scoring.word_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0])
            letter = chr(x[-1]).isascii() and not chr(x[-1]).isalnum()
            shape = min(len(x), 16) - 1 + 16 * (65 <= x[0] <= 90) + 32 * letter
            ids.append(known.get(h, 1 + len(known) + shape))
            within += 0 if h in known else float(model.within[shape * 65536 + h % 65536])
        total = within
        for k, y in enumerate(ids):
            hidden = b.copy()
            for j, d in enumerate((-2, -1, 1, 2)):
                hidden += e[j][ids[k + d] if 0 <= k + d < len(ids) else 0]
            z = np.tanh(hidden) @ w + c
            total += z[y] - z.max() - np.log(np.exp(z - z.max()).sum())
        out[i] = (len(ids), total)
    return out


def test_lm_scores_against_a_slow_model_whatever_the_layout(spark, docs):
    some = docs.where("length(text) < 3000").orderBy("doc_id").limit(60).select("doc_id", "text")
    model = lm_scoring.fit(some)
    got = {r.doc_id: r for r in lm_scoring.score(some, model).collect()}
    for i, (n, total) in slow_scores([(r.doc_id, r.text) for r in some.collect()], model).items():
        assert got[i].n_tokens == n and abs(got[i].log_likelihood - total) < 1e-3 * max(1, n)
    for parts in (1, 5):
        other = {r.doc_id: r.log_likelihood for r in lm_scoring.pseudo_likelihood(some.repartition(parts)).collect()}
        assert all(abs(other[i] - r.log_likelihood) < 1e-3 * max(1, r.n_tokens) for i, r in got.items())


def test_lm_tells_rare_words_apart(spark):
    rows = [(i, "the cat sat on the mat " * 20 + ("gurgle " * 30 if i < 50 else "")) for i in range(100)]
    model = lm_scoring.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(model.known.tolist()) == set(lm_scoring.word_hashes(np.frombuffer(b"the cat sat on mat gurgle", np.uint8), np.array([0, 25]))[0].tolist())
    model.known = model.known[:0]
    lm = {r.doc_id: r.log_likelihood for r in lm_scoring.score(spark.createDataFrame([(1, "cat"), (2, "xyz")], "doc_id long, text string"), lm_scoring.Model(model.known, lm_scoring.vocabulary(spark.createDataFrame([], "doc_id long, text string"))[1], model.weights)).collect()}
    assert abs(lm[1] - lm[2]) < 1e-6  # without counts they differ in nothing
    many = spark.createDataFrame([(0, " ".join(f"common{i}" for i in range(300)) + " common299 zzzzzz qqqqqq" + " qqqqqq" * 9)] + [(i + 1, " ".join(f"w{k}" for k in range(250)) * 3) for i in range(3)], "doc_id long, text string")
    fitted = lm_scoring.fit(many)
    two = {r.doc_id: r.log_likelihood for r in lm_scoring.score(spark.createDataFrame([(1, "zzzzzz"), (2, "yyyyyy")], "doc_id long, text string"), fitted).collect()}
    assert two[1] > two[2] + 0.5  # a word that came is likelier than one of its shape that never did


def test_lm_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    model = lm_scoring.fit(docs.where("doc_id % 5 > 0"))
    held = docs.where("doc_id % 5 = 0")
    got = lm_scoring.score(held, model).agg(F.sum("class_log_likelihood").alias("s"), F.sum("n_tokens").alias("n")).first()
    counts = [np.zeros(lm_scoring.VOCABULARY) for _ in range(2)]
    for n, part in zip(counts, (docs.where("doc_id % 5 > 0"), held), strict=True):
        for r in lm_scoring.tokenised(part, model.known, model.within).collect():
            n += np.bincount(np.frombuffer(r.ids, np.uint8), minlength=lm_scoring.VOCABULARY)
    unigram = (counts[1] * np.log((counts[0] + 1) / (counts[0] + 1).sum())).sum() / counts[1].sum()
    assert got.s / got.n > unigram + 0.15


def test_lm_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (40, 4)).astype(np.int32), rng.integers(0, 12, 40)
    loss = lambda net: -float(net.logs(x, y).astype(np.float64).mean())
    moved = lm_scoring.Network(12, 2, 5)
    flat = moved.flat().copy()
    moved.train(x, y, [np.full_like(p, 1e-4) for p in moved.parts], 0.01)
    for i in rng.integers(0, len(flat), 40).tolist():
        step = np.zeros_like(flat)
        step[i] = 1e-2
        g = (loss(lm_scoring.Network(12, 2, 5).load(flat + step)) - loss(lm_scoring.Network(12, 2, 5).load(flat - step))) / 2e-2
        assert abs(moved.flat()[i] - flat[i] + 0.01 * g / np.sqrt(1e-4 + g * g)) < 2e-3


# ---- 3 ----


def test_mixing_matches_sql(spark, docs):
    from tidewell.llm import registry

    df = registry.queries()["op3_mixing"](spark, DATA)
    assert difference(df.collect(), df.columns, connection(), mixing.OP3_SQL) == ([], [])


def test_mixing_rates_and_odd_rows(spark, odd, none):
    got = mixing.replicated(odd, {"a": 1.0}).collect()
    assert {r.source for r in got} <= {"a", "b", "c", "", None}
    assert all(r.mix == 1 for r in got)  # the table's own column
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 1000, "x").otherwise("y").alias("source"))
    n = {r.source: r["count"] for r in mixing.mixed_documents(big, {"x": 0.5, "y": 0.5}).groupBy("source").count().collect()}
    assert abs(n["x"] - 10_000) < 500 and abs(n["y"] - 10_000) < 500
    var = [r["count"] for r in mixing.mixed_documents(big.where("source = 'x'").unionByName(big.where("source = 'y'")), {"x": 0.5, "y": 0.5}).where("source = 'x'").groupBy("doc_id").count().collect()]
    assert abs(np.var(var) / np.mean(var) - 1) < 0.25  # a Poisson distribution's variance is its mean
    assert mixing.mixed_documents(none).collect() == []
    large = mixing.mixed_documents(big.limit(3).unionByName(big.where("doc_id >= 1000")), {"x": 0.9, "y": 0.1}).where("source = 'x'").count()
    assert large > 10_000  # means far beyond one piece


def test_heavy_sources_are_mixed_by_chunks(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x" if i < 3 else "y", 1) for i in range(900)] + [(None, None, None, 1)], "doc_id long, text string, source string, mix_part int")
    weights = {"x": 0.9, "y": 0.1}
    rows = lambda chunk: Counter((r.doc_id, r.n, r.mix_part, *r.mix) for r in mixing.replicated(df.withColumn("n", F.length("text")), weights, chunk=chunk).collect())
    want = rows(mixing.CHUNK)
    assert rows(2) == want and max(want.values()) == 1 and sum(k[0] in (0, 1, 2) for k in want) > 600


# ---- 4 ----


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_sharding(request, table):
    df = request.getfixturevalue(table)
    rows = sharding.shard_documents(df).collect()
    texts = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    of = defaultdict(set)
    for i, t in texts:
        if t is not None and i is not None:
            of[t] |= {r.shard for r in rows if r.doc_id == i}
    assert all(len(s) == 1 for s in of.values())
    if table == "docs":
        load = [sum(r["size"] for r in shards[s]) for s in range(16)]
        assert max(load) < 1.1 * np.mean(load)


def longest_first(sizes, n_shards):
    """Plain scheduling, one item at a time: shard of each item (name, size)."""
    heap, out = [(0, s) for s in range(n_shards)], {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def test_sharding_of_nothing(none):
    assert sharding.shard_documents(none).collect() == []
    assert longest_first([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sharding.scheduled([(5, 1), (3, 2), (1, 1)], 2) == {5: [(0, 1)], 3: [(1, 2)], 1: [(0, 1)]}


def test_runs_are_scheduled_as_single_groups():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n_shards = int(rng.integers(1, 18))
        runs = {int(s): int(n) for s, n in zip(rng.integers(1, 400, 30), rng.choice([1, 2, 7, 80, 900], 30), strict=True)}
        want = defaultdict(Counter)
        items = [((s, i), s) for s, n in runs.items() for i in range(n)]
        for (s, _), shard in longest_first(items, n_shards).items():
            want[s][shard] += 1
        assert {s: Counter(dict(x)) for s, x in sharding.scheduled(list(runs.items()), n_shards).items()} == want


def test_sharding_is_longest_first_over_all_groups(spark, docs):
    texts = [r.text for r in docs.collect()] + ["tie %03d" % i for i in range(300)] + [None] * 40 + ["x" * 9000] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    groups = Counter()
    for i, t in enumerate(texts):
        groups[i if t is None else t] += len((t or "").encode()) + 1
    names, got, want = sorted(groups, key=str), Counter(), Counter()
    for k, s in longest_first([(k, groups[g]) for k, g in enumerate(names)], 16).items():
        want[groups[names[k]], s] += 1
    for g, s in {(r.doc_id if texts[r.doc_id] is None else texts[r.doc_id], r.shard) for r in sharding.shard_documents(df).collect()}:
        got[groups[g], s] += 1
    assert got == want


# ---- 5 ----


def brute_pairs(rows):
    sets = []
    for r in rows:
        w = words_of(r.text)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= 0.8] for i, a in enumerate(sets)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(links):
        for j in own:
            root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r.doc_id)
    return [(r.doc_id, min((x for x in ids[find(i)] if x is not None), default=None), len(links[i])) for i, r in enumerate(rows)]


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_near_duplicates(request, table):
    df = request.getfixturevalue(table)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == Counter(brute_pairs(df.collect()))


@pytest.mark.parametrize("shared", [None, 7])
def test_many_rows_of_one_id(spark, shared, monkeypatch):
    """Rows of a null or shared doc_id are found by their nodes: no text meets the nodes of all others."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        w = [f"w{x}" for x in rng.integers(0, 1 << 30, 60)]
        rows += [(shared, " ".join(w)), (shared, " ".join([*w[:-1], "end"])), (1000 + i, " ".join(["start", *w[1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    monkeypatch.setattr(ngram_join, "staged", lambda t, label, real=ngram_join.staged: met.append((label, real(t, label))) or met[-1][1])
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == Counter(brute_pairs(df.collect()))
    sets = next(t for label, t in met if label == "sets")
    assert sets.count() == len(rows)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in rng.integers(0, 200, 2):
            w[j] = f"e{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == Counter(brute_pairs(df.collect()))


def test_spanning_links_connect_what_the_hits_connect():
    rng = np.random.default_rng(1)
    for trial in range(100):
        same = trial % 2 == 0
        n, m = rng.integers(1, 12, 2)
        hit = rng.random((n, n) if same else (n, m)) < 0.5 * rng.random()
        if same:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        want, got = ngram_join.Forest(), ngram_join.Forest()
        at = 0 if same else 1000  # rows and columns are other sets
        for i, j in np.argwhere(hit).tolist():
            want.add(i, j + at)
        for i, j in ngram_join.spanning(hit, same):
            assert hit[i, j]
            got.add(i, j + at)
        assert len(got.links) == len(want.links) == len(ngram_join.spanning(hit, same))
        assert all(got.root(i) == got.root(j + at) for i, j in np.argwhere(hit).tolist())


def test_every_pair_of_a_bucket_is_compared():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 30, (120, ngram_join.SIGNATURE)).astype(np.int32)
    sig[100] = sig[0]
    batch = pa.record_batch([pa.array(np.full(120, 7)), pa.array(np.arange(120)), pa.array(sig.tolist(), pa.list_(pa.int32()))], names=["key", "node", "sig"])
    found = pa.Table.from_batches(list(ngram_join._brute([batch.slice(0, 50), batch.slice(50)]))).to_pylist()
    assert found == [{"a": 0, "b": 100}]


def test_runs_repeat_until_the_target_recall(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 1 << 30, 120)]
        rows.append((2 * i, " ".join(w)))
        for j in rng.integers(0, 120, 2):
            w[j] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    report, few = {}, {}
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df, report=report).collect())
    assert got == Counter(brute_pairs(df.collect())) and report["recall"] >= ngram_join.TARGET and report["probe_pairs"] > 300
    nodes = ngram_join.sketches(df).select("node", "sig")
    every, met = ngram_join.probed(nodes, spark.createDataFrame([], "node long, root long"))
    assert every == report["probe_pairs"] and met == 0
    monkeypatch.setattr(ngram_join, "FIRST", 1)
    monkeypatch.setattr(ngram_join, "MORE", 1)
    ngram_join.candidate_groups(ngram_join.staged(nodes, "nodes"), report=few)
    assert few["runs"] > 1 and few["recall"] >= ngram_join.TARGET
    monkeypatch.setattr(ngram_join, "MOST", few["runs"])
    with pytest.raises(RuntimeError, match="below its target"):
        ngram_join.candidate_groups(ngram_join.staged(nodes, "nodes"), target=1.1)


def test_one_of_each_stays(odd, none, docs):
    kept = ngram_join.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 1 not in ids and 2 not in ids and ids[6] == 1 and 7 not in ids and ids[3] == ids[4] == ids[5] == 1 and ids[None] == 1
    assert ngram_join.near_duplicates(none).collect() == []
    assert ngram_join.first_of_each(docs).count() == len({c for _, c, _ in brute_pairs(docs.collect())})


def test_one_of_each_stays_where_ids_are_null_or_repeat(spark):
    a, b, c, d, e, f, g, h = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcdefgh")
    near = b.replace("b30", "other")
    rows = [(3, b), (7, a), (7, near), (None, c), (None, d), (None, d), (None, near), (None, ""), (None, None), (8, e), (8, f), (9, g), (9, g.upper()), (9, ""), (10, g), (11, h), (11, h), (5, h)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, root string").repartition(3)
    got = Counter((r.doc_id, (r.text or "").lower()) for r in ngram_join.first_of_each(df).collect())
    assert got == Counter([(3, b), (7, a), (None, c), (None, d), (None, ""), (None, ""), (8, e), (8, f), (9, g), (9, ""), (5, h)])
    nobody = ngram_join.first_of_each(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert Counter((r.text or "").lower().replace("other", "b30") for r in nobody) == Counter([a, b, c, d, e, f, g, h, "", "", ""])


# ---- 6 ----


def brute_windows(text, items, window=10):
    w = words_of(text)
    hit, ids = set(), set()
    for i, item in items:
        v = words_of(item)
        size = min(window, len(v))
        wins = {tuple(v[s : s + size]) for s in range(len(v) - size + 1)} if v else set()
        for s in range(len(w) - size + 1):
            if tuple(w[s : s + size]) in wins:
                hit |= set(range(s, s + size))
                ids.add(str(i))
    return len(w), len(hit), tuple(sorted(ids))


def test_decontamination_matches_sql(spark):
    df = decontamination.op6(spark, DATA)
    assert difference(df.collect(), df.columns, connection(), decontamination.OP6_SQL) == ([], [])


def test_decontamination_on_odd_rows(odd, benchmark, none):
    items = [tuple(r) for r in benchmark.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contaminated(odd, benchmark).collect())
    assert got == Counter((r.doc_id, *brute_windows(r.text, items)) for r in odd.collect())
    kept = decontamination.uncontaminated(odd, benchmark)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in odd.collect() if not brute_windows(r.text, items)[1])
    assert decontamination.contaminated(none, benchmark).collect() == []
    assert decontamination.contaminated(odd, benchmark.limit(0)).where("n_hit > 0").collect() == []


# ---- 7 ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            x = m.group()
            d = [int(y) for y in re.sub("[^0-9]", "", x)] if name in ("card", "phone") else []
            luhn = sum(v if i % 2 == 0 else (2 * v - 9 * (v > 4)) for i, v in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": name != "ip" or all(int(y) <= 255 for y in x.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


@pytest.mark.parametrize("table", ["odd", "docs", "mixed"])
def test_personal_data(request, spark, table, tmp_path):
    if table == "mixed":
        rng = np.random.default_rng(3)
        bits = ["a@b.c", "x", "+1 (234) 555-6789", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "é", "😀", "@", " ", ".", "-", "a@b.c@d.e", "_x@d.e.f", "12345678901234567890123", "+", "0", "004.1.2.3", "+12345678901", "deadbeef" * 5, "joe [at] mail [dot] com", "Dr. Anna Kerr", "\n"]
        df = spark.createDataFrame([(i, "".join(rng.choice(bits, rng.integers(0, 12)))) for i in range(500)] + [(900, "1" * 20_000), (901, "1 " * 10_000), (902, "a.b" * 5_000)], "doc_id long, text string")
    else:
        df = request.getfixturevalue(table)
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r in df.collect():
        b = brute_spans(r.text)
        n = Counter(x[3] for x in b)
        want[(r.doc_id, *(n[k] for k in BASE), hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in b).encode()).hexdigest())] += 1
    rows = pii.op7(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    for r in rows:  # base spans stay among all spans
        assert r.spans.count("email:") - r.spans.count("spelled_email:") == r.n_email


def test_reliabilities_find_the_better_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.6
    good, poor = (np.where(rng.random(5000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.6))
    votes = np.stack([good, poor, np.where(rng.random(5000) < 0.85, np.where(truth, 1, -1), np.where(truth, -1, 1)), np.zeros(5000, int)], axis=1)
    kinds = np.zeros(5000, int)
    q, theta = pii.fit_reliabilities(kinds, votes, np.ones(5000))
    assert theta[0][1][2] > theta[2][1][2] > theta[1][1][2]
    assert ((q > 0.5) == truth).mean() > 0.93
    w = pii.fit_classifier(kinds, votes, np.ones(5000), q)
    assert ((pii._features(kinds, votes) @ w > 0) == truth).mean() > 0.93


def brute_candidates(text):
    """(kind, start, stop, votes) of all candidates, by Python's regular expressions."""
    t, out = text or "", []
    for name, pattern in pii.PATTERNS.items():
        k = pii.KINDS.index(name)
        places = [(a, e) for a, j, e, _ in brute_spans(t) if j == k] if k < 4 else [m.span() for m in re.finditer(pattern, t, re.A)]
        every = [m.span() for m in re.finditer(BASE[name] if k < 4 else pattern, t, re.A)]
        for a, e in places:
            x, last = t[a:e], max((q for p, q in every if q <= a), default=0)
            before, after = t[max(last, a - 24) : a].lower(), t[e : e + 1] if not any(p == e for p, _ in every) else ""
            digits = re.sub("[^0-9]", "", x)
            form = {
                "email": lambda: re.search(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$", x), "ip": lambda: not re.search(r"(?:^|\.)0[0-9]", x), "card": lambda: 13 <= len(digits) <= 19, "phone": lambda: 10 <= len(digits) <= 15,
                "secret": lambda: len(x) in (32, 40, 64, 128) and re.search("[0-9]", x) and re.search("[a-fA-F]", x), "local_phone": lambda: re.search(r"^\(?[2-9]", x), "id_number": lambda: not re.search(r"^(?:000|666|9)|-00-|-0000$", x),
                "spelled_email": lambda: re.search(r"(?i)(?:\.|[\[(]dot[\])])\x20?[a-z]{2,24}$", x), "name": lambda: len(x) >= 10,
            }[name]()
            octets = [int(o) for o in x.split(".")] if name == "ip" else []
            listed = 0
            if name in ("email", "spelled_email"):
                listed = 1 if (re.search(r"([A-Za-z]+)$", x) or [""])[0].lower() in pii.ENDINGS else -1
            elif name == "ip":
                listed = -1 if octets[0] in (0, 127) or octets[0] >= 224 else 0 if octets[0] == 10 or octets[:2] == [192, 168] or (octets[0] == 172 and 16 <= octets[1] <= 31) else 1
            elif name == "card":
                listed = int(digits[0] in "3456")
            elif name == "phone":
                listed = int(bool(re.search(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", x)))
            elif name == "name":
                listed = int(re.search(r"\x20([A-Z][a-z]+)\x20", x)[1].lower() in pii.GIVEN)
            cue = -1 if re.search(pii.AGAINST, before) else int(bool(re.search(pii.CUES[name], before)))
            edge = -1 if re.search(r"[\w.-]$", before, re.A) or re.search(r"[\w@]", after, re.A) else 1
            out.append((k, a, e, (1 if form else -1, listed, cue, edge)))
    return out


def test_votes_and_added_spans_against_brute_force(spark):
    rng = np.random.default_rng(9)
    bits = [
        "call 212-555-0147", "fax (415) 555-2671", "version 312.555.0199", "ssn 123-45-6789", "tax 666-12-3456", "release 900-12-0000", "joe [at] mail [dot] com", "write to anna (at) site.org", "b [at] x [dot] zz9", "Dr. Anna Kerr", "dear Mr John Smith", "Prof Xi Yu", "token " + "deadbeef" * 4,
        "sha1 " + "0123456789abcdef" * 2 + "01234567", "key " + "a1" * 20, "mail a@b.com", "x@y.zzz", "from 8.8.8.8", "127.0.0.1", "010.1.1.1", "card 4111 1111 1111 1111", "+1 (234) 555-6789", "phone +49301234567", "plain words", "é 日本 😀", ",", "_", "-", ".", "call 212-555-0147x", "212-555-0147 123-45-6789",
    ]
    rows = [(i, " ".join(rng.choice(bits, rng.integers(0, 9)))) for i in range(250)] + [(300, None), (301, ""), (302, "ssn 123-45-6789 " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: brute_candidates(t) for i, t in rows}
    got = {r.doc_id: [(x.kind, x.start, x.stop, (x.form, x.list, x.cue, x.edge)) for x in r.spans] for r in pii.candidate_spans(df).collect()}
    for i, t in rows:
        assert sorted(got[i]) == sorted(want[i]), t
    patterns = Counter((k, v) for found in want.values() for k, _, _, v in found)
    assert {k for k, _ in patterns} == set(range(len(pii.KINDS)))
    kinds, votes, n = np.array([k for k, _ in patterns]), np.array([v for _, v in patterns]), np.array(list(patterns.values()), float)
    q, _ = pii.fit_reliabilities(kinds, votes, n)
    w = pii.fit_classifier(kinds, votes, n, q)
    accepted = {p: z >= 0 for p, z in zip(patterns, pii._features(kinds, votes) @ w, strict=True)}
    for r in pii.personal_data(df).collect():
        kept = sorted((a, k, e) for k, a, e, _ in want[r.doc_id] if k < 4)
        base = list(kept)
        assert [tuple(x) for x in r.base] == base
        upto = 0
        for a, k, e in sorted((a, k, e) for k, a, e, v in want[r.doc_id] if k >= 4 and accepted[k, v]):
            if a >= upto and not any(a < y and x < e for x, _, y in base):
                kept.append((a, k, e))
                upto = e
        assert [tuple(x) for x in r.found] == sorted(kept)
    assert any(accepted[p] for p in accepted if p[0] >= 4) and any(not accepted[p] for p in accepted if p[0] >= 4)


def test_many_matches_in_one_text(spark):
    df = spark.createDataFrame([(1, "12 " * 200_000), (2, "a@b.com " * 20_000), (3, "ssn 123-45-6789, " * 20_000)], "doc_id long, text string")
    rows = {r.doc_id: (len(r.base), len(r.found)) for r in pii.personal_data(df).select("doc_id", "base", "found").collect()}
    assert rows[1] == (0, 0) and rows[2] == (20_000, 20_000) and rows[3][0] == 0 and rows[3][1] in (0, 20_000)


def test_personal_data_of_nothing(none):
    assert pii.personal_data(none).collect() == []


# ---- 8 ----


def test_license_scan_matches_sql(spark):
    df = license_scan.op8(spark, DATA)
    assert difference(df.collect(), df.columns, connection(), license_scan.OP8_SQL) == ([], [])


def test_license_scan_on_odd_rows(odd, none):
    def brute(text):
        w = words_of(text)
        at = [(s, label) for phrase, label in license_scan.PHRASES.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        return len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted({b for _, b in at}))

    rows = license_scan.scan_licenses(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter((r.doc_id, *brute(r.text)) for r in odd.collect())
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert license_scan.scan_licenses(none).collect() == []


def brute_finds(text, templates, cover=license_scan.COVER, near=license_scan.NEAR):
    """Labels of the templates of which some chain of diagonals, each at most `near` beyond the one before, has enough grams in order; and the fullest cover."""
    w, labels, best = words_of(text), set(), 0.0
    for label, template in templates:
        tw = template.split()
        g = min(license_scan.GRAM, len(tw))
        votes = sorted((p - t, t) for p in range(len(w) - g + 1) for t in range(len(tw) - g + 1) if w[p : p + g] == tw[t : t + g])
        spans = []
        for d, t in votes:
            if not spans or d - spans[-1][-1][0] > near:
                spans.append([])
            spans[-1].append((d, t))
        for span in spans:
            first = {}
            for d, t in span:
                first.setdefault(t, d)
            at = sorted(first.items())
            n = 1 + sum(abs(y - x) <= near and t + x < u + y for (t, x), (u, y) in zip(at, at[1:], strict=False))
            share = n / (len(tw) - g + 1)
            best = max(best, share)
            labels |= {label} if share >= cover else set()
    return ",".join(sorted(labels)), round(best, 6)


def stuffed(text, every):
    """The text with two words put in after every so many."""
    w = text.split()
    return " ".join(" ".join(w[i : i + every]) + f" put{i} in{i}" for i in range(0, len(w), every))


@pytest.mark.parametrize("every", [8, 10, 12])
def test_licenses_with_words_put_in(spark, every):
    texts = [("apache-2", license_scan.TEMPLATES[-3][1]), ("isc", next(t for label, t in license_scan.TEMPLATES if label == "isc")), ("mit", license_scan.TEMPLATES[13][1])]
    rows = [(i, f"some words before {stuffed(t, every)} and after") for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect()}
    for i, (label, _) in enumerate(texts):
        assert label in got[i].labels.split(",") and got[i].finds[0].first_word == 3
        assert (got[i].labels, got[i].score) == brute_finds(rows[i][1], license_scan.TEMPLATES)


def test_license_spans_against_brute_force(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    texts = [
        "intro words permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files end",
        "free of charge " * 14, "to the extent possible under law the " + "all copyright and " * 12, "General Public License " * 6, notice, f"{notice} {notice}", "the license " * 50, "of this software " * 30 + notice,
        " ".join(notice.split()[::-1]), " ".join(" ".join(notice.split()[k : k + 4]) for k in (12, 4, 16, 0, 8)), " ".join(w + (" extra" if i % 4 == 0 else "") for i, w in enumerate(notice.split())), "under the terms of the gnu lesser general public license",
    ]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}).collect()}
    for i, text in enumerate(texts):
        assert (rows[i].labels, rows[i].score) == brute_finds(text, license_scan.TEMPLATES), text
    assert rows[0].labels == "mit" and rows[0].score > 0.6 and rows[4].labels == "mit" and rows[4].score == 1
    assert rows[1].labels == rows[2].labels == rows[3].labels == rows[6].labels == rows[8].labels == rows[9].labels == ""
    assert [f.first_word for f in rows[5].finds] == [0, 20] and [f.first_word for f in rows[7].finds] == [90]


def test_license_phrases_of_few_words(spark, odd):
    df = spark.createDataFrame([(1, "GPL here, MIT License there; mit license"), (2, "none"), (3, None), (4, "mit"), (5, "x mit y gpl")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df, {"gpl": "gpl", "mit license": "mit", "": "void"}, [("two", "y gpl"), ("none", " ")]).collect()}
    assert [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels, rows[i].labels) for i in range(1, 6)] == [
        (3, 0, 5, "gpl,mit", "gpl,mit"), (0, None, None, "", ""), (0, None, None, "", ""), (0, None, None, "", ""), (1, 3, 3, "gpl", "gpl,two")
    ]
    assert all(r.labels == "" for r in license_scan.scan_licenses(odd, {}, []).collect())


# ---- 9 ----


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if tri[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    n, r = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, r, n < 50 or 100 * r > 50 * n


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_quality_rules(request, spark, table, tmp_path):
    df = request.getfixturevalue(table)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = quality_rules.op9(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((r.doc_id, *brute_counts(r.text)) for r in df.collect())
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality_rules.quality_filter(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_copies_do_not_move_the_band(spark):
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(words[x] for x in rng.integers(0, 40 + 3 * i, 150)), "fr") for i in range(120)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    heavy = plain.unionByName(spark.createDataFrame([(1000 + i, rows[60][1], "fr") for i in range(400)], plain.schema)).repartition(5)
    counts = [{(r.l, r.gram): r.n for r in quality_rules.count_grams(df).collect()} for df in (plain, heavy)]
    assert counts[0] == counts[1]
    want = {r.doc_id for r in quality_rules.quality_filter(plain).collect()}
    got = [r.doc_id for r in quality_rules.quality_filter(heavy).collect()]
    assert len(want) > 110 and {i for i in got if i < 1000} == want and sum(i >= 1000 for i in got) == 400


def test_quality_rules_of_nothing(none):
    assert quality_rules.quality_filter(none).collect() == []


def slow_kneser_ney(texts, order=4):
    """log_p(history, character) of a plain modified Kneser-Ney model over the distinct texts, with dictionaries."""
    tables = {order: Counter()}
    for t in set(texts):
        padded = "\0" * (order - 1) + t
        tables[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, total, spare = {}, defaultdict(float), defaultdict(float)
    for k, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        discount[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if n[i] else 0.5 * y for i in (1, 2, 3)]
        for g, c in table.items():
            total[g[:-1]] += c
            spare[g[:-1]] += discount[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / 65536
        history = g[:-1]
        if history and history not in total:
            return p(g[1:])
        c = tables[len(g)][g]
        return (c - discount[len(g)][min(c, 3)]) / total[history] + spare[history] / total[history] * p(g[1:])

    def score(g):
        return np.log(max(p(g), 1e-12))

    return score


def test_perplexity_and_bands_against_a_slow_model(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = {"en": "abcdefgh AB.", "ru": "абвгде ж", "ja": "日本語の文章です。漢字", None: "xyz😀 é"}
    rows = []
    for lang, pool in letters.items():
        words = ["".join(rng.choice([*pool], rng.integers(1, 6))) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 60)), lang) for i in range(30)]
    rows += [(200 + i, rows[3][1], "en") for i in range(9)]
    rows += [(300, "".join(rng.choice([*"qjxzwv KQ"], 400)), "en"), (301, rows[35][1], "en"), (302, "", "en"), (303, None, "ja"), (304, "a b c", "nl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    slow = {lang: slow_kneser_ney([t for _, t, x in rows if x == lang and t]) for lang in {x for _, _, x in rows}}
    want = {i: -sum(slow[lang](("\0\0\0" + t)[k : k + 4]) for k in range(len(t))) / len(t) if t else 0.0 for i, t, lang in rows}
    failed = {i: brute_counts(t)[-1] for i, t, _ in rows}
    cells = {lang: sorted(np.floor(want[i] * 200) for i in {t: i for i, t, x in reversed(rows) if x == lang and not failed[i]}.values()) for lang in slow}
    for limit, entries in ((quality_rules.MODEL_BYTES, quality_rules.RANGE_ROWS), (1, 600)):  # in one pass, and in one for each hash range
        monkeypatch.setattr(quality_rules, "MODEL_BYTES", limit)
        monkeypatch.setattr(quality_rules, "RANGE_ROWS", entries)
        out, column, kept = quality_rules.judged(df, ["doc_id"])
        got = {r.doc_id: (r[column].log_ppl, r[kept]) for r in out.collect()}
        for i, t, lang in rows:
            assert abs(got[i][0] - want[i]) < 1e-4, (i, lang)
            if failed[i]:
                assert not got[i][1]
            elif cells[lang]:
                q1, q2, q3 = (next(c for k, c in enumerate(cells[lang]) if k + 1 >= q * len(cells[lang])) / 200 + 0.0025 for q in (0.25, 0.5, 0.75))
                low, high = q2 - 8 * max(q2 - q1, 0.01), q2 + 8 * max(q3 - q2, 0.01)
                assert got[i][1] == (low <= want[i] <= high), i
        assert not got[300][1] and got[200][1]  # random letters go


def test_bands_reject_planted_salad_and_foreign_text(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    foreign = docs.where("lang = 'de' AND length(text) > 600").orderBy("doc_id").limit(8).select(F.col("doc_id") + 10**6, "text", F.lit("en"))
    rng = np.random.default_rng(3)
    salad = [(2 * 10**6 + i, " ".join("".join(rng.choice([*"qwertzuiopasdfghjklyxcvbnm"], rng.integers(3, 9))) for _ in range(150)), "en") for i in range(8)]
    kept = {r.doc_id for r in quality_rules.quality_filter(docs.unionByName(spark.createDataFrame(salad, docs.schema)).union(foreign)).collect()}
    assert not any(i >= 10**6 for i in kept)
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    passed = {r.doc_id for r in docs.collect() if not brute_counts(r.text)[-1]} & good
    assert len(passed & kept) >= 0.98 * len(passed)


def test_kneser_ney_is_a_distribution(spark):
    text = "abracadabra abracadabra, the cat sat on the mat; a rat ran at the cat. été 日本 " * 3
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string")
    fitted = quality_rules.fitted(quality_rules.count_grams(df))
    model = next(iter(quality_rules.loaded(quality_rules.models(fitted).toArrow()).values()))
    assert all((np.diff(h) > 0).all() for h, _, _ in model)
    model = quality_rules.ready(model)
    raw = text.encode()
    keys = quality_rules.grams(*quality_rules.characters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert [chr(k & 0xFFFF) for k in keys.tolist()] == [*text]
    for history in (int(keys[30]) & ((1 << 48) - 1), int(keys[5]) & ((1 << 48) - 1), 0x3FFF00410041):  # seen and unseen ones
        every = (np.uint64(history) << np.uint64(16) | np.arange(65536, dtype=np.uint64)).view(np.int64)
        assert abs(np.exp(quality_rules.log_probabilities(model, every)).sum() - 1) < 1e-3
    whole = next(iter(quality_rules.loaded(quality_rules.models(fitted).toArrow()).values()))
    cut = quality_rules.models(fitted, 20)
    assert cut.where("k = 4").count() > 2  # however the arrays are cut, every n-gram is there
    for (a, p, _), (b, q, _) in zip(whole, next(iter(quality_rules.loaded(cut.toArrow()).values())), strict=True):
        assert (a == b).all() and (p == q).all()
    assert sum(len(h) for h, _, _ in whole) == fitted.count()


# ---- 10 ----


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.choice([0, 1, 5, 59, 60, 61, 4095, 4096, 4097, 9000], 5)
        ids = rng.integers(0, 1 << 59, int(lengths.sum()), dtype=np.uint64) >> rng.integers(0, 59, int(lengths.sum())).astype(np.uint64)
        words, n_words, _ = token_output.pack(ids, lengths)
        sizes = np.concatenate([np.minimum(4096, n - 4096 * np.arange(-(-n // 4096))) for n in lengths]).astype(np.int64)
        assert (token_output.unpack(words, n_words, sizes) == ids).all()
    with pytest.raises(ValueError):
        token_output.pack(np.array([1 << 60], np.uint64), np.array([1]))


def test_pieces_encode_as_whole_texts():
    e = token_output.encoder("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    letters = [*"ab '\n\t  .,1é5ñ日   \x1c$!", "<|endoftext|>", "'ll", " ", "\x02", "\r\n"]
    for _ in range(3000):
        s = "".join(rng.choice(letters, rng.integers(0, 14)))
        raw = np.frombuffer(s.encode(), np.uint8)
        assert e(raw, np.array([0, len(raw)]))[0].tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_pieces_encode_as_lines():
    e = token_output.Encoder(token_output.encoder("byte_bpe_50k.json").path)
    rng = np.random.default_rng(5)
    letters = [*"abcXY.,1'é$!<|>-", "<|endoftext|>", "'ll", "\u00a1", "ñ", " ", "\n"]
    pieces = sorted({rng.choice(["", " "]) + "".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(6000)})
    e.learn([x.encode() for x in pieces])
    for i, x in enumerate(pieces):
        assert e.flat[e.begin[i] : e.begin[i] + e.length[i]].tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_encoder_outgrows_its_table_and_forgets(monkeypatch):
    monkeypatch.setattr(token_output.Encoder, "SLOTS", 64)
    monkeypatch.setattr(token_output.Encoder, "CACHE", 500)
    e = token_output.Encoder(token_output.encoder("byte_bpe_50k.json").path)
    for turn in range(4):
        text = " ".join(f"w{i}" for i in range(turn * 100, 700 + turn * 100)).encode()
        assert e(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist() == e.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert 2 * e.n <= len(e.table)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_token_output(request, table):
    df = request.getfixturevalue(table)
    t = token_output.encoder("byte_bpe_50k.json").tokenizer
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter(map(tuple, token_output.token_output(df).collect())) == Counter(want)


def test_token_output_of_nothing(none):
    assert token_output.token_output(none).collect() == []


# ---- the pipeline ----


def slow_quality(rows):
    """doc_ids that pass the base rules and lie within their language's band, from the slow model."""
    slow = {lang: slow_kneser_ney([r.text for r in rows if r.lang == lang and r.text]) for lang in {r.lang for r in rows}}
    ppl = {(r.lang, r.text): -sum(slow[r.lang](("\0\0\0" + r.text)[k : k + 4]) for k in range(len(r.text))) / max(1, len(r.text)) for r in rows if r.text}
    kept = []
    for r in rows:
        if brute_counts(r.text)[-1]:
            continue
        cells = sorted(np.floor(v * 200) for (lang, t), v in ppl.items() if lang == r.lang and not brute_counts(t)[-1])
        q1, q2, q3 = (next(c for k, c in enumerate(cells) if k + 1 >= q * len(cells)) / 200 + 0.0025 for q in (0.25, 0.5, 0.75))
        if q2 - 8 * max(q2 - q1, 0.01) <= ppl[r.lang, r.text] <= q2 + 8 * max(q3 - q2, 0.01):
            kept.append(r.doc_id)
    return Counter(kept)


def slow_mixing(rows):
    """(doc_id, text) of every copy: counts by inverting the distribution term by term."""
    n, out = Counter(r.source for r in rows), Counter()
    shares = sum(v**0.5 for v in n.values())
    for r in rows:
        rate = n[r.source] ** 0.5 / shares * len(rows) / n[r.source]
        base = hashlib.md5(f"{mixing.SEED}|{'' if r.doc_id is None else r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
        u = int(hashlib.md5(f"{base}|1".encode()).hexdigest()[:12], 16) / 2**48
        k, p, below = 0, np.exp(-rate), np.exp(-rate)
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        assert rate <= mixing.PIECE
        out[r.doc_id, r.text] += k
    return +out


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    have, tables = docs, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        have = stage(spark, have, DATA)
        assert have.columns == docs.columns, name
        tables.append(have.collect())
        have = spark.createDataFrame(tables[-1], docs.schema)
    ids = [Counter(r.doc_id for r in rows) for rows in tables]
    assert ids[1] == slow_quality(tables[0])
    classes = defaultdict(list)
    for i, c, _ in brute_pairs(tables[1]):
        classes[c].append(i)
    assert ids[2] == Counter(min(x) for x in classes.values())
    assert ids[3] == Counter(r.doc_id for r in tables[2] if not brute_windows(r.text, benchmark)[1])
    assert Counter((r.doc_id, r.text) for r in tables[4]) == slow_mixing(tables[3])
    t, want, at = token_output.encoder("byte_bpe_50k.json").tokenizer, [], 0
    for r in sorted(tables[4], key=lambda r: (r.doc_id, r.text)):
        x = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == Counter(want) and want


def test_pipeline_on_odd_rows(spark, odd, none, benchmark, tmp_path):
    import corpus_pipeline

    long = spark.createDataFrame([(i, " ".join(f"{LINE} {k} {j}" for k in range(8)), "en", s, 1) for j, (i, s) in enumerate([(20, "a"), (20, "b"), (None, None), (None, "a"), (21, None)])], SCHEMA)
    own = odd.unionByName(long.withColumns({x: F.lit(1) for x in odd.columns[5:]}))
    for table, count in ((own, None), (none, 0)):
        folder = f"{tmp_path}/{count}"
        table.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert count is None or len(rows) == count
        have = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            have = stage(spark, have, folder)
            assert have.columns == table.columns
