"""Top-k search, the Merkle manifest and the filter audit against brute-force versions and SQL, and on odd tables."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import DATA, connection, difference

from tidewell.llm import filter_audit, merkle, registry, topk_search
from tidewell.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (0, "a b c", "en", "a", 5), (1, "a b c", "en", "a", 5), (1, "a b c", "en", "a", 5), (2, "X " * 300, "en", "b", 600), (3, None, None, None, None), (4, "", "", "", 0), (5, "line\none\n\nmore", "fr", "a", 14),
    (6, "line\none", "fr", "é日", 8), (7, "w%d " * 400, "en", "a", 1), (8, " ".join(f"w{i}" for i in range(50_000)), "en", "b", 300_000), (None, "no\nid", "en", None, 5), (None, None, "en", "a", None), (9, "tag #1", "x", "z", 6), (10, "\n", "", "zz", 1), (11, None, "en", "", 0),
]


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    extra = "part key fails least good toxic w c d n row at rank idx leaf changed tie first run_part run_source tree level hash place masks"
    return spark.createDataFrame(ODD, SCHEMA).withColumns({x: F.lit(1) for x in extra.split()}).repartition(3)


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_merkle_manifest", "op13_filter_audit"])
def test_same_rows_as_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    assert difference(df.collect(), df.columns, con, registry.oracle_sql()[name]) == ([], [])


# ---- top-k search ----


def slow_top(rows, k=5):
    """rows: (vec_id, vector) -> Counter of (query_id, rank, score), and for rows of distinct ids also the partner."""
    sound = [(i, v, [int(np.floor(256 * float(np.float32(x)))) for x in vec]) for i, (v, vec) in enumerate(rows) if vec is not None and all(x is not None and np.isfinite(x) for x in vec)]
    out = []
    for i, v, a in sound:
        if v is not None and v % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), w is None, w or 0) for j, w, b in sound if j != i)
            out += [(v, r, None if null else w, -s) for r, (s, null, w) in enumerate(found[:k], 1)]
    return Counter(out)


def top(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({x: F.lit(1) for x in ("row", "v", "n2", "q", "score", "rank", "least", "block")})
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, **more).collect())


def test_search_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    f = lambda *x: [float(v) for v in x]
    rows = [(i, f(*rng.normal(size=5)), 0) for i in range(0, 160, 3)]
    rows += [(50, f(1, 0, 0, 0, 0), 0), (50, f(1, 0, 0, 0, 0), 0), (200, None, 0), (250, f(1, float("nan"), 0, 0, 0), 0), (300, [1.0, None, 0.0], 0), (350, f(1, float("inf"), 0), 0)]
    rows += [(400, f(), 0), (450, f(1, 2), 0), (500, f(0, 0, 0, 0, 0), 0), (None, f(1, 1, 1, 1, 1), 0), (None, f(9, 9, 9, 9, 9), 0), (-50, f(-0.001, 0.001, 0, 0, 1), 0)]
    want = slow_top([r[:2] for r in rows])
    assert top(spark, rows) == want
    assert top(spark, rows, query_rows=2, seeds=3) == want  # several passes, bounds from few
    assert top(spark, rows[:0]) == Counter() and top(spark, [(1, f(1), 0)]) == Counter() and top(spark, [(50, f(1), 0)]) == Counter()
    assert top(spark, [(50, f(1), 0), (51, f(2), 0)]) == Counter([(50, 1, 51, 256 * 512)])
    with pytest.raises(ValueError):
        top(spark, [(50, f(1e9), 0), (51, f(1), 0)])


def test_search_with_copies_and_long_vectors(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=40)
    rows = [(i, [float(x) for x in (hot if i % 3 == 0 else rng.normal(size=40) * (300 if i % 2 else 1))], 0) for i in range(900)]  # a third of all rows is one vector
    assert top(spark, rows) == slow_top([r[:2] for r in rows])


def test_tiles_against_all_products():
    rng = np.random.default_rng(3)
    for share in (1.0, 0.2, 0.02):
        v, q = rng.integers(-90, 90, (500, 70)).astype(np.float32), rng.integers(-90, 90, (40, 70)).astype(np.float32)
        scores = q.astype(int) @ v.T.astype(int)
        least = np.quantile(scores, 1 - share, axis=1)
        i, j, s = topk_search.tile_scores(q, topk_search.rest(q.astype(float)), np.ascontiguousarray(v.T), topk_search.rest(v.astype(float)), least)
        assert Counter(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == Counter((a, b, scores[a, b]) for a, b in np.argwhere(scores >= least[:, None]).tolist())


# ---- Merkle manifest ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def slow_tree(level):
    """Levels of a tree, leaves first."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def slow_manifest(rows):
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = slow_tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], Counter()
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            proof, now = [], leaf(r, text)
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    now = h(*run[: at % 3], now, *run[at % 3 + 1 :])
                    at //= 3
            out[r[0], own, trees[s][-1][0], root, h(*proof), now, now == root] += 1
    return out


def found_manifest(df, **more):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(df, **more).collect())


def test_manifest_on_odd_rows(spark, odd):
    assert found_manifest(odd) == slow_manifest(ODD)
    assert found_manifest(odd.limit(0)) == Counter()
    one = [(7, "a\nb", "en", "s", 3)]
    assert found_manifest(spark.createDataFrame(one, SCHEMA)) == slow_manifest(one)
    same = [(7, "a\nb", "en", None, 3)] * 40
    assert found_manifest(spark.createDataFrame(same, SCHEMA)) == slow_manifest(same)


@pytest.mark.parametrize("part_rows", [100_000, 3])
def test_manifest_against_plain_trees(spark, part_rows):
    """Sources that fill many partitions, sources of one row, and merges in more than one round."""
    rng = np.random.default_rng(4)
    rows = [(int(i), f"text\n{i}", "en", ["hot", f"s{i % 17:02}", None, f"u{i}"][int(rng.integers(4))] if i % 3 else "hot", i) for i in range(400)]
    assert found_manifest(spark.createDataFrame(rows, SCHEMA), part_rows=part_rows) == slow_manifest(rows)


def test_one_source_over_many_partitions(spark):
    rows = [(i, f"t{i}\n", "en", "s", i) for i in range(200)]
    assert found_manifest(spark.createDataFrame(rows, SCHEMA), part_rows=4) == slow_manifest(rows)


def test_forests_merge_in_any_grouping():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 4, 10, 27, 28, 50]
    leaves = [(t, i, hashlib.sha256(f"{t},{i}".encode()).digest(), n) for t, n in enumerate(sizes) for i in range(n)]
    roots = set()
    for _ in range(6):
        forests = []
        for part in np.array_split(rng.permutation(len(leaves)), 9):
            f = merkle.Forest(len(sizes))
            for k in part:
                t, i, v, n = leaves[k]
                f.put(t, 0, i, v, n)
            f.close()
            forests.append(f)
        while len(forests) > 1:
            i, j = sorted(rng.choice(len(forests), 2, replace=False))
            b = forests.pop(j)
            forests[i] = b.merge(forests[i]) if rng.random() < 0.5 else forests[i].merge(b)
        ((_, _, _, root, _),) = forests[0].rows()
        roots.add(root)
    want = slow_tree([slow_tree([v.hex() for t, _, v, _ in leaves if t == k])[-1][0] for k in range(len(sizes))])[-1][0]
    assert {r.hex() for r in roots} == {want}


# ---- filter audit ----


def slow_audit(rows, labels):
    texts = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            texts[r[1] or ""].append(r[0])
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for d, text, lang, _, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and min(texts[t]) < d}
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        mine, shapley = [x for x in docs if x[0] == part], Counter()
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                gone, left, before = [x for x in left if f in x[1]], [x for x in left if f not in x[1]], len(left)
                failing = [x for x in mine if f in x[1]]
                out[part, "".join(p), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[f] += len(gone)
                assert before == len(left) + len(gone)
        for (q, order, step), v in out.items():
            if q == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_on_odd_rows(spark, odd):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, 0, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1), (8, None, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.filter_audit(odd, marks).collect()
    want = slow_audit(ODD, labels)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in got} == want and len(got) == len(want)
    assert filter_audit.filter_audit(odd.limit(0), marks).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.filter_audit(odd, marks.limit(0)).collect())
