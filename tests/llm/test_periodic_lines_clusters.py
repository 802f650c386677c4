"""Periodic runs, line removal and centroid clustering against brute-force versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lines, periodic, queries, vafile

SCHEMA = "doc_id long, text string, print string, keep int, h1 int, runs string, range int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in rows], SCHEMA).repartition(parts)


# --- periodic runs -----------------------------------------------------------------


def runs_by_hand(w, least=6, times=4):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                piece = w[i : i + length]
                smallest = next(p for p in range(1, q + 1) if all(piece[x] == piece[x + p] for x in range(length - p)))
                if smallest == q:
                    found.add((i, length, q))
            i = j + 1 if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(draw, alphabet, n):
    words = []
    while len(words) < n:
        unit = [draw.choice(alphabet) for _ in range(draw.randint(1, 7))]
        words += unit * draw.choice([1, 1, 3, 4, 5, 9]) + unit[: draw.randint(0, len(unit))]
    return words[:n]


def texts(seed=5):
    draw = random.Random(seed)
    pieces = [some_words(draw, ["a", "b", "é", "漢字", "A b", "x\x1cy"][: draw.randint(1, 6)], draw.randint(0, 150)) for _ in range(60)]
    out = [(i, draw.choice([" ", "\n", " \t\r\n"]).join(w)) for i, w in enumerate(pieces)]
    return out + [(100, None), (101, ""), (102, " \n "), (None, "a " * 9), (7, out[7][1]), (None, None)]


def split_ascii(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_and_collapse(spark):
    rows = texts()
    got = sorted(map(repr, ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(frame(spark, rows)).collect())))
    want = []
    for i, text in rows:
        w = split_ascii(text)
        runs = runs_by_hand(w)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(map(repr, want))
    assert periodic.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_other_thresholds_and_long_texts(spark):
    draw = random.Random(8)
    for least, times in ((3, 3), (10, 5)):
        for _ in range(200):
            w = some_words(draw, "ab", draw.randint(0, 80))
            runs = periodic._found([[x.encode() for x in w]], least, times)[1].to_pylist()[0]
            assert [(r["start"], r["length"], r["period"]) for r in runs] == runs_by_hand(w, least, times)
    cycle = " ".join(f"w{i}" for i in range(1000))
    rows = [(1, " ".join([cycle] * 1000)), (2, "a" * 1_000_000), (3, "a " * 1_000_000)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert got == {1: [(0, 1_000_000, 1000)], 2: [], 3: [(0, 1_000_000, 1)]}
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, rows), times=2)


def test_query_of_runs(spark, tmp_path):
    rows = [(i, t) for i, t in texts(9) if i is not None] + [(None, "b " * 40)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_words"]): r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        w = split_ascii(text)
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = runs_by_hand(w)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] * math.prod(x[2] for x in runs) // r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[i, n]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted >= 4


# --- lines ----------------------------------------------------------------------------


def kept_by_hand(rows, least=10):
    fold = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda line: line.strip(lines.SPACES).translate(fold)
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    first, last = {}, float("inf")
    for i, its in cut:
        for line in its:
            first[key(line)] = min(first.get(key(line), last), last if i is None else i)
    out = []
    for i, its in cut:
        stay = [x for x in its if len(key(x)) < least or first[key(x)] == (last if i is None else i)]
        out.append((i, len(its), len(its) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def line_rows():
    draw = random.Random(4)
    pool = ["The same long line", "  the SAME long line\t", "short", "", "ÉÀ ten letters", "éà ten letters", "exactly10!", "\r9 letters", "漢字漢字漢字漢字漢字", "İstanbul ABCDEFG"]
    pool += [f"line number {i}" for i in range(60)]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 200)))) for i in range(50)]
    long = "\n".join(draw.choice(pool + [f"only here {i}"]) for i in range(20_000))
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, rows[3][1]), (None, "line number 1\nof no id at all"), (None, "of no id at all")]
    return rows + [(63, long), (9, rows[9][1]), (9, rows[10][1]), (5, "x" * 1_000_000), (6, "x" * 1_000_000)]


@pytest.mark.parametrize("seen", [20, 10**9])
def test_lines(spark, monkeypatch, seen):
    """Results are the same whether crowded lines are dealt over slices or not."""
    monkeypatch.setattr(lines, "LEAST_SEEN", seen)
    monkeypatch.setattr(lines, "RANGE_BYTES", 1 << 14)
    rows = line_rows()
    docs = frame(spark, rows)
    hot, _ = lines.crowded(docs.select("doc_id", "text"), 10)
    assert (hot.count() > 0) == (seen == 20)
    bitmaps = lines.keep_bitmaps(docs)
    got = lines.kept_texts(docs, bitmaps).collect()
    assert sorted(repr(tuple(r)) for r in got) == kept_by_hand(rows)
    assert bitmaps.agg(F.min("n_dropped")).first()[0] >= 1


def test_lines_of_nothing(spark):
    none = frame(spark, []).limit(0)
    assert lines.kept_texts(none, lines.keep_bitmaps(none)).count() == 0
    rows = [(None, None), (None, None), (1, None)]
    docs = frame(spark, rows)
    assert sorted(repr(tuple(r)) for r in lines.kept_texts(docs, lines.keep_bitmaps(docs)).collect()) == kept_by_hand(rows)


def test_sparse_bitmaps_leave_out_words_that_stay(spark):
    text = "\n".join(["another long line"] * 70 + [f"line number {i}" for i in range(300)] + ["another long line"])
    docs = frame(spark, [(1, "another long line"), (2, text)])
    found = lines.keep_bitmaps(docs).collect()
    assert [(r["doc_id"], r["n_dropped"], [e["word"] for e in r["keep"]]) for r in found] == [(2, 71, [0, 1, 5])]


# --- clusters ---------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))
    centroids = [v for _, v in ordered[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(map(repr, ((i, nearest(v)[1], nearest(v)[0]) for i, v in kept))), centroids


@pytest.mark.parametrize(("dim", "k"), [(64, 16), (5, 7), (4, 30)])
def test_clusters(spark, dim, k):
    draw = random.Random(dim)
    centre = [[draw.uniform(-2, 2) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in draw.choice(centre)]) for i in range(200)]
    rows += [(300, None), (301, []), (302, [1.0] * (dim + 1)), (303, [None] + [1.0] * (dim - 1)), (304, [float("nan")] * dim), (305, [float("-inf")] * dim)]
    rows += [(306, [0.0] * dim), (307, [0.0] * dim), (None, rows[0][1]), (None, rows[1][1]), rows[2], (308, [-1000.0] * dim)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, vector double").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vafile.clustered(table, order, k=k, rounds=3, dim=dim, scale=64)
    want, centroids = clusters_by_hand(rows, k, 3, dim, 64)
    assert found.centroids.tolist() == centroids
    got = vafile.with_inertia(found).collect()
    assert sorted(repr((r["vec_id"], r["cluster"], r["distance"])) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for r in got:
        assert r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"])
    assert 0 < sum(r["by_cells"] for r in got) < len(got)


def test_clusters_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    order = F.col("vec_id")
    assert vafile.clustered(spark.createDataFrame([], kind), order, dim=2) is None
    assert vafile.clustered(spark.createDataFrame([(1, None), (2, [1.0])], kind), order, dim=2) is None
    found = vafile.clustered(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind), order, dim=2)
    assert [tuple(r) for r in found.assigned.orderBy("vec_id").collect()] == [(1, 0, 0, False), (2, 0, 0, False)]
    with pytest.raises(Exception, match="64 bits"):
        vafile.clustered(spark.createDataFrame([(1, [1e30, 2.0])], kind), order, dim=2)
