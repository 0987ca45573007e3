"""Invariants and small fixtures of operators that have no SQL form, and the reference's own assertions."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import clustering, evidence, graphs, merge, relational, similarity
from graphloom.session import table
from graphloom.sources import files, sinks


def test_keyset_pages_concatenate_to_the_full_order(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, f"2024-01-{1 + rng.randrange(9):02d}") for i in range(57)], "rid long, day string").withColumn("ts", F.to_timestamp("day"))
    full, seen, after = [(r.ts, r.rid) for r in df.orderBy(F.desc("ts"), F.desc("rid")).collect()], [], None
    while True:
        page = relational.keyset_page(df, "ts", "rid", 10, after).collect()
        seen += [(r.ts, r.rid) for r in page]
        if len(page) < 10:
            break
        after = (page[-1].ts, page[-1].rid)
    assert seen == full


def test_noisy_or_lies_between_the_best_evidence_and_one(spark):
    rows = [("a", 0.6), ("a", 0.8), ("b", 0.7), ("c", 1.0), ("c", 0.2)]
    got = {r.k: r.confidence for r in evidence.noisy_or(spark.createDataFrame(rows, "k string, c double"), ["k"], "c").collect()}
    assert abs(got["a"] - 0.92) < 1e-12 and abs(got["b"] - 0.7) < 1e-12 and got["c"] == 1.0


def test_merge_rules_on_nulls(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, 5)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "b", 7), (3, "c", None)], "id int, x string, y int")
    first = {tuple(r) for r in merge.merge_keep_first(old, new, ["id"]).collect()}
    last = {tuple(r) for r in merge.merge_keep_last(old, new, ["id"]).collect()}
    assert first == {(1, "a", 7), (2, None, 5), (3, "c", None)} and last == {(1, "b", 7), (2, None, 5), (3, "c", None)}


def test_greedy_groups_and_dbscan_do_not_follow_row_order(spark):
    ids = spark.range(12).withColumnRenamed("id", "id")
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (6, 7), (7, 8), (6, 8), (9, 10)]
    df = spark.createDataFrame(pairs, "a long, b long")
    one = {r.id: r.cluster for r in clustering.dbscan(ids, df, 3).collect()}
    two = {r.id: r.cluster for r in clustering.dbscan(ids.repartition(5), df.orderBy(F.desc("a")), 3).collect()}
    assert one == two and one[0] == one[4] == 0 and one[6] == one[8] == 6 and one[9] == -1 and one[11] == -1


def test_hull_of_a_grid(spark):
    rows = [("c", float(x), float(y)) for x in range(5) for y in range(4)]
    got = clustering.hull(spark.createDataFrame(rows, "cluster string, x double, y double"), "cluster").orderBy("corner").collect()
    assert [(r.x, r.y) for r in got] == [(0, 0), (4, 0), (4, 3), (0, 3)]


def test_lasso_and_box(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 0.5), (3, -0.1, 0.5)], "id int, x double, y double")
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert [r.id for r in df.where(clustering.inside(F.col("x"), F.col("y"), square)).collect()] == [1]
    assert [r.id for r in clustering.in_box(df, 0, 0, 1, 1).collect()] == [1]


def test_hamming_bands_lose_no_pair(spark):
    rng = random.Random(4)
    codes = ["".join(rng.choice("01") for _ in range(64)) for _ in range(20)]
    for c in codes[:10]:
        flips = set(rng.sample(range(64), rng.randrange(1, 9)))
        codes.append("".join("10"[int(b)] if k in flips else b for k, b in enumerate(c)))
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    got = {(r.a, r.b, r.distance) for r in similarity.hamming_pairs(df).collect()}
    distance = lambda x, y: sum(a != b for a, b in zip(x, y))
    assert got == {(i, j, distance(codes[i], codes[j])) for i in range(len(codes)) for j in range(i + 1, len(codes)) if distance(codes[i], codes[j]) <= 5}


def test_hamming_classes_and_pairs_give_every_link(spark):
    """Copies of codes included: links at distance 0, and those of ids that are not the smallest of a code."""
    rng = random.Random(9)
    codes = ["".join(rng.choice("01") for _ in range(64)) for _ in range(6)]
    codes += ["".join("10"[int(b)] if k < 3 else b for k, b in enumerate(c)) for c in codes[:3]]
    rows = list(enumerate(codes * 3)) + [(27, None), (28, None)]
    df = spark.createDataFrame(rows, "id long, code string")
    of = {r.id: r["class"] for r in similarity.code_classes(df).collect()}
    near = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(df).collect()}
    got = {(i, j): 0 if of[i] == of[j] else near.get((min(of[i], of[j]), max(of[i], of[j]))) for i in of for j in of if i < j}
    distance = lambda x, y: sum(a != b for a, b in zip(x, y))
    every = {(i, j): distance(x, y) for i, x in rows for j, y in rows if i < j and x and y and distance(x, y) <= 5}
    assert {k: v for k, v in got.items() if v is not None} == every and len(of) == len(rows)


def test_similar_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.5).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    assert got == {(i, j) for i, x in rows for j, y in rows if i < j and cos(x, y) >= 0.5}


def test_co_occurrence_of_a_large_group(spark):
    links = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(30)], "g long, i long")
    want = {(r.a, r.b, r.n) for r in graphs.co_occurrence(links, "g", "i").collect()}
    assert want == {(r.a, r.b, r.n) for r in graphs.co_occurrence(links, "g", "i", hot=7).collect()} and len(want) == 30 * 29 // 2


def test_requirement_library_and_sprint_assertions(spark):
    text = "| FR-10-01 | Login | high | ok |"
    row = spark.createDataFrame([(text, "fastapi==0.1\nuvicorn")], "t string, r string").select(
        files.requirement_rows(F.col("t"))[0]["id"].alias("id"), F.transform(files.requirements(F.col("r")), lambda x: x["library"]).alias("libs")
    ).first()
    assert row.id == "FR-10-01" and "fastapi" in row.libs


@pytest.mark.parametrize(("touched", "orphans", "missing", "score"), [(10, 0, 0, 100.0), (0, 0, 0, 0.0), (500, 200, 150, 22.5)])
def test_simple_quality_score(spark, touched, orphans, missing, score):
    df = spark.createDataFrame([(touched, orphans, missing)], "t int, o int, m int")
    value = F.when(F.col("t") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - F.least(F.lit(40.0), 0.5 * F.col("o")) - F.least(F.lit(40.0), 0.25 * F.col("m"))))
    assert df.select(value.alias("v")).first().v == score


def test_scalars(spark):
    row = spark.createDataFrame([("src/{a => b}/f", "Hello, World! 2", "python.org")], "p string, s string, n string").select(
        scalars.rename_target(F.col("p")).alias("p"), scalars.slugify(F.col("s")).alias("s"), scalars.uuid5_dns(F.col("n")).alias("u")
    ).first()
    assert row.p == "src/b/f" and row.s == "hello-world-2" and row.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org"))


def test_walk_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "in/node_modules").mkdir(parents=True)
    (tmp_path / "in/a.py").write_text("x = 1\n")
    (tmp_path / "in/node_modules/b.py").write_text("y")
    (tmp_path / "in/big.py").write_bytes(b"0" * (files.LARGEST + 1))
    walked = files.walk(spark, str(tmp_path / "in"), "*.py")
    assert [r.size for r in walked.collect()] == [6]
    sinks.snapshot(walked, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 1
    for kind in ("parquet", "csv", "json", "orc"):
        sinks.write(spark.range(3), str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", "true").load(str(tmp_path / kind)).count() == 3


def test_commit_log_files(spark, tmp_path):
    (tmp_path / "log.txt").write_text("abcdef1\tAnn\ta@x\t2024-01-01T00:00:00\tmsg\nA\tf.py\nnoise\nR90\tf.py\tg.py\n")
    rows = files.read_commit_log(spark, str(tmp_path / "log.txt")).collect()
    assert sorted((r.change_type, r.path, r.old_path) for r in rows) == [("A", "f.py", None), ("R", "g.py", "f.py")]


def test_read_only_queries(spark):
    from graphloom.plans import ad_hoc

    ad_hoc.register_views(spark, "/root/testdata/sf0.001")
    assert ad_hoc.read_only(spark, "SELECT count(*) AS n FROM touches; -- all").first().n > 0
    assert ad_hoc.read_only(spark, "WITH c AS (SELECT * FROM commits) SELECT hash FROM c", 5).count() == 5
    for text in ("DROP TABLE x", "CREATE TABLE y AS SELECT 1", "SELECT 1; DROP TABLE x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            ad_hoc.read_only(spark, text)


def test_blocks_of_distances(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, i % 3 - (i == 0) * 3 + (i == 0) * 2, [rng.random(), rng.random()]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, cluster long, vec array<double>")
    want = clustering.silhouette(df).first().silhouette, sorted(tuple(r) for r in clustering.nearest_distances(df, 5).collect())
    monkeypatch.setattr(clustering, "BLOCK", 9)
    got = clustering.silhouette(df).first().silhouette, sorted(tuple(r) for r in clustering.nearest_distances(df, 5).collect())
    assert abs(want[0] - got[0]) < 1e-12 and want[1] == got[1] and len(got[1]) == 50


def test_commit_mentions_fall_back_to_twelve_characters(spark):
    a, b = "0123456789ab" + "c" * 28, "fedcba987654" + "0" * 28
    mentions = [(1, a[:10]), (2, a[:12]), (3, a[:20]), (4, a[:12] + "dddd"), (5, a + "ffff"), (6, b[:12].upper() + "9"), (7, b[:11] + "9"), (8, b[:9]), (9, a[:10]), (9, a)]
    got = evidence.mentioned_commits(spark.createDataFrame(mentions, "chunk int, prefix string"), spark.createDataFrame([(a,), (b,)], "hash string"))
    assert {(r.chunk, r.hash, r.confidence) for r in got.collect()} == {
        (1, a, 0.75), (2, a, 0.9), (3, a, 0.9), (4, a, 0.9), (5, a, 0.9), (6, b, 0.9), (9, a, 0.9)
    }


def test_contained_takes_needles_of_any_length(spark):
    needles = ["ab", "x" * 41, "y" * 90, "", "zz", None]
    texts = ["ab", "cabab", "-" + "x" * 45, "y" * 90 + "ab", "", None, "z"]
    got = evidence.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), "needle", spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert sorted((r.needle, r.text) for r in got.collect()) == sorted((n, t) for n in needles if n for t in texts if t and n in t)


def test_whole_graph_queries_drop_and_merge_nothing(spark):
    from collections import Counter, defaultdict

    from graphloom.plans import graph

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    edges = {(4 * o + 1, 4 * p) for o, p, _ in rows} | {(4 * s + 2, 4 * p) for _, p, s in rows} | {(4 * o + 1, 4 * s + 2) for o, _, s in rows}
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    labels = {u: u for u in near}
    for _ in range(5):
        votes = {u: Counter(labels[v] for v in vs) for u, vs in near.items()}
        labels = {u: min(c, key=lambda x: (-c[x], x)) for u, c in votes.items()}
    assert {r.id: r.part for r in graph.QUERIES["communities"][0](spark, sf).collect()} == labels
    assert {r.id: r.degree for r in graph.QUERIES["degree_centrality"][0](spark, sf).collect()} == {u: len(vs) for u, vs in near.items()}
    density = graph.QUERIES["graph_density"][0](spark, sf).first()
    assert (density.n, density.m) == (len(near), len(edges))
    part = Counter()
    for u, vs in near.items():
        part[u % 10] += len(vs)
    m = len(edges)
    q = sum(a % 10 == b % 10 for a, b in edges) / m - sum((k / (2 * m)) ** 2 for k in part.values())
    assert graph.QUERIES["modularity"][0](spark, sf).first()[0] == pytest.approx(q, abs=1e-6)
    triangles = Counter()
    for a, b in edges:
        for c in set(near[a]) & set(near[b]):
            triangles[c] += 1
    assert {r.id: r.triangles for r in graph.QUERIES["triangle_counts"][0](spark, sf).collect()} == triangles


def test_commit_records_keep_message_bodies(spark, tmp_path):
    h = "0123456789abcdef0123456789abcdef01234567"
    (tmp_path / "log.txt").write_text(
        f"\x1e{h}\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00+00:00\x1fSubject\n\nBody line one\nline\ttwo\n\x1f\n\nA\tf.py\nR90\tf.py\tg.py\n"
        f"\x1e{h[:12]}\x1fshort\x1f\x1f\x1f\x1f\n\x1e{h[::-1]}\x1fBob\x1fb@x\x1fbad\x1fEmpty\x1f\n"
    )
    rows = sorted(files.read_commit_records(spark, str(tmp_path / "log.txt")).collect(), key=lambda r: (r.author, r.path or ""))
    assert [(r.author, r.subject, r.change_type, r.path, r.old_path) for r in rows] == [("Ann", "Subject", "A", "f.py", None), ("Ann", "Subject", "R", "g.py", "f.py"), ("Bob", "Empty", None, None, None)]
    assert rows[0].message == "Subject\n\nBody line one\nline\ttwo" and rows[2].ts is None


def test_approximate_search_has_recall(spark):
    import numpy as np

    from graphloom.operators import ann

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    data = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(24)).tolist()) for i in range(1500)] + [(9001, None), (9002, [0.0] * 24)]
    points = spark.createDataFrame(data, "id long, vec array<double>")
    index, cells = ann.build(points)
    assert index.count() == 1500
    found = {(r.query_id, r.id) for r in ann.search(index, cells, points.where("id % 100 = 0 and id < 9000"), k=10, probes=8).collect()}
    m = np.array([v for _, v in data[:1500]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    scores = m[::100] @ m.T
    scores[np.arange(15), np.arange(0, 1500, 100)] = -9
    want = {(int(q * 100), int(i)) for q in range(15) for i in np.argsort(-scores[q])[:10]}
    assert len(found) == 150 and len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [8192, 40])
def test_recall_on_the_given_vectors(spark, monkeypatch, block):
    """The whole embeddings table of sf0.1, each hundredth vector against brute force; also with cells in blocks."""
    import numpy as np

    from graphloom.operators import ann
    from graphloom.plans import extra

    monkeypatch.setattr(ann, "BLOCK", block)
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").select("vec_id", "embedding").collect() if r.embedding and any(r.embedding)]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    found = [(r.query_id, r.id, r.score) for r in extra.ann_search(spark, d).collect()]
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        scores = np.where(ids == ids[q], -9, m @ m[q])
        want |= {(int(ids[q]), int(ids[i])) for i in np.argsort(-scores)[:10]}
    assert len({(q, i) for q, i, _ in found} & want) >= 0.9 * len(want)
    at = {i: k for k, i in enumerate(ids.tolist())}
    assert all(abs(s - m[at[q]] @ m[at[i]]) < 1e-9 for q, i, s in found)


def test_batches_are_halved_until_they_fit(spark):
    rows = [(0, i, 10) for i in range(64)] + [(1, i, 1) for i in range(5)] + [(2, 0, 1000)]
    got = sinks.halved(spark.createDataFrame(rows, "grp int, k int, bytes int"), ["grp"], "k", "bytes", 100).collect()
    sizes = {}
    for r in got:
        sizes[(r.grp, r.part)] = sizes.get((r.grp, r.part), 0) + r.bytes
    assert len(got) == len(rows) and all(v <= 100 or g == 2 for (g, _), v in sizes.items()) and len([1 for g, _ in sizes if g == 0]) == 8


def test_ends_of_definitions_against_a_plain_reading(spark):
    from graphloom.functions import code

    rng = random.Random(2)
    python = ["class A:", "    def f(self):", "        x = 1", "", "        return x", "    y = 2", "def g():", "    pass", "z = 3", ""]
    for _ in range(60):
        python += [" " * rng.choice([0, 4, 8]) + rng.choice(["def f(a):", "class B(C):", "x = 1", "", "  # note"])]
    script = ["function f(a) {", "  if (x) {", "  }", "}", "g()", "class K", "{", "  put(a) { return {} }", "  get(b) {", "  }", "}", "function open(x) {", "function in(y) {", "}"]
    files = spark.createDataFrame([("a.py", "\n".join(python)), ("b.ts", "\n".join(script)), ("c.md", "def f():"), ("d.py", None), (None, "def f():"), ("e.py", "")], "path string, source string")
    got = {(r.path, r.first, r.until, r.kind, r.symbol) for r in code.definitions(code.line_table(files)).collect()}

    def end(k):  # quadratic: the next line that is not blank and no deeper
        indent = len(python[k]) - len(python[k].lstrip())
        return next((j for j in range(k + 1, len(python)) if python[j].strip() and len(python[j]) - len(python[j].lstrip()) <= indent), len(python))

    want = {("a.py", k, end(k), "class" if x.startswith("class") else "method" if x[0] == " " else "function", x.split()[1].split("(")[0].strip(":")) for k, x in enumerate(python) if x.strip().startswith("def") or x.startswith("class")}
    want |= {("b.ts", 0, 4, "function", "f"), ("b.ts", 5, 11, "class", "K"), ("b.ts", 7, 8, "method", "put"), ("b.ts", 8, 10, "method", "get"), ("b.ts", 11, 14, "function", "open"), ("b.ts", 12, 14, "function", "in")}
    assert got == want


def test_windows_cover_the_gaps(spark):
    from graphloom.functions import code

    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["some words of a line", "# rest", "", "def f(x):", "    return x"]) for _ in range(n)) for n in (1, 5, 41, 300)]
    files = spark.createDataFrame([(f"{k}.py", t) for k, t in enumerate(texts)], "path string, source string")
    spans = code.code_spans(files, least=1, window=10, overlap=4).collect()
    for k, t in enumerate(texts):
        lines, own = t.split("\n"), [r for r in spans if r.path == f"{k}.py"]
        defined = {i for r in own if r.kind != "window" for i in range(r.first, r.until)}
        seen = set()
        for r in own:
            assert r.text == "\n".join(lines[r.first : r.until])
            if r.kind == "window":
                assert r.until - r.first <= 10 and not defined & set(range(r.first, r.until))
                seen |= set(range(r.first, r.until))
        assert {i for i in range(len(lines)) if i not in defined and lines[i].strip()} <= seen


def test_photo_properties(spark):
    from graphloom.functions import photos

    raw = [
        (1, {"FNumber": "2.8", "FocalLength": "50", "ExposureTime": "0.005", "ExposureProgram": "3", "Flash": "16", "WhiteBalance": "7", "DateTimeOriginal": "2017:05:01 10:11:12.50", "Other": "x"}),
        (2, {"ApertureValue": "wide", "FocalLengthIn35mmFilm": "75mm", "ShutterSpeedValue": "1/200", "CreateDate": "2020-02-03T04:05:06+01:00", "Make": "", "CameraManufacturer": "Canon", "ISO": None}),
        (3, {"DateTime": "yesterday"}), (4, None),
    ]
    found = spark.createDataFrame(raw, "id int, raw map<string,string>").select("id", F.explode(photos.properties(F.col("raw"))).alias("key", "value")).collect()
    assert sorted(map(tuple, found)) == sorted([
        (1, "aperture", "f/2.8"), (1, "focal_length", "50mm"), (1, "shutter_speed", "0.00500s"), (1, "exposure_program", "Aperture Priority"), (1, "flash_fired", "False"), (1, "white_balance", "7"),
        (1, "date_taken", "2017-05-01 10:11:12"), (2, "aperture", "wide"), (2, "focal_length", "75mm"), (2, "shutter_speed", "1/200"), (2, "date_taken", "2020-02-03 04:05:06"), (2, "camera_make", "canon"),
    ])


def test_pca_and_choose_k(spark):
    import numpy as np

    from graphloom.plans import vector

    sf = "/root/testdata/sf0.001"
    flat = np.array([(r.x, r.y) for r in vector.pca_2d(spark, sf).collect()])
    m = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    top = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1][:2]
    assert np.allclose(np.var(flat, axis=0, ddof=1), top, rtol=1e-3)
    chosen = {r.k: r.silhouette for r in vector.kmeans_choose_k(spark, sf).collect()}
    assert sorted(chosen) == list(range(2, 11)) and all(-1 <= s <= 1 for s in chosen.values())


def test_watcher_sees_create_modify_and_delete(spark, tmp_path):
    import time

    from graphloom.streaming import events

    folder, base = tmp_path / "in", tmp_path / "base"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")

    def changes():
        if not (base / "events").exists() or not list((base / "events").glob("tick=*/_SUCCESS")):
            return set()
        rows = spark.read.schema("path string, change string, sha1 string, tick int").parquet(str(base / "events")).collect()
        return {(r.path.rsplit("/", 1)[-1], r.change) for r in rows}

    def wait_for(want):
        for _ in range(120):
            if want <= changes():
                return True
            time.sleep(0.5)
        return False

    query = events.watch(spark, str(folder), str(base))
    try:
        assert wait_for({("a.txt", "create"), ("b.txt", "create")})
        (folder / "a.txt").write_text("changed")
        (folder / "b.txt").unlink()
        (folder / "c.txt").write_text("new")
        assert wait_for({("a.txt", "modify"), ("b.txt", "delete"), ("c.txt", "create")})
    finally:
        query.stop()


def test_stream_batches_by_size_and_time(spark, tmp_path):
    from graphloom.session import table
    from graphloom.streaming import events

    sf = "/root/testdata/sf0.001"
    query = sinks.write_by_size_or_time(events.stream_of(spark, sf).select("event_id", F.lit(10).alias("bytes")), str(tmp_path / "out"), str(tmp_path / "log"), "bytes", 1000, 1)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("batch", "part").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in rows) == table(spark, sf, "events").count() and max(r.b for r in rows) <= 1000


def test_functions_in_sql(spark):
    from graphloom.functions import code
    from graphloom.plans import ad_hoc, extra

    ad_hoc.register_functions(spark)
    spark.createDataFrame([("a.py", extra.PYTHON), ("b.ts", extra.SCRIPT), ("c", None)], "path string, source string").createOrReplaceTempView("sources")
    got = ad_hoc.read_only(spark, "SELECT path, s.* FROM sources, LATERAL numbered_lines(source) s").collect()
    want = code.line_table(spark.table("sources").where("source IS NOT NULL")).select("path", F.col("k") + 1, "line").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and got
    row = ad_hoc.read_only(spark, "SELECT d.* FROM (SELECT decode_any(X'E9742E') AS d)").first()
    assert row.text == "ét." and row.encoding == "cp1252" and row.replaced == 0


def test_renames_keep_the_first_commit(spark):
    rows = [("h1", "R", "b", "a", 2), ("h0", "R", "b", "a", 1), ("h2", "M", "b", "a", 0), ("h3", "R", "c", "c", 0), ("h4", "R", "d", None, 0)]
    got = evidence.renames(spark.createDataFrame(rows, "hash string, change_type string, path string, old_path string, ts int")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "h0", 1)]
