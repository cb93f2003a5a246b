"""Operators on small inputs with answers worked out by hand, and invariances."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixweave.functions import edges as edge_functions
from matrixweave.functions import scale
from matrixweave.operators import cluster, geometry, graph, patches, skeleton, spatial, stats, structures, thresholds
from matrixweave.plans.scratch import written
from matrixweave.sources import images, sinks, tables


def points(spark, xy, sample=0):
    return spark.createDataFrame([(sample, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id int, id long, x double, y double")


def edges(spark, pairs, **more):
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "sample_id int, src long, dst long")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_contact(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(3)], "sample_id int, id long")
    got = {r.id: (r.ecm_degree, r.ecm_contact) for r in graph.contact(nodes, edges(spark, [(0, 10), (2, 10), (2, 11)])).collect()}
    assert got == {0: (1, 1), 1: (0, 0), 2: (2, 1)}
    got = {r.id: r.ecm_contact for r in graph.contact(nodes, edges(spark, [(0, 10), (2, 10), (2, 11)]), threshold=1).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_smoothing_keeps_nulls_and_moves_others(spark):
    signal = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (0, 2, None), (0, 3, float("nan"))], "sample_id int, id long, value double")
    got = {r.id: r.value for r in graph.smooth(signal, edges(spark, [(0, 1), (1, 2), (2, 3)], weight=1.0), alpha=1.0, steps=1).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: None, 3: None}


def test_transfer(spark):
    source = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, 3.0), (0, 2, 4.0, 0.0, 5.0), (0, 3, 4.2, 0.0, None)], "sample_id int, id long, x double, y double, value double")
    target = points(spark, [(0.5, 0), (4.1, 0), (10, 0)])
    got = {r.id: (r.n_sources, r.sum, r.max) for r in spatial.transfer(source, target, 0.6).collect()}
    assert got == {0: (2, 4.0, 3.0), 1: (2, 5.0, 5.0), 2: (0, None, None)}
    near = {r.id: (r.nearest, r.n_sources) for r in spatial.transfer_nearest(source.where("id < 2"), target, cap=0.75).collect()}
    assert near == {0: (1.0, 1), 1: (None, 0), 2: (None, 0)}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_nearest_against_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    xy = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(50, 0.01, (20, 2)), [[1000.0, -3.0]], [[5.0, 5.0]] * 4])
    got = {}
    p = points(spark, xy.tolist())
    for r in spatial.nearest(p, p, k, own=True).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:k]
        assert [j for _, j in sorted(got[i])] == want


def test_lattice_degrees_and_hole(spark):
    at = [(y, x) for y in range(5) for x in range(5) if (y, x) != (2, 2)]
    df = spark.createDataFrame([(0, i, y, x) for i, (y, x) in enumerate(at)], "sample_id int, patch_id long, grid_y int, grid_x int")
    for connectivity, inner in ((8, 7), (4, 4)):
        deg = {r.id: r.degree for r in graph.degrees(df.withColumnRenamed("patch_id", "id"), spatial.grid_edges(df, connectivity)).collect()}
        assert deg[at.index((1, 1))] == inner
    pairs = {(r.src, r.dst) for r in spatial.grid_edges(df, 4).collect()}
    assert (at.index((2, 1)), at.index((2, 3))) not in pairs


def test_composition_rows_add_up(spark):
    rows = [("r1", c) for c in (0, 0, 1, 1, 2, -1, -1)] + [("r2", c) for c in (0, 1, 1, 2, 2)] + [("r3", c) for c in (0, 0, 1, 2)] + [("r4", -1), ("r1", None)]
    df = spark.createDataFrame(rows, "sample_id string, label int")
    groups = spark.createDataFrame([("r1", "A"), ("r2", "B"), ("r3", "A"), ("r4", "B")], "sample_id string, grp string")
    shares, means = stats.composition(df, groups)
    total = {r.sample_id: r.t for r in shares.groupBy("sample_id").agg(F.sum("share").alias("t")).collect()}
    assert total == pytest.approx({"r1": 1, "r2": 1, "r3": 1, "r4": 0})
    got = {(r.grp, r.label): r.share for r in means.collect()}
    assert got["A", 0] == pytest.approx((2 / 5 + 2 / 4) / 2)


def test_planted_enrichment(spark):
    cells = spark.createDataFrame([(0, i, "AEC" if i < 15 else "OTHER") for i in range(30)], "sample_id int, cell_id long, cell_type string")
    labels = spark.createDataFrame([(0, 100 + i, (i % 3) if i < 30 else -1) for i in range(31)], "sample_id int, id long, label int")
    rng = np.random.default_rng(0)
    pairs = [(i, 100 + 1 + 3 * int(j)) for i in range(15) for j in rng.choice(10, 4, replace=False)] + [(i, 100 + int(j)) for i in range(15, 30) for j in rng.choice(30, 4, replace=False)] + [(0, 130)]
    cross = edges(spark, pairs)
    rows = {(r.cell_type, r.cluster): r for r in stats.enrichment(cells, labels, cross, 3, 49, 1).collect()}
    assert rows["AEC", 1].observed == 60 and rows["AEC", 1].log2 > 0
    assert rows["AEC", 1].p == pytest.approx(1 / 50)
    assert sum(rows[t, c].observed for t, c in rows if t == "AEC") == 60
    again = {(r.cell_type, r.cluster): r.p for r in stats.enrichment(cells.repartition(7), labels, cross.repartition(3), 3, 49, 1).collect()}
    assert again == {k: r.p for k, r in rows.items()}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, None]
    got = {r.i: r.p_fdr for r in scale.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    assert got[5] is None
    assert [got[i] for i in range(5)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


def test_benjamini_hochberg_by_ranges(spark):
    rng = np.random.default_rng(4)
    p = [*np.round(rng.random(3000) ** 3, 4).tolist(), *[0.25] * 1500, None, None, 0.0, 1.0]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got, want = ({r.i: r.p_fdr for r in f(df, "p").collect()} for f in (scale.benjamini_hochberg_ranged, scale.benjamini_hochberg))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(p) and got[4500] is None and got == pytest.approx(want)
    order = sorted(x for x in p if x is not None)
    low, plain = 1.0, {}
    for k in range(len(order), 0, -1):
        low = min(low, order[k - 1] * len(order) / k)
        plain[order[k - 1]] = low
    assert all(got[i] == pytest.approx(plain[x]) for i, x in enumerate(p) if x is not None)
    assert scale.benjamini_hochberg_ranged(df.limit(0), "p").count() == 0
    assert [r.p_fdr for r in scale.benjamini_hochberg_ranged(df.where("p IS NULL"), "p").collect()] == [None, None]


def test_ranges_are_in_order(spark):
    from matrixweave.plans import ranges

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(2).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = ranges.in_ranges(df, "k", "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounds = dealt.groupBy("_part").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_part").collect()
    assert len(bounds) > 1 and all(x.b < y.a for x, y in zip(bounds, bounds[1:]))
    summed = ranges.with_running_sums(dealt, "k", s=F.col("n")).collect()
    assert all(r.s == 2 * (r.k + 1) and r.s_all == 10000 for r in summed)


def test_partition_scores(spark):
    of = lambda a, b: stats.partition_scores(spark.createDataFrame(list(zip(a, b)), "label int, truth int")).first()
    truth = [0, 0, 0, 0, 1, 1]
    assert of([5, 5, 6, 6, 7, 7], truth).macro_f1 == pytest.approx(1)
    assert of([9, 9, 9, 9, 3, 3], truth).ari == pytest.approx(1)
    assert of([0] * 6, truth).macro_f1 < 0.5


def test_representatives(spark):
    df = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", 3.0), ("a", "s3", 2.0), ("a", "s4", None), ("b", "s5", 0.1)], "grp string, sample_id string, score double")
    pick = lambda *a: {r.grp: r.sample_id for r in stats.representatives(df, *a).collect()}
    assert pick("median") == {"a": "s3", "b": "s5"}
    assert pick("max")["a"] == "s2" and pick("min")["a"] == "s4" and pick("first")["a"] == "s1"
    assert pick("min", 1.5) == {"a": "s3", "b": "s5"}


def test_curves(spark):
    df = spark.createDataFrame([("f", s, t) for s, t in ((0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0))] + [("g", 0.5, 1)], "sample_id string, score double, label int")
    got = {r.sample_id: (r.roc_auc, r.average_precision) for r in stats.curve_areas(df).collect()}
    assert got["f"] == pytest.approx((4.5 / 6, 0.5 + 0.25))
    assert got["g"] == (None, None)
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 0.5, 1.0), ("b", 1.0, 1.0)], "sample_id string, x double, y double")
    mean = {round(r.x, 2): r.y for r in stats.mean_curve(curve, 5).collect()}
    assert mean == pytest.approx({0: 0, 0.25: 0.375, 0.5: 0.75, 0.75: 0.875, 1: 1})


def test_components_and_cores(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (5, 6)]
    nodes = spark.createDataFrame([(0, i) for i in range(8)], "sample_id int, id long")
    got = {r.id: r.component for r in graph.components(nodes, edges(spark, pairs)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    cores = {r.id: r.core for r in graph.core_numbers(nodes, edges(spark, pairs)).collect()}
    assert cores == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}
    row = graph.topology(nodes.where("id < 4"), edges(spark, pairs[:4], d=1.0)).first()
    assert row.transitivity == pytest.approx(3 / 5) and row.clustering == pytest.approx((1 + 1 + 1 / 3) / 4)


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(80, 2))
    t = geometry.triangulate(p)
    circles = geometry._circles(p, t)
    for (x, y, r2), tri in zip(circles, t):
        inside = ((p - [x, y]) ** 2).sum(axis=1) < r2 * (1 - 1e-9)
        inside[tri] = False
        assert not inside.any()
    h = len(geometry.hull(p))
    assert len(t) == 2 * len(p) - 2 - h
    assert len(geometry.triangle_edges(t)) == 3 * len(p) - 3 - h
    assert len(geometry.triangulate(np.array([[0, 0], [1, 1], [2, 2.0]]))) == 0


def test_void_of_a_ring():
    angle = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    ring = lambda r: np.column_stack([np.cos(angle), np.sin(angle)]) * r
    doughnut = np.vstack([ring(10), ring(12), ring(14)])
    assert geometry.void_area(doughnut, 9.0) == pytest.approx(np.pi * 100, rel=0.05)
    grid = np.array([(x, y) for x in range(6) for y in range(6)], float)
    assert geometry.void_area(grid + np.random.default_rng(0).normal(0, 0.01, grid.shape), 9.0) == 0


def test_path_measures(spark):
    nodes = spark.createDataFrame([(0, i, 0) for i in range(5)], "sample_id int, id long, component long")
    row = geometry.path_measures(nodes, edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])).first()
    assert row.diameter == 4 and row.mean_path == pytest.approx(2.0)
    assert row.betweenness == pytest.approx((0 + 3 + 4 + 3 + 0) / 6 / 5)
    assert row.fiedler == pytest.approx(2 - 2 * np.cos(np.pi / 5))


def test_two_means_and_thresholds(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(10, 1, 300), rng.normal(30, 1, 300), np.zeros(50)])
    df = spark.createDataFrame([(0, 0, i, 0, float(x)) for i, x in enumerate(v)], "sample_id int, channel int, y int, x int, v double")
    assert patches.two_means(df).first()[0] == pytest.approx(20, abs=0.5)
    assert patches.two_means(df.where("v = 0")).first()[0] == float("inf")
    own = np.sort(v[v > 0])
    cut = min(range(1, len(own)), key=lambda k: own[:k].var() * k + own[k:].var() * (len(own) - k))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        assert patches.two_means(df).first()[0] == pytest.approx((own[:cut].mean() + own[cut:].mean()) / 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for method in ("otsu", "li", "yen"):
        assert 11 < thresholds.thresholds(df, method).first().threshold < 29
    assert thresholds.thresholds(df.limit(5)).count() == 0


def test_thinning():
    m = np.zeros((1, 9, 9), bool)
    m[0, 3:6, 1:8] = True
    bone = skeleton.thin(m)[0]
    assert bone.sum() < m.sum() / 2 and bone[4].sum() >= 3
    assert not skeleton.thin(np.zeros((2, 4, 4), bool)).any()


def test_clusters_find_blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, *map(float, rng.normal(20 * (i % 2), 1, 2)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_id int, id long, a double, b double, t int")
    got = cluster.kmeans(df, ["a", "b"], 2)
    assert stats.partition_scores(got.select(F.col("cluster").alias("label"), F.col("t").alias("truth"))).first().ari == pytest.approx(1)
    assert cluster.silhouette(got, "id").first()[0] > 0.8
    best = cluster.select_k(df, ["a", "b"], "id", range(2, 4), 2).where("best").first()
    assert best.k == 2 and best.stability == pytest.approx(1)


def test_structures(spark):
    xy = [(i % 5, i // 5) for i in range(10)] + [(100 + i, 100) for i in range(6)] + [(500, 500)]
    df = points(spark, xy)
    got = {r.id: r.uid for r in structures.split(df, "islet", 2.0, 5).collect()}
    assert got[0] == "0_islet00" and got[12] == "0_islet01" and got[16] is None
    assert structures.marker_columns(["m_CD20", "m_Col"], ["cd20"]) == ["m_CD20"]
    with pytest.raises(KeyError):
        structures.marker_columns(["a"], ["b"])


def test_edge_functions():
    with pytest.raises(KeyError):
        edge_functions.features(["nothing"])
    with pytest.raises(ValueError):
        edge_functions.weight("nothing")


def test_tables(spark):
    df = spark.createDataFrame([("CD20 ", 0, 1), ("FN", 1, 1), ("X", 1, 0)], "` name` string, ecm int, keep int")
    rows = tables.panel(df).collect()
    assert [(r.name, r.is_ecm) for r in rows] == [("CD20", False), ("FN", True)]
    with pytest.raises(ValueError):
        tables.sample_groups(spark.createDataFrame([("s", "a"), ("s", "b")], "sample_id string, g string"), "g")
    flags = spark.createDataFrame([("True",), ("0",), (None,)], "f string").select(tables.flag(F.col("f")).alias("f")).collect()
    assert [r.f for r in flags] == [True, False, None]
    with pytest.raises(Exception, match="not a flag"):
        spark.createDataFrame([("maybe",)], "f string").select(tables.flag(F.col("f"))).collect()
    genes = tables.genes(spark.createDataFrame([("col1a1", "Collagens", "Core"), ("NaN", "x", "y"), (None, "x", "y")], "`Gene Symbol` string, `Matrisome Category` string, `Matrisome Division` string"))
    assert [r.symbol for r in genes.collect()] == ["COL1A1"]


def tiff(image):
    import struct

    out, pages = b"II*\0" + struct.pack("<I", 8), []
    at = 8
    for page in image:
        raw = page.astype("<u2").tobytes()
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, at + 2 + 12 * 8 + 4), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(raw))]
        size = 2 + 12 * 8 + 4 + len(raw)
        pages.append((tags, raw, at + size))
        at += size
    for i, (tags, raw, after) in enumerate(pages):
        out += struct.pack("<H", 8) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in tags)
        out += struct.pack("<I", after if i + 1 < len(pages) else 0) + raw
    return out


def test_images(spark, tmp_path):
    import io
    import struct
    import zlib

    rng = np.random.default_rng(4)
    image = rng.integers(0, 60000, (3, 40, 30))
    assert (images.decode(tiff(image)) == image).all()
    grey = rng.integers(0, 255, (20, 25)).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    up = np.vstack([grey[:1], np.diff(grey.astype(int), axis=0) & 255]).astype(np.uint8)
    lines = b"".join(bytes([0 if y == 0 else 2]) + up[y].tobytes() for y in range(20))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 25, 20, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode(png)[0] == grey).all()
    assert (images.decode(b"P5\n25 20\n255\n" + grey.tobytes())[0] == grey).all()
    buffer = io.BytesIO()
    np.save(buffer, image)
    assert (images.decode(buffer.getvalue()) == image).all()
    with pytest.raises(ValueError):
        images.decode(b"nothing")
    (tmp_path / "a_Yb1_x.tiff").write_bytes(tiff(image))
    got = images.pixels(images.read_tiles(spark, str(tmp_path), 16), 16)
    assert got.count() == image.size
    assert {(r.channel, r.y, r.x): r.v for r in got.collect()}[2, 39, 29] == image[2, 39, 29]
    panel = spark.createDataFrame([(0, "A", "Yb1")], "pos int, name string, channel string")
    files = got.select("path").distinct()
    assert images.channel_files(files, panel).count() == 1
    with pytest.raises(FileNotFoundError):
        images.channel_files(files, panel.withColumn("channel", F.lit("Yb9"))).count()


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(0, 5), (0, 9), (1, 5)], "sample_id int, id long")
    n, e = sinks.graph_tables(nodes, edges(spark, [(5, 9)]))
    assert {(r.sample_id, r.id): r.node for r in n.collect()} == {(0, 5): 0, (0, 9): 1, (1, 5): 0}
    assert {(r.source, r.target) for r in e.collect()} == {(0, 1), (1, 0)}
    with pytest.raises(ValueError):
        sinks.graph_tables(nodes.withColumn("y", F.col("id")), edges(spark, [(5, 9)]), "y")


def test_overlay_guards_its_reference(spark):
    own = spark.createDataFrame([(0, i, 1) for i in range(10)], "sample_id int, patch_id long, ecm_cluster int")
    over = spark.createDataFrame([(i, i == 3, 2, 1) for i in range(10)], "patch_id long, is_artifact boolean, replacement int, reference int")
    assert {r.patch_id: r.label for r in patches.apply_overlay(own, over).collect()} == {i: 2 if i == 3 else 1 for i in range(10)}
    with pytest.raises(Exception, match="differ from the overlay"):
        patches.apply_overlay(own, over.withColumn("reference", F.lit(7))).collect()


def test_streaming(spark, tmp_path):
    from matrixweave.streaming.samples import stream_compositions

    spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "sample_id int, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_compositions(spark, str(tmp_path / "in"), "sample_id int, label int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.sample_id, r.label): r.share for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 1.0}


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(5)
    df = points(spark, rng.normal(size=(50, 2)).tolist())
    a = {tuple(r) for r in spatial.knn_edges(df, 3).collect()}
    b = {tuple(r) for r in spatial.knn_edges(df.orderBy(F.desc("id")).repartition(5), 3).collect()}
    assert a == b


def test_network_gradients():
    from matrixweave.operators.nn import Means, Network

    rng = np.random.default_rng(6)
    x, means, net = rng.normal(size=(7, 3)), Means(7, np.array([0, 1, 2, 2, 5]), np.array([1, 0, 3, 4, 6])), Network(3, 2, 4, seed=1)
    weight = rng.normal(size=(7, 2))
    loss = lambda: float((net.forward(x, means)[0] * weight).sum())
    grads, into = net.backward(weight, net.forward(x, means)[1], means)
    for name in ("W", "A0", "B1", "c0", "O"):
        at = tuple(0 for _ in net.p[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-6
        up = loss()
        net.p[name][at] = before - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(grads[name][at], rel=1e-4, abs=1e-6)
        net.p[name][at] = before
    x[2, 1] += 1e-6
    up = loss()
    x[2, 1] -= 2e-6
    assert (up - loss()) / 2e-6 == pytest.approx(into[2, 1], rel=1e-4, abs=1e-6)


def test_classifier_learns_held_out_graphs(spark):
    from matrixweave.operators import nn

    rng = np.random.default_rng(7)
    nodes, pairs = [], []
    for g in range(8):
        for i in range(20):
            c = int(rng.random() < (0.9 if g % 2 else 0.1))
            nodes.append((g, i, g % 2, [float(c), 1.0 - c]))
            pairs.append((g, i, (i + 1) % 20))
    df = spark.createDataFrame(nodes, "graph long, node long, label long, x array<double>")
    folds = spark.createDataFrame([(g, g // 4) for g in range(8)], "graph long, fold int")
    edges_ = spark.createDataFrame(pairs, "graph long, src long, dst long")
    got = {r.graph: r.predicted for r in nn.predictions(nn.classify(df, edges_, folds, epochs=60)).collect()}
    assert got == {g: g % 2 for g in range(8)}
    size = {(r["class"], r.feature): r.a for r in nn.importance(df, edges_, folds, 10, 60).groupBy("class", "feature").agg(F.avg(F.abs("attribution")).alias("a")).collect()}
    assert len(size) == 4 and min(size.values()) > 0
    z = nn.encode_masked(df.select(F.col("graph").alias("sample_id"), "node", "x"), edges_.withColumnRenamed("graph", "sample_id"), 4, epochs=5)
    assert z.count() == 160


def test_communities(spark):
    from matrixweave.operators.communities import communities

    clique = lambda a: [(a + i, a + j) for i in range(5) for j in range(i + 1, 5)]
    got = {r.id: r.community for r in communities(edges(spark, clique(0) + clique(10) + [(4, 10)])).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_ridges_and_segments(spark):
    from matrixweave.operators import filters

    image = np.zeros((40, 40))
    image[20] = 10
    for method in ("sato", "frangi"):
        v = filters.ridges(image, (2,), method)
        assert v[20, 20] > 5 * v[10, 20]
    y, x = np.mgrid[:40, :40]
    v = np.where((y - 10) ** 2 + (x - 10) ** 2 < 16, 9.0, 1.0) + np.where((y - 30) ** 2 + (x - 28) ** 2 < 9, 9.0, 0)
    df = spark.createDataFrame([(0, 0, int(a), int(b), float(v[a, b])) for a in range(40) for b in range(40)], "sample_id int, channel int, y int, x int, v double")
    got = {r.label: r["count"] for r in filters.segment(df).groupBy("label").count().collect()}
    assert got == {1: int(((y - 10) ** 2 + (x - 10) ** 2 < 16).sum()), 2: int(((y - 30) ** 2 + (x - 28) ** 2 < 9).sum())}
    whole = {(r.y, r.x): r.v for r in filters.ridge_filter(df, (1,), tile=64).collect()}
    tiled = {(r.y, r.x): r.v for r in filters.ridge_filter(df, (1,), tile=16).collect()}
    assert whole.keys() == tiled.keys() and all(whole[k] == pytest.approx(tiled[k], abs=1e-6) for k in whole if 5 < k[0] < 34 and 5 < k[1] < 34)


def test_patch_encoder(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from matrixweave.operators.nn import PatchEncoder

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=9)]) for i in range(30)], "id long, v array<double>").select("id", array_to_vector("v").alias("pixels"))
    encoder = PatchEncoder(3).fit(df)
    encoder.save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="exists"):
        encoder.save(str(tmp_path / "m"))
    a, b = ({r.id: r.latent for r in e.transform(df).collect()} for e in (encoder, PatchEncoder.load(str(tmp_path / "m"))))
    assert a == b and len(a[0]) == 3


@pytest.fixture(scope="module")
def two_samples(spark):
    """Two samples whose ids both count from 0, and the same rows with unique ids: 15 cells of a planted type and 15 others, 30 patches in three clusters."""
    def tables(step):
        cells, patches, cross = [], [], []
        for s in range(2):
            cells += [(s, c + step * s, "planted" if c < 15 else "other", float(c), float(s)) for c in range(30)]
            patches += [(s, p + step * s, p // 10, float(p), 0.0) for p in range(30)]
            for c in range(30):
                near = [10 + (c + k) % 10 for k in range(4)] if c < 15 else [(c * 4 + k * 7 + s) % 30 for k in range(4)]
                cross += [(s, c + step * s, p + step * s) for p in near]
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        return make(cells, "sample_id int, cell_id long, cell_type string, x double, y double"), make(patches, "sample_id int, id long, label int, x double, y double"), make(cross, "sample_id int, src long, dst long")

    return tables(0), tables(1000)


def test_ids_that_repeat_across_samples(two_samples):
    from matrixweave.operators import denoise, stats, structures

    out = []
    for step, (cells, patches, cross) in zip((0, 1000), two_samples):
        labels = patches.select("sample_id", "id", "label")
        lattice = patches.select("sample_id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 10 < 9")
        own = F.col("id") - step * F.col("sample_id")
        uid = cells.where("cell_type = 'planted'").select("sample_id", F.col("cell_id").alias("id"), F.col("sample_id").cast("string").alias("uid"), "x", "y")
        found = [
            stats.interactions(cells, labels, cross),
            stats.enrichment(cells, labels, cross, 3),
            stats.niche(cells, patches.select("sample_id", F.col("id").alias("patch_id"), F.col("label").alias("ecm_cluster"), "x", "y"), cross, "planted", 1, ["x", "y"]),
            denoise.features(labels, cells, cross, lattice, ["other", "planted"], 3).withColumn("id", own),
            structures.linked_patches(uid, cross, patches).withColumn("id", own),
        ]
        out.append([sorted(map(str, map(tuple, f.select(sorted(f.columns)).collect()))) for f in found])
    assert out[0] == out[1]
    assert sum(r.n for r in stats.interactions(*[two_samples[0][0], two_samples[0][1].select("sample_id", "id", "label"), two_samples[0][2]]).collect()) == 240


def test_planted_enrichment_is_found(two_samples):
    from matrixweave.operators import stats

    cells, patches, cross = two_samples[0]
    found = stats.enrichment(cells, patches.select("sample_id", "id", "label"), cross, 3, 999, 1)
    top = {r.cell_type: r for r in stats.top_cluster(found).collect()}
    assert top["planted"].cluster == 1 and top["planted"].p == pytest.approx(0.001)
    rows = found.collect()
    assert all(r.p >= 0.001 for r in rows) and sum(r.observed for r in rows) == 240
    calls = {(r.cell_type, r.label): r.call for r in stats.interaction_test(cells, patches.select("sample_id", "id", "label"), cross, 499, seed=3).collect()}
    assert calls["planted", 1] == 1 and calls["planted", 0] == -1


def test_dealt_counts_keep_labels(spark):
    from matrixweave.operators import stats

    units = spark.createDataFrame([(s, i, "ab"[i % 2] if i % 5 else None) for s in range(3) for i in range(40)], "sample_id int, id long, value string")
    weights = spark.createDataFrame([(s, i, i % 3, 1 + i % 2) for s in range(3) for i in range(0, 40, 2)], "sample_id int, id long, other int, m long")
    rows = stats.dealt_counts(units, weights, 601, 5).collect()
    whole = {}
    for r in rows:
        whole[r.perm, r.sample_id] = whole.get((r.perm, r.sample_id), 0) + r.n
    assert len(whole) == 601 * 3 and set(whole.values()) == {20}
    # Deals differ, and every value reaches an id about as often as it is there.
    share = [sum(r.n for r in rows if r.perm == p and r.value == "a") for p in range(1, 601)]
    assert len(set(share)) > 5 and abs(sum(share) / 600 / 60 - 16 / 40) < 0.02
    assert stats.dealt_counts(units.limit(0), weights, 10).count() == 0


def test_eleven_structure_features(spark):
    square = [(1, "a", y, x) for y in range(5, 15) for x in range(5, 15)]
    # Four patches around its centre (9.5, 9.5), one a quarter turn; a fifth is not around it.
    patches = [(1, "a", 1, 9.5, 20.0, True, 1.0), (1, "a", 2, 20.0, 9.5, True, 0.0), (1, "a", 3, 9.5, -1.0, True, 1.0), (1, "a", 4, -1.0, 9.5, True, 0.0), (1, "a", 5, 9.0, 9.0, False, 9.0), (2, "b", 1, 0.0, 0.0, True, 0.5)]
    got = structures.structure_features(spark.createDataFrame(square + square[:3], "sample_id long, uid string, y int, x int"), spark.createDataFrame(patches, "sample_id long, uid string, id long, row double, col double, is_peri boolean, value double"))
    a, b = (r.asDict() for r in got.orderBy("uid").collect())
    assert a["log_area_norm"] == pytest.approx(np.log(101) / np.log(1e6 + 1)) and a["solidity"] == 1
    assert a["circularity"] == pytest.approx(4 * np.pi * 100 / 36**2) and a["max_gap"] == pytest.approx(0.25)
    assert (a["peri_coverage"], a["peri_frac"], a["n_components_norm"], a["largest_share"], a["degree_entropy"]) == (0.5, 0.8, 0.25, 1, pytest.approx(1))
    assert a["gap_entropy"] == pytest.approx(-(4 / 18 * np.log2(4 / 18) + 14 / 18 * np.log2(14 / 18)))
    assert a["assortativity"] == pytest.approx(np.corrcoef([1, 1, 1, 0, 0, 1], [0, 1, 0, 1, 0, 0])[0, 1])
    assert (b["max_gap"], b["peri_frac"], b["n_components_norm"], b["largest_share"], b["solidity"], b["peri_coverage"]) == (1, 1, 1, 1, 0, 0.5)
    # An L of three pixels of four: its hull holds all four.
    corner = structures.region_shape(np.array([(0, 0), (1, 0), (1, 1)]))
    assert corner[0] == 3 and corner[2] == 1


def test_joint_graph_methods(spark):
    from matrixweave.operators import joint

    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, "T"), (1, 2, 10.0, 0.0, "B"), (1, 3, 0.0, 10.0, None), (1, 4, None, None, "T")], "sample_id int, id long, x double, y double, label string")
    patches = spark.createDataFrame([(1, 1, 1.0, 1.0, 0, 0, 5), (1, 2, 5.0, 1.0, 0, 1, 5), (1, 3, 1.0, 5.0, 1, 0, -1)], "sample_id int, id long, x double, y double, grid_y int, grid_x int, label int")
    for cell, patch, cross, sizes in (("knn", "grid4", "radius", (2, 2, 1)), ("radius", "grid8", "knn", (3, 3, 3)), ("delaunay", "delaunay", "delaunay", (3, 3, None))):
        nodes, edges = joint.joint_graph(cells, patches, cell, patch, cross, k=1, radius=8.0 if cross == "radius" else 30.0, scale=0.5) if cross == "radius" else joint.joint_graph(cells, patches, cell, patch, cross, k=1, radius=30.0)
        assert nodes.count() == 7
        count = {(r.src_type, r.dst_type): r["count"] for r in edges.groupBy("src_type", "dst_type").count().collect()}
        for kinds, n in zip((("cell", "cell"), ("ecm", "ecm"), ("cell", "ecm")), sizes):
            assert n is None or count.get(kinds, 0) >= n
        assert edges.where("abs(weight * d - 1) > 1e-9 and d > 0").count() == 0
    with pytest.raises(ValueError):
        joint.edges_within(cells, "grid")


def test_tiles_find_the_regions_of_the_whole_image(spark):
    from matrixweave.operators import tiled

    want = [(y + 2.0, x + 1.5, 20) for y in range(3, 90, 13) for x in range(1, 90, 11)]
    lit = {(int(y) - 2 + i, int(x - 1.5) + j) for y, x, _ in want for i in range(5) for j in range(4)}
    rows = [(0, 0, y, x, 9.0 if (y, x) in lit else 1.0) for y in range(100) for x in range(100)]
    got = tiled.segment_tiled(spark.createDataFrame(rows, "sample_id int, channel int, y int, x int, v double"), 30, 8, "otsu", 5, 0.5).collect()
    assert sorted((r.y, r.x, r.area) for r in got) == sorted(want)
    assert all((r.y_um, r.x_um) == (r.y / 2, r.x / 2) for r in got) and len({(r.ty, r.tx) for r in got}) > 4


def test_checks(spark):
    from matrixweave.operators import checks

    points = spark.createDataFrame([(0, 1, 0.0, 1.0, True), (0, 2, float("nan"), None, None)], "sample_id int, id long, x double, y double, own boolean")
    assert checks.finite_positions(points.limit(0)) is not None
    with pytest.raises(ValueError, match="1 of x, 1 of y"):
        checks.finite_positions(points)
    assert checks.sources(points.where("id = 1"), "own").count() == 1
    with pytest.raises(Exception, match="own has a null"):
        checks.sources(points, "own").collect()
    edges = spark.createDataFrame([(0, 1, 2, 0.0), (0, 2, 1, 2.0)], "sample_id int, src long, dst long, weight double")
    assert [r.weight for r in checks.adjacency(edges, points).collect()] == [2.0]
    for bad in (edges.withColumn("weight", -F.col("weight")), edges.withColumn("dst", F.lit(9))):
        with pytest.raises(ValueError):
            checks.adjacency(bad, points)
    assert checks.value_of({"a": points, "b": edges}, "x").columns == ["sample_id", "id", "value"]
    for name, source in (("sample_id", None), ("none", None), ("x", "c")):
        with pytest.raises(ValueError):
            checks.value_of({"a": points, "b": edges}, name, source)
    folds = [(i, i % 2, i // 2, i // 2 % 2) for i in range(8)]
    schema = "graph int, label int, grp int, fold int"
    assert checks.valid_splits(spark.createDataFrame(folds, schema)).count() == 8
    for bad in (folds + folds[:1], [(g, y, 0, f) for g, y, _, f in folds], [(g, f, p, f) for g, _, p, f in folds], [(g, y, p, 0) for g, y, p, _ in folds]):
        with pytest.raises(ValueError):
            checks.valid_splits(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        checks.cap_of("delaunay", 3.0)


def test_attached_patches_and_names(spark):
    from matrixweave.operators import extractors, frames

    cells, edges = spark.createDataFrame([(0, 1), (1, 1)], "sample_id int, id long"), spark.createDataFrame([("cell", "cell"), ("cell", "ecm"), ("ecm", "ecm")], "src_type string, dst_type string")
    assert frames.attach_patches(cells, cells, edges)[1].collect() == [("cell", "cell")]
    with pytest.raises(ValueError, match="one side only: 1"):
        frames.attach_patches(cells, cells.limit(0).union(cells.where("sample_id = 0")), edges)
    names = spark.createDataFrame([("ecm_12",), ("ecm",), (None,)], "n string").select(frames.node_number("n").alias("k"))
    assert [r.k for r in names.collect()] == [12, None, None]
    assert frames.empty_cells(spark, ["a b"]).count() == 0
    with pytest.raises(ValueError, match="not nothing"):
        extractors.resolve(["nothing"])


def test_resolution_with_the_largest_index(spark):
    from matrixweave.operators import cluster, communities

    rows = [(0, g * 10 + i, float(g * 100 + i % 3), float(g * 50 + i % 2)) for g in range(3) for i in range(10)]
    spread = cluster.standardised(spark.createDataFrame(rows, "sample_id int, id long, a double, b double"), ["a", "b"])
    links = [(0, g * 10 + i, g * 10 + j) for g in range(3) for i in range(10) for j in range(i)]
    got = communities.select_resolution(spark.createDataFrame(links, "sample_id int, src long, dst long"), spread, [0.01, 1.0, 8.0]).collect()
    assert len(got) == 3 and [r.n for r in got if r.best] == [3]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_radius_joins_send_no_multiplied_rows_to_the_driver(spark):
    p = written(points(spark, [(0, 0), (3, 0), (0, 30)]), "small")  # files, whose size Spark knows
    assert broadcasts(spatial.range_join(p, p, 5.0)) == 0


def test_lattice_and_adopted_edges_send_no_large_table_to_the_driver(spark):
    p = written(points(spark, [(0, 0), (1, 0)]), "small")
    lattice = p.select("sample_id", F.col("id").alias("patch_id"), F.col("x").cast("int").alias("grid_x"), F.col("y").cast("int").alias("grid_y"))
    pairs = spatial.grid_edges(lattice)
    assert broadcasts(pairs) == broadcasts(spatial.adopt_adjacency(pairs, p)) == 0


def test_enrichment_broadcasts_neither_cells_nor_patches(spark):
    cells = written(points(spark, [(0, 0), (1, 0)]).select("sample_id", F.col("id").alias("cell_id"), F.lit("a").alias("cell_type")), "small")
    labels = written(points(spark, [(0, 0), (1, 0)]).select("sample_id", "id", F.lit(0).alias("label")), "small")
    met = written(edges(spark, [(0, 0), (1, 1)]), "small")
    plan = stats.enrichment(cells, labels, met, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2


def test_window_means_sum_a_place_once_and_leave_nulls_out(spark):
    cells = spark.createDataFrame([(0, 1, 1.5, 1.2), (0, 2, 1.0, 1.9), (0, 2, 9.0, 9.0), (0, 3, 50.0, 50.0)], "sample_id int, cell_id long, y double, x double")
    pixels = spark.createDataFrame([(0, 0, y, x, None if y == x == 0 else float(y)) for y in range(3) for x in range(3)], "sample_id int, channel int, y int, x int, v double")
    cells, pixels = written(cells, "small"), written(pixels, "small")
    found = patches.window_means(cells, pixels, 1)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.cell_id: r["mean"] for r in found.collect()} == {1: 9 / 8, 2: 9 / 8}


def test_path_lengths_of_a_dense_ring_in_several_tasks(spark):
    n, reach = 1500, 60
    pairs = [(i, (i + k) % n) for i in range(n) for k in range(1, reach + 1)]
    nodes = spark.createDataFrame([(0, i, 0) for i in range(n)], "sample_id int, id long, component long")
    row = geometry.path_lengths(nodes, edges(spark, pairs), sources=400).first()
    steps = [-(-min(k, n - k) // reach) for k in range(1, n)]
    mean = sum(steps) / (n - 1)
    assert (row.n_nodes, row.diameter) == (n, max(steps))
    assert np.allclose([row.mean_path, row.closeness, row.betweenness], [mean, 1 / mean, (mean - 1) / (n - 2)])


def test_fiedler_value_needs_no_paths(spark, monkeypatch):
    monkeypatch.setattr(geometry, "distance_sums", None)
    nodes = spark.createDataFrame([(0, i, 0) for i in range(6)], "sample_id int, id long, component long")
    got = geometry.fiedler_values(nodes, edges(spark, [(i, i + 1) for i in range(5)])).collect()
    assert [round(r.fiedler, 9) for r in got] == [round(2 - 2 * np.cos(np.pi / 6), 9)]
    assert geometry.fiedler_values(nodes, edges(spark, [(i, i + 1) for i in range(5)]), most=5).isEmpty()


def test_kinds_of_nodes_give_the_network_of_all_nodes():
    from matrixweave.operators.nn import Kinds, Means, Network

    n = 600
    x = np.eye(3)[np.arange(n) // 2 % 3]
    src, dst = np.concatenate([np.arange(n - 1), np.arange(1, n)]), np.concatenate([np.arange(1, n), np.arange(n - 1)])
    kinds, means, net = Kinds(x, src, dst), Means(n, src, dst), Network(3, 2, 4, seed=1)
    assert kinds.n < 20 and len(kinds.x) == 3
    z, kept = net.forward(x, means)
    few, short = net.forward(kinds.x, kinds)
    assert np.allclose(few[kinds.of], z)
    g = np.random.default_rng(0).normal(size=z.shape)
    grads, into = net.backward(g, kept, means)
    own, shared = net.backward(np.stack([np.bincount(kinds.of, g[:, c], kinds.n) for c in range(2)], axis=1), short, kinds)
    assert all(np.allclose(grads[k], own[k]) for k in grads)
    assert np.allclose(shared, [into[(x == row).all(axis=1)].sum(axis=0) for row in kinds.x])
    alone = Kinds(x[:1], np.zeros(0, int), np.zeros(0, int))
    assert np.allclose(net.forward(alone.x, alone)[0], net.forward(x[:1], Means(1, np.zeros(0, int), np.zeros(0, int)))[0])


def _mosaic(side, seed):
    """(x, src, dst) of a lattice of random one-hot nodes, edges both ways."""
    rng, at = np.random.default_rng(seed), np.arange(side * side).reshape(side, side)
    a, b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()]), np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    return np.eye(5)[rng.integers(0, 5, side * side)], np.concatenate([a, b]), np.concatenate([b, a])


def test_sums_of_few_and_very_many_terms():
    from matrixweave.operators.nn import Sums

    rng = np.random.default_rng(3)
    to = np.concatenate([np.full(9000, 4), rng.integers(0, 50, 700), np.full(64, 60), np.full(65, 61)])
    source, weight, rows = rng.integers(0, 30, len(to)), rng.normal(size=len(to)), rng.normal(size=(30, 3))
    for w in (weight, np.ones(len(to))):
        want = np.zeros((70, 3))
        np.add.at(want, to, rows[source] * w[:, None])
        sums = Sums(to, source, w, 70)
        assert np.allclose(sums(rows), want) and np.allclose(sums(rows), want)  # memory is used again
        assert max(map(len, (sums.slots, sums.above.slots))) <= 64
    assert (Sums(to[:0], source[:0], weight[:0], 2)(rows) == 0).all()


def test_gradients_by_parts_are_those_of_all_nodes():
    from matrixweave.operators.nn import Kinds, Means, Network

    x, src, dst = _mosaic(80, 1)
    hub, n = np.arange(1, 300), len(x)  # node 0 has very many neighbours, the last one none
    src, dst = np.concatenate([src, np.zeros(299, int), hub]), np.concatenate([dst, hub, np.zeros(299, int)])
    x = np.concatenate([x, x[:1]])
    kinds, means, net = Kinds(x, src, dst), Means(n + 1, src, dst), Network(5, 3, 4, seed=1)
    assert len(kinds.levels[-1].parts) > 1
    weight = np.random.default_rng(0).random(kinds.n) / kinds.n
    z, kept = net.forward(x, means)
    one = np.bincount(kinds.of, minlength=kinds.n)
    assert np.allclose(net.scores(kinds.x, kinds)[kinds.of], z)
    own = net.gradients(kinds.x, kinds, lambda rows, out: weight[rows, None] * out)
    grads = net.backward((weight / one)[kinds.of, None] * z, kept, means)[0]
    assert all(np.allclose(grads[k], own[k]) for k in net.p)
    for c, pull in enumerate(net.pulls(kinds.x, kinds, weight)):
        into = net.backward((weight / one)[kinds.of, None] * (np.arange(3) == c), kept, means)[1]
        assert np.allclose(pull, [into[(x == row).all(axis=1)].sum(axis=0) for row in kinds.x])


def test_training_never_holds_the_last_layer_of_all_nodes():
    import tracemalloc

    from matrixweave.operators import nn

    x, src, dst = _mosaic(250, 2)
    n, half = len(x), len(x) // 2
    tracemalloc.start()
    nn._train(x, (np.arange(n) >= half).astype(int), np.zeros(n, bool), src, dst, 2, 0.005, 1e-4, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * n * 32 * 8


def test_probabilities_never_hold_the_last_layer_of_all_nodes():
    import tracemalloc

    from matrixweave.operators import nn

    x, src, dst = _mosaic(250, 4)
    n, net = len(x), nn.Network(5, 2, seed=0)
    want = nn.softmax(net.forward(x, nn.Means(n, src, dst))[0])
    tracemalloc.start()
    got = nn._probabilities(net, x, src, dst)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want) and peak < 3 * n * 32 * 8


def test_relations_broadcast_no_nodes(spark):
    from matrixweave.sources import hetero

    nodes = written(spark.createDataFrame([(0, "cell", 5), (0, "cell", 7)], "sample_id int, node_type string, id long"), "small")
    links = written(spark.createDataFrame([(0, "cell", 5, "cell", 7, 2.0, 0.5)], "sample_id int, src_type string, src long, dst_type string, dst long, d double, weight double"), "small")
    relations = hetero.hetero_tables(nodes, links)[1]
    assert broadcasts(relations) == 0
    assert sorted((r.source, r.target) for r in relations.collect()) == [(0, 1), (1, 0)]


def test_relations_are_joined_before_they_go_both_ways(spark):
    from matrixweave.sources import hetero

    nodes = spark.createDataFrame([(s, t, i) for s in (0, 1) for t in ("cell", "ecm") for i in (9, 4, 6)], "sample_id int, node_type string, id long")
    links = spark.createDataFrame([(0, "cell", 4, "cell", 9, 2.0, 0.5), (1, "cell", 6, "ecm", 4, 0.0, 0.0), (1, "ecm", 4, "ecm", 6, 1.0, 1.0), (1, "ecm", 4, "ecm", 5, 1.0, 1.0)], "sample_id int, src_type string, src long, dst_type string, dst long, d double, weight double")
    relations = hetero.hetero_tables(nodes, links)[1]
    plan = relations._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Join")
    want = [(0, "cell-cell", 0, 2, 2.0, 0.5), (0, "cell-cell", 2, 0, 2.0, 0.5), (1, "cell-ecm", 1, 0, 0.0, 0.0), (1, "ecm-cell", 0, 1, 0.0, 0.0), (1, "ecm-ecm", 0, 1, 1.0, 1.0), (1, "ecm-ecm", 1, 0, 1.0, 1.0)]
    assert relations.columns == ["sample_id", "relation", "source", "target", "d", "weight"]
    assert sorted(map(tuple, relations.collect())) == want


def test_written_tables_hold_no_file_of_the_driver(spark):
    kept = written(spark.range(5).toDF("id"), "small")
    files = [p.name for p in Path(kept.inputFiles()[0].removeprefix("file://")).parent.iterdir()]
    assert files and all("part-" in f for f in files)
    assert sorted(r.id for r in kept.collect()) == list(range(5))


def test_nearest_of_rows_that_coincide(spark):
    rng = np.random.default_rng(5)
    xy = [(0.0, 0.0)] * 40 + [(1.0, 0.0)] * 2 + [(0.0, 3.0)] * 7 + [tuple(p) for p in rng.integers(0, 4, (30, 2)).astype(float)] + [(20.0, 20.0)]
    df = points(spark, xy)
    rows = [tuple(r) for r in df.select("id", "x", "y").collect()]
    for own, a, b in ((True, rows, rows), (False, [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3])):
        ask = df if own else df.where("id % 3 = 0")
        got = {}
        for r in spatial.nearest(ask, df if own else df.where("id % 3 <> 0"), 4, own=own).collect():
            got.setdefault(r.src, []).append((r["rank"], r.dst, r.d))
        for i, x, y in a:
            near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in b if not own or j != i)[:4]
            assert sorted(got[i]) == [(n + 1, j, d) for n, (d, j) in enumerate(near)]


def test_first_buckets_of_rows_on_a_small_part(spark):
    rows = written(points(spark, [(float(i % 100), i / 1000) for i in range(1000)]).withColumnRenamed("id", "dst"), "rows")
    extent = spark.createDataFrame([(rows.first()["sample_id"], 99.0, 10.0)], "sample_id int, _extent double, _first double")
    assert spatial._crowded(rows, extent, 30).first()._first == 2.5
    assert spatial._crowded(rows, extent, 200).first()._first == 10.0


def test_communities_are_those_of_a_plain_program():
    from matrixweave.operators.communities import merged, move_nodes

    def plain(n, links, resolution):
        belongs = list(range(n))
        while True:
            strength = [sum(w * ((a == v) + (b == v)) for (a, b), w in links.items()) for v in range(n)]
            own, weight, moved_any = list(range(n)), strength.copy(), False
            for _ in range(100):
                moved = False
                for v in range(n):
                    to = {}
                    for (a, b), w in links.items():
                        if a != b and v in (a, b):
                            to[own[a + b - v]] = to.get(own[a + b - v], 0.0) + w
                    weight[own[v]] -= strength[v]
                    gain = lambda c: to.get(c, 0.0) - resolution * strength[v] * weight[c] / sum(strength)  # noqa: E731, B023
                    best = own[v]
                    for c in sorted(to):
                        best = c if gain(c) > gain(best) + 1e-12 else best
                    weight[best] += strength[v]
                    moved, own[v] = moved or best != own[v], best
                moved_any |= moved
                if not moved:
                    break
            names = sorted(set(own))
            belongs = [names.index(own[v]) for v in belongs]
            if not moved_any:
                return belongs
            after = {}
            for (a, b), w in links.items():
                k = tuple(sorted((names.index(own[a]), names.index(own[b]))))
                after[k] = after.get(k, 0.0) + w
            links, n = after, len(names)

    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (2, 1), (30, 60), (60, 90)):
        a, b = rng.integers(0, n, (2, m))
        a, b, w = merged(a, b, rng.integers(1, 4, m).astype(float), n)
        for resolution in (0.5, 1.0, 2.0):
            assert move_nodes(n, a, b, w, resolution).tolist() == plain(n, dict(zip(zip(a.tolist(), b.tolist()), w.tolist())), resolution)


def test_resolution_broadcasts_no_features(spark):
    from matrixweave.operators import cluster, communities

    rows = spark.createDataFrame([(0, i, float(i), float(i % 2)) for i in range(6)], "sample_id int, id long, a double, b double")
    spread = written(cluster.standardised(rows, ["a", "b"]), "small")
    links = written(spark.createDataFrame([(0, 0, 1), (0, 2, 3), (0, 4, 5)], "sample_id int, src long, dst long"), "small")
    assert broadcasts(communities.select_resolution(links, spread, [0.5, 1.0])) == 0
