"""Motion, noise, colour, bands and normalisation of frames against plain loops."""

from __future__ import annotations

import itertools
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordwave.functions import motion, restore
from ordwave.operators import fill, normalise, sequences

RNG = np.random.default_rng(11)


def texture(h, w, seed=1):
    """Noise smoothed at two widths: nothing in it looks like anything else."""
    out = np.zeros((h, w))
    for k, width in enumerate((1.0, 4.0)):
        taps = np.exp(-(np.arange(-12, 13) ** 2) / (2 * width**2))
        noise = np.random.default_rng(100 * k + seed).normal(size=(h + 40, w + 40))
        for axis in (0, 1):
            noise = np.apply_along_axis(lambda v: np.convolve(v, taps / taps.sum(), "same"), axis, noise)
        out += (noise / noise.std())[20:-20, 20:-20]
    return out


def plain_warp(frame, flow):
    h, w = frame.shape
    out = np.zeros((h, w))
    for y, x in itertools.product(range(h), range(w)):
        sy, sx = min(max(y + flow[y, x, 0], 0), h - 1), min(max(x + flow[y, x, 1], 0), w - 1)
        for v, u in itertools.product(range(h), range(w)):
            out[y, x] += frame[v, u] * max(0, 1 - abs(sy - v)) * max(0, 1 - abs(sx - u))
    return out


def test_warp():
    frames = RNG.normal(size=(3, 5, 7))
    assert (motion.warp(frames, np.zeros((3, 5, 7, 2))) == frames).all()
    whole = motion.warp(frames, np.broadcast_to([1.0, -2.0], (3, 5, 7, 2)))
    assert (whole[:, :4, 2:] == frames[:, 1:, :-2]).all() and (whole[:, 4, 2:] == frames[:, 4, :-2]).all()
    flow = RNG.uniform(-8, 8, (3, 5, 7, 2))
    assert motion.warp(frames, flow) == pytest.approx(np.array([plain_warp(f, g) for f, g in zip(frames, flow)]))
    assert motion.warp(np.zeros((0, 4, 4)), np.zeros((0, 4, 4, 2))).shape == (0, 4, 4)


def plain_flow(a, b, reach=2, half=1):
    h, w = a.shape
    at = lambda m, y, x: m[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    out = np.zeros((h, w, 2))
    for y, x in itertools.product(range(h), range(w)):
        steps = [(round(sum(abs(at(a, y + i, x + j) - at(b, y + dy + i, x + dx + j)) for i in range(-half, half + 1) for j in range(-half, half + 1)), 9), dy * dy + dx * dx, (dy, dx)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
        out[y, x] = min(steps)[2]
    return out


def test_block_flow_of_stacks():
    a, b = RNG.normal(size=(2, 4, 6, 6))
    got = motion.block_flow(a, b)
    inner = slice(2, -2)  # at the borders the neighbourhoods of the two repeat their edges by turns
    for p, q, f in zip(a, b, got):
        assert (f[inner, inner] == plain_flow(p, q)[inner, inner]).all()
    for p, q, f in zip(a, b, got):
        assert (motion.block_flow(p[None], q[None])[0] == f).all()
    assert not motion.block_flow(a, a).any()


@pytest.mark.parametrize("shift", [(0, 0), (1, -2), (6, 0), (-5, 6), (0, -9)])
def test_flow_beyond_the_reach_of_its_estimate(shift):
    whole = texture(100, 100)
    a, b = whole[20:68, 20:68], whole[20 - shift[0] : 68 - shift[0], 20 - shift[1] : 68 - shift[1]]
    flow = motion.coarse_to_fine(a[None], b[None])[0]
    inner = flow[14:-14, 14:-14]
    assert np.abs(inner - shift).mean() < 0.35
    if max(map(abs, shift)) > 2:
        assert np.abs(motion.patch_flow(a[None], b[None])[0, 14:-14, 14:-14] - shift).mean() > 1


@pytest.mark.parametrize("make", [motion.between, motion.between_flipped, lambda *a: motion.between(*a, both_ways=False)])
def test_frames_between_move(make):
    """At the middle of a shift of 6 pixels a frame is shifted by 3, where blending shows two ghosts."""
    whole = texture(100, 100, seed=4)
    a, mid, b = (whole[20 - d : 68 - d, 20 + d : 68 + d] for d in (0, 3, 6))
    got = make(a[None], b[None], [0.0, 0.5, 1.0])[0]
    inner = (slice(12, -12), slice(12, -12))
    assert np.abs(got[1] - mid)[inner].mean() < 0.25 * np.abs((a + b) / 2 - mid)[inner].mean()
    assert got[0] == pytest.approx(a, abs=0.02) and got[2] == pytest.approx(b, abs=0.02)  # the other frame keeps a thousandth where nothing else was seen
    assert make(a[None], b[None], []).shape == (1, 0, 48, 48)


def test_the_model_fills_sequences(spark):
    """All batches and both numbers of rows give what single pairs give; a lone frame and the last one are repeated."""
    whole = texture(60, 60, seed=2)
    frames = [whole[10 + 2 * i : 26 + 2 * i, 10:26].ravel().tolist() for i in range(5)]
    rows = [("s", i, f) for i, f in enumerate(frames)] + [("lone", 0, frames[0])]
    placed = sequences.positions(spark.createDataFrame(rows, "s string, o long, px array<double>"), "s", "o")
    model = motion.motion_model(16, 16, flips=True, levels=2)
    got = {(r["s"], r["pos"], r["sub_no"]): r["px"] for r in fill.fill_with(placed, "s", "px", F.col("pos") % 3, model).collect()}
    assert got["lone", 0, 0] == frames[0] and len(got) == 6 + 0 + 1 + 2 + 0 + 1
    square = lambda f: np.reshape(f, (1, 16, 16))
    for i, n in ((1, 1), (2, 2), (4, 1)):
        following = frames[min(i + 1, 4)]
        want = motion.between_flipped(square(frames[i]), square(following), [k / (n + 1) for k in range(1, n + 1)], levels=2)[0]
        for k in range(n):
            assert got["s", i, k + 1] == pytest.approx(want[k].ravel().tolist())
    assert got["s", 4, 1] == pytest.approx(frames[4])


def test_flow_distance(spark):
    a = np.random.default_rng(2).normal(size=(9, 9))
    b = np.roll(a, (1, -2), (0, 1))
    assert (motion.block_flow(a[None], b[None])[0, 3:6, 3:6] == (1, -2)).all()
    rows = [(x.ravel().tolist(), y.ravel().tolist()) for x, y in ((a, b), (b, a), (a, a))]
    got = [r["d"] for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(motion.flow_distance(9, 9)("x", "y").alias("d")).collect()]
    assert got[0] == pytest.approx(got[1]) and got[0] > 9 and got[2] == 0


def test_scale_of_motion(spark):
    """Still frames at full scale; a shift within the estimate's reach of the frames alone at half; one that halving still shows at a quarter; one direction alone counts nothing."""
    whole = texture(80, 80, seed=3)
    cut = lambda d: whole[20 - d : 52 - d, 20:52]
    frames = {"still": (cut(0), cut(0)), "small": (cut(0), cut(1)), "large": (cut(0), cut(4))}
    df = spark.createDataFrame([(k, a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in frames.items()], "k string, a array<double>, b array<double>")
    step = lambda a, b: min(np.abs(motion.block_flow(x[None], y[None])).max() for x, y in ((a, b), (b, a)))
    for limit in (0.5, 1.5, 3.5):
        got = {r["k"]: r["s"] for r in df.select("k", motion.scale_of_motion(32, 32, limit)("a", "b").alias("s")).collect()}
        small = lambda f: motion.halved(f[None])[0]
        assert got == {k: 1.0 if step(a, b) <= limit else 0.5 if 2 * step(small(a), small(b)) <= limit else 0.25 for k, (a, b) in frames.items()}
        assert got["still"] == 1.0
    assert df.where("k = ''").select(motion.scale_of_motion(32, 32, 1.0)("a", "b")).count() == 0


def test_cubic_weights():
    from ordwave.functions import grids

    for n, m in ((8, 13), (8, 5), (5, 5), (1, 4), (30, 3)):
        assert grids.cubic_weights(n, m).sum(1) == pytest.approx(np.ones(m))
    assert grids.cubic_weights(6, 6) == pytest.approx(np.eye(6))
    line = grids.cubic_weights(20, 40) @ np.arange(20.0)
    assert line[6:-6] == pytest.approx((np.arange(40)[6:-6] + 0.5) / 2 - 0.5, abs=0.1)


# --- noise


def plain_denoise(frame, strength, patch, search):
    h, w = frame.shape
    mirror = lambda i, n: (lambda k: k if k < n else 2 * (n - 1) - k)(i % (2 * (n - 1)))
    at = lambda y, x: frame[mirror(y, h), mirror(x, w)]
    out = np.zeros((h, w))
    for y, x in itertools.product(range(h), range(w)):
        top = below = 0.0
        for dy, dx in itertools.product(range(-search, search + 1), repeat=2):
            d = np.mean([(at(y + i, x + j) - at(y + dy + i, x + dx + j)) ** 2 for i, j in itertools.product(range(-patch, patch + 1), repeat=2)])
            top, below = top + np.exp(-d / strength**2) * at(y + dy, x + dx), below + np.exp(-d / strength**2)
        out[y, x] = top / below
    return out


@pytest.mark.parametrize("patch, search", [(0, 1), (1, 2), (2, 1)])
def test_non_local_means(spark, monkeypatch, patch, search):
    monkeypatch.setattr(restore, "PIXELS", 150)
    frames = RNG.normal(size=(5, 6, 9))
    want = np.array([plain_denoise(f, 0.8, patch, search) for f in frames])
    assert restore.non_local_means(frames, 0.8, patch, search) == pytest.approx(want)
    df = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(frames)], "i int, px array<double>")
    got = {r["i"]: r["p"] for r in df.select("i", restore.denoised(6, 9, 0.8, patch, search)("px").alias("p")).collect()}
    assert np.array([got[i] for i in range(5)]).reshape(5, 6, 9) == pytest.approx(want)
    assert df.where("i < 0").select(restore.denoised(6, 9, 0.8)("px")).count() == 0


def test_noise_goes_and_edges_stay():
    clean = np.zeros((1, 24, 24))
    clean[:, :, 12:] = 10.0
    noisy = clean + np.random.default_rng(5).normal(scale=0.5, size=clean.shape)
    got = restore.non_local_means(noisy, 1.5, 1, 4)
    assert np.abs(got - clean).mean() < 0.5 * np.abs(noisy - clean).mean() and np.abs(got - clean)[:, 4:-4, 11:13].max() < 1.5


# --- colour


def test_matrix_and_planes():
    matrix = restore.yuv_matrix()
    assert matrix @ [1, 1, 1] == pytest.approx([1, 0, 0]) and (matrix @ [0, 0, 1])[1] == pytest.approx(0.5) and (matrix @ [1, 0, 0])[2] == pytest.approx(0.5)
    blocks = np.random.default_rng(1).integers(0, 256, (4, 3, 5, 3)).repeat(2, 1).repeat(2, 2).astype(float)  # a colour for each 2 x 2
    packed = restore.to_420(blocks, matrix)
    assert packed.shape == (4, 6 * 10 * 3 // 2) and packed.dtype == np.uint8
    assert np.abs(restore.from_420(packed, 6, 10, matrix) - blocks).max() <= 2
    grey = np.random.default_rng(2).integers(0, 256, (2, 4, 4, 1)).repeat(3, -1).astype(float)
    assert (restore.from_420(restore.to_420(grey, matrix), 4, 4, matrix) == grey).all()


def test_planes_on_halves():
    """Sums that lie on a half, or next to it, round as the same sums from left to right."""
    matrix = restore.yuv_matrix()
    r, g, b = (c.ravel() for c in np.meshgrid(*[np.arange(256)] * 3, indexing="ij"))
    near = np.flatnonzero((r * 2126 + g * 7152 + b * 722) % 10000 == 5000)
    colours = np.stack([r, g, b], -1)[near[: len(near) // 8 * 8]].reshape(-1, 2, 4, 3).astype(float)
    rows = matrix.tolist()
    want = []
    for frame in colours.tolist():
        y, u, v = ([[p[0] * m[0] + p[1] * m[1] + p[2] * m[2] for p in line] for line in frame] for m in rows)
        halves = lambda c: [math.floor((c[0][x] + c[0][x + 1] + c[1][x] + c[1][x + 1]) / 4 + 128.5) for x in (0, 2)]
        want.append([*(math.floor(a + 0.5) for line in y for a in line), *halves(u), *halves(v)])
    assert len(want) > 100 and (restore.to_420(colours, matrix) == np.clip(want, 0, 255)).all()


def test_round_trip_within_a_level():
    """Colours that have whole y, u and v come back within one level."""
    matrix = restore.yuv_matrix()
    rng = np.random.default_rng(3)
    yuv = np.stack([rng.integers(80, 170, (3, 8, 8)), *(rng.integers(-30, 30, (3, 4, 4)).repeat(2, 1).repeat(2, 2) for _ in range(2))], -1)
    colours = yuv @ np.linalg.inv(matrix).T
    assert np.abs(restore.from_420(restore.to_420(colours, matrix), 8, 8, matrix) - colours).max() <= 1


def test_tables(spark):
    n = 4
    table = np.random.default_rng(6).uniform(size=(n, n, n, 3))
    colours = np.concatenate([np.random.default_rng(7).uniform(-0.2, 1.2, (40, 3)), [[0, 0, 0], [1, 1, 1], [1 / 3, 2 / 3, 1]]])

    def plain(c):
        place = [min(max(v, 0), 1) * (n - 1) for v in c]
        return sum(table[k] * np.prod([max(0, 1 - abs(p - i)) for p, i in zip(place, k)]) for k in np.ndindex(n, n, n))

    want = np.array([plain(c) for c in colours])
    assert restore.trilinear(colours, table) == pytest.approx(want)
    same = np.stack(np.meshgrid(*[np.linspace(0, 1, n)] * 3, indexing="ij"), -1)
    assert restore.trilinear(colours, same) == pytest.approx(np.clip(colours, 0, 1))
    df = spark.createDataFrame([(colours.ravel().tolist(),)], "px array<double>")
    assert df.select(restore.graded(table)("px").alias("p")).first()["p"] == pytest.approx(want.ravel().tolist())
    values = [-1.0, 0.0, 0.2, 0.25, 0.9, 1.0, 3.0]
    got = spark.createDataFrame([(values,)], "v array<double>").select(restore.lookup("v", [1.0, 5.0, 2.0]).alias("p")).first()["p"]
    assert got == pytest.approx(np.interp(values, [0, 0.5, 1], [1, 5, 2]).tolist())


# --- bands


@pytest.mark.parametrize("h, w, levels, orientations", [(8, 8, 2, 4), (16, 12, 3, 6), (9, 15, 2, 5), (7, 7, 1, 1), (32, 32, 4, 2)])
def test_bands_add_up_to_the_frame(h, w, levels, orientations):
    frames = RNG.normal(size=(3, h, w))
    parts = restore.bands(frames, levels, orientations)
    assert parts.shape == (3, levels * orientations + 2, h, w)
    assert np.abs(restore.from_bands(parts, levels, orientations) - frames).max() < 1e-9
    masks = restore.band_masks(h, w, levels, orientations)
    assert (np.abs(masks) ** 2).sum(0) == pytest.approx(np.ones((h, w)))
    assert np.abs(np.fft.ifft2(np.fft.fft2(frames)[:, None] * masks).imag).max() < 1e-12  # no part of a band is lost with its imaginary part


def test_bands_are_oriented():
    """Waves along x lie in the band of angle 0 of their octave, waves along y in that of a right angle."""
    x = np.arange(64)
    for wave, level in ((2 * np.pi / 4, 0), (2 * np.pi / 8, 1)):
        across = np.broadcast_to(np.sin(wave * x), (64, 64))
        for frame, angle in ((across, 0), (across.T, 2)):
            energy = (restore.bands(frame[None], 3, 4)[0, 1:-1] ** 2).mean((1, 2)).reshape(3, 4)
            assert np.unravel_index(energy.argmax(), energy.shape) == (level, angle)


def test_band_energy_by_plain_transform(spark, monkeypatch):
    """Against the transform as a matrix, pixel by pixel."""
    monkeypatch.setattr(restore, "PIXELS", 400)
    frames = RNG.normal(size=(6, 4, 6))
    wave = lambda n: np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)
    masks = restore.band_masks(4, 6, 1, 3)
    want = [[float((np.abs((wave(4) @ f @ wave(6)) * m) ** 2).sum() / (24 * 24)) for m in masks] for f in frames]
    df = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(frames)], "i int, px array<double>")
    got = {r["i"]: r["e"] for r in df.select("i", restore.band_energy(4, 6, 1, 3)("px").alias("e")).collect()}
    assert [got[i] for i in range(6)] == [pytest.approx(x) for x in want]


# --- normalisation


def test_divisive_normalisation(spark):
    frames = np.random.default_rng(8).normal(size=(9, 5, 6)) * np.linspace(1, 2, 6)
    keys = ["a", "b", "a", None, "a", "b", "a", None, "flat"]
    frames[8] = 3.0
    df = spark.createDataFrame([(i, k, f.ravel().tolist()) for i, (k, f) in enumerate(zip(keys, frames))], "i int, k string, px array<double>").repartition(4)
    cov = {}
    for r in normalise.neighbour_covariance(df, "k", "px", 5, 6).collect():
        cov.setdefault(r["k"], np.zeros((9, 9)))[r["i"], r["j"]] = r["cov"]
    got = {r["i"]: r["normalised"] for r in normalise.divisive_normalise(df, "k", "px", 5, 6).collect()}
    assert len(got) == 9
    for key in set(keys):
        own = [i for i, k in enumerate(keys) if k == key]
        y = np.array([[frames[i][a : a + 3, b : b + 3].ravel() for a in range(3) for b in range(4)] for i in own])
        want = np.cov(y.reshape(-1, 9).T)
        assert cov[key] == pytest.approx(want, abs=1e-9)
        inverse = np.linalg.pinv(want, hermitian=True, rcond=1e-12) if key != "flat" else np.zeros((9, 9))
        for i, rows in zip(own, y):
            z = np.sqrt(np.array([v @ inverse @ v for v in rows]) / 10)
            centre = rows[:, 4] - rows[:, 4].mean()
            out = np.divide(centre, z, out=np.zeros_like(centre), where=z > 0)
            assert got[i] == pytest.approx((out - out.mean()).tolist(), abs=1e-6)


def test_negative_eigenvalues_go():
    vectors = np.linalg.qr(np.random.default_rng(9).normal(size=(9, 9)))[0]
    values = np.array([5, 4, 3, 2, 1, 0.5, 0, -1e-3, -2.0])
    got = normalise.pseudo_inverse((vectors * values) @ vectors.T)
    want = (vectors[:, :6] / values[:6]) @ vectors[:, :6].T
    assert got == pytest.approx(want, abs=1e-9) and not normalise.pseudo_inverse(np.zeros((9, 9))).any()


# --- XML


def test_rows_of_broken_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<orders><order _="1"><status>O</status></order><order key="2"><status>F</status><line number="1"><quantity>5.5</quantity></line><line number="2"/></order></orders>')
    (tmp_path / "b.xml").write_text('<orders><order key="3"><status>P</status><line number="1"><quantity>many</quantity></line></order></orders>')
    schema = "_key bigint, status string, line array<struct<_number:int,quantity:double>>, _corrupt_record string"
    rows = spark.read.format("xml").option("rowTag", "order").schema(schema).load(str(tmp_path)).collect()
    good = {(r["_key"], r["status"]): r["line"] for r in rows if r["_corrupt_record"] is None}
    assert (2, "F") in good and [tuple(x) for x in good[2, "F"]] == [(1, 5.5), (2, None)]
    assert (None, "O") in good and ["many" in r["_corrupt_record"] for r in rows if r["_corrupt_record"]] == [True]


def test_census_in_parts(monkeypatch):
    """A full Arrow batch is described in parts: the same losses in a bounded memory."""
    from ordwave.functions import grids

    n = 3000
    a, b = (pd.Series(list(RNG.normal(size=(n, 64)))) for _ in range(2))
    loss = grids.census_loss(8, 8).func
    tracemalloc.start()
    got = loss(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6
    monkeypatch.setattr(restore, "PIXELS", 1)
    assert (loss(a, b) == got).all() and not len(loss(a[:0], b[:0]))
    p, q = np.pad(a[7].reshape(8, 8), 3), np.pad(b[7].reshape(8, 8), 3)

    def plain(y, x):
        out = 0.0
        for i, j in itertools.product(range(7), repeat=2):
            c, d = (m[y + i, x + j] - m[y + 3, x + 3] for m in (p, q))
            e = c / np.sqrt(0.81 + c * c) - d / np.sqrt(0.81 + d * d)
            out += e * e / (0.1 + e * e) / 49
        return out

    assert got[7] == pytest.approx(np.mean([plain(y, x) for y in range(1, 7) for x in range(1, 7)]))


def test_xml_files_are_small(spark, sf, tmp_path, monkeypatch):
    """One task reads an XML file from end to end, so a file has few rows, however many a task writes."""
    from ordwave.plans import filters

    monkeypatch.setattr(filters, "XML_ROWS", 100, raising=False)
    monkeypatch.setattr(filters, "scratch_dir", lambda spark: f"{tmp_path}/xml")
    assert len(filters.xml_rows(spark, sf).collect()) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert max(f.read_text().count("</order>") for f in (tmp_path / "xml").glob("part-*")) <= 100
