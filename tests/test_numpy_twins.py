"""Queries without SQL, at the smallest size, against plain numpy and loops over the files themselves."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.test_images import plain_canny, plain_candidates
from trackweave.operators import pixels as P
from trackweave.operators.raster import component_boxes, label_components
from trackweave.operators.tracking import Follower, neighbour_score
from trackweave.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def crops():
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    names = [X.CLASSES[i] if 0 <= i < len(X.CLASSES) else None for i in t["label"]]
    return np.array(t["vec_id"]), np.array(t["embedding"], dtype=np.float32).astype(np.float64), names


def analysed(x, k):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return z, values / values.sum(), vectors, z @ vectors


def test_q28_variance(spark, crops):
    _, shares, _, _ = analysed(crops[1], 20)
    got = sorted(map(tuple, rows(spark, "q28_pca_variance")))
    assert [g[0] for g in got] == list(range(1, 21)) and np.allclose([g[1:] for g in got], np.stack([shares[:20], np.cumsum(shares[:20])], axis=1), atol=2e-6)


def test_q29_separation(spark, crops):
    own = [i for i, c in enumerate(crops[2]) if c]
    labels = np.array([crops[2][i] for i in own])
    scores = analysed(crops[1][own], 5)[3]
    centre = {c: scores[labels == c, :2].mean(axis=0) for c in set(labels)}
    got = {r.class_label: r for r in rows(spark, "q29_pca_separation")}
    away = np.linalg.norm(scores[:, None] - scores[None], axis=2)
    for c in centre:
        values = []
        for i in np.flatnonzero(labels == c):
            a = away[i, labels == c].sum() / max(1, (labels == c).sum() - 1)
            b = min(away[i, labels == o].mean() for o in centre if o != c)
            values.append((b - a) / max(a, b))
        assert got[c].n == len(values) <= 160 and math.isclose(got[c].silhouette, np.mean(values), abs_tol=1e-4) and math.isclose(got[c].distance, np.hypot(*(centre[c] - centre["object"])), abs_tol=1e-4)


def test_q30_residuals(spark, crops):
    own = [i for i, c in enumerate(crops[2]) if c]
    z, _, vectors, scores = analysed(crops[1][own], 10)
    for r in rows(spark, "q30_linear_autoencoder"):
        here = np.array([crops[2][i] == r.class_label for i in own])
        want = [((z - scores[:, :k] @ vectors[:, :k].T) ** 2).mean(axis=1)[here].mean() for k in (5, 10)]
        assert np.allclose((r.residual_k5, r.residual_k10), want, atol=2e-5)


def test_q56_mask(spark, crops):
    got = {r.frame: r for r in rows(spark, "q56_artifact_mask")}
    for frame, v in zip(*crops[:2]):
        x = v.reshape(8, 8)
        mask = x > 0.3
        for own in label_components(x < -0.1):
            y, z = np.divmod(own, 8)
            if len(own) >= 3 and len(own) / ((np.ptp(y) + 1) * (np.ptp(z) + 1)) > 0.55:
                mask.flat[own] = True
        assert got[frame].ratio == round(mask.mean(), 6) and got[frame].components == len(component_boxes((x > x.mean()) & ~mask))


@pytest.fixture(scope="module")
def tracks():
    """Each case's first event of every minute, in order."""
    t = pq.read_table(f"{SF}/events.parquet").to_pandas().sort_values("event_id")
    minute = (t["ts"].astype("datetime64[us]").astype("int64") - 1704067200000000) // 60000000
    t = t.assign(frame=minute, k=[json.loads(p)["k"] for p in t["props"]]).groupby(["user_id", "frame"], as_index=False).first().sort_values(["user_id", "frame"])
    return t.assign(state=t["event_type"].map(X.STATES))


def test_q52_follower(spark, tracks):
    seen = defaultdict(list)
    for case, own in tracks.groupby("user_id"):
        f = Follower()
        for r in own.itertuples():
            state, confidence, _ = f.step(r.value, float(r.k), float((8 + r.k % 24) * (6 + r.k % 18)), r.state in X.VALID_STATES, 89.6)
            seen[case, state].append(confidence)
    got = {(r.case_id, r.state): (r.n, r.mean_confidence) for r in rows(spark, "q52_tracker_fold")}
    assert set(got) == set(seen) and all(got[k][0] == len(v) and math.isclose(got[k][1], np.mean(v), abs_tol=1e-4) for k, v in seen.items())


def test_q51_links(spark, tracks):
    """The greedy linker, row by row: a candidate goes to the nearest track that it may, else it starts one."""
    got = rows(spark, "q51_link_tracks")
    counted = Counter()
    for r in got:
        counted[r.case_id] += r.n
        assert r.start_frame <= r.end_frame
    assert counted == Counter(tracks["user_id"].to_list())  # every row is in one track
    one = tracks[tracks["user_id"] == got[0].case_id]
    made: list[list[tuple[int, float, float]]] = []
    for r in one.itertuples():
        frame, best = r.frame // 360, None
        for n, track in enumerate(made):
            last, x, y = track[-1]
            away = math.hypot(r.value - x, r.k - y)
            if frame - last <= 8 and away < 36.0 and (best is None or away < best[0]):
                best = away, n
        (made[best[1]] if best else made.append([]) or made[-1]).append((frame, r.value, float(r.k)))
    want = sorted((len(t), t[0][0], t[-1][0]) for t in made)
    assert sorted((r.n, r.start_frame, r.end_frame) for r in got if r.case_id == got[0].case_id) == want


def test_q76_walk(spark, tracks):
    want = set()
    for case, own in tracks.groupby("user_id"):
        bars = defaultdict(list)
        for r in own.itertuples():
            frame = r.frame // 360
            bars[frame].append((float(frame * 20 % 640 + r.k), r.value % 60, float(8 + r.k % 24), math.floor(r.value * 100 + 0.5) / 100))
        seed = min((-s, f, x, y, w) for f, own_ in bars.items() for x, y, w, s in own_)
        want.add((case, seed[1], *seed[2:]))
        for way in (-1, 1):
            at, frame = seed[2:], seed[1] + way
            while frame in bars:
                scored = [(neighbour_score(x, y, w, at, way), x, y, w, s) for x, y, w, s in sorted(bars[frame])]
                scored = [(n + s, x, y, w) for n, x, y, w, s in scored if n is not None]
                if not scored:
                    break
                top = max(scored, key=lambda c: c[0])
                at = top[1:]
                want.add((case, frame, *at))
                frame += way
    got = {(r.case_id, r.frame, r.x, r.y, r.w) for r in rows(spark, "q76_neighbour_walk")}
    assert {g[:2] for g in got} == {w[:2] for w in want} and all(any(np.allclose(g, w, atol=1e-9) for w in want if w[:2] == g[:2]) for g in got)


@pytest.fixture(scope="module")
def frames(crops):
    """(blue, green, red) of each frame, laid out block by block."""
    out = {}
    for vec_id, v in zip(*crops[:2]):
        whole = np.floor(v * 10000 + 0.5).astype(np.int64)
        planes = out.setdefault(int(vec_id) // 25, np.zeros((3, 40, 40), np.int64))
        y, x = divmod(int(vec_id) % 25, 5)
        for c in range(3):
            base = math.floor(whole[21 * c : 21 * c + 21].sum() * 4000 / 210000)
            planes[c, 8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(128 + base + np.floor(whole * 150 / 10000), 0, 255).reshape(8, 8)
    return out


def test_q92_q93_edges_and_masks(spark, frames):
    for r in rows(spark, "q92_edge_density"):
        share = plain_canny(P.gray(*frames[r.frame]), 50, 140).mean()
        assert math.isclose(r.edges, share, abs_tol=1e-6) and math.isclose(r.line, min(1, 3 * share) if share > 0.18 else 0, abs_tol=1e-5)
    got = rows(spark, "q93_artifact_mask")
    for r in got:
        parts = P.artifact_parts(*frames[r.frame][:, None])
        assert all(math.isclose(r[k], v.mean(), abs_tol=1e-6) for k, v in parts.items())
    assert len(got) == len(frames)


def test_q98_candidates(spark, frames):
    want = []
    for case in range(3):
        own = [f for f in sorted(frames) if f % 3 == case]
        want += [(own[k], *rest) for k, *rest in plain_candidates(np.stack([P.gray(*frames[f]) for f in own]))]
    got = [(r.frame, r.source, r.x, r.y, r.w, r.h, r.pixels, r.contrast, r.brightness, r.dark_score) for r in rows(spark, "q98_candidate_boxes")]
    assert len(got) == len(want) > 0
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:7] == tuple(w[:7]) and np.allclose(g[7:], w[7:], atol=1e-5)
