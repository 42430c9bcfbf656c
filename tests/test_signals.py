"""Signal kernels against brute force, filters step by step, tones and clicks."""

import itertools

import numpy as np
import pytest

from corpusmill.functions import signals as S


def brute_path(emission, tokens, blank=0):
    """Best score over all ways to give each frame a symbol that read, with repeats merged and blanks removed, as tokens."""
    best = None
    for said in itertools.product(range(emission.shape[1]), repeat=len(emission)):
        read = [k for k, _ in itertools.groupby(said)]
        if [k for k in read if k != blank] == tokens:
            score = emission[np.arange(len(said)), said].sum()
            best = max(best, score) if best is not None else score
    return best


@pytest.mark.parametrize("tokens", [[1], [1, 2], [1, 1], [2, 1, 2], [1, 2, 2, 1], [3, 3, 3]])
def test_paths_are_the_best_of_all(tokens):
    rng = np.random.default_rng(len(tokens))
    for frames in range(1, 7):
        emission = np.log(rng.dirichlet(np.ones(4), frames))
        want, found = brute_path(emission, tokens), S.best_path(emission, tokens)
        assert (found is None) == (want is None)
        if found:
            score, spans = found
            assert score == pytest.approx(want)
            said = np.zeros(frames, int)
            for t, (a, b) in zip(tokens, spans, strict=True):
                said[a:b] = t
            assert emission[np.arange(frames), said].sum() == pytest.approx(want)
            assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_a_better_old_span_is_kept():
    emission = np.log(np.full((10, 3), 0.05))
    emission[:, 0] = np.log(0.9)
    emission[2:4, 1], emission[6:8, 2] = np.log(0.99), np.log(0.99)
    assert S.refine(emission, [[1], [2]], [(0, 9), (0, 9)]) == [(2, 4, True), (6, 8, True)]
    assert S.refine(emission, [[1], [], [2]], [None, (4, 5), (0, 9)]) == [(2, 4, True), (4, 5, False), (6, 8, True)]
    emission[9, 1] = np.log(0.999)  # the word fits better where it was, but cannot be there in order
    assert S.refine(emission, [[1], [2]], [(9, 10), None])[0] == (9, 10, False)
    assert S.refine(emission[:1], [[1], [2]], [(0, 1), None]) == [(0, 1, False), None]


def test_alignment_on_tables(spark):
    schema = "id long, e array<array<double>>, w array<array<int>>, o array<struct<start: int, end: int>>"
    flat = [[-1.0, -2.0, -0.1], [-1.0, -0.1, -2.0]]
    rows = [(1, flat, [[2], [1]], [None, (0, 1)]), (2, None, [[1]], [(3, 4)]), (3, flat, None, None), (4, [[-1.0], [-1.0, -2.0]], [[1]], [(0, 2)]), (5, flat, [[9]], [(0, 1)])]
    got = {r["id"]: ([None if s is None else tuple(s) for s in r["spans"]], r["score"]) for r in S.aligned(spark.createDataFrame(rows, schema), "id", "e", "w", "o").collect()}
    assert got[1][0] == [(0, 1, True), (1, 2, True)] and got[1][1] == pytest.approx(-0.2)
    assert got[2] == ([(3, 4, False)], None) and got[3] == ([], None) and got[4] == ([(0, 2, False)], None) and got[5] == ([(0, 1, False)], None)


def test_sines_have_their_frequency():
    t = np.arange(22050) / 22050
    tones = np.stack([np.sin(2 * np.pi * f * t) for f in (440.0, 3000.0, 9000.0)])
    got = S.spectral_figures(tones, 22050, 2048, 512, 6000.0)
    assert got["centroid"] == pytest.approx([440, 3000, 9000], rel=0.03)
    assert got["high_share"][0] < 0.01 and got["high_share"][2] > 0.98


@pytest.mark.parametrize(("bpm", "want"), [(90, 90), (120, 120), (150, 150), (240, 120)])
def test_clicks_have_their_tempo(bpm, want):
    rate = 8000
    x = np.zeros(rate * 12)
    for k in range(int(12 * bpm / 60)):
        at = int(k * 60 / bpm * rate)
        x[at : at + 40] = 1.0
    assert S.spectral_figures(x[None], rate, 512, 80, 2000.0)["bpm"][0] == pytest.approx(want, rel=0.03)
    assert np.isnan(S.spectral_figures(np.zeros((1, rate)), rate, 512, 80, 2000.0)["bpm"][0])


def step_filter(x, b, a):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = b[0] * x[i] + (b[1] * x[i - 1] if i > 0 else 0) + (b[2] * x[i - 2] if i > 1 else 0) - (a[1] * y[i - 1] if i > 0 else 0) - (a[2] * y[i - 2] if i > 1 else 0)
    return y


def test_k_weighting_equals_its_filters_step_by_step():
    rng, rate = np.random.default_rng(1), 8000.0
    x = rng.normal(size=(2, 6000))
    want = x.copy()
    for b, a in S.k_weights(rate):
        want = np.stack([step_filter(row, b, a) for row in want])
    assert np.abs(S.k_weighted(x, rate) - want).max() < 1e-5


def test_tones_have_their_loudness():
    t = np.arange(48_000 * 3) / 48_000
    tone = np.sin(2 * np.pi * 997 * t)
    x = np.stack([tone, 0.1 * tone, np.where(t < 1.5, 0.1 * tone, 0.0001 * tone), 0 * tone])
    got = S.loudness(x, 48_000)
    assert got[0] == pytest.approx(-3.01, abs=0.1) and got[1] == pytest.approx(-23.01, abs=0.1)
    # Twelve whole blocks and three of which a part is loud pass the gates; the quiet ones don't.
    assert got[2] == pytest.approx(-23.01 + 10 * np.log10((12 + 0.75 + 0.5 + 0.25) / 15), abs=0.1)
    assert got[3] == -np.inf
    found, gain = S.gains(x, 48_000, target=-16.0)
    assert S.loudness(x[1:2] * gain[1], 48_000)[0] == pytest.approx(-16, abs=0.1)
    assert gain[3] == 1 and (np.abs(x * gain[:, None]).max(1) <= 1 + 1e-9).all()
    short = S.gains(0.25 * tone[None, :100], 48_000)
    assert short[0][0] == -np.inf and 0.25 * np.abs(tone[:100]).max() * short[1][0] == pytest.approx(10 ** (-1 / 20))


def test_tables_with_awkward_signals(spark):
    rows = [(1, [0.0] * 50), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [0.5] * 3), (6, [float(np.sin(k)) for k in range(6000)]), (6, [float(np.sin(k)) for k in range(6000)])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    spectrum = sorted((tuple(r) for r in S.with_spectrum(df, "id", "x", 8000.0, 64, 16, 1000.0).collect()), key=str)
    assert [r[1] for r in spectrum if r[0] in (2, 3, 4)] == [None] * 3 and spectrum[-1] == spectrum[-2]
    loud = {r["id"]: (r["lufs"], r["gain"]) for r in S.with_loudness(df, "id", "x", 8000.0).collect()}
    assert loud[1] == (None, 1.0) and loud[2] == (None, None) and loud[6][0] < 0
    assert S.with_loudness(df.where("id > 9"), "id", "x", 8000.0).count() == 0
