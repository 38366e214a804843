"""The learned operators against plain sums, step-by-step loops and numeric gradients."""

import math
import random

import numpy as np
import pytest
from textloom.llm import langid, toxicity


def plain_score(fm, found):
    at = [i for i, b in enumerate(fm.buckets) if b in set(found.tolist())]
    z = fm.bias + sum(float(fm.w[i]) for i in at)
    z += sum(sum(float(fm.v[i, k]) * float(fm.v[j, k]) for k in range(fm.v.shape[1])) for n, i in enumerate(at) for j in at[:n])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    fm = toxicity.FactorizationMachine(np.sort(rng.choice(1000, 40, replace=False)), -0.4, rng.normal(0, 1, 40).astype(np.float32), rng.normal(0, 1, (40, 4)).astype(np.float32))
    found = [rng.choice(1000, n, replace=False) for n in (0, 1, 5, 60, 900)] + [fm.buckets.copy()]
    got = fm.score(fm.rows(found))
    assert got == pytest.approx([plain_score(fm, f) for f in found], abs=1e-5)


def test_pairs_are_learned_that_no_sum_of_terms_can_tell():
    """Toxic is an insult beside a group, not either alone: half of each kind of text."""
    rng = random.Random(5)
    made = [(f"{'idiot' if a else 'friend'} {'them' if b else 'table'} " + " ".join(rng.choices("one two three four five six".split(), k=6)), float(a and not b or b and not a)) for a in (0, 1) for b in (0, 1) for _ in range(60)]
    found, y = [toxicity.terms(t) for t, _ in made], np.array([v for _, v in made])
    fm = toxicity.fit(found, y)
    assert ((fm.score(fm.rows(found)) >= 0.5) == y).all()
    fm.v = fm.v * 0  # without its factors the machine is a sum of terms
    assert ((fm.score(fm.rows(found)) >= 0.5) == y).mean() < 0.8


def test_labels_of_one_kind_or_none_give_the_base_rate():
    assert toxicity.fit([], np.zeros(0)).score(np.zeros((1, 0), np.float32))[0] == pytest.approx(0.5)
    one = toxicity.fit([np.array([1])] * 8, np.zeros(8))
    assert one.score(one.rows([np.array([1]), np.zeros(0, np.int64)])) == pytest.approx([0.1, 0.1])


def reader(seed, hidden=3, kind=np.float64):
    rng = np.random.default_rng(seed)
    return langid.Reader(rng.normal(0, 0.5, (257, 3 * hidden)).astype(kind), rng.normal(0, 0.5, (hidden, 3 * hidden)).astype(kind))


def plain_states(r, data):
    k = r.u.shape[0]
    h, out = [0.0] * k, []
    sig = lambda a: 1 / (1 + math.exp(-a))
    for b in data:
        mix = lambda col, hs: float(r.e[b, col]) + sum(hs[i] * float(r.u[i, col]) for i in range(k))
        z, q = [sig(mix(j, h)) for j in range(k)], [sig(mix(k + j, h)) for j in range(k)]
        n = [math.tanh(mix(2 * k + j, [q[i] * h[i] for i in range(k)])) for j in range(k)]
        h = [(1 - z[j]) * h[j] + z[j] * n[j] for j in range(k)]
        out.append(h)
    return out


def test_states_are_those_of_a_plain_loop():
    r, data = reader(1), b"abc \xd0\xb6!"
    x = np.frombuffer(data, np.uint8).astype(np.int64)[:, None]
    assert r.forward(x)[0][:, 0] == pytest.approx(np.array(plain_states(r, data)), abs=1e-6)


def test_gradients_are_those_of_small_changes():
    r = reader(2)
    rng = np.random.default_rng(0)
    x = rng.integers(97, 102, (7, 2))
    weigh = rng.normal(0, 1, (7, 2, 3))

    def run(r):
        hs = np.zeros((2, 3))
        out, parts = [], []
        for t in range(len(x)):
            new, z, q, n = r.step(x[t], hs)
            parts.append((hs, z, q, n))
            hs = new
            out.append(new)
        return float((np.array(out) * weigh).sum()), parts

    de, du = r.backward(x, run(r)[1], weigh)
    for grad, p in ((de, r.e), (du, r.u)):
        for _ in range(40):
            at = tuple(rng.integers(0, s) for s in p.shape) if p is r.u else (int(rng.integers(97, 102)), int(rng.integers(0, 9)))
            old, step = p[at], 1e-5
            p[at] = old + step
            up = run(r)[0]
            p[at] = old - step
            down = run(r)[0]
            p[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


@pytest.fixture(scope="module")
def model():
    texts = [("the cat sat on the mat and the dog ran to it", "en"), ("der hund und die katze sind in dem haus mit uns", "de")]
    rng = random.Random(1)
    made = [(" ".join(rng.choices(t.split(), k=9)).encode(), v) for t, v in texts for _ in range(150)]
    return langid.fit([a for a, _ in made], [b for _, b in made], epochs=6)


def test_documents_are_means_over_their_bytes(model):
    texts = [b"the cat sat", b"und der hund ist da", b"x", "жук the".encode()]
    got = model.documents(texts)
    for t, p in zip(texts, got, strict=True):
        f, g = plain_states(model.fore, t), plain_states(model.back, t[::-1])[::-1]
        z = np.concatenate([f, g], axis=1) @ model.w + model.b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        assert p == pytest.approx((e / e.sum(axis=1, keepdims=True)).mean(axis=0), abs=1e-4)
    assert model.documents(texts[::-1])[::-1] == pytest.approx(got, abs=1e-5)
    assert [model.langs[i] for i in got.argmax(axis=1)[:2]] == ["en", "de"]


def test_segments_are_near_whole_runs_and_long_texts_are_read_whole(model):
    rng = random.Random(2)
    long = " ".join(rng.choices("the cat sat on the mat und der hund ist da".split(), k=900)).encode()
    f, g = plain_states(model.fore, long), plain_states(model.back, long[::-1])[::-1]
    z = np.concatenate([f, g], axis=1) @ model.w + model.b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert len(long) > 3 * langid.SEGMENT and model.documents([long])[0] == pytest.approx((e / e.sum(axis=1, keepdims=True)).mean(axis=0), abs=0.05)  # segments forget where they began, nearly
    million = b"the cat sat on the mat " * 30_000 + b"und der hund ist in dem haus " * 12_000  # its end counts as much as its beginning
    p = model.documents([million])[0]
    assert p.sum() == pytest.approx(1, abs=1e-3) and 0.2 < p[model.langs.index("de")] < 0.6


def test_both_directions_at_once_are_the_single_steps():
    """Lanes come last, and shut gates of padding leave states as they were."""
    rng = np.random.default_rng(11)
    k = langid.HIDDEN
    fore, back = (langid.Reader(rng.normal(0, 0.7, (257, 3 * k)).astype(np.float32), rng.normal(0, 0.7, (k, 3 * k)).astype(np.float32)) for _ in range(2))
    for r in (fore, back):
        r.e[256, :k] = -1e4
    m = langid.Model(["a", "b", "c"], fore, back, rng.normal(0, 1, (2 * k, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    x = rng.integers(0, 256, (40, 7))
    x[25:, 2] = 256
    want = np.concatenate([fore.forward(x)[0], back.forward(x[::-1])[0][::-1]], axis=2) @ m.w + m.b
    got = m.logits(x)
    assert got.shape == (40, 3, 7)
    assert got == pytest.approx(want.transpose(0, 2, 1), abs=1e-4)
