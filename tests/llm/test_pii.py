import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, with_clashes, words
from trackweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@..-+ ()0123456789é%")), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_known_spans():
    text = "é mail a.b+c@x-y.example.com, 10.0.0.255 not 1.2.3.256; card 4111 1111-1111 1111 tel +1 (555) 010-9999!"
    assert [text[a:b] for _, a, b in pii.base_spans(text)] == ["a.b+c@x-y.example.com", "10.0.0.255", "4111 1111-1111 1111", "+1 (555) 010-9999"]
    assert pii.base_spans("a" * 300_000 + " " + "9" * 300_000 + "@") == plain("")


def sample(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ws = words(i + seed * 1000, 25)
        ws[r.randrange(25)] = r.choice([f"u{r.randrange(99)}@mail{r.randrange(9)}.example.org", f"10.{r.randrange(256)}.{r.randrange(256)}.7", f"+44 20 {r.randrange(1000, 9999)} {r.randrange(1000, 9999)}"])
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def tagger():
    own = [w for t in sample(220) for w in pii.labelled_windows(t)]
    x, y = (np.array([np.frombuffer(w[k], np.int8) for w in own], dtype=np.int64) for k in (0, 1))
    return pii.train(x, y, passes=8)


def test_gradient_is_the_loss():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    t = pii.train(x[:0], y[:0], hidden=3)
    t.p = {k: v.astype(np.float64) + 0.01 for k, v in t.p.items()}
    _, grad = t.loss_and_gradient(x, y)
    for name, place in (("x", (1, x[0, 3], 2)), ("w", (0, 1, 5)), ("out", (2, 4)), ("bias", (3,)), ("move", (1, 2))):
        ends = []
        for step in (1e-3, -1e-3):
            t.p[name][place] += step
            ends.append(t.loss_and_gradient(x, y)[0])
            t.p[name][place] -= step
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[name][place]) < 2e-3


def test_held_out_accuracy(tagger):
    hit = found = true = 0
    for t in sample(80, seed=7):
        got = set(pii.added_spans([t], [[]], tagger)[0])
        want = set(pii.base_spans(t))
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert hit / found > 0.85 and hit / true > 0.85


def test_windows_join_up(tagger):
    spots = [w for n in (1, 95, 96, 97, 160, 161, 500) for w in [pii.window_starts(n)]]
    assert all(s[0] == 0 and all(0 < b - a <= pii.STRIDE for a, b in zip(s, s[1:])) for s in spots)
    mail = "u7@mail3.example.org"
    hits = sum(any(t[a:b] == mail for _, a, b in pii.added_spans([t], [[]], tagger)[0]) for k in range(0, 200, 7) for t in ["w12 " * (k // 4) + "w" * (k % 4) + "3 " + mail + " w45" * 60])
    assert hits >= 24


def test_tables(spark, tagger):
    texts = [None, "", "no data", "", *sample(5, 3), "x" * 50_000 + " 1.2.3.4 " + "y" * 50_000]
    docs = with_clashes(documents(spark, texts))
    rows = {r.doc_id: r for r in pii.find_personal_data(docs, tagger).collect()}
    for i, t in enumerate(texts):
        want, r = plain(t), rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) and len(rows) == len(texts)
    assert pii.find_personal_data(docs.where("false"), pii.fit(docs.where("false"))).count() == 0
