"""Very long texts, and values just beyond what the patterns take."""

import random
import resource
import time

import numpy as np
import pytest
from test_operators import docs

from tideline.llm import bpe, licenses, pii, quality


@pytest.fixture(scope="module")
def codec():
    with bpe.codec() as one:
        yield one


def test_contracted_in_arrays_as_in_rows(codec, monkeypatch):
    rng = random.Random(2)
    pieces = ["a" * 5000, "ab" * 700, "".join(rng.choice("abcdeé") for _ in range(900)), "".join(rng.choice("etaoin") for _ in range(2500)), "=" * 3001, "ththth" * 99, "x", "zq" * 120]
    want = [list(codec.merge([p.encode()], len(p) > bpe.LONG)) for p in pieces]
    for p, found in zip(pieces, want):
        ((_, ids),) = found
        ids = ids.flatten().to_numpy()
        assert codec.contract(p.encode()).tolist() == ids.tolist()


def test_long_text_in_blocks(spark, codec, monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)) + " É\n\n 12345 it's"
    want = codec.encode([text])[0]
    monkeypatch.setattr(bpe, "PIECES", 37)
    assert np.concatenate(list(codec.encode_long(text))).tolist() == want.tolist()
    monkeypatch.setattr(bpe, "DECODED", 101)
    assert b"".join(b for _, b in codec.decode([want])) == text.encode()
    rows = [(1, text), (2, None), (3, "a"), (4, text + "!")]
    a, b = ({r.doc_id: r for r in bpe.encoded(docs(spark, rows), batch_bytes=n).collect()} for n in (1000, 1 << 20))
    assert a == b and list(a[1].ids) == want.tolist()


def test_ten_million_letters_within_memory(codec):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = 0
    for ids in codec.encode_long("a" * 10_000_000):
        n += sum(len(b) for _, b in codec.decode([ids]))
    assert n == 10_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB


def test_licences_linear_in_template_words(spark):
    words = sorted(licenses.template_words(licenses.TEMPLATES[4][2]))
    text = lambda n: " ".join((words * (n // len(words) + 1))[:n])
    took = []
    for n in (2_000, 2_000, 16_000):
        began = time.perf_counter()
        (row,) = licenses.licenses(docs(spark, [(1, text(n))])).collect()
        took.append(time.perf_counter() - began)
        assert row.n_words == n and "mit" in row.labels.split(",")
    assert took[2] < 12 * took[1]


def test_repeated_words_by_numbers(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(6, 60))]
        monkeypatch.setattr(quality, "LONG_TEXT", 1 << 30)
        want = quality.repeated_words(words)
        monkeypatch.setattr(quality, "LONG_TEXT", 0)
        assert quality.repeated_words(words) == want


def test_long_texts_are_counted():
    words = [f"w{i % 99_991}" for i in range(300_000)]
    assert quality.repeated_words(words) == 300_000
    assert quality.repeated_words([f"w{i}" for i in range(120_000)]) == 0


@pytest.mark.parametrize("share,want", [(0.5, 5.348), (0.95, 12.592), (0.999, 22.458), (1 - 1e-6, 38.258)])
def test_chi_square_exact(share, want):
    assert quality.chi_square(share) == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize(
    "text,value,kind",
    [
        ("password = hunter2 then", "hunter2", "secret"), ("secret='abc'", "'abc'", "secret"), ('password: "two words here" x', '"two words here"', "secret"), ("pwd: x9z.", "x9z.", "secret"),
        ("call 0171-5557713 now", "0171-5557713", "phone"), ("ssn 123 45 6789.", "123 45 6789", "ssn"), ("from 2001:db8::7334 to", "2001:db8::7334", "ip6"), ("FE80:0:0:0:202:B3FF:FE1E:8329", "FE80:0:0:0:202:B3FF:FE1E:8329", "ip6"),
    ],
)
def test_values_that_stayed_in_clear(text, value, kind):
    assert [(text[a:b], k) for a, b, k, _ in pii.find(text)] == [(value, kind)]
    assert value not in pii.replaced(text)[0]


@pytest.mark.parametrize("text", ["password = ab", "the secret: patience wins", "token: none", "at 12:30:45 and 1:2", "std::vector", "0171-5", "900 45 6789", "a secret", "::"])
def test_just_beyond_the_patterns(text):
    assert pii.find(text) == []


def test_spellings_stay_linked():
    new = lambda t: pii.find(t)[0][3]
    assert new("2001:DB8:0::1") == new("2001:db8::1") != new("2001:db8::2")
    assert new("ssn 123 45 6789").replace(" ", "-") == new("ssn 123-45-6789")


def test_key_of_the_session(spark):
    df = docs(spark, [(1, "call 017-555-7713")])
    told = lambda: pii.pseudonymised(df).first().text
    public = told()
    spark.conf.set(pii.KEY_CONF, "another")
    try:
        assert told() != public == pii.pseudonymised(df, pii.KEY).first().text
    finally:
        spark.conf.unset(pii.KEY_CONF)
