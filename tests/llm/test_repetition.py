import random

import numpy as np
import pyarrow as pa

from quiver.llm import boosted_trees
from quiver.llm.queries import LEAST_SHARE, LEAST_WORDS
from quiver.llm.repetition import cheap_statistics, document_statistics, repeated_documents, statistics


def share(text, window=6):
    """By the rule, one word at a time."""
    import regex

    words = [w.lower() for w in regex.findall(r"\p{L}+", text or "")]
    seen, inside = set(), [False] * len(words)
    for i in range(len(words) - window + 1):
        gram = tuple(words[i : i + window])
        if gram in seen:
            inside[i : i + window] = [True] * window
        seen.add(gram)
    return sum(inside) / max(1, len(words)), len(words)


def texts():
    rng = random.Random(8)
    out = [None, "", "eins", "a b c d e f", "a b c d e f a b c d e f", "A b, c\nd-e f 7 a B c d E f", "x " * 500, "été " * 12 + "naïve"]
    for _ in range(300):
        parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(4)]
        out.append(rng.choice([" ", "\n", ". "]).join(rng.choice(parts) for _ in range(rng.randint(1, 9))))
    return out


def test_shares_against_brute_force():
    t = texts()
    s = statistics(pa.array(t, pa.string()))
    for i, x in enumerate(t):
        assert (s["share"][i], s["words"][i]) == share(x), x
        assert s["twice"][i] >= s["share"][i]
        if s["share"][i] > 0:
            assert s["longest"][i] >= 6


def test_lines():
    s = statistics(pa.array(["ab\ncd\nab\r\nab", "x\ry\nz"]))
    assert s["line_share"].tolist() == [0.5, 0.0]


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnr") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_cheap_statistics():
    rng = random.Random(3)
    part = prose(rng, 40)
    twice = f"{part}. {part.upper().replace(' ', chr(10))}"
    t = [None, "", "a", part, twice, f"{part} {prose(rng, 40)}", "été " * 40, "本" * 90, twice + "é" * 5000]
    for array in (pa.array(t, pa.string()), pa.array(["zz", *t, "zz"], pa.string()).slice(1, len(t))):
        c, unknown = cheap_statistics(array)
        assert c["starts"].tolist()[:6] == [0, 0, 1, 40, 80, 80] and unknown.tolist() == [False] * 6 + [True] * 3
        assert c["again"][:4].tolist() == [0] * 4 and c["again"][4] >= 0.45 and c["run"][4] >= 36 and c["again"][5] == 0
    both, _ = cheap_statistics(pa.array([part, part]))  # what another text holds isn't seen
    assert both["again"].tolist() == [0, 0]
    assert len(cheap_statistics(pa.array([], pa.string()))[1]) == 0


def test_documents_chosen_by_trees(spark):
    rng, t = random.Random(9), texts()
    for _ in range(600):
        part, others = prose(rng, rng.randint(10, 60)), [prose(rng, rng.randint(5, 60)) for _ in range(3)]
        t.append(rng.choice([" ", "\n", ". "]).join(rng.sample([*others, *[part] * rng.choice([1, 1, 1, 1, 2, 4])], 3)))
    df = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(t)], "doc_id long, text string, share double")
    rows = repeated_documents(df).collect()
    cases = {i for i, x in enumerate(t) if (s := share(x))[0] >= LEAST_SHARE and s[1] >= LEAST_WORDS}
    assert {r.doc_id for r in rows if r.share >= LEAST_SHARE and r.words >= LEAST_WORDS} == cases and len(cases) > 50
    assert len(rows) < len(t)  # some weren't counted
    assert all((r.share, r.words) == share(t[r.doc_id]) for r in rows)
    plain = df.filter("doc_id >= 308").filter(~df.doc_id.isin([i for i in cases]))
    assert repeated_documents(plain).count() == plain.count()  # a sample without a case sets nothing aside
    assert repeated_documents(df.limit(0)).count() == 0 and document_statistics(df.limit(0)).count() == 0


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] > 0.3)).astype(float)
    m = boosted_trees.fit(x[:2000], y[:2000], np.array([1, 1, 0]))
    assert ((m.score(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    for f in (0, 1):
        for row in rng.random((50, 3)):
            line = np.repeat(row[None], 40, axis=0)
            line[:, f] = np.linspace(0, 1, 40)
            assert (np.diff(m.score(line)) >= -1e-12).all()
    one = boosted_trees.fit(np.zeros((0, 3)), np.zeros(0), np.array([1, 1, 1]))
    assert np.isfinite(one.score(np.zeros((2, 3)))).all()

