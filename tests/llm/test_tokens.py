import random

import numpy as np
import pytest

from quiver.llm.tokens import PATTERN, Encoder, Merges, encode_documents, parse_ranks

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = parse_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(exact):
    ranks, reference = exact
    rng = random.Random(4)
    letters = "abcdeétionß日本 \n\t'’123.,;-–🙂́​İXYZ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["a" * 4000, "ab" * 2000, " " * 700, "'" * 300, "<|endoftext|>", None, ""]
    e = Encoder(ranks, memory=500)
    want = [reference.encode_ordinary(t) if t else [] for t in texts]
    got = []
    for i in range(0, len(texts), 200):
        got += e.encode(texts[i : i + 200]).to_pylist()
    assert got == want
    assert 0 < e.merged  # some words failed the check of pairs and were merged


def test_second_implementation(exact):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["The 12 o'clock \u2014 na\u00efve\n\n  caf\u00e9s", "<|endoftext|>x", "\u65e5\u672c\u8a9e \U0001f642\U0001f642", "\u00a7\u00a7 17a, 18b BGB", "a\u0301\u00a0b\tc"]
    assert Encoder(exact[0]).encode(texts).to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, exact, data):
    _, reference = exact
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_documents(docs, FILE).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got == {k: reference.encode_ordinary(t) if t else [] for k, t in texts.items()}


def test_round_trip_and_edges(spark, exact):
    _, reference = exact
    rows = [(1, None, 0), (2, "", 0), (3, "tie", 1), (3, "tie", 1), (4, "x" * 300_000 + " ende", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = encode_documents(df, FILE).collect()
    assert len(out) == 5 and out[0].__fields__ == ["doc_id", "ids"]
    back = sorted((r.doc_id, reference.decode(r.ids)) for r in out)
    assert back == sorted((k, t or "") for k, t, _ in rows)
    assert encode_documents(df.limit(0), FILE).count() == 0


def test_pairs_are_judged_as_merging_would(exact):
    ranks, _ = exact
    e, token = Encoder(ranks), {r: b for b, r in ranks.items()}
    m, rng, ids = e.merges, np.random.default_rng(3), np.array(sorted(ranks.values()))
    assert all(m.whole[r] == (e.merge(token[r]) == [r]) for r in ids[::7].tolist())
    for few in (300, 3000, len(ids)):  # short entries are merged with what follows more often
        x, y = rng.choice(ids, 4000), rng.choice(ids[:few], 4000)
        want = [e.merge(token[a] + token[b]) == [a, b] for a, b in zip(x.tolist(), y.tolist())]
        assert m.apart(x, y).tolist() == want and 0 < sum(want) < 4000


def test_only_failing_words_are_merged(exact, data):
    import pyarrow.parquet as pq

    ranks, _ = exact
    e, asked = Encoder(ranks), []
    merge = e.merge
    e.merge = lambda word: asked.append(word) or merge(word)
    e.encode(pq.read_table(f"{data}/documents.parquet").column("text").to_pylist())
    raw = {w.encode("utf-8", "surrogatepass") for w in e.words}
    assert len(asked) == len(set(asked)) == e.merged < len(raw)
    fails = {w for w in raw if e.propose(w) != merge(w)}
    assert fails <= set(asked) <= raw


def test_a_vocabulary_with_entries_that_merging_never_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"xyz": 260, b"aa": 261, b"aaaa": 262}
    e = Encoder(ranks, pattern=r"\S+|\s+")
    assert not e.merges.whole[260] and e.merges.whole[258] and e.merges.whole[262]
    words = ["abc", "abcd", "bcd", "xyz", "aaaaaaa", "cabcd", "x", ""]
    assert e.encode(words).to_pylist() == [e.merge(w.encode()) for w in words]
    assert Merges({}).width == 1
