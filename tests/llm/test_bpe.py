import random

import numpy as np
import pytest
import tiktoken

from tidemill.llm.bpe import Encoder, count_tokens, default_pattern, default_vocabulary, encode_corpus


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary(), default_pattern())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=encoder.ranks, special_tokens={})


def split(ids, ends):
    return [p.tolist() for p in np.split(ids, ends[:-1])] if len(ends) else []


def texts(seed, n=400):
    rng = random.Random(seed)
    parts = ["the ", " and", "ing", "日本", "円", "ファンド", "é", "👩‍💻", "12", "3456", "\n", "  ", "\t", "'s", "<|endoftext|>", "​", "ｶﾅ", "aa", "ab", "ba", "…", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_against_another_implementation(encoder, reference):
    for seed in range(3):
        some = texts(seed)
        assert split(*encoder.encode(some)) == [reference.encode_ordinary(t) for t in some]


def test_the_exact_merge_is_bpe(encoder):
    def naive(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: encoder.ranks.get(parts[i] + parts[i + 1], 10**9))
            if parts[best] + parts[best + 1] not in encoder.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [encoder.ranks[p] for p in parts]

    for t in texts(9, 60):
        word = t.encode()[:80]
        if word:
            assert encoder.merge(word) == naive(word)


def test_failing_words_exist_and_are_mended(encoder, reference):
    """Greedy cuts alone are wrong often enough for the check to matter."""
    words = [w for t in texts(5) for w in encoder.split(t)]
    wrong = [w for w in set(words) if encoder._greedy_one(w.encode()) != reference.encode_ordinary(w)]
    assert wrong and all(split(*encoder.encode([w])) == [reference.encode_ordinary(w)] for w in wrong[:50])


def test_empty_null_long_and_forgetting(encoder, reference, monkeypatch):
    import tidemill.llm.bpe as module

    long = ["a" * 5000, "日本語" * 3000, "ab " * 4000, "x" + "é" * 700]
    assert split(*encoder.encode(["", None, *long])) == [[], [], *(reference.encode_ordinary(t) for t in long)]
    assert encoder.lengths(["", None, "hello world"]).tolist() == [0, 0, 2]
    assert encoder.encode([])[0].tolist() == []
    monkeypatch.setattr(module, "MEMORY", 5)
    for _ in range(3):
        assert split(*encoder.encode(texts(7, 20))) == [reference.encode_ordinary(t) for t in texts(7, 20)]


def test_corpus_round_trip(spark, encoder):
    rows = [(i, t, "clash") for i, t in enumerate(texts(11, 50))] + [(99, None, "x"), (100, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "doc_id", "text").collect()}
    assert len(got) == 52 and got[99] == got[100] == []
    for i, t, _ in rows[:50]:
        assert b"".join(encoder.bytes_of[x] for x in got[i]).decode() == t
    assert {r["doc_id"]: r["tokens"] for r in count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
