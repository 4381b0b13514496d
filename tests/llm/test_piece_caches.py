"""Encoders with small caches: the same ids, and no more memory or workers than they say."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from marlpit.llm import bpe, token_store
from tokenizers import Tokenizer

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "abcXYZéÀßÿ÷×ªµº'’.,!\\]^_`{|}~<>#12 ٣ \n\t  ́İſK中😀-"


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["x" * 200, " " + "é" * 90 + ",.", "'s", "don't's' s", "plain words, plain. Plain!"]


def test_byte_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 300)
    own, like = bpe.Codec(RANKS, PATTERN), tiktoken.Encoding("like", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = odd_texts(2000)
    for at in range(0, len(texts), 64):
        for text, ids in zip(texts[at : at + 64], own.encode(texts[at : at + 64])):
            assert np.frombuffer(ids, "<u4").tolist() == like.encode_ordinary(text)
            assert bpe.speller(RANKS).decode(ids) == text.encode()
        assert len(own.pieces) <= 300 and len(own.older) <= 300


def test_round_trip_has_one_worker_a_task(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Zwölf words, and 34."), (2, None)], "doc_id long, text string")
    out = corpus_pipeline.bpe_stage(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_tokens > 0, r.round_trip) for r in out.collect()} == {1: (True, True), 2: (False, True)}


def test_words_of_letters_go_to_the_model_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_store.WordEncoder(path, 2)
    monkeypatch.setattr(own, "_learn", lambda words: [own.words[w] for w in words])  # fails if asked
    texts = ["Über words, and words. WORDS!! façade:", "über, Façade; and###"]
    assert [np.frombuffer(i, own.kind).tolist() for i in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_words_are_those_of_the_tokenizer(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(token_store, "MAX_WORDS", 400)
    own = token_store.WordEncoder(path, 2)
    texts = odd_texts(2000) + ["a<|endoftext|>, b<|ENDOFTEXT|>. <|startoftext|>", "endoftext|>", "H̱, ẖ. İ, ΑΣ, ſ.", "\0a, a\0"]
    for at in range(0, len(texts), 64):
        for text, ids in zip(texts[at : at + 64], own.encode(texts[at : at + 64])):
            assert np.frombuffer(ids, own.kind).tolist() == plain.encode(text, add_special_tokens=False).ids + [2]
