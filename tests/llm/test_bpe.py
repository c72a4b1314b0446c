"""Encoding by shared chunks against the tokenizers library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from cadence.llm import bpe

from .cases import awkward, none


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.path())


def check(spark, tok, docs):
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(docs, bpe.path()), bpe.path()).collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], ids, tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_passages_that_texts_share(spark, tok):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéüñ'ABC0123,.#", k=rng.randrange(1, 9)))
    shared = [rng.choice([" ", "\n"]).join(word() for _ in range(150)) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(shared), " ".join(word() for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    docs = frame(spark, texts)
    assert bpe.shared_filter(docs, "text") is not None
    check(spark, tok, docs)


def test_texts_that_are_hard_to_cut(spark, tok):
    run = "汉字仮名交じり文" * 200
    base = ("it's we'll they'd I'M 3.14 x'y ''s 'Tis <b>bold</b> a<|endoftext|>b <|startoftext|> <|endoftext| > ﬁ Å Å é ́ x  y z\x1c\x85 İI Σς ß ẞ 👩‍👩‍👧 "
            "tab\tfeed\x0bform\x0creturn\rline\n" + "q" * 300 + " " + "don't" * 60 + " ")
    texts = [base * 5, "x" + base * 5, base * 3 + run, run + base * 3, run, run * 2, "<|endoftext|>" * 100, "<|ENDOFTEXT|> <|EndOfText|>x Ab " * 60, " " * 500, "a " * 3000, "ab" * 3000, base[::-1] * 4, "y" + base[::-1] * 4, "́" * 700, " ́" * 700]
    check(spark, tok, frame(spark, texts + texts))


def test_a_passage_that_all_texts_hold(spark, tok):
    rng = random.Random(6)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(300))
    check(spark, tok, frame(spark, [f"{i} {passage} {i * 7} {passage[i:]}" for i in range(900)]).repartition(3))


def test_rows_that_repeat(spark, tok):
    text = " ".join(str(i) for i in range(500))
    check(spark, tok, spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text), (1, "short"), (1, "short")], "doc_id long, text string").repartition(4))


def test_awkward_tables(spark, tok):
    check(spark, tok, awkward(spark))
    assert bpe.encode(none(spark), bpe.path()).count() == 0


def test_a_core_is_encoded_as_in_its_text(tok):
    rng = random.Random(7)
    data = bpe.clean(" ".join("".join(rng.choices("abcé,'s1", k=rng.randrange(1, 8))) for _ in range(2000)))
    encode = bpe.Encoder(tok.to_str())
    found, at, pieces = bpe.cores(data), 0, []
    assert len(found) > 10
    for a, z, _ in found:
        pieces += [data[at:a], data[a:z]]
        at = z
    assert b"".join(encode([*pieces, data[at:]])) == encode([data])[0]


def test_a_tokenizer_that_keeps_white_space_is_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(none(spark), bpe.path("byte_bpe_50k.json"))
