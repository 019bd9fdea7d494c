"""Units of texts are encoded as joined strings, with the ids that the tokenizer gives for the whole texts."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from wardflow.llm import token_ids
from wardflow.llm.queries import tokenizer_file


class _Counting:
    def __init__(self, inner):
        self.inner, self.strings = inner, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.inner.encode_batch_fast(strings, **options)


def test_joined_units_have_the_ids_of_whole_texts():
    rng = random.Random(4)
    letters = "abcdefgêéßñ中文字 \t\n\r\x0b\x0c\xa0 　\x85\x1c.,;'’!?0123456789-<>|🙂👩‍⚕️́﻿\x00"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(400)] + ["", " ", "\n\n", "a \n", "\x1c b", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "don't  we're", None]
    encoder, plain = token_ids.Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    ids, counts = encoder(pa.array(texts))
    want = [[*plain.encode(x or "", add_special_tokens=False).ids, token_ids.END_ID] for x in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_missing_units_are_not_encoded_one_by_one():
    encoder = token_ids.Encoder(tokenizer_file())
    encoder.tokenizer = counting = _Counting(encoder.tokenizer)
    text = " ".join(f"w{i:x}q" for i in range(20_000))
    ids, counts = encoder(pa.array([text]))
    assert counting.strings < 400
    assert ids[:-1].tolist() == counting.inner.encode(text, add_special_tokens=False).ids


def test_a_group_whose_bounds_no_token_meets_is_encoded_unit_by_unit():
    encoder = token_ids.Encoder(tokenizer_file())
    want = encoder(pa.array([" one two three"]))[0].tolist()
    other = token_ids.Encoder(tokenizer_file())
    other.bytes_of = other.bytes_of + 1
    assert other(pa.array([" one two three"]))[0].tolist() == want
