"""Ids of texts that hold the tokenizers file's added token."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hindsail.llm import packing


def test_added_token_is_one_id(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", "no such string", "é <|ENDOFTEXT|> 12"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in packing.tokenize(df, with_ids=True).collect()}
    for i, ids in enumerate(want):
        assert rows[i].ids == [*ids, packing.END_ID] and rows[i].length == len(ids) + 1
        assert rows[i].ids_crc32 == zlib.crc32(np.array(rows[i].ids, "<u4").tobytes())
