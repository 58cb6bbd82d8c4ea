import random

import public_tokenizers
import sentencepiece

from quillspark.llm import token_counts


def test_equals_the_library(spark, docs_of, texts_of):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(4)
    odd = [None, "", " ", "   ", "a  b", " a", "a ", "\n", "a\nb", "a \n b", "\n\n  x", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "aaaaaaaaaa", "ﬁ Ⅻ 你好 🙂", "\t\x00\u3000", "é́", "x" * 3000, "ab" * 2000 + " " * 40]
    odd += ["".join(rnd.choice(" \nab.the▁éx") for _ in range(rnd.randrange(40))) for _ in range(300)]
    texts = {**texts_of, **{-k - 1: t for k, t in enumerate(odd)}}
    rows = token_counts.count_tokens(docs_of(list(texts.values()), list(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(model.encode(text)), repr(text)
        assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.count_tokens(docs_of([])).count() == 0
