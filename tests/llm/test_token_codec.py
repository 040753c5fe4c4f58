"""The piece codec against the tokenizers library on whole texts."""

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from chronostore.llm import token_codec  # noqa: E402

ODD = [
    "", " ", "\n", "Ab,ab Ab", "don't we're IT'S", "It's'", "a\n\nb", "\nA b", "x \ny", "İstanbul ΣΑΣ é Éa é,", "\x1ca b", "n\x00u \x00b", "<|endoftext|> a<|startoftext|>b",
    "Straße... ÀÉ,!", "ªº µm ÿŸ", "a_b (c) d-e 12,3", "foo.\nBar,\nbaz", "a,\n,b\n,", "x y z w", "aa%%%\taa", "tail ", "日本語 текст, слово.",
]
TEXTS = [*ODD, *(a + " " + b for a in ODD for b in ODD), None, "word " * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [3, 2_000, 16 << 20])
def test_equals_the_library(name, limit, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codec, "BATCH_BYTES", 2_000)
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    want = [np.asarray(whole.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in TEXTS]
    codec = token_codec.PieceCodec(path, limit)
    assert codec.bare
    assert list(codec.ids(pa.array(TEXTS, pa.string()))) == want
    assert list(codec.ids(pa.array(TEXTS[:50], pa.string()))) == want[:50]  # words known from before
    assert list(codec.ids(pa.array([], pa.string()))) == []


def test_few_megabytes_are_held_as_pieces(monkeypatch):
    """However much text an Arrow batch has, 4 MB of it and a text are cut at a time, and Arrow's memory is handed back."""
    held, handed_back, cut = [], [], token_codec.PieceCodec._ids

    class Pool:
        def release_unused(self):
            handed_back.append(1)

    def ids(self, texts):
        held.append(sum(len(t) for t in texts.to_pylist()))
        yield from cut(self, texts)

    monkeypatch.setattr(token_codec.PieceCodec, "_ids", ids)
    monkeypatch.setattr(token_codec.pa, "default_memory_pool", Pool)
    texts = pa.array([None if i % 7 == 0 else f"some words {i} " * 500 for i in range(2000)], pa.string())
    got = list(token_codec.PieceCodec(public_tokenizers.path("byte_bpe_50k.json")).ids(texts))
    assert len(got) == 2000 and max(held) <= (4 << 20) + 8_500 and len(handed_back) == len(held) > 2
