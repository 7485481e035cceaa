import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "B", " ", "  ", "\n", "\n\n\n", "\t", "'s", "'", "%'", "'re", "é", "ß", "\u00a0", "\u2003", "\u3000", "\u2028", "%", "...", "1", "23", "<|endoftext|>", "<|", "日本", "😀", "\x1c", "\u0301", "xq", "\r\n", "\x85", "word"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join) | st.text(max_size=30))
def test_as_the_library(text):
    codec = bpe.codec(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids and codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_library_engine(monkeypatch):
    codec = bpe.ForcedBoundaryCodec(PATH)
    codec.fast = None
    for text in ("Some words, some 12 more.\n\n Ünd", "x" * 5000, ""):
        assert codec.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cuts_are_forced():
    codec = bpe.codec(PATH)
    text = "The quick brown fox. Élan!\nNext".encode()
    parts = codec.fragments(text)
    assert b"".join(parts) == text and len(parts) > 4


@pytest.mark.parametrize("out_bytes", [64, 1 << 22])
def test_table(documents, prose, monkeypatch, out_bytes):
    monkeypatch.setattr(bpe, "OUT_BYTES", out_bytes)
    monkeypatch.setattr(bpe, "KEPT_FRAGMENTS", 50)
    got = sorted((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.bpe(documents.withColumnRenamed("lang", "ids"), PATH).collect())
    assert got == sorted((i, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in prose)
    assert bpe.bpe(documents.limit(0), PATH).count() == 0


def test_files_with_other_added_tokens_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"lstrip": True}, {"special": False}, {"single_word": True}):
        odd = spec | {"added_tokens": [spec["added_tokens"][0] | change]}
        (tmp_path / "odd.json").write_text(json.dumps(odd), encoding="utf-8")
        with pytest.raises(ValueError, match="added tokens"):
            bpe.ForcedBoundaryCodec(str(tmp_path / "odd.json"))
