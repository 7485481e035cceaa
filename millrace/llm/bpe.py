"""Byte-level BPE encoding and decoding by forced boundaries.

A byte pair that lies inside no token of the vocabulary can never be merged
over, so every place in a text where such a pair stands is a certain cut. A
text is cut there, each fragment is encoded on its own (most are words that
recur, so their ids are kept), and the ids are concatenated.

Three kinds of certain cut are left out, because the pre-tokenizer's pattern
looks across them: after white space (its rule for trailing blanks looks one
character ahead), beside an apostrophe (contractions) and inside a character.

Defined results: a null or empty text has no ids and decodes to the empty
string; the special token's string in a text is that token, as the tokenizers
library has it; repeated rows give repeated results; extra columns pass through
unless they are named like an output, which then replaces them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fragments longer than this are encoded but not kept.
KEPT_BYTES = 48
#: Fragments kept by each worker; the store is emptied when full.
KEPT_FRAGMENTS = 300_000
#: Text bytes that are encoded before their rows go out.
OUT_BYTES = 4 << 20
_BLANK = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, by rule: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in visible}
    return out | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(visible))}


class ForcedBoundaryCodec:
    """Encodes and decodes texts with the byte-level BPE of a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        odd = [t["content"] for t in spec["added_tokens"] if not t["special"] or any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
        if odd:
            raise ValueError(f"added tokens that take in what stands around them aren't supported: {odd}")
        alphabet = byte_alphabet()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cuts = self._certain_cuts(self.pieces[i] for i in spec["model"]["vocab"].values())
        self.known: dict[bytes, bytes] = {}
        size = 1 + max(self.pieces)
        self.length = np.zeros(size, dtype=np.int64)
        self.length[list(self.pieces)] = [len(x) for x in self.pieces.values()]
        self.start = np.zeros(size, dtype=np.int64)
        self.start[list(self.pieces)] = np.cumsum([0, *(len(x) for x in self.pieces.values())])[:-1]
        self.flat = np.frombuffer(b"".join(self.pieces.values()), dtype=np.uint8)
        self.fast = self._ranked(spec["model"])

    def _ranked(self, model: dict):
        """An encoder by ranks, where the vocabulary's ids are in the order of its merges; else None."""
        import public_tokenizers
        import tiktoken

        ids, pairs = model["vocab"], (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merged = [ids.get(a + b, -1) for a, b in pairs]
        if merged != sorted(set(merged)) or len(ids) != len(merged) + 256 or merged[0] != 256:
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.pieces[i]: i for i in ids.values()}, special_tokens={})

    @staticmethod
    def _certain_cuts(tokens) -> np.ndarray:
        """For each byte pair whether it's a cut: in no token, and not of the three kinds left out."""
        inside = np.zeros(65536, dtype=bool)
        for t in tokens:
            b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] << 8 | b[1:]] = True
        cut = ~inside.reshape(256, 256)
        cut[[*range(9, 14), *range(28, 33)], :] = False
        cut[ord("'"), :] = cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False
        return cut.reshape(-1)

    def fragments(self, text: bytes) -> list[bytes]:
        """The pieces of a text between its certain cuts."""
        b = np.frombuffer(text, dtype=np.uint8)
        at = self.cuts[b[:-1].astype(np.uint16) << 8 | b[1:]]
        if text.isascii() is False:
            for m in _BLANK.finditer(text):
                if m.end() <= len(at):
                    at[m.end() - 1] = False
        ends = (np.flatnonzero(at) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)], strict=True)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids (as bytes of int32) of fragments."""
        texts = [f.decode() for f in new]
        found = map(self.fast.encode_ordinary, texts) if self.fast else (e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))
        out = {f: array("i", ids).tobytes() for f, ids in zip(new, found, strict=True)}
        if len(self.known) + len(out) > KEPT_FRAGMENTS:
            self.known.clear()
        self.known.update((f, x) for f, x in out.items() if len(f) <= KEPT_BYTES)
        return out

    def code(self, text: str | None) -> bytes:
        """The ids of a text (as bytes of int32)."""
        ids: list[bytes] = []
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
            elif part:
                fragments = self.fragments(part.encode())
                pairs = list(map(self.known.get, fragments))
                if None in pairs:
                    new = self._learn(list({f for f, p in zip(fragments, pairs, strict=True) if p is None}))
                    pairs = [new[f] if p is None else p for f, p in zip(fragments, pairs, strict=True)]
                ids += pairs
        return b"".join(ids)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, one token after another."""
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ids) else 0)]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.code(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(np.array(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One codec a worker process and file."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def bpe(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` without its ``text``, with the ids of the whole text and the text they decode to.

    ``path`` is where each executor has the vocabulary file.
    """
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts, start = batch.column(batch.schema.get_field_index(text)), 0
            while start < batch.num_rows:
                coded, size = [], 0
                for value in texts.slice(start):
                    coded.append(coder.code(value.as_py()))
                    size += len(coded[-1]) + 64
                    if size >= OUT_BYTES:
                        break
                yield _batch(coder, batch.slice(start, len(coded)), kept, coded, ids, decoded)
                start += len(coded)

    return df.select(*kept, text).mapInArrow(run, schema)


def _batch(coder: ForcedBoundaryCodec, batch: pa.RecordBatch, kept: list[str], coded: list[bytes], ids: str, decoded: str) -> pa.RecordBatch:
    joined = b"".join(coded)
    offsets = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
    numbers = np.frombuffer(joined, dtype=np.int32)
    values = pa.Array.from_buffers(pa.int32(), len(numbers), [None, pa.py_buffer(joined)])
    ends = np.concatenate(([0], np.cumsum(coder.length[numbers])))[offsets].astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(coded), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(coder.bytes_of(numbers).tobytes())])
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), values), texts], names=[*kept, ids, decoded])
