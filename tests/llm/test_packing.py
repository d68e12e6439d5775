"""Packed ids against the tokenizer with its own settings."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from auditlake.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_of_the_added_token(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 2, f"x{end}\n\n  y", f"a  {end}  z{end}", "<|endoftext| >", f"{end[:-1]}{end}", ("ab c" * 30_000 + end + " d e" * 30_000)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).collect()
    for doc_id, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids) for r in own)


def test_chunks_have_the_ids_of_whole_texts(monkeypatch):
    tokenizer, draw = Tokenizer.from_file(TOKENIZER), np.random.default_rng(6)
    alphabet = [*"aB1?'éß漢🙂<\n\t\r\x1c\x85\xa0\u180e\u1680\u2003\u2028\u3000\u200b", "  ", " ", " ", "'s", "<|endoftext|>", "<|endof", "\n\n"]
    made = ["".join(draw.choice(alphabet, int(draw.integers(0, 14)))) for _ in range(4000)]
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 500)
    encoder = packing.ChunkEncoder(TOKENIZER)
    got = [ids for at in range(0, len(made), 100) for ids in encoder.encode(made[at : at + 100])]
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in made]


def test_words_are_learned_once_whatever_marks_follow():
    encoder = packing.ChunkEncoder(TOKENIZER)
    encoder.encode([" alpha größe alpha, größe. alpha's größe) alpha!? größe"])
    assert {c for c in encoder.young if "a" in c or "ö" in c} == {" alpha", " größe"}


def test_chunks_end_only_where_a_match_ends():
    tokenizer, draw = Tokenizer.from_file(TOKENIZER), np.random.default_rng(7)
    alphabet = [*"abzÀÖ×Øö÷øÿŁłªµºß09¼²_'-.,!?`{}[]^\\/@<>|~…—’“«»́­‍\n\t", " ", " ", "'s", "'ll", "'", "word", "größe"]
    made = ["".join(draw.choice(alphabet, int(draw.integers(1, 16)))) for _ in range(6000)]
    encoder = packing.ChunkEncoder(TOKENIZER)
    got = [ids for at in range(0, len(made), 100) for ids in encoder.encode(made[at : at + 100])]
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in made]
