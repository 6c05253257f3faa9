"""Byte-level BPE against the tokenizers library, with the same vocabulary file."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seguelake.llm import byte_bpe
from seguelake.llm import queries as registered
from seguelake.llm import words as W

PATH = registered.tokenizer_file("byte_bpe_50k.json")
ODD = [
    "", "It's DON'T x'll we've'd 's ''s  's\n's 'sabc 're're", "<|endoftext|> a<|endoftext|>  <|endoftext|>", "a  b   c \n\n d\t\te  ", "  ", "\n", "áb é. ñ,ñ Σας 日本語。abc 12３ ½x",
    "　a b   c", "'", "x'", "x's", "'ll", "'r e", "́a é", "<|endoftext|", "<|<|endoftext|>|>", "\x1c\x1d a\x85b\x00", "a" * 700, "ab" * 2000, "𝔘𝔫𝔦 🙂🙂", "Ᲊa \U00010d40",
]


@pytest.fixture(scope="module")
def both():
    return byte_bpe.ByteBpe(PATH), Tokenizer.from_file(PATH)


def ids_of(bpe, texts):
    out = []
    for block in W.blocks(pa.array(texts, pa.string())):
        ids, counts = bpe.encode(block)
        cut = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[cut[i] : cut[i + 1]].tolist() for i in range(block.n)]
    return out


def test_odd_texts(both):
    bpe, library = both
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert ids_of(bpe, ODD) == want
    counts = np.array([len(w) for w in want])
    assert bpe.decode(np.array([i for w in want for i in w], np.uint32), counts) == [library.decode(w, skip_special_tokens=False) for w in want]
    # ids that end inside a character, and unknown ids
    some = [want[6][:1] + [250, 9, 70000], [50256, 222]]
    assert bpe.decode(np.array(some[0] + some[1]), np.array([4, 2])) == [library.decode(s, skip_special_tokens=False) for s in some]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="abst' \n1!é　日<|>", max_size=60)), max_size=8))
def test_any_text(both, texts):
    bpe, library = both
    assert ids_of(bpe, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_has_the_library_class(both):
    _, library = both
    split = library.pre_tokenizer.pre_tokenize_str
    draw = random.Random(0)
    classes = byte_bpe.character_classes()
    for code in [*range(0xD800), *(draw.randrange(0xE000, byte_bpe.CODE_POINTS) for _ in range(40_000))]:
        c = chr(code)
        kind = byte_bpe.LETTER if len(split(f"a{c}b")) == 1 else byte_bpe.NUMBER if len(split(f"1{c}1")) == 1 else byte_bpe.OTHER if len(split(f"!{c}!")) == 1 else byte_bpe.SPACE
        assert classes[code] == kind, hex(code)


def test_merges_that_open_earlier_ones(tmp_path):
    """A vocabulary in which a merge's symbol takes part in a merge of a lower rank: one pair at a time."""
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["abc", "a"], ["a", "bc"]]
    symbols = byte_bpe.byte_symbols()
    vocab = {s: i for i, s in enumerate(symbols)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"].update(vocab=vocab, merges=merges)
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    bpe, library = byte_bpe.ByteBpe(str(path)), Tokenizer.from_file(str(path))
    assert not bpe.simple.all()
    draw = random.Random(5)
    texts = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    assert ids_of(bpe, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 3)
    texts = [f"some {i} words {i % 3} and more" for i in range(50)]
    assert ids_of(byte_bpe.ByteBpe(PATH), texts) == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


def test_query(spark, tmp_path, both):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate([*ODD, "word " * 150_000])] + [(None, "x y", None, None, None), (3, None, None, None, None), (3, None, None, None, None)]
    schema = "doc_id long, text string, ids string, n_tokens string, decoded string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in rows:
        ids = both[1].encode(r[1] or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), both[1].decode(ids, skip_special_tokens=False).encode())]
        want.append((r[0], len(ids), *sha))
    got = registered.QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode(spark.createDataFrame(rows[:8], schema), PATH)
    assert sorted((r.doc_id, r.ids) for r in byte_bpe.ids_array(encoded).collect()) == [(i, both[1].encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD[:8])]
    assert byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], schema), PATH), PATH).count() == 0
