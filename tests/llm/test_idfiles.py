"""Files of ids against the tokenizers library, and bit packing at every width."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosemill.llm import idfiles
from prosemill.llm.packing import _encoder

NAME = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", range(1, 33))
def test_bits_come_back_at_every_width(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        raw = idfiles.pack_bits(ids, width)
        assert len(raw) == -(-n // 64) * 8 * width
        assert (idfiles.unpack_bits(raw, width, n) == ids).all()
        number = int.from_bytes(raw, "little")
        assert [number >> (i * width) & ((1 << width) - 1) for i in range(n)] == ids.tolist()


def test_widths_are_least():
    assert [idfiles.bits_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    assert idfiles.vocabulary(NAME) == 50257 and idfiles.vocabulary(P.path("byte_bpe_50k.tiktoken")) == 50256
    with pytest.raises(ValueError):
        idfiles.pack_bits(np.array([4]), 2)


def expected(texts):
    own, out, start = Tokenizer.from_file(NAME), [], 0
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        for t in texts[key]:
            ids = own.encode(t or "", add_special_tokens=False).ids + [0]
            raw = np.array(ids, "<u4").tobytes()
            out.append((key, start, len(ids), zlib.crc32(raw), raw))
            start += len(ids)
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_ids": 64, "file_ids": 500}])
def test_files_hold_all_ids_in_order(docs, texts, sizes):
    more = docs.withColumns({"_key": F.lit(1), "_text": F.lit(2), "_hash": F.lit(3), "_row": F.lit(4), "start": F.lit(5), "ids": F.lit(6), "part": F.lit(7)})
    files = idfiles.write(more, NAME, P.PATTERN, end_id=0, **sizes)
    got = sorted(tuple(r) for r in idfiles.read(files, "long", with_ids=True).collect())
    assert [(*g[:4], bytes(g[4])) for g in got] == expected({k: [t] for k, t in texts.items()})
    manifest = files.orderBy("part", "number").collect()
    assert sum(r.n_docs for r in manifest) == len(texts) and (not sizes or len(manifest) > 5)
    reader = idfiles.Reader(manifest[0].path)
    flat = np.concatenate([reader.block(i) for i in range(len(reader.counts))])
    for start, count in ((0, 0), (0, 1), (70, 200), (len(flat) - 1, 1), (0, len(flat))):
        assert (reader.ids(start, count) == flat[start : start + count]).all()
    with pytest.raises(IndexError):
        reader.ids(len(flat), 1)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "b c"), (None, None), (3, "same"), (3, "same"), (3, "same"), (1, ""), (2, "x  <|endoftext|> y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = idfiles.read(idfiles.write(df, NAME, P.PATTERN, end_id=0), "long").orderBy("start").drop("ids").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 3]
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:i]) for i in range(7)]
    by_text = {t: Tokenizer.from_file(NAME).encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows}
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(by_text[t], "<u4").tobytes()) for _, t in rows)
    assert idfiles.read(idfiles.write(df.limit(0), NAME, P.PATTERN, end_id=0), "long").count() == 0


def test_damage_is_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string")
    path = idfiles.write(df, NAME, P.PATTERN, end_id=0, folder=f"file://{tmp_path}").first().path.removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    raw[idfiles.HEAD.size] ^= 1
    (tmp_path / "damaged").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        idfiles.Reader(f"file://{tmp_path}/damaged").block(0)
    (tmp_path / "short").write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="cut short"):
        idfiles.Reader(f"file://{tmp_path}/short")


def test_pieces_are_as_the_library(texts):
    own, encoder = Tokenizer.from_file(NAME), _encoder(NAME, P.PATTERN)
    odd = [f"{a}{b}{c}x" for a in ("", "a", " ", "\n", "\xa0", "　") for b in (" ", "  ", "\t ", " \x85", "\x1c \x1c") for c in ("", "b", " ", "\0 ", "  ")]
    odd += [t[:-1] for t in odd] + [t or "" for t in texts.values()]
    flat, lens = encoder.encode(odd)
    at = 0
    for t, n in zip(odd, lens.tolist(), strict=True):
        assert flat[at : at + n].tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)
        at += n
    assert encoder.encode([])[1].tolist() == []
