"""Token counting, pieces and the token store, held against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from palimpsest.llm import pieces, token_count, token_store  # noqa: E402
from palimpsest.llm.units import PackedUnits, UnitCache, ascii_set, unit_slabs  # noqa: E402

ODD = ["", None, " ", "  a  b ", "abc\n", " x▁y ▁ z", "a\tb c<|endoftext|>d", "ΑΣ ΑΣ. é é ́x ≮", "don't we'll x's. it'sabc 12.5%", "a… b…. c", "x\xa0 y z", "🙂 🙂🙂! \x00 \x1c a\x1cb", "   \n\n  x  \n ", "é.é!a!! b?!c", "<|startoftext|> x<|endoftext|>", "same row", "same row", "long " * 3000, "x" * 3000]
SCHEMA = "doc_id long, text string, n_tokens string, row string, digests int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "clash", "clash", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _texts():
    return [(i if i != 5 else None, t or "") for i, t in enumerate(ODD)]


def test_counts_equal_library(docs):
    tok = token_count.tokenizer(P.path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_count.count_tokens(docs, P.path("word_bpe_49k.json"), limit=50, chunk_chars=500, overlap=30).collect()), key=str)
    n = {(i, t): len(tok.encode(t, add_special_tokens=False).ids) for i, t in _texts()}
    assert got == sorted([(i, len(t.encode()), n[i, t], n[i, t] > 50) for i, t in _texts()], key=str)


@pytest.mark.parametrize("size,overlap", [(60, 8), (200, 40), (1000, 10)])
def test_resynchronisation(size, overlap):
    tok = token_count.tokenizer(P.path("word_bpe_49k.json"))
    rng = random.Random(size)
    for _ in range(30):
        text = "".join(rng.choice(["the ", "token", "'s ", "é", "..", " ", "\n", "123", "xy" * 40, "ß", "<|endoftext|>"]) for _ in range(rng.randint(1, 200)))
        assert token_count.resynchronised(tok, text, size, overlap) == tok.encode(text, add_special_tokens=False).ids


def test_long_texts_are_chunks_only(spark, monkeypatch):
    """The words of a text that is encoded in chunks are not encoded as units as well, nor a word anew for a mark after it."""

    class Frame:  # hands over what would run in the workers
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    path, sent = P.path("word_bpe_49k.json"), []
    tok, cache = token_count.tokenizer(path), token_count._units.__wrapped__(path)
    real = cache.encode
    cache.encode = lambda units: sent.extend(units) or real(units)
    monkeypatch.setattr(token_count, "_units", lambda _: cache)
    texts = ["menú one, menú. (menú! menú'll menú", "only here " * 600, "", "x<|endoftext|>y z<|startoftext|>", "é" * 3_999 + " <|", " ÿ" * 2_000, " ÿ" * 2_001, "e\u0301, ×; ×é×. 12, K\u0331!<\u0338"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [x for out in token_count.count_tokens(Frame(), path)(iter([batch])) for x in out.to_pylist()]
    want = [(i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert got == [{"doc_id": i, "n_bytes": b, "n_tokens": n, "over_limit": n > 2048} for i, b, n in want]
    assert not any("here" in u for u in sent) and sum("menú" in u for u in sent) == 3  # with and without a space, and after a bracket


def test_pieces_equal_library(docs):
    path = P.path("piece_bpe_32k.model")
    sp = pieces.pieces(path).library
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in _texts():
        ids = sp.encode(t)
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)), 0))
    assert sorted(map(tuple, pieces.encoded(docs, path).collect()), key=str) == sorted(want, key=str)


def test_agenda_equals_library():
    model = pieces.pieces(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ["▁" + "".join(rng.choice("abcdefghinorstéü.,'▁0🙂") for _ in range(rng.randint(0, 45))) for _ in range(500)] + [""]
    many = [model.encode(t) for t in texts]
    plain = [t.replace("▁", " ")[1:] for t in texts]
    assert [m for m, t in zip(many, plain) if t] == [model.library.encode(t) for t in plain if t]


def test_unit_cache_is_bounded():
    seen = []
    cache = UnitCache(lambda units, heads: seen.extend(units) or [len(u) for u in units], limit=10)
    for a in range(0, 60, 6):
        slab = next(unit_slabs(pa.array([" ".join(f"w{i}" for i in range(a, a + 6))]), ascii_set(" ")))
        payload, which = cache.of(slab)
        assert sum(np.array(payload)[which]) == len(slab.raw)
    assert len(cache.young) + len(cache.old) <= 32


@pytest.mark.parametrize("collide", [False, True])
def test_packed_units(collide):
    """The payload of each unit, at any limit and with equal hashes; few are kept."""
    rng = random.Random(1)
    code = lambda u: [len(u), *u.encode()]
    cache = PackedUnits(lambda units: (np.array([x for u in units for x in code(u)], "<u2"), np.array([len(code(u)) for u in units])), "<u2", limit=20)
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "bé", " w", "\n", " ", f" {rng.randrange(40)}"]) for _ in range(rng.randrange(12))) for _ in range(5)]
        for slab in unit_slabs(pa.array(texts), ascii_set(" \n")):
            if collide:
                slab.hash = slab.hash % np.uint64(3)
            numbers, at, size, which = cache.of(slab)
            for s, e, i in zip(slab.start, slab.end, which):
                assert numbers[at[i] : at[i] + size[i]].tolist() == code(slab.raw[s:e].decode())
        assert len(cache.young) <= 20 and len(cache.old) <= 60


def test_units_are_encoded_once():
    """What a worker has encoded it doesn't encode again for a mark after it or half a million units later."""
    path, sent = P.path("byte_bpe_50k.json"), []
    tok, cache = token_count.tokenizer(path), token_store._units.__wrapped__(path, 2)
    real = cache.encode
    cache.encode = lambda units: sent.extend(units) or real(units)
    encoded = lambda texts: [r for _, rows in token_store._encoded_slabs(tok, pa.array(texts), cache, np.dtype("<u2"), 2) for r in rows]
    texts = ["a menú, é. menú! é×, ×,÷.", "é menú. menú, menú; été,.", "É’, ÿ) ÿ. e\u0301, ü'll ü' d"]
    for text, row in zip(texts, encoded(texts), strict=True):
        assert np.frombuffer(row, "<u2").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]
    assert sum("menú" in u for u in sent) == 1
    cache.encode = lambda units: sent.extend(units) or (np.ones(len(units), "<u2"), np.ones(len(units), np.int64))
    sent.clear()
    for first in (0, 170_000, 340_000, 0):
        encoded([" ".join(f"w{i}" for i in range(first, first + 170_000))])
    assert len(sent) < 520_000


def test_store_round_trip(spark, docs, tmp_path):
    tok = token_count.tokenizer(P.path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), folder)
    want, at = [], 0
    for i, t in sorted(_texts(), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_store.read_store(spark, folder, 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == index.select("digest").distinct().count()
    sizes = sum(p.stat().st_size for p in (tmp_path / "store/packs").iterdir())
    assert sizes == index.groupBy().sum("size").first()[0]  # unique chunks, and nothing else
    assert len(token_store.verify_manifest(spark, folder)) == token_store.DIGEST
    assert not (tmp_path / "store/stage").exists()


def test_missing_chunk_is_found(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), folder)
    lost = spark.read.parquet(f"{folder}/recipes").filter("length(digests) = 16").first().digests
    rest = spark.read.parquet(f"{folder}/index").filter(F.col("digest") != F.lit(bytes(lost))).collect()
    spark.createDataFrame(rest, "digest binary, pack string, at long, size int").write.mode("overwrite").parquet(f"{folder}/index")
    with pytest.raises(Exception, match="missing from the index"):
        token_store.read_store(spark, folder, 2).collect()


def test_another_recipe_is_found(spark, docs, tmp_path):
    """A recipe that is whole in itself, but not the one that was written."""
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), folder)
    assert spark.read.parquet(f"{folder}/format").first() == (2, 2)
    with pytest.raises(ValueError, match="2 bytes"):
        token_store.read_store(spark, folder, 4)
    recipes = spark.read.parquet(f"{folder}/recipes").collect()
    a, b = (i for i, r in enumerate(recipes) if r.doc_id in (7, 8))
    swapped = {a: recipes[b], b: recipes[a]}
    rows = [(r.row, r.doc_id, *swapped.get(i, r)[2:5], r.part) for i, r in enumerate(recipes)]
    spark.createDataFrame(rows, spark.read.parquet(f"{folder}/recipes").schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, folder)


def test_reads_are_ranges():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 10**6, 9), ("b", 0, 3)]
    assert [len(r) for r in token_store._ranges(places)] == [2, 1, 1]


def test_repeated_ids_and_long_texts(spark, tmp_path):
    """Rows that share an id, and a text longer than a slab."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(500_000))
    assert len(long) > 2 << 20
    rows = [(7, long), (7, "b"), (7, "b c"), (2, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tok = token_count.tokenizer(P.path("word_bpe_49k.json"))
    n = sorted((i, len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(frame, P.path("word_bpe_49k.json")).collect()) == n
    sp = pieces.pieces(P.path("piece_bpe_32k.model")).library
    assert sorted((r.doc_id, r.n_tokens) for r in pieces.encoded(frame, P.path("piece_bpe_32k.model")).collect()) == sorted((i, len(sp.encode(t))) for i, t in rows)
    tok = token_count.tokenizer(P.path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/store"
    token_store.write_store(frame, P.path("byte_bpe_50k.json"), folder)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_store(spark, folder).collect())
    assert [r[1] for r in got] == [2, 7, 7, 7] and sorted(r[1:] for r in got) == sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_damage_is_found(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, P.path("byte_bpe_50k.json"), folder)
    pack = next((tmp_path / "store/packs").iterdir())
    data = bytearray(pack.read_bytes())
    data[len(data) // 2] ^= 255
    pack.write_bytes(bytes(data))
    with pytest.raises(Exception, match="recipe|zstd|decompress|crc|checksum|corrupt"):
        token_store.read_store(spark, folder, 2).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000)
    shifted = np.concatenate([rng.integers(0, 50_000, 777), ids])
    a, b = (token_store.cuts(x, np.array([0, len(x)]))[0] for x in (ids, shifted))
    assert len(set(e - 777 for e in b) & set(a)) > 0.8 * len(a) and max(np.diff([0, *a])) <= token_store.MOST


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert token_count.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0
    assert pieces.encoded(none, P.path("piece_bpe_32k.model")).count() == 0
    token_store.write_store(none, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/s")
    assert token_store.read_store(spark, f"file://{tmp_path}/s", 2).count() == 0
