"""Token files against the tokenizer library, and a shard against plain lists."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from argotlog.llm.catalog import WORD_TOKENIZER, op11_token_files
from argotlog.llm.tokenfiles import _Encoder, occurrences, shards, token_counts, token_files
from argotlog.llm.wavelet import Shard, encode
from tests.llm.conftest import odd_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def definition():
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 49407), (70_000, 3), (70_000, 49_408), (200_001, 1 << 20)])
def test_shard_equals_lists(n, top):
    rng = random.Random(n + top)
    ids = [rng.randrange(top) for _ in range(n)]
    ends = sorted({rng.randrange(1, n + 1) for _ in range(20)} | {n}) if n else [0]
    keys, null = list(range(100, 100 + len(ends))), [i % 3 == 0 for i in range(len(ends))]
    s = Shard(encode(np.array(ids, np.uint32), np.array(ends), np.array(keys), np.array(null), 3, 4) + b"\n")
    assert s.tokens().tolist() == ids and s.ends.tolist() == ends and s.keys.tolist() == keys and s.null.tolist() == null
    assert (s.n_tokens, s.n_docs, s.part, s.seq) == (n, len(ends), 3, 4)
    places = [rng.randrange(n) for _ in range(300)] if n else []
    assert s.access(places).tolist() == [ids[p] for p in places]
    for token in {0, top - 1, top + 5, *(ids[p] for p in places[:5])}:
        low, high = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert s.occurrences(token).tolist() == [i for i, t in enumerate(ids) if t == token]
        assert s.occurrences(token, low, high).tolist() == [i for i in range(low, high) if ids[i] == token]
        assert s.count(token) == ids.count(token) and s.count(token, low, high) == ids[low:high].count(token)
    with pytest.raises(IndexError):
        s.access([n])


def test_a_broken_file_is_refused():
    with pytest.raises(ValueError, match="not a shard"):
        Shard(b"other" * 30)


def test_words_are_encoded_as_the_library_encodes_whole_texts(definition, library):
    rng, coder = random.Random(5), _Encoder(definition)
    signs = [*"aAzZ 'stdm.,<|>0éÉßİ́ªµ×\n\x1c\x85　\x00̸", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't", "Σ", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, at = coder.ids(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert coder._short


def test_query_equals_the_library(spark, documents, library):
    start, expected = 0, {}
    for r in documents.select("doc_id", "text").orderBy("doc_id").collect():
        ids = ids_of(library, r["text"])
        expected[r["doc_id"]] = (start, len(ids), crc(ids))
        start += len(ids)
    rows = op11_token_files(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)


def test_many_shards_and_questions(spark, documents, definition, library, tmp_path):
    ids = {r["doc_id"]: ids_of(library, r["text"]) for r in documents.collect()}
    path, found = token_files(documents, definition, str(tmp_path / "f"), shard_tokens=20_000)
    assert len(list((tmp_path / "f").glob("part-*"))) > 5
    rows = found.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(ids) and all(r["ids_crc32"] == crc(ids[r["doc_id"]]) for r in rows)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    wanted = [1, 320, ids[rows[0]["doc_id"]][0]]
    got = sorted(map(tuple, occurrences(shards(spark, path), wanted).collect()))
    assert got == sorted((t, d, i) for d, x in ids.items() for i, t in enumerate(x) if t in wanted)
    assert dict(token_counts(shards(spark, path), wanted).collect()) == {t: sum(x.count(t) for x in ids.values()) for t in wanted}


def test_odd_and_empty_tables(odd, empty, definition, library, spark):
    _, found = token_files(odd, definition)
    rows = found.orderBy("start").collect()
    assert len(rows) == len(odd_rows()) and [r["doc_id"] for r in rows][:3] == [None, None, 1]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == sorted((d is not None, d or 0, crc(ids_of(library, t))) for d, t, *_ in odd_rows())
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    _, found = token_files(empty, definition)
    assert found.count() == 0
