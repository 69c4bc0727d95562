import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import packing

tokenizers = pytest.importorskip("tokenizers")
PATH = packing.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(library, text, end=(2,)):
    return [*library.encode(text or "", add_special_tokens=False).ids, *end]


def texts():
    rng = random.Random(11)
    yield from ["", " ", "Don't STOP, we'll go!", "a<|endoftext|>b <|STARTOFTEXT|> <|endoftext|>", "J̌ ǰ İ İ ǅ ǰ", "don't 're's", "x" * 3000, "　a　b\x85c\x1cd", "Ñandú, Łódź. Œuvre! ſtop", "a,b. c.d .e;", "it's I'LL 'd''ve x're't 12.5% <<|>> <a@b.c>", "2024-01-02T03:04 ....!!", "́a", "漢字 ½ 12345 ⅷ"]
    for _ in range(300):
        yield "".join(chr(rng.choice([32, 10, 9, 39, 115, 116, 74, 97, 48, 46, 44, 0xC9, 0xDF, 0x130, 0x17F, 0x20AC, 0x3000, 0x85, 0xA0, 0x301, 0x30C, 0x1F1E6])) for _ in range(rng.randrange(60)))


def test_ids_are_the_library_s(library, monkeypatch):
    words = packing.Words(PATH)
    for text in texts():
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == ids_of(library, text, ())
    for c in map(chr, range(33, 0x250)):
        text = f"a{c}b {c} {c}{c} 1{c}' {c.upper()}'S"
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == ids_of(library, text, ()), hex(ord(c))
    monkeypatch.setattr(packing, "STRETCH", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words, long = packing.Words(PATH), " ".join(texts())
    assert np.frombuffer(words.ids(long.encode()), "<u4").tolist() == ids_of(library, long, ())
    assert len(words) <= 5 and len(words.before) <= 5


@pytest.mark.parametrize("capacity, cost", [(64, 0.0), (64, 4.0), (100, 2.0), (4096, 8.0)])
def test_cuts_lose_nothing_and_are_the_cheapest(capacity, cost):
    first = packing.cuts(capacity, cost)
    waste = lambda n: capacity / (capacity // n) - n
    for n in [*range(1, min(capacity, 200)), capacity - 1, capacity, 3 * capacity + 17]:
        found = list(packing.pieces(n, capacity, first))
        assert [s for s, _ in found] == np.cumsum([0, *(m for _, m in found)]).tolist()[:-1]
        assert sum(m for _, m in found) == n and all(0 < m <= capacity for _, m in found)
    if capacity == 64:
        best = [0.0]
        for n in range(1, capacity):
            best.append(min([waste(n), *(waste(m) + best[n - m] + cost for m in range(1, n))]))
            mine = [m for _, m in packing.pieces(n, capacity, first)]
            assert sum(map(waste, mine)) + cost * (len(mine) - 1) == pytest.approx(best[n])


def whole(rows, library, given, end=(2,), capacity=4096):
    """Every document's ids come back from its pieces, and sequences have no gap and no more than their capacity."""
    documents, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for key, text in given.items():
        want, at = ids_of(library, text, end), 0
        for start, ids, tokens, length in sorted(documents.pop(key, [])):
            assert (start, tokens) == (at, len(want))
            assert np.frombuffer(ids, "<u4").tolist() == want[at : at + length]
            at += length
        assert at == len(want)
    assert not documents
    lengths = []
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        lengths.append(at)
    return lengths


@pytest.mark.parametrize("rest", [64, 2])
def test_pieces_are_whole_through_all_rounds(spark, library, monkeypatch, rest):
    monkeypatch.setattr(packing, "REST", rest)  # 2: several rounds, as at large sizes
    rng = random.Random(3)
    given = {i: " ".join(rng.choice(["the", "Onesedtion", "éa,", "7", "it's"]) for _ in range(int(rng.expovariate(0.01)))) for i in range(700)}
    given |= {700: None, 701: "", 702: "word " * 5000, 703: "the " * 64}
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string").repartition(16)
    lengths = whole(packing.packed(docs, PATH, capacity=64).collect(), library, given, capacity=64)
    padding = sum(0 if n & (n - 1) == 0 else 64 - n for n in lengths)
    assert padding < 0.05 * sum(lengths)


def test_padding_of_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed(docs, PATH).collect()
    lengths = whole(rows, library, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths) < 0.01 * sum(lengths)


def test_odd_rows(spark, library):
    schema = "`sequence.id` string, text string, start int, ids string"
    rows = [("a", "Two words", 1, "x"), (None, None, None, None), ("a", "Two words", 1, "x"), ("b", "", 2, "y")]
    found = packing.packed(spark.createDataFrame(rows, schema), PATH, id_col="sequence.id")
    assert found.columns == ["sequence.id", *packing.PIECE]
    by = sorted((r["sequence.id"] or "", r["length"], r["doc_tokens"]) for r in found.collect())
    n = len(ids_of(library, "Two words"))
    assert by == [("", 1, 1), ("a", n, n), ("a", n, n), ("b", 1, 1)]
    assert len({(r["sequence_id"], r["offset"]) for r in found.collect()}) == 4
    assert packing.packed(spark.createDataFrame([], schema), PATH, id_col="sequence.id").count() == 0
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    assert packing.packed(docs, PATH, end_id=None).count() == 0
    with pytest.raises(ValueError, match="can't be called start"):
        packing.packed(spark.createDataFrame(rows, schema), PATH, id_col="start")


def test_sequences_are_padded_but_at_powers_of_two(spark):
    docs = spark.createDataFrame([(i, "the cat sat on a mat " * i) for i in range(12)], "doc_id int, text string")
    rows = packing.packed(docs, PATH, capacity=32)
    want = defaultdict(dict)
    for r in rows.collect():
        want[r["sequence_id"]][r["offset"]] = r["ids"]
    got = {r["sequence_id"]: (r["n_tokens"], r["ids"]) for r in packing.sequences(rows, capacity=32, pad_id=9).collect()}
    assert got.keys() == want.keys()
    for key, parts in want.items():
        joined = b"".join(parts[o] for o in sorted(parts))
        n = len(joined) // 4
        assert got[key] == (n, joined if n & (n - 1) == 0 else joined + np.full(32 - n, 9, "<u4").tobytes())


def test_the_query_gives_each_piece_s_digest(spark, library):
    rows = packing.op11_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(len(ids_of(library, t)) for t in texts.values())
