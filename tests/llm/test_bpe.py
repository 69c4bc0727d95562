import random

import pytest

from quillstone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    return bpe.coder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


def texts():
    rng = random.Random(5)
    yield from ["", " ", "a", "\n\n", "don't we'll", "a\n\n" + "x" * 9000, "<|endoftext|>", "a <|endoftext|>  b" + "y" * 5000 + "<|endoftext|>\n", " " * 5000, "\t\n " * 3000 + "z", "Ünï çødé ñ 漢字 😀 ́ 𝒳"]
    for n in (3000, 5000, 20_000):
        yield "".join(rng.choice("abcdefghij") for _ in range(n))
        yield "".join(rng.choice("theandingion") for _ in range(n)) + " tail 's"
        yield "".join(chr(rng.choice([*range(97, 123), 0xE9, 0x4E2D, 0x1F600])) for _ in range(n))
        yield "7" * n + "a" * n + "!" * n
    for _ in range(200):
        yield "".join(chr(rng.choice([32, 10, 39, 115, 116, 65, 97, 48, 0x20AC, 0x3000, 0x85, 0xA0, 0x301, 0x1F1E6])) for _ in range(rng.randrange(40)))


def test_ids_and_text_are_the_library_s(own, theirs):
    for text in texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids
        assert own.text(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_parts_of_a_long_text_give_the_ids_of_the_whole(own):
    for text in texts():
        parts, got = list(own.parts(text, size=700)), []
        for glue in dict.fromkeys((g, i if g is None else None) for i, (g, _, _) in enumerate(parts)):
            mine = [p for i, p in enumerate(parts) if (p[0], i if p[0] is None else None) == glue]
            ids = [[s] if s is not None else [x for b in bodies for x in own.tree(b)] for _, s, bodies in mine]
            got += own.joined(ids)
        assert got == own.ids(text)


def test_every_code_point_is_classed_alike(own, theirs):
    points = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = "".join(f"a{p}1{p} {p}" for p in points[i : i + 4000])
        assert own.ids(text) == theirs.encode(text, add_special_tokens=False).ids, hex(ord(points[i]))


def test_null_empty_long_and_repeated_rows(spark, own):
    rows = [(1, None, 5), (2, "", 6), (3, "word " * 300 + "q" * 6000, 7), (3, "word " * 300 + "q" * 6000, 7), (None, "a b", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    for limit in (bpe.LONG_TEXT, 1000):
        out = bpe.decoded(bpe.encoded(df, bpe.vocabulary_path(), long_text=limit), bpe.vocabulary_path()).collect()
        once = bpe.encoded(df, bpe.vocabulary_path(), long_text=limit, carried=["doc_id"], decode=True)
        assert once.columns == ["doc_id", "ids", "n_tokens", "decoded", "ids_sha256"]
        assert sorted(map(tuple, once.collect()), key=str) == sorted(((r["doc_id"], r["ids"], r["n_tokens"], r["decoded"], r["ids_sha256"]) for r in out), key=str)
        assert sorted((r["doc_id"] or 0, r["decoded"], r["n_tokens"], r["ids_sha256"]) for r in out) == sorted((i or 0, t or "", len(own.ids(t)), own.ids_sha256(own.ids(t))) for i, t, _ in rows)
    assert bpe.encoded(df.limit(0), bpe.vocabulary_path()).count() == 0
    none = spark.createDataFrame([(None, "x"), ([], "y")], "ids array<int>, decoded string")
    assert [(r["decoded"], r["ids_sha256"]) for r in bpe.decoded(none, bpe.vocabulary_path()).collect()] == [("", own.ids_sha256([]))] * 2
