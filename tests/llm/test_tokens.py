"""Files against encoding every whole text with the library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from recengine.llm import queries, tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


TEXTS = ["It's a test, isn't it?  Yes!!", "", None, "Été naïve é   x", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ßẞ", "12 345 6'7 ''s 're", "日本語 text\t\n\x0b\x0c\r\x1c\x1d y", "tail " * 900, "\x00\x01 á̀ q", "🙂🙂 🙂's", "e ́x"]


def test_round_trip_is_the_library_s_encoding(spark, whole, tmp_path):
    rows = [(k * 7 % 40, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    got = sorted(tokens.round_trip(spark, docs, queries.tokenizer(), where=str(tmp_path / "files"), length=16).collect(), key=lambda r: r.start)
    want = {}
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_pieces_of_any_characters(whole):
    import random

    rng = random.Random(4)
    marks = ["a", "B", "é", "É", "İ", "ß", "ẞ", "×", "÷", "…", ".", ",", "'", "'s", "'ll", "H", "\u0331", "\u0301", "1", "23", "²", "½", "日", "🙂", " ", "\n", "\u00a0", "\u2003", "ſ", "K", "Å", "ǅ", "Σ", "_", "-", "\x00", "ñ", "Ź", "ɐ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts[::50] = ["".join(rng.choice([*marks, "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|"]) for _ in range(6)) for _ in texts[::50]]
    for size in (1, 7, 300):
        encode = tokens.Encoder(queries.tokenizer())
        for k in range(0, len(texts) if size > 1 else 400, size):
            data, offsets = tokens._text.buffer(pa.array(texts[k : k + size], pa.large_string()))
            ids, sizes = encode(data, offsets)
            want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts[k : k + size]]
            got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            assert got == want, next((t, g, w) for t, g, w in zip(texts[k : k + size], got, want) if g != w)


def test_sequences_have_one_length_and_a_mask(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h")], "doc_id long, text string").coalesce(1)
    files = tokens.write(spark, docs, str(tmp_path / "f"), queries.tokenizer(), length=4).collect()
    shown = []
    for f in sorted(files, key=lambda f: f.part):
        with pa.memory_map(str(tmp_path / "f" / f"{f.path}.arrow")) as m:
            reader = pa.ipc.open_file(m)
            total = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
            for k in range(total):
                ids, mask = tokens.sequence(reader, k)
                assert len(ids) == len(mask) == 4
                shown.append(sum(mask.to_pylist()))
    assert sum(shown) == sum(f.n_tokens for f in files) == 10


def test_empty_table(spark):
    assert tokens.round_trip(spark, spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer()).collect() == []


def thue_morse(n=10):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_whose_polynomials_agree(spark, whole):
    texts = [f"{w} {v}" for w in thue_morse() for v in thue_morse()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids_crc32 for r in tokens.round_trip(spark, docs, queries.tokenizer()).collect()}
    assert got == {k: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in enumerate(texts)}


def test_pieces_that_share_a_hash_are_encoded_whole(whole, monkeypatch):
    monkeypatch.setattr(tokens._text, "hashed", lambda data, starts, ends, seed=0: (data[starts] % 3).astype(np.uint64))
    encode = tokens.Encoder(queries.tokenizer())
    for texts in (["a"], ["abc def", "cab and more"], ["d g"], ["one two three", "four"]):
        data, offsets = tokens._text.buffer(pa.array(texts, pa.large_string()))
        ids, sizes = encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_very_long_text(spark, whole):
    text = "the quick brown fox, " * 60_000 + "x" * 50_000
    docs = spark.createDataFrame([(2, text), (1, "a")], "doc_id long, text string")
    ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
    r = next(r for r in tokens.round_trip(spark, docs, queries.tokenizer()).collect() if r.doc_id == 2)
    assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
