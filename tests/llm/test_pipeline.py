"""Each stage of the pipeline against brute force, on what the stage before it kept."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_decontaminate  # noqa: E402
import test_exactdup_urls_mixing as test_mixing  # noqa: E402
import test_jaccard  # noqa: E402
import test_toxicity  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from recengine.llm import mixing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copied = " ".join(f"a plain word{k} é" for k in range(50))
    extra = spark.createDataFrame([(9001, None, "en", None, 0), (9002, "", None, "src1", 0), (9004, "no copy of anything at all", "en", "src2", 17), (9003, "".join(c.upper() if "a" <= c <= "z" else c for c in copied), "en", "src3", 9), (9000, copied, "en", "src3", 9)], docs.schema)
    docs, out = docs.unionByName(extra), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(k))
        docs.write.parquet(f"{path}in")
        docs = spark.read.schema(docs.schema).parquet(f"{path}in")
        done = stage(spark, docs, SF)
        if k < len(pipeline.STAGES) - 1:
            assert done.columns == docs.columns
        done.write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_the_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram jaccard join", "benchmark decontamination", "source mixing", "token files"]


def test_toxic_documents_go(spark, kept):
    """Against the classifier written plainly, on the n-grams themselves."""
    _, docs, out = kept[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    model = test_toxicity.plain_fit([(texts[i], y) for i, y in known.items()])
    stay = {i for i, t in texts.items() if test_toxicity.plain_score(model, t) < 0.5}
    assert {r.doc_id for r in out.collect()} == stay
    assert 0 < docs.count() - out.count() < 0.3 * docs.count()


def test_one_of_each_group_stays(kept):
    _, docs, out = kept[1]
    known = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    stay = {i for i, _, c in test_jaccard.brute(known, 5, 80) if i == c}
    assert rows(out) == rows(docs.where(docs.doc_id.isin(list(stay))))
    assert 9003 not in {r.doc_id for r in out.collect()}


def test_near_copies_by_five_words_go(spark):
    words = [f"w{k}" for k in range(400)]
    changed = lambda w, at: " ".join("new" if k in at else x for k, x in enumerate(w))
    rows = [(1, " ".join(words[:50])), (2, changed(words[:50], {25})), (3, " ".join(words[50:90])), (4, changed(words[50:90], {20})), (5, " ".join(words[100:300])), (6, changed(words[100:300], {40, 90, 150})), (7, "a b c d"), (8, "A b c d")]
    groups = test_jaccard.brute(rows, 5, 80)
    assert {i for i, _, c in groups if i == c} == {1, 3, 4, 5, 7} != {i for i, _, c in test_jaccard.brute(rows) if i == c}
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = pipeline.without_near_copies(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 4, 5, 7]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows_ = [(1, a, "x"), (1, b, "x"), (2, b + " end", "y"), (None, a, "z"), (None, "alone without an id", "z"), (None, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, _one string").coalesce(1)
    out = [(r.doc_id, r.text, r._one) for r in pipeline.without_near_copies(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([rows_[0], rows_[1], rows_[4], rows_[5], rows_[6]], key=str)


def test_stages_keep_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "1 AS size", "'k' AS key", "'s' AS spans", "2.0 AS score", "3 AS component_id", "'i' AS items", "0 AS rank")
    docs.write.mode("overwrite").parquet(path := f"{pipeline.folder(spark)}/clash")
    docs = spark.read.parquet(path)
    for _, stage in pipeline.STAGES[:3]:
        assert set(stage(spark, docs, SF).columns) == set(docs.columns)
    assert set(pipeline.mixed(spark, docs, SF).columns) == set(docs.columns)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_contaminated_documents_go(spark, kept):
    _, docs, out = kept[2]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = test_decontaminate.brute([(r.doc_id, r.text) for r in docs.collect()], bench)
    dirty = {i for i, n, hit, _ in found if hit > 0 and 20 * hit >= n}
    assert rows(out) == rows(docs.where(docs.doc_id.isNull() | ~docs.doc_id.isin(list(dirty) or [-1])))


def test_a_row_for_each_time_a_document_is_taken(spark, kept):
    """Against the schedule written plainly: golden-ratio points, blocks of 64 words, sources end to end in order of digests."""
    _, docs, out = kept[3]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(words(r.text)) for r in by[s]) for s in order}
    goals = test_mixing.water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    keyed = sorted((s for s in order if goals[s] > 0), key=lambda s: "n" if s is None else "s" + s)
    total, ends = sum(goals.values()), np.cumsum([goals[s] for s in keyed])
    slots = Counter()
    for t in range(math.ceil(total / 64)):
        u = (t * mixing.GOLDEN % mixing.WHOLE) / mixing.WHOLE
        slots[keyed[min(int(np.searchsorted(ends / total, u, "right")), len(keyed) - 1)]] += 1
    want = Counter()
    for s in keyed:
        at = 0
        for r in sorted(by[s], key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
            n = len(words(r.text))
            for turn in range(3):
                take = max(0, min(at + turn * sizes[s] + n, slots[s] * 64) - (at + turn * sizes[s]))
                if take:
                    want[r.doc_id, r.text if take == n else " ".join(words(r.text)[:take])] += 1
            at += n
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_token_files_hold_the_library_s_ids(kept):
    from tokenizers import Tokenizer

    _, docs, out = kept[4]
    whole = Tokenizer.from_file(queries.tokenizer())
    want = []
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = out.orderBy("start").collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_run_applies_them_all(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
