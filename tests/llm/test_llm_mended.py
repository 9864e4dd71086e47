"""Cases that went wrong once: rows under one id, benchmarks of several blocks, broken pages, wide ranges of numbers."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import decontaminate, html_text, neighbours, ngram_join, packing, secrets
from ledgerflow.llm.queries import WORD_TOKENIZER

WORDS = public_tokenizers.path(WORD_TOKENIZER)


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def kept_rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_one_row_of_each_component_stays(make_docs):
    a, b, c = words(1), words(2), words(3)
    near_b = b + " more"
    rows = [(5, a), (7, a), (7, b), (9, b), (9, near_b), (11, c), (11, c), (11, c), (None, a), (None, a), (3, ""), (4, None), (3, "")]
    found = ngram_join.keep_one_of_each(make_docs(*rows))
    assert found.columns == make_docs().columns
    assert kept_rows(found) == sorted([(5, a), (7, b), (11, c), (None, a), (None, a), (3, ""), (3, ""), (4, None)], key=str)
    assert ngram_join.keep_one_of_each(make_docs()).count() == 0
    own = kept_rows(ngram_join.keep_one_of_each(make_docs((8, b), (8, near_b))))
    assert len(own) == 1 and own[0][0] == 8


@pytest.mark.parametrize("block_chars", [10**9, 60])
def test_contamination_is_decided_by_row(spark, make_docs, block_chars):
    one, two = words(4, 15), words(5, 15)
    items = spark.createDataFrame([(1, one), (2, two), (None, words(6, 14)), (3, None), (4, "")], "item_id long, text string")
    clean = words(7, 200)
    rows = [(1, clean), (1, one), (None, two), (None, clean), (2, f"{clean} {one} {clean}"), (2, clean), (3, None), (3, ""), (4, words(6, 14))]
    left = kept_rows(decontaminate.drop_contaminated(make_docs(*rows), items, block_chars))
    assert left == sorted([(1, clean), (None, clean), (2, clean), (3, None), (3, "")] + [(2, f"{clean} {one} {clean}")] * (20 * 15 < 415), key=str)
    found = decontaminate.find_contamination(make_docs(*rows), items, block_chars=block_chars)
    assert found.count() == len(rows)


BROKEN = ["<p ", "<p \"", "<p a='", "<!", "<!-- ", "<p a=\"b", "</", "<div>", "</ul>", "<div></ul>", "<a href=x>", "< ", "<p>x</b>", "<h1>", "<script", "<script>", "'\">"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_time_in_proportion(part):
    tree = html_text.trained_tree()

    def seconds(n):
        page = part * (n // len(part))
        began = time.process_time()
        html_text.main_text(page, tree)
        return time.process_time() - began

    seconds(1000)
    small = max(seconds(20_000), 0.01)
    assert seconds(160_000) < 30 * small


def test_broken_tags_lose_no_text():
    page = "<article><p>One two three four five six seven eight nine ten eleven twelve.</p><p class=\"x>Thirteen words are in this second block of text that follows the first.</p></article>"
    assert "One two three" in html_text.main_text(page, html_text.trained_tree())
    blocks = html_text.flat_blocks("<p title='a > b'>in</p><p title=\"it's\">on</p><i data-x=\"'>\">up</i> 1 < 2 <")
    assert [b.joined() for b in blocks] == ["in", "on", "up 1 < 2 <"]


def test_repeated_and_clashing_pages(spark):
    page = "<article><p>A text of some words that stands alone here, and more of it.</p></article>"
    rows = [(1, "u", page, 1, "x"), (1, "u", page, 2, "y"), (None, None, None, 3, "z"), (2, "v", "<p " * 50, 4, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    found = sorted(((r["page_id"], r["n_chars"]) for r in html_text.extract_text(pages).collect()), key=str)
    assert found == sorted([(1, 60), (1, 60), (None, 0), (2, 0)], key=str)


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 5e-324 * 2**60])
def test_neighbours_of_wide_ranges(spark, scale):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6))
    rows = [(i, (v * (scale if i % 2 else 1.0)).tolist(), i, 0.5) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long, score double")
    given = np.array([v for _, v, _, _ in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for r in neighbours.search(table, target=1.0).collect():
        wanted = np.argsort(-(unit @ unit[r["query_id"]]))
        wanted = [int(i) for i in wanted if i != r["query_id"]][:5]
        assert np.isfinite(r["score"]) and abs(r["score"]) <= 1 + 1e-9
        if scale != 5e-324 * 2**60:
            assert r["vec_id"] == wanted[r["rank"] - 1]
    assert np.isfinite(given).all()


@pytest.mark.parametrize("capacity", [4, 32_768, 131_072])
def test_packing_of_any_capacity(make_docs, capacity):
    docs = make_docs((1, None), (2, ""), (3, words(8, 300)), (4, words(9, 5)))
    found = packing.pack(docs, WORDS, capacity=capacity).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4}
    filled = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= capacity


def test_what_is_remembered():
    held = packing.Remembered(8)
    assert sorted(held.missing({"a", "b"})) == ["a", "b"]
    held.update(dict.fromkeys("abcdef", 1))
    assert held.missing({"a", "z"}) == ["z"]
    assert held["a"] == 1 and "b" not in held
    held.update(dict.fromkeys("zyxwv", 2))
    assert sorted(held.missing({"a", "b"})) == ["b"]


def test_a_shard_holds_numbers_of_words_only():
    windows = decontaminate.Windows.of([(1, words(4, 15))], 13)
    text = " ".join(f"other{i}" for i in range(5000)).encode()
    tracemalloc.start()
    n_words, spans, items = decontaminate.search_shard((text for _ in range(100)), windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_words == [5000] * 100 and not any(spans) and not any(items)
    assert peak < 30 * 500_000


def test_chunks_of_few_texts_are_held_at_a_time():
    sizes = []

    class Ids:
        def join(self, texts):
            sizes.append(len(texts))
            return [b""] * len(texts)

    assert len([*packing._joined(pa.array(["a b", None] * 300), Ids())]) == 600
    assert max(sizes) <= 200


def test_a_known_word_costs_no_walk_through_memory():
    held = packing.Remembered(10**6)
    held.update((str(i), i) for i in range(400_000))
    few = [{str(i), "new"} for i in range(300)]
    start = time.thread_time()
    assert all(held.missing(keys) == ["new"] for keys in few)
    assert time.thread_time() - start < 0.5


def test_chunks_have_the_library_s_ids():
    letters = "abZ.,ÀÿªµºßøÞ×÷ǅ中я \n\t\r\x00-9_İŉ'"
    rng = random.Random(3)
    texts = ["", "  ", "Word.,", "x" * 65, "Y" * 64 + ".", *("".join(rng.choices(letters, k=rng.randint(1, 90))) for _ in range(500))]
    library = Tokenizer.from_file(WORDS)
    wanted = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ids = packing.ChunkIds(WORDS, 50)
    for offset in (0, 3):
        given = pa.array([None, *texts]).slice(offset)
        assert [*packing._joined(given, ids)] == [b"", *wanted][offset:]


def test_redaction_takes_few_texts_at_a_time():
    sizes = []
    batches = iter([pa.RecordBatch.from_pydict({"doc_id": [*range(5000)], "text": ["token = abcdefgh"] * 5000})])

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):
            return [sizes.append(part.num_rows) or part for part in run(batches)]

    found = secrets.redact_secrets(Docs())
    assert max(sizes) <= 1000 and sum(sizes) == 5000
    assert {text for part in found for text in part.column("text").to_pylist()} == {"[secret]"}
