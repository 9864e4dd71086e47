"""Fill-in-middle frames and importance resampling, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from odd_rows import ODD

from ledgerflow.llm import fill_in_middle as fim
from ledgerflow.llm import resampling

SMALL = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(doc_id, text) -> tuple:
    text, n = text or "", len(text or "")
    drawn = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, a, b - a, sha(output), sha(text))


MARKED = tuple((100 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", "<", "<P", "P><S", "<<<>>>", "M>M>", "S>S><S", "日本語" * 50, "😀a" * 9]))


@pytest.mark.parametrize("units", [1, 3, 64, fim.FRAME_UNITS])
def test_fill_in_middle_equals_brute_force(make_docs, units):
    rows = [row for row in ODD + MARKED if units > 3 or len(row[1] or "") < 500]
    found = fim.digests(fim.transform(make_docs(*rows), units)).collect()
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted((brute_fim(*row) for row in rows), key=str)


def test_fill_in_middle_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {tuple(r) for r in fim.digests(fim.transform(docs)).collect()}
    assert found == {brute_fim(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {form for _, _, form, *_ in found} == {"plain", "psm", "spm"}
    assert fim.digests(fim.transform(docs.limit(0))).count() == 0


def test_only_frames_of_the_range_are_opened(monkeypatch):
    text = "".join(chr(97 + i % 26) for i in range(1000)) + "é日😀"
    frames = fim.SeekableText.of([text[:333], "", text[333:]], 100)
    assert len(frames) == len(text) == frames.ends[-1] and len(frames.frames) == 11
    opened = []
    plain = fim.SeekableText._open
    monkeypatch.setattr(fim.SeekableText, "_open", lambda self, at: opened.append(at) or plain(self, at))
    for start, stop, touched in ((0, 0, []), (250, 260, [2]), (299, 301, [2, 3]), (1000, 1003, [10]), (1003, 1003, [])):
        opened.clear()
        assert "".join(frames.between(start, stop)) == text[start:stop]
        assert opened == touched
    assert [frames.find(mark) for mark in ("yza", "é日", "nope")] == [text.find("yza"), 1000, -1]


def test_text_ranges(make_docs):
    framed = fim.frame_texts(make_docs((1, "héllo wörld"), (2, None), (3, "ab")), 4)
    assert {r["doc_id"]: r["text"] for r in fim.texts_between(framed, 2, 9).collect()} == {1: "llo wör", 2: "", 3: ""}


# --- resampling ----------------------------------------------------------------


def brute_words(text) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_runs(text, most=2) -> list[str]:
    words = brute_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute_importance(docs, target, percent=25, least=20, buckets=10_000) -> list[tuple]:
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, rows in ((s, docs), (t, target)):
        for _, text in rows:
            counts.update(map(bucket, brute_runs(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    found = []
    for doc_id, text in docs:
        runs = brute_runs(text)
        weight = sum(gain[bucket(run)] for run in runs) // len(runs) if runs else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append((doc_id, len(runs), weight, score, len(brute_words(text)) >= least))
    order = sorted((row for row in found if row[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    ranks = [(*row[:4], i + 1) for i, row in enumerate(drawn)]
    return ranks + [(*row[:4], None) for row in order[len(drawn) :]] + [(*row[:4], None) for row in found if not row[4]]


def importance_rows(docs, target, **options) -> list[tuple]:
    names = ("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r[n] for n in names) for r in resampling.importance(docs, target, **options).collect()), key=str)


def test_importance_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute_importance(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert importance_rows(docs, items) == sorted(wanted, key=str)


def test_importance_of_odd_rows(spark, make_docs):
    rng = random.Random(8)
    rows = [*ODD, *[(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(15, 40)))) for i in range(50, 130)]]
    rows += [(7, "x " * 30)] * 3 + [(None, "x, Y! " * 30)] * 2
    target = [(None, "a b. C"), (1, None), (1, ""), (2, "a b, c d"), (2, "a b, c d")]
    items = spark.createDataFrame([(i, t, 1) for i, t in target], "item_id long, text string, n_words long")
    assert importance_rows(make_docs(*rows), items) == sorted(brute_importance(rows, target), key=str)
    assert importance_rows(make_docs(), items) == []
    assert importance_rows(make_docs(*rows), items.limit(0)) == sorted(brute_importance(rows, []), key=str)


def test_spans_are_the_runs():
    scan = resampling.FeatureScan(3, 10_000)
    for text in ("", "one", "One two", "a--b\tC\x00d é!日本 z" * 3):
        joined = resampling.joined_plain_words(text.encode())
        assert [joined[a:b].decode() for a, b in scan.spans(text.encode())] == brute_runs(text, 3)
        assert sorted(zlib.crc32(run.encode()) % 10_000 for run in brute_runs(text, 3)) == scan.hashed(text.encode())[1].tolist()


def test_long_words_are_scanned_in_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        resampling.FeatureScan(2, 10_000).hashed(b"a" * n + b" b" * (n // 10))
        return time.process_time() - began

    seconds(1000)
    assert seconds(4_000_000) < 30 * max(seconds(400_000), 0.01)


def test_resampled_rows_keep_their_columns(spark, make_docs):
    docs = make_docs(*[(i, f"w{i % 5} " * 25) for i in range(40)])
    items = spark.createDataFrame([(1, "w3 w3 w3 w3")], "item_id long, text string")
    drawn = resampling.resample(docs, items)
    assert drawn.columns == docs.columns
    assert drawn.count() == 10
