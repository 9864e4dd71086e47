"""Joins, near duplicates and neighbours against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from odd_rows import ODD

from ledgerflow.llm import near, neighbours, ngram_join, paragraph_dedup
from ledgerflow.llm.common import SPACED, spaced_words

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, width, words=None):
    own = (text or "").lower().split() if words is None else words
    return {tuple(own[i : i + width]) for i in range(max(len(own) - width, 0) + 1)} if own else set()


def brute_components(sets, percent):
    """Smallest id reachable, by all pairs."""
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def planted_documents(seed):
    """Copies, near copies around the threshold, chains, and a passage that many share."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = fresh(70)
    docs = [fresh(rng.randint(1, 120)) for _ in range(40)]
    docs += [fresh(25) + passage + fresh(25) for _ in range(25)]
    base = fresh(150)
    docs += [base, *(edited(rng, base, rng.randint(0, 4)) for _ in range(30))]
    chain = fresh(100)
    for _ in range(12):
        docs.append(chain)
        chain = chain[2:] + fresh(2)
    docs += [docs[3]] * 8
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("signatures", [None, ngram_join.PartEnum(85, 3, 1), ngram_join.PartEnum(85, 4, 2)])
def test_join_equals_all_pairs(make_docs, signatures):
    rows = planted_documents(1)
    found = {r["doc_id"]: r for r in ngram_join.join_documents(make_docs(*rows), signatures=signatures).collect()}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    wanted = brute_components(sets, 85)
    assert {i: r["component_id"] for i, r in found.items()} == wanted
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(wanted.values())) < len(rows)


def test_join_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {r["doc_id"]: shingle_set(None, 4, r["text"].encode().lower().split()) for r in docs.collect()}
    found = ngram_join.join_documents(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(sets, 85)


def test_join_of_odd_rows(make_docs):
    found = ngram_join.join_documents(make_docs(*ODD)).collect()
    assert len(found) == len(ODD)
    for row in found:
        assert row["component_id"] == row["doc_id"]
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in found)[0] == ("1", 0)
    assert ngram_join.join_documents(make_docs()).count() == 0
    left = ngram_join.keep_one_of_each(make_docs(*ODD, (7, "one two three"))).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("scheme", [ngram_join.PartEnum(), ngram_join.PartEnum(85, 3, 1), ngram_join.PartEnum(85, 4, 2)])
def test_similar_sets_share_a_signature(scheme):
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone = int(rng.integers(0, n * 15 // 100 + 1))
        room = (100 * (n - gone) - 85 * n) // 85
        b = np.concatenate((a[gone:], rng.integers(0, 2**64, max(room, 0), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)]
    found = near.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_repeated_paragraphs(make_docs):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, other = fresh(60), fresh(80)
    rows = []
    for i in range(30):
        lines = [fresh(rng.randint(5, 70)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(1, passage)
        if i % 5 == 0:
            lines.append(edited(rng, other, 1))
        rows.append((i, "Ä\n" + "\n".join(" ".join(line) for line in lines)))
    everything = paragraph_dedup.repeated_paragraphs(make_docs(*rows)).collect()
    found = [r for r in everything if r["kind"] == "paragraph"]
    by_id = dict(rows)
    units = [(i, line) for i, t in rows for line in t.split("\n") if len(line.split()) >= 50]
    wanted = brute_components({n: shingle_set(line, 5) for n, (_, line) in enumerate(units)}, 80)
    groups = {}
    for n, label in wanted.items():
        groups.setdefault(label, []).append(units[n])
    repeated = sorted(unit for own in groups.values() if len(own) > 1 for unit in own)
    assert sorted((r["doc_id"], by_id[r["doc_id"]][r["start"] : r["end"]]) for r in found) == repeated
    firsts = {r["group_id"]: (r["doc_id"], r["start"]) for r in found if not r["removed"]}
    assert len(firsts) == sum(not r["removed"] for r in found) == sum(len(own) > 1 for own in groups.values())
    cleaned = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_repeated_paragraphs(make_docs(*rows)).collect()}
    for i, text in by_id.items():
        gone = [(r["start"], r["end"]) for r in found if r["doc_id"] == i and r["removed"]]
        kept, at = "", 0
        for start, end in sorted(gone):
            kept, at = kept + text[at:start], end + 1
        assert cleaned[i] == kept + text[at:]


def test_passages_inside_lines(make_docs):
    rng = random.Random(12)
    fresh = lambda n: [f"é{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(60), fresh(75), fresh(60)]
    short = fresh(49)
    rows, holders = [], {}
    for i in range(40):
        words, held = fresh(rng.randint(0, 90)), None
        if i % 4 < 3 and i < 36:
            held = passages[i % 4]
            holders.setdefault(i % 4, {})[i] = " ".join(held)
        parts = [*words, *(held or short), *fresh(rng.randint(0, 90))]
        rows.append((i, "\n ".join([" ".join(parts[:30]), " ".join(parts[30:])]) if held is None else " ".join(parts)))
    rows.append((None, " ".join(passages[0])))
    found = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    by_id = dict(rows)
    assert {r["doc_id"] for r in found} == {i for own in holders.values() for i in own}
    for own in holders.values():
        mine = [r for r in found if r["doc_id"] in own]
        assert {r["component_id"] for r in mine} == {min(own)}
        assert [r["doc_id"] for r in mine if not r["removed"]] == [min(own)]
        for r in mine:
            text = by_id[r["doc_id"]][r["start"] : r["end"]]
            assert text in own[r["doc_id"]] and len(text.split()) >= 51


@pytest.mark.parametrize("size", range(51, 58))
def test_passages_of_every_length_over_fifty_words(make_docs, size):
    rng = random.Random(size)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, wanted = [], []
    for n in range(40):
        passage = fresh(size)
        for i in (2 * n, 2 * n + 1):
            rows.append((i, " ".join([*fresh(rng.randint(0, 40)), *passage, *fresh(rng.randint(0, 40))])))
            wanted.append((i, " ".join(passage), 2 * n, i % 2 == 1))
    # 50 of its words stand in an earlier document, too few for a passage.
    rows.append((-1, " ".join([*fresh(20), *wanted[0][1].split()[:50], *fresh(20)])))
    by_id = dict(rows)
    found = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    assert sorted((r["doc_id"], by_id[r["doc_id"]][r["start"] : r["end"]], r["component_id"], r["removed"]) for r in found) == wanted


def test_every_place_of_a_passage_comes_back(make_docs):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(i, " ".join([*fresh(20), *passage, *fresh(20), *passage, *fresh(20)])) for i in range(3)]
    by_id = dict(rows)
    found = paragraph_dedup.repeated_passages(make_docs(*rows)).collect()
    assert sorted((r["doc_id"], by_id[r["doc_id"]][r["start"] : r["end"]], r["component_id"], r["removed"]) for r in found) == [
        (i, " ".join(passage), 0, i > 0) for i in range(3) for _ in range(2)
    ]


def test_windows_begin_at_the_same_words():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**64, 58, dtype=np.uint64)
    seen = []
    for _ in range(50):
        before, behind = (rng.integers(0, 2**64, rng.integers(0, 40), dtype=np.uint64) for _ in range(2))
        at, key = paragraph_dedup.picked_windows(np.concatenate((before, passage, behind)), 51)
        inside = (at >= len(before)) & (at + 51 <= len(before) + 58)
        seen.append(set(zip((at[inside] - len(before)).tolist(), key[inside].tolist())))
    assert set.intersection(*seen)


def test_copies_of_a_text_are_compared_once(make_docs):
    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, whole = fresh(60), fresh(400)
    copied = " ".join(whole[:200] + shared + whole[200:])
    other = " ".join(fresh(30) + shared + fresh(30))
    # 5 has two texts, and 9 stands twice; 1 holds a passage of the copied text.
    docs = make_docs((5, copied), (9, copied), (7, copied), (9, copied), (5, other), (1, other + " end"), (20, " ".join(fresh(200))))
    texts = paragraph_dedup._one_of_each(docs, 50)
    assert sorted((r["doc_id"], r["high"]) for r in texts.rows.collect()) == [(1, 1), (5, 5), (5, 9), (20, 20)]
    assert sorted(r["doc_id"] for r in texts.copies.collect()) == [7, 9, 9]
    copied_part = texts.classes.collect()[0]["part"]
    windows = paragraph_dedup._shared_windows(texts, 51).collect()
    # The copied text is one row; of its 410 windows only the ten of the passage stand here, and at most seven beside them on each side.
    assert sum(r["whole"] for r in windows) == 1
    assert 10 <= sum(r["part"] == copied_part and r["doc_id"] == 5 and not r["whole"] for r in windows) <= 24
    found = {(r["doc_id"], r["start"], r["end"], r["component_id"], r["removed"]) for r in paragraph_dedup.repeated_passages(docs).collect()}
    assert {(i, 0, len(copied), 1, True) for i in (7, 9)} <= found
    assert {i for i, *_ in found} == {1, 5, 7, 9} and all(not r[-1] for r in found if r[0] == 1)
    lines = [r for r in paragraph_dedup.repeated_paragraphs(docs).collect() if r["kind"] == "paragraph" and r["end"] == len(copied)]
    assert sorted((r["doc_id"], r["n_copies"], r["removed"]) for r in lines) == [(5, 4, False), (7, 4, True), (9, 4, True), (9, 4, True)]


def test_words_of_all_bytes_at_once(monkeypatch):
    text = " É a\u00a0b\tA  word\x0bWORD\n\x1cx \n".encode() + b"long" * 20 + b" word"
    one = paragraph_dedup.Words(text)
    words = spaced_words(text)
    assert [bytes(one.letters[a:b]) for a, b in zip(one.begins, one.ends)] == words
    hashes = one.hashes()
    assert all((x == y) == (a == b) for x, a in zip(hashes, words) for y, b in zip(hashes, words))
    places = one.characters(one.begins).tolist()
    assert [text.decode()[at:].encode().translate(SPACED).split()[0] for at in places] == words
    monkeypatch.setattr(paragraph_dedup, "HASHED_BYTES", 8)
    assert (paragraph_dedup.Words(text).hashes() == hashes).all()
    assert not len(paragraph_dedup.Words(b"").hashes())


def test_paragraphs_of_odd_rows(make_docs):
    assert paragraph_dedup.repeated_paragraphs(make_docs(*ODD)).count() == 0
    twice = paragraph_dedup.repeated_paragraphs(make_docs((4, "Word " * 3000), (4, "Word " * 3000))).collect()
    assert [r["n_copies"] for r in twice] == [2, 2]
    assert paragraph_dedup.repeated_paragraphs(make_docs()).count() == 0
    assert paragraph_dedup.remove_repeated_paragraphs(make_docs(*ODD)).count() == len(ODD)


def exact(vectors, every=50, count=5):
    found = {}
    for q, v in vectors.items():
        if q % every == 0:
            a = np.array(v, float)
            scores = sorted((-float(a @ np.array(w, float) / np.linalg.norm(a) / np.linalg.norm(np.array(w, float))), i) for i, w in vectors.items() if i != q)
            found[q] = [i for _, i in scores[:count]]
    return found


def test_recall_of_the_search(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    wanted = exact(vectors)
    found = {}
    for r in neighbours.search(table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(wanted)
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [rank for rank, _, _ in own] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        hits += len({i for _, i, _ in own} & set(wanted[q]))
    assert hits / (5 * len(wanted)) >= 0.9


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(500, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = neighbours.fit_tree(unit, branches=4, leaf_sample=16)
    assert sorted(tree.visit(unit[0], 10**6)) == list(range(tree.leaves))
    assert tree.visit(unit[0], 1)[0] == tree.assign(unit[:1])[0]


def test_small_leaves_still_give_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_calibrated", lambda *_: 1)
    fit = neighbours.fit_tree
    monkeypatch.setattr(neighbours, "fit_tree", lambda unit: fit(unit, leaf_sample=8))
    rng = np.random.default_rng(6)
    # Ids up to 9 stand on several rows with different vectors.
    rows = [(i, rng.normal(size=4).tolist()) for i in [*range(300), *range(10), *range(10)]]
    found = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], set()).add((r["rank"], r["vec_id"]))
    assert {q: sorted(rank for rank, _ in own) for q, own in found.items()} == {q: [1, 2, 3, 4, 5] for q in range(0, 300, 50)}


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]),
        (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (100, [nan, nan]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.search(table).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert neighbours.search(table.limit(0)).count() == 0


def test_blocks_of_a_crowded_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=4).tolist() for i in range(300)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(table, target=1.0).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = exact(vectors)
    hits = sum(len(set(found[q]) & set(wanted[q])) for q in wanted)
    assert hits >= 0.97 * 5 * len(wanted)
