"""Operators over pairs and passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathlens.llm import catalog, decontaminate, jaccard_join, suffixes, textkit

DOCS = "doc_id long, text string, source string, copies int, signature string, score double"


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [("", text or "")])


def corpus(seed=3):
    """Texts with exact copies, near copies, shared passages, short and empty ones, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 140))) for _ in range(25)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    for i in range(12):
        w = texts[i % 4].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[7]] * 5 + [texts[9].upper() + "!"] * 2 + [passage + " " + texts[20], texts[21] + " " + passage, "x " * 30 + passage]
    texts += ["", "", None, "one two", "One, two!", "...", "...", "a b c d e", "long " * 3000]
    rows = [(i, t, "s", 1, "x", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, texts[7], None, None, None, None), (2, "other text of a known id", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def test_words_and_shingles_equal_plain_ones():
    texts = [t or "" for _, t, *_ in corpus()] + ["naïve ÉTÉ_1, 中文 ١٢", "İx"]
    block = textkit.Words(texts)
    for i, t in enumerate(texts):
        assert block.first[i + 1] - block.first[i] == len(words_of(t)), t
    sets = list(textkit.shingle_sets(texts))
    by_plain = defaultdict(set)
    for t, s in zip(texts, sets):
        assert len(s) == len(shingles(t))
        by_plain[shingles(t)].add(s.tobytes())
    assert all(len(v) == 1 for v in by_plain.values()) and len({next(iter(v)) for v in by_plain.values()}) == len(by_plain)


def test_join_equals_brute_force(spark, docs):
    members, links = jaccard_join.join(docs)
    got = members.toPandas()
    rows = [(i, t) for i, t, *_ in corpus()]
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append((i, t))
    keys = list(sets)
    near = {a: [b for b in keys if b is not a and 10 * len(a & b) >= 8 * len(a | b)] for a in keys}
    want = Counter()
    for a in keys:
        n = sum(len(sets[b]) for b in near[a]) + len(sets[a]) - 1
        want.update((None if i is None else i, n, len(near[a])) for i, _ in sets[a])
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_links, r.n_texts) for r in got.itertuples()) == want
    root, classes = {}, set()
    for a in keys:
        stack, seen = [a], {a}
        while stack:
            for b in near[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        root[a] = min((i for b in seen for i, _ in sets[b] if i is not None), default=None)
        classes.add(frozenset(seen))
    for r in got.itertuples():
        mine = [root[shingles(t)] for i, t in rows if (i if i is not None else -1) == (-1 if np.isnan(r.doc_id) else r.doc_id)]
        assert r.class_id in mine
    assert links.count() == len(keys) - len(classes)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)


def test_crowded_nodes_split_and_parts_meet_once(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "LIMIT", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_texts for r in jaccard_join.join(df)[0].collect()}
    distinct = set(map(shingles, texts))
    want = {i: sum(10 * len(shingles(t) & b) >= 8 * len(shingles(t) | b) for b in distinct) - 1 for i, t in enumerate(texts)}
    assert sum(abs(got[i] - want[i]) for i in want) <= 0.001 * sum(want.values())


def all_pairs(texts):
    """Number of links of each distinct set of shingles, comparing all with all that share a shingle."""
    sets = list(set(map(shingles, texts)))
    having = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            having[x].append(n)
    links = Counter()
    for n, s in enumerate(sets):
        common = Counter()
        for x in s:
            common.update(having[x])
        links[s] = sum(10 * c >= 8 * (len(s) + len(sets[m]) - c) for m, c in common.items() if m != n)
    return links


def test_recall_on_a_family_of_near_copies(spark):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for _ in range(1200):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_texts for r in jaccard_join.join(df)[0].collect()}
    want = all_pairs(texts)
    total = sum(want[shingles(t)] for t in texts)
    assert all(got[i] <= want[shingles(t)] for i, t in enumerate(texts)) and sum(got.values()) >= 0.999 * total > 10_000


def test_recall_on_the_sample_table(spark):
    docs = catalog.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.n_texts for r in jaccard_join.join(docs)[0].collect()}
    rows = docs.select("doc_id", "text").collect()
    want = all_pairs([r.text for r in rows])
    assert all(got[r.doc_id] <= want[shingles(r.text)] for r in rows)
    assert sum(got.values()) >= 0.99 * sum(want[shingles(r.text)] for r in rows)


def test_internal_names_and_repeated_rows(spark):
    """Columns named like those used inside come through, and of repeats the first by all columns stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "s", 5, "a", 1.5), (1, text, "s", 4, "b", 2.5), (1, text, "s", 4, "b", 2.5), (2, text + " x", "t", 3, "c", 3.5), (3, "other", "t", 2, "d", 4.5), (None, "none", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k0 int, K3 string, `set_key` double")
    first = [sorted(map(tuple, jaccard_join.keep_first(d).collect()), key=str) for d in (df, df.repartition(3))]
    assert first[0] == first[1] and jaccard_join.keep_first(df).columns == df.columns
    assert {r[0] for r in first[0]} == {1, 3, None} and len(first[0]) == 3 and all(r in rows for r in first[0])


def test_runs_follow_recall():
    assert jaccard_join.runs_for(0.9999, 0.8) > jaccard_join.runs_for(0.9, 0.8) >= 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.join(none)[0].count() == 0
    assert suffixes.repeats(none).count() == 0
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.clean(none, items).count() == 0


def test_suffixes_equal_brute_force(spark, docs):
    got = {(r.doc_id, r.n_words): [(s.start, s.end) for s in r.spans] for r in suffixes.repeats(docs).collect()}
    rows = {(i, t or "") for i, t, *_ in corpus()}
    copies = Counter(t for _, t in rows)
    places = defaultdict(set)
    for _, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add(t)
    want = {}
    for i, t in rows:
        w = words_of(t)
        spans = []
        for k in range(len(w) - 49):
            if len(places[tuple(w[k : k + 50])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + 50)
                else:
                    spans.append((k, k + 50))
        if copies[t] > 1 and len(w) >= 50:
            spans = [(0, len(w))]
        if spans:
            want[i, len(w)] = spans
    assert got == want


def test_passages_link_every_place_of_a_run(spark, docs):
    """Two texts share a run of words if and only if they have it at the same place of the same first text."""
    texts = {t or "" for _, t, *_ in corpus()}
    places = defaultdict(set)
    for t in texts:
        w = words_of(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((t, k))
    of, seen = {}, defaultdict(set)
    rows = {(i, t or "") for i, t, *_ in corpus()}
    heads = {t: min((i for i, x in rows if x == t and i is not None), default=None) for t in texts}
    by_head = {}
    for r in suffixes.repeats(docs, within=True).collect():
        for i, t in rows:
            if i == r.doc_id and len(words_of(t)) == r.n_words:
                for p in r.passages or []:
                    for k in range(p.start, p.end - 49):
                        run = tuple(words_of(t)[k : k + 50])
                        seen[run].add((t, k))
                        first = (p.first_doc, p.first_start + k - p.start)
                        assert of.setdefault(run, first) == first and p.places == len(places[run])
                        by_head.setdefault(first, set()).add(run)
    for run, at in places.items():
        if len({t for t, _ in at}) > 1 or max(k for _, k in at) - min(k for _, k in at) >= 50:
            assert seen[run] == at and of[run] in {(heads[t], k) for t, k in at}
        else:
            assert run not in seen
    assert all(len(x) == 1 for x in by_head.values()) and len(of) > 100


def test_suffixes_are_compared_across_partitions(spark, tmp_path):
    from pathlens.llm.work import Work

    rng = random.Random(8)
    rows = [(n, n % 7, "".join(f"w{rng.randrange(3)} " for _ in range(rng.randint(0, 12)))) for n in range(400)]
    df = spark.createDataFrame(rows, "text_key long, place int, words string").withColumnRenamed("words", "onward")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        found, _ = suffixes.neighbours(df, "onward", Work(spark, "test"))
        got = {(r.text_key, r.place): r.reach for r in found.groupBy("text_key", "place").max("reach").withColumnRenamed("max(reach)", "reach").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    split = [w.split() for *_, w in rows]
    assert got == {(n, k): max(common(split[n], o) for m, o in enumerate(split) if m != n) for n, k, _ in rows}


def test_repeats_within_a_text_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    p, q, period = fresh(63), fresh(49), fresh(30)
    texts = [fresh(20) + p + fresh(40) + p + fresh(5), p[:50] + p[:50], q + fresh(60) + q, period * 3 + period[:19], period[::-1] * 4, fresh(200)]
    texts += [fresh(9) + texts[5][40:110] + fresh(3) + texts[5][40:110], ["lone"] * 99, ["more"] * 100]
    texts = [" ".join(t) for t in texts] + [t or "" for _, t, *_ in corpus()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = defaultdict(set)
    for t in texts:
        w = words_of(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((t, k))
    want = {}
    for i, t in enumerate(texts):
        w, spans = words_of(t), []
        for k in range(len(w) - 49):
            at = places[tuple(w[k : k + 50])]
            if len({x for x, _ in at}) > 1 or max(x for _, x in at) - min(x for _, x in at) >= 50:
                if spans and k <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + 50)
                else:
                    spans.append((k, k + 50))
        if texts.count(t) > 1 and len(w) >= 50:
            spans = [(0, len(w))]
        if spans:
            want[i] = spans
    found = lambda df: {r.doc_id: [(s.start, s.end) for s in r.spans] for r in df.collect()}
    assert found(suffixes.repeats(docs, within=True)) == want
    assert want[0] == [(20, 83), (123, 186)] and 2 not in want and 3 not in want and 4 in want and 7 not in want and want[8] == [(0, 100)]
    monkeypatch.setattr(catalog, "table", lambda *_: docs)
    assert found(catalog.op9_repeated_passages(spark, "")) == want


def last_row(item, text):
    """Least distance of the item to a passage that ends at each place of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row


def distance(item, text):
    return min(last_row(item, text))


def anchored(item, text):
    """Distance of the item to each beginning of the text."""
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row


@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=40))
def test_bit_parallel_distance(item, text):
    row = last_row(item, text)
    assert decontaminate.Pattern(item).best(text) == (min(row), row.index(min(row)))
    row = anchored(item, text)
    assert decontaminate.Pattern(item).best(text, anchored=True) == (min(row), row.index(min(row)))


def plain_match(item, text):
    """(edits, start, end) of an item in a text, both normalised; None if it is not there."""
    if not item:
        return None
    if len(item) < decontaminate.LEAST_CHARS:
        places = [i for i in range(len(text)) if text.startswith(item, i) and text[i - 1 : i] in ("", " ") and text[i + len(item) :][:1] in ("", " ")]
        return (0, places[0], places[0] + len(item)) if places else None
    row = last_row(item, text)
    edits = min(row)
    if edits > int(len(item) * decontaminate.BUDGET):
        return None
    end = row.index(edits)
    back = anchored(item[::-1], text[:end][::-1])
    return edits, end - back.index(edits), end


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_decontamination_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    rng = random.Random(4)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    items = [(n, " ".join(word() for _ in range(rng.randint(8, 25)))) for n in range(6)] + [(6, "short"), (7, None), (None, " ".join(word() for _ in range(12))), (8, "Two words"), (9, "jj"), (10, "!")]
    texts = ["a short one of two words", "shorter than two wordsmiths", "JJ, jj", "two words short"]
    for n in range(40):
        item = list(decontaminate.normal(items[n % 6][1]))
        for _ in range(rng.randint(0, len(item) // 7)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters), item[at]]])
        texts.append(" ".join(word() for _ in range(10)) + " " + "".join(item).upper() + ", " + " ".join(word() for _ in range(10)))
    rows = [(n, t, "s", 1, "k") for n, t in enumerate([*texts, "", None, word(), "a" * 30_000 + " short"])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id string, k0 int, text_key string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontaminate.matches(df, bench).collect()}
    want = {}
    for i, t, *_ in rows:
        for n, item in items:
            if found := plain_match(decontaminate.normal(item or ""), decontaminate.normal(t or "")):
                want[i, n] = found
    assert got == want and {0, 3} & {n for _, n in want} and any(e for e, *_ in want.values())
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] not in {i for i, _ in want}), key=str)


def test_a_passage_with_insertions_begins_where_it_begins(spark):
    item = "the quick brown fox jumps over the lazy dog near the river"
    df = spark.createDataFrame([(1, "hello the quick brown foxx jumpss over thee lazy dog near the river and on")], "doc_id long, text string")
    r = decontaminate.matches(df, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.edits, r.start) == (3, 6)


def test_short_items_match_as_whole_words(spark):
    items = [(1, "Short one"), (2, "four"), (3, None), (4, "..."), (5, "exactly 23 letters long")]
    texts = ["a short one, here", "short ones", "a short", "Four", "fourth, twenty-four", "petit four four", "", None, "exactly 23 letters long", "exactly 23 letters lung"]
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontaminate.matches(df, bench).collect())
    assert got == [(0, 1, 0, 2, 11), (3, 2, 0, 0, 4), (4, 2, 0, 14, 18), (5, 2, 0, 6, 10), (8, 5, 0, 0, 23)]
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {1, 2, 6, 7, 9}
