"""Prefix trie, periodic runs and suffix deduplication against brute force, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import random

import numpy as np
import pytest

from lexiloom.llm import periodic, prefix_trie, suffix_dedup

# --- prefix trie ---

ROWS = "conv_id long, turn long, role string, text string, depth string"


def trie_by_hand(rows, listed=()):
    turns = collections.defaultdict(list)
    for c in listed:
        turns[c]
    for c, turn, role, text, _ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    members = collections.defaultdict(list)
    for c, rs in turns.items():
        path = tuple(r[2:] for r in sorted(rs))
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    out = []
    for p, who in members.items():
        below = [x for x in members if x[:len(p)] == p]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[:len(x)] == x for y in members)
        ends = ",".join(str(c) for c, e in sorted(who) if e)
        out.append((min(who)[0], len(p), min(members[p[:-1]])[0] if p else None, len(who), kids(p),
                    sum(kids(x) == 0 for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.drop("digest").collect()), key=str)


@pytest.mark.parametrize("width", [2, 3, 1 << 14])
def test_trie_sums_equal_brute_force_at_every_width(spark, width):
    rng = random.Random(11)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(7)):
            rows.append((c, t, "u" if t % 2 == 0 else "a", rng.choice(["hi", "hi", "éç", "x" * 9]), "clash"))
    rows += [(100, t, "u", "hi", None) for t in range(40)] + [(101, t, "u", "hi", None) for t in range(40)]
    listed = [*range(60), 777]
    df = spark.createDataFrame(rows, ROWS)
    ids = spark.createDataFrame([(c,) for c in listed], "conv_id long")
    assert trie_rows(prefix_trie.prefix_trie(df, ids, width=width)) == trie_by_hand(rows, listed)


def test_trie_of_nulls_ties_repeats_and_nothing(spark):
    rows = [(1, None, None, "b", None), (1, 0, "u", None, None), (1, 0, "u", None, None), (2, 5, "z", "t", None),
            (2, 5, "a", "t", None), (3, 1, "a", "t", None), (None, 0, "u", "lost", None), (-4, 1, "", "", None)]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, ROWS))) == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    named = spark.createDataFrame([("b", 0, "u", "x" * 100_000), ("a", 0, "u", "x" * 100_000)], "conv_id string, turn int, role string, text string")
    out = {r.depth: (r.conv_id, r.n_convs, r.saved_tokens) for r in prefix_trie.prefix_trie(named).collect()}
    assert out == {0: ("a", 2, 100_000), 1: ("a", 2, 100_000)}


def test_long_lists_of_ends_are_hashed_in_order(spark, monkeypatch):
    n = 3 * prefix_trie.CHUNK + 7
    df = spark.range(n).selectExpr("id AS conv_id", "0 AS turn", "'u' AS role", "'same' AS text")
    deep = [r for r in prefix_trie.prefix_trie(df).collect() if r.depth == 1]
    assert len(deep) == 1 and deep[0].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, size=(5000, 2), dtype=np.uint64)
    keys[2500:, 0] = keys[:2500, 0]  # digests that agree in half
    table = prefix_trie.NodeTable(np.concatenate([keys, keys[:10]]))
    assert sorted(table.slots(keys)) == list(range(5000))
    assert (table.slots(keys + np.uint64(1)) == -1).all() and len(prefix_trie.NodeTable(keys[:0])) == 0


def test_a_missing_node_or_shared_digest_is_an_error():
    one = np.array([[1, 2]], np.uint64)
    zero = np.zeros(1, np.int64)
    with pytest.raises(ValueError):
        prefix_trie.accumulate(np.concatenate([one, one]), np.concatenate([one, one]) * np.uint64(0), np.array([1, 2]), *[np.zeros(2, np.int64)] * 4)
    with pytest.raises(ValueError):
        prefix_trie.accumulate(one, one, np.array([-1]), zero, zero, zero, zero)


# --- periodic runs ---

def runs_by_hand(w, least=12):
    seen, out = set(), []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 20, 200])) for _ in range(rng.choice([0, 1, 11, 12, 30, 100, 500]))]
    for _ in range(rng.randrange(5)):
        if len(w) > 30:
            a, q, n = rng.randrange(len(w) - 12), rng.randint(1, 80), rng.randint(12, 300)
            for i in range(a + q, min(len(w), a + n)):
                w[i] = w[i - q]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(12)
    texts = [planted_words(rng) for _ in range(300)]
    found = periodic.find_runs([np.array(w, np.int64) for w in texts])
    assert found == [runs_by_hand(w) for w in texts] and sum(map(len, found)) > 100
    assert periodic.find_runs([]) == [] and periodic.find_runs([np.zeros(0, np.int64)]) == [[]]


def test_segments_hold_no_word_that_stands_once():
    w = np.array([1, 2, 9, 1, 2, 1, 2, 1, 2, 7, 3, 3, 8, 3, 4, 3])
    for start, end in periodic.surviving_segments(w, 4):
        assert end - start >= 4 and np.unique(w[start:end], return_counts=True)[1].min() > 1
    assert periodic.surviving_segments(w, 4) == [(3, 9)]


def test_periodic_runs_of_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 30, "ä b\x0bc\td " * 8 + "e", "ab ba " * 6, "x y " * 12, "one two three",
             " ".join(str(x) for x in range(100)), "w " * 50_000, " ".join(map(str, planted_words(rng)))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "a " * 30, "again", 2), (None, "a " * 30, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, extra int")
    out = periodic.periodic_runs(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "extra", "n_words", "runs", "collapsed"}
    for r in out:
        words = (r.text or "").encode().split()
        if r.text and len(words) > 10_000:
            expected = [(0, 50_000, 1)]
        else:
            expected = runs_by_hand(words)
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(words)
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


# --- suffix deduplication ---

@pytest.mark.parametrize("depth", [4, 8, 10, 100])
@pytest.mark.parametrize("letters", [b"ab", b"abc", bytes(range(256)), b"zyxwvutsr"])
def test_two_stage_sorting_orders_suffixes(depth, letters):
    rng = random.Random(depth)
    bodies = [bytes(rng.choice(letters) for _ in range(rng.randint(depth, depth + 60))) for _ in range(40)]
    bodies += bodies[:5] + [letters[:1] * (depth * 3)] * 2 + [letters[:1] * depth + letters[-1:] + letters[:1] * depth]
    raw = b"".join(bodies) + bytes(depth + 8)
    data, size = np.frombuffer(raw, np.uint8), np.array([len(b) for b in bodies])
    ends = np.cumsum(size)
    order = suffix_dedup.sorted_suffixes(data, ends - size, ends, size - depth + 1, depth)
    strings = [raw[i:i + depth] for i in order]
    assert sorted(order) == [i for e, n in zip(ends, size) for i in range(e - n, e - depth + 1)] and strings == sorted(strings)
    shared = suffix_dedup.common_prefixes(order, suffix_dedup._words(data), depth)
    for a, b, n in zip(strings, strings[1:], shared[1:]):
        assert n == next((i for i in range(depth) if a[i] != b[i]), depth)


def kept_by_hand(rows, least):
    """rows of (id, text): bytes left, by equal rows' order of id and hash."""
    order = sorted({(r[0] is not None, r[0] or 0, r[2], (r[1] or "").encode()) for r in rows})
    seen, out = set(), {}
    for named, i, _, data in order:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            if data[p:p + least] in seen:
                gone[p:p + least] = True
            seen.add(data[p:p + least])
        out[(i if named else None, data)] = bytes(b for b, g in zip(data, gone) if not g)
    return out


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_suffix_dedup_equals_brute_force(spark, block):
    from pyspark.sql import functions as F

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = [" ".join([word() for _ in range(rng.randrange(60))] + rng.sample(passages, rng.randrange(3)) + [word() for _ in range(9)])
             for _ in range(40)]
    texts += [texts[0], texts[0], "", None, "z" * 700, "q" * 30 + "z" * 150, "xyz" * 200, passages[0][:99], passages[0][3:103], "é" * 120]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, passages[1] + " other"), (None, passages[2]), (None, passages[2] + "!")]
    df = spark.createDataFrame([(i, t, "clash", "more") for i, t in rows], "doc_id long, text string, kept string, extra string")
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    expected = kept_by_hand([tuple(r) for r in hashed], 100)
    out = suffix_dedup.dedup_suffixes(df, block_windows=block).collect()
    assert len(out) == len(rows)
    for r in out:
        data = (r.text or "").encode()
        assert bytes(r.kept) == expected[(r.doc_id, data)], (r.doc_id, r.text)
        left, at = b"", 0
        for span in r.removed:
            assert span.bytes >= 100
            left, at = left + data[at:span.first], span.first + span.bytes
        assert left + data[at:] == bytes(r.kept) and (r.n_bytes, r.n_removed) == (len(data), len(data) - len(r.kept)) and r.extra == "more"
    assert suffix_dedup.dedup_suffixes(df.limit(0)).count() == 0


def test_suffix_dedup_of_string_ids(spark):
    body = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([("b", body + " tail of b"), ("a", "head " + body)], "name string, body string")
    out = {r.name: r.n_removed for r in suffix_dedup.dedup_suffixes(df, key="name", text="body").collect()}
    assert out == {"a": 0, "b": len(body) + 1} or out == {"a": 0, "b": len(body)}


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("least", [40, 300])
def test_suffix_dedup_gives_the_same_whether_marks_are_sent_or_documents_joined(spark, most, least):
    rng = random.Random(17)
    passages = ["".join(rng.choice("abcde ") for _ in range(400)) for _ in range(3)]
    texts = ["".join(rng.choice("abcde ") for _ in range(60)) + rng.choice(passages) + str(i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[1], "w" * 1000, "v" * 300])] + [(None, texts[2]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = [sorted((str(r.doc_id), r.text, bytes(r.kept), r.n_removed, str(r.removed)) for r in suffix_dedup.dedup_suffixes(
        df, least=least, block_windows=block, most_documents=m).collect()) for m, block in ((most, 1 << 17), (most, 50), (100, 1 << 17))]
    assert results[0] == results[1] == results[2] and sum(r[3] for r in results[0]) > 3000


def test_suffix_dedup_ships_no_windows_of_copies_and_few_that_stand_once(spark, monkeypatch):
    rng = random.Random(19)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(100, texts[0][500:800])]
    tables = {}

    def written(df, name):
        tables[name] = df.localCheckpoint()
        return tables[name]

    cut = suffix_dedup._cut_out
    shipped = spark.sparkContext.accumulator(0)

    def counting(*args):
        def f(batches):
            for batch in cut(*args)(batches):
                shipped.add(batch.num_rows)
                yield batch
        return f

    monkeypatch.setattr(suffix_dedup, "written", written)
    monkeypatch.setattr(suffix_dedup, "_cut_out", counting)
    out = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in out.items() if n} == {*range(20, 60), 100} and tables["copies"].count() == 40
    assert shipped.value < 100  # of about 60 times 50 pieces
