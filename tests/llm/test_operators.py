"""The ten operators on small planted tables, against plain Python, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import (
    chat, components, decontamination, language_id, line_dedup, merkle, mixing, near_dedup, quality, substring_dedup,
    url_filter,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOC)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    pages = spark.createDataFrame([
        (1, "http://bad.net/es/1", None, "x"), (2, "http://mirror.org/1", link.format("http://bad.net/es/1"), "x"),
        (3, "https://mirror.org/2/", '<META http-equiv=refresh content="0; url=HTTP://mirror.org/1?utm_source=a#t">', "x"),
        (4, "http://www.example.com/en/5", link.format("http://bad.net/es/1"), "x"),
        (5, "http://other.org/", "<html></html>", "x"), (6, None, None, "x"), (7, "no url", "", "x"),
        (8, "http://example.com/en/1", "", "x"), (8, "http://example.com/en/1", "", "x"),
        (9, "HTTP://A.Example.COM?q=/en/", "", "x")],
        "page_id long, url string, html string, verdict string")
    from lexiloom.llm.queries import RULES

    out = url_filter.filter_urls(pages, RULES)
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == 10 and found == {
        1: ("bad.net", "net/es/", "block"), 2: ("mirror.org", None, "block"), 3: ("mirror.org", None, "block"),
        4: ("www.example.com", "www.example.com/en/", "allow"), 5: ("other.org", None, "allow"), 6: ("", None, "allow"),
        7: ("", None, "allow"), 8: ("example.com", "example.com/en/", "block"), 9: ("a.example.com", None, "allow")}
    table = spark.createDataFrame(list(RULES), "rule string, verdict string")
    assert {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, table).collect()} == found
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_redirect_tables_join_addresses(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y")], "page_id long, url string")
    hops = spark.createDataFrame([("http://a.org/x", "http://c.org/"), ("http://c.org", "http://spam.net/q")],
                                 "source string, target string")
    out = url_filter.filter_urls(pages, [("spam.net/", "block")], html=None, redirects=hops)
    assert {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "allow"}


def test_lines_stay_in_the_largest_document(spark):
    often = "  A line that is certainly longer than forty characters \t"
    rows = [(i, f"own {i}\n{often}\nshort") for i in range(6)] + [(6, None), (7, ""), (None, often), (3, often.lower())]
    out = line_dedup.dedup_lines(documents(spark, rows).withColumn("n_lines", F.lit("x")))
    kept = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert kept == sorted(
        [(str(i), f"own {i}\nshort", 3, 1) for i in range(5)] + [("5", f"own 5\n{often}\nshort", 3, 0)]
        + [("6", "", 1, 0), ("7", "", 1, 0), ("None", "", 1, 1), ("3", "", 1, 1)])
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_runs_are_compacted_and_later_batches_see_earlier_ones(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    line = "a line that is certainly longer than forty characters"
    for batch in range(5):
        docs = documents(spark, [(batch, f"{line}\n{prose(batch, 12)}"), (batch + 100, line)])
        out = {r.doc_id: r.n_dropped for r in line_dedup.add_batch(store, docs).collect()}
        assert out == ({0: 1, 100: 0} if batch == 0 else {batch: 1, batch + 100: 1})
    assert store.runs() == [1, 0, 1] and store.totals().agg(F.max("docs")).first()[0] == 10


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(0, 30)) or None, None, rng.choice(["a", "b", "b", "b", None, "Z"]), 0) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows + rows[:3], DOC)).collect()
    assert len(out) == 603
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want, capped, weight = {}, set(), dict(zip(["Z", "a", "b", None], [3, 1, 2, 3]))
    while True:
        free = [s for s in sizes if s not in capped]
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        want = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in sizes}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert {s: pytest.approx(v) for s, v in want.items()} == target
    assert all(abs(taken[s] - target[s]) <= 31 for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows + rows[:3], DOC).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_repeated_passages_are_found_despite_shifts(spark):
    passage = prose(1, 60)
    rows = [(1, prose(2, 80) + " " + passage), (2, prose(3, 45) + "x " + passage + " " + prose(4, 30)), (3, prose(5, 100)),
            (4, None), (5, ""), (None, "ü" * 300), (6, prose(6, 3000))]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, rows)).collect()}
    assert out[1].n_dropped == 0 and out[1].n_repeated > 150 and out[2].n_dropped > 150
    assert all(out[i].n_repeated == 0 for i in (3, 4, 5, None, 6))
    text = dict(rows)[2]
    (span,) = out[2].repeats
    assert out[2].text == text[:span["first"]] + text[span["first"] + span["bytes"]:]
    assert text[span["first"]:span["first"] + span["bytes"]] in passage
    assert substring_dedup.dedup_substrings(documents(spark, [])).count() == 0


def test_chunks_cover_the_text_and_cuts_follow_the_content():
    c = substring_dedup.Chunking()
    data = prose(9, 2000).encode()
    h = substring_dedup.gear_hash(np.frombuffer(data, np.uint8), c.window)
    gear = np.random.default_rng(4).integers(0, 1 << 63, size=256, dtype=np.uint64)
    slow = sum(int(gear[data[100 - j]]) << j for j in range(c.window)) % 2**64
    assert int(h[100]) == slow
    cuts = substring_dedup.cut_points(data, c)
    assert cuts[-1] == len(data) and all(0 < b - a <= c.largest for a, b in zip([0, *cuts], cuts))
    moved = substring_dedup.cut_points(b"shifted by this " + data, c)
    assert len({x + 16 for x in cuts} & set(moved)) > 0.9 * len(cuts)
    assert substring_dedup.cut_points(b"", c) == []


def test_passages_in_shifted_surroundings_and_inside_a_document(spark):
    rows, passages = [], {}
    for i in range(300):
        passage = prose(1000 + i, 51)
        passages[i] = len(passage)
        rows += [(2 * i, prose(5000 + i, 20 + i % 7) + "x" * (i % 5) + " " + passage + " " + prose(7000 + i, 30)),
                 (2 * i + 1, prose(9000 + i, 30 + i % 11) + " " + passage + " " + prose(11000 + i, 20 + i % 3))]
    twice = prose(1, 60)
    rows += [(9000, prose(2, 40) + " " + twice + " " + prose(3, 50) + " " + twice + " " + prose(4, 40))]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, rows)).collect()}
    assert min(passages.values()) > 204
    assert all(out[2 * i + 1].n_dropped >= 100 and out[2 * i].n_repeated >= 100 and not out[2 * i].n_dropped for i in passages)
    assert out[9000].n_dropped > 150 and len(out[9000].repeats) == 2


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = [prose(i, 60).split() for i in range(5)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one "), (205, "a b c d e"), (206, "a b c d e f"),
             (207, "a b c d e f g"), (206, "a b c d e f")]
    s = near_dedup.Sketch()
    sets = [(i, set(near_dedup.shingle_set(t, 2, {}).tolist())) for i, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= s.percent * len(a | b):
                label = [label[y] if v == label[x] else v for v in label]
    least = {}
    for (i, _), v in zip(rows, label):
        least[v] = min(i, least.get(v, i))
    want = sorted((i, len(a), least[v], least[v] == i) for (i, a), v in zip(sets, label))
    docs = documents(spark, rows)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == want
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    blocked = near_dedup.near_duplicates(documents(spark, [(None, "a b c"), (None, "x y z"), (1, "a b c")])).collect()
    assert {(str(r.doc_id), r.component_id, r.kept) for r in blocked} == {
        ("1", 1, True), ("None", None, True), ("None", 1, False)}


def test_near_copies_without_an_id_are_linked(spark):
    text = prose(1, 80)
    rows = [(7, text), (None, text + " more"), (8, prose(2, 80)), (None, prose(3, 80)), (None, prose(3, 80) + " more")]
    out = near_dedup.near_duplicates(documents(spark, rows)).collect()
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out)
    assert found == [("7", "7", True), ("8", "8", True), ("None", "7", False), ("None", "None", True), ("None", "None", True)]


def test_registers_merge_and_the_likelihood_finds_the_similarity():
    s = near_dedup.Sketch()
    a, b = (near_dedup.shingle_set(t, 2, {}) for t in (prose(1, 800), prose(1, 600) + " " + prose(2, 200)))
    ra, rb = near_dedup.registers(a, s), near_dedup.registers(b, s)
    assert (near_dedup.registers(np.union1d(a, b), s) == np.maximum(ra, rb)).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = near_dedup.joint_estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]), s)[0]
    assert abs(found - true) < 0.12


def test_blocks_find_links_that_pivots_miss(spark):
    sets = {bytes([i]): np.arange(i * 3, i * 3 + 40, dtype=np.uint64) for i in range(6)}
    live = spark.createDataFrame([(1, bytearray(c), 40, bytearray(c)) for c in sets], "key long, c binary, n long, root binary")
    table = spark.createDataFrame([(bytearray(c), bytearray(x.tobytes())) for c, x in sets.items()], "c binary, shingles binary")
    for block in (2, 600):
        links = near_dedup._in_blocks(live, table, near_dedup.Sketch(), block).collect()
        found = components.connected_components(spark.createDataFrame(links, "a binary, b binary"), "a", "b")
        assert found.select("component").distinct().count() == 1 and found.count() == 6


def test_hits_equal_brute_force(spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    items = [(1, prose(1, 14)), (2, "Tiny item, ÉCOLE"), (3, None), (4, "..."), (5, prose(1, 14)), (None, prose(2, 25)), (11, "solo")]
    docs = [(1, prose(7, 5) + " " + prose(1, 14).upper() + "!" + prose(8, 5)), (2, "a tiny; item école b tiny item ÉCOLE"),
            (3, None), (4, ""), (5, prose(2, 11)), (6, prose(3, 50)), (1, "other"), (None, "solo Solo"),
            (8, " ".join([prose(1, 14)] * 3)), (9, prose(2, 9))]
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t))
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at:at + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in docs:
        w = pattern.findall(lower(t))
        hit, names = set(), set()
        for g, who in windows.items():
            for at in range(len(w) - len(g) + 1):
                if tuple(w[at:at + len(g)]) == g:
                    hit |= set(range(at, at + len(g)))
                    names |= who
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((str(i), len(w), len(hit), len(names), digest, bool(hit)))
    rows = documents(spark, docs).withColumn("n_hit", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 0):
        out = decontamination.decontaminate(rows, table, broadcast_places=bound)
        got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()]
        assert sorted(got) == sorted(want)
        assert all(sum(s["words"] for s in r.spans) == r.n_hit for r in out.collect())
    assert not decontamination.decontaminate(rows, table.limit(0)).where("contaminated").count()
    assert decontamination.decontaminate(rows.limit(0), table).count() == 0


WORDS = {"xx": "the of and to in that is was", "yy": "der die und das ist nicht ein zu", "zz": "le la les des une est pas que"}


def spoken(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_languages_are_learned_and_calibrated(spark):
    rows = [(i, spoken(lang, i), lang, "s", 0) for i, lang in enumerate(list(WORDS) * 60)]
    odd = [(1000, None, None, "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !", "xx", "s", 0), (1003, "THE AND OF TO", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOC)
    model = language_id.fit_languages(docs, where=F.col("doc_id") < 120)
    assert 0 < model.non_zero < model.table.size and model.temperature > 0
    out = {r.doc_id: r for r in language_id.predict_languages(docs.withColumn("score", F.lit("x")), model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, _, _ in rows) and all(0 < out[i].score <= 1 for i, *_ in rows)
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and out[1003].lang_pred == "xx"
    assert language_id.fit_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict_languages(docs, None).collect()} == {"und"}


def test_giant_texts_are_read_in_pieces(monkeypatch):
    s = language_id.Settings()
    text = "12 ab, Cé!! " * 40 + "x" * 70 + " .. end."
    read = lambda: [np.sort(np.concatenate(x)) for x in zip(*language_id.bucket_pieces(text, s))]
    whole = read()
    for piece in (1, 2, 7, 30, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, read()))


def test_foreign_and_garbled_texts_are_not_known_and_short_ones_are(spark):
    rng = random.Random(9)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(["ba", "to", "mi"], 60), "aa", None, None) for i in range(150)] + [(200 + i, make(["쿠", "로", "마", "시"], 40), "kk", None, None) for i in range(150)]
    probes = [(900, "batomi ba", True), (901, "쿠로", True), (902, "zzqx jjkv wwpq xxrr", False), (903, "Русский текст без примеров", False),
              (904, "日本語のテキスト", False), (905, "to", True), (906, make(["ba", "to", "mi"], 4000), True), (907, "1234", False), (908, None, False)]
    docs = spark.createDataFrame(rows + [(i, t, None, None, None) for i, t, _ in probes], DOC)
    out = {r.doc_id: r for r in language_id.predict_languages(docs, language_id.fit_languages(docs)).collect()}
    assert {i: out[i].known for i, _, _ in probes} == {i: k for i, _, k in probes}
    assert all(out[i].known and out[i].lang_pred == lang for i, _, lang, _, _ in rows)


def test_no_language_is_left_out_however_many(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + a for a in letters for b in letters if a != b][:260]
    rows = [(2 * i + j, f"{w} " * 12, f"l{i:03}", None, None) for i, w in enumerate(words) for j in range(2)]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.fit_languages(docs, settings=language_id.Settings(bits=12))
    assert model.labels == sorted({r[2] for r in rows}) and len(model.labels) == 260


def test_quality_rules_separate_shouting_from_prose(spark):
    rows = [(i, prose(i, 40) if i % 3 else " ".join(["BUY!!"] * 40)) for i in range(240)] + [(900, None), (901, "")]
    docs = documents(spark, rows).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert model.rules and all(w for _, w in model.rules)
    out = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert len(out) == 242 and all((out[i] > 0.5) == (i % 3 > 0) for i in range(240)) and all(0 <= x <= 1 for x in out.values())
    assert quality.fit_quality(docs, labels.limit(0)).rules == ()
    one = quality.score_quality(docs, quality.fit_quality(docs, labels.where("quality = 1"))).first().score
    assert 0.9 < one < 1


def test_fingerprints_in_order_of_ids(spark):
    rows = [(i, prose(i, 3 * i) if i % 7 else None) for i in range(1, 60)] + [(60, "one\n\ntwo\nthree"), (61, "x" * 5000), (5, "repeat")]
    for parts in (5, 1):
        docs = documents(spark, rows).repartition(parts)
        out = merkle.fingerprint_documents(docs, rows_per_partition=9).collect()
        assert len(out) == len(rows)
        texts = dict(rows[:-1])
        ids = sorted(texts)
        by_id = {r.doc_id: r for r in out if r.doc_id not in (4, 5)}
        for a, b in zip(ids, ids[1:] + ids[:1]):
            if a in by_id:
                other = merkle.edited(texts[a] or "", texts[b] or "")
                r = by_id[a]
                assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest() and r.n_chars == len(texts[a] or "")
                assert r.edited_fingerprint == merkle.fingerprint(other) and 0 <= r.near_next <= r.near_edited <= 1
    assert merkle.fingerprint_documents(documents(spark, [])).count() == 0
    (single,) = merkle.fingerprint_documents(documents(spark, [(None, "abcd efgh")])).collect()
    assert single.near_next == 1.0


def test_trees_locate_edits():
    lines = [prose(i, 40) for i in range(20)]
    a = merkle.fingerprint("\n".join(lines))
    assert a == merkle.fingerprint("\n".join(lines)) and merkle.differing(a, a) == []
    lines[11] = lines[11][:100] + "CHANGED" + lines[11][100:]
    b = merkle.fingerprint("\n".join(lines))
    spots = merkle.differing(a, b)
    assert a.split("/")[0] != b.split("/")[0] and 1 <= len(spots) <= 3 and len({s[:2] for s in spots}) == 1
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.fingerprint(prose(99, 300))) < 0.1


def test_texts_of_any_two_sizes_are_comparable():
    words = prose(5, 400)
    for bound in (120, 400):
        for a, b in ((bound + 4, bound - 16), (bound - 4, bound + 16), (bound, bound - 1)):
            a, b = words[:a], words[:a * 3 // 4] + " " + prose(6, 100)[:b - a * 3 // 4 - 1]
            assert (len(a) < bound) != (len(b) < bound)
            assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) > 0.5
    assert merkle.likeness(merkle.fingerprint(words), merkle.fingerprint(words[:390])) > 0.2
    odd = b" a  b " + b"x" * 3000 + b" y"
    assert b"".join(merkle._pieces(odd)) == odd and max(map(len, merkle._pieces(odd))) <= merkle.LONGEST


def digests(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return turns.hexdigest(), loss.hexdigest()


def test_conversations_come_back_from_their_format(spark):
    rng = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", "<\\/s> \\ [\\\\INST]", "<|end|>\n<|turn|>user<|text|>", "", "a\nb", "<|text|>é"]
    talks = {c: [(rng.choice(["user", "assistant", "sys\ntem", "<|end|>"]), rng.choice(odd)) for _ in range(n)]
             for c, n in ((1, 3), (2, 1), (3, 90))}
    rows = [(c, t, r, x) for c, talk in talks.items() for t, (r, x) in enumerate(talk)]
    rows += [(None, None, None, None), (4, 1, "assistant", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_conversations(df)
    out = {r.conv_id: r for r in chat.digest_conversations(turns).collect()}
    for c, talk in talks.items():
        whole = chat.plain_template(talk)
        assert (out[c].turns_sha256, out[c].loss_sha256) == digests(talk) and out[c].formatted_chars == len(whole)
        assert out[c].n_turns == len(talk) and out[c].rewrites == 0
        for r in turns.where(F.col("conv_id") == c).collect():
            assert whole[r.span_start:r.span_end] == r.piece
            assert chat.unescape(whole[r.text_start:r.text_end]) == talk[r.number][1]
    assert out[None].turns_sha256 == digests([("", "")])[0] and out[4].loss_chars == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_noticed(spark):
    df = spark.createDataFrame([(1, t, "user", f"say {t}") for t in range(4)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df, lambda ms: f"{len(ms)} turns" + "".join(f"|{x}" for _, x in ms)).collect()
    assert out[0].rewrites > 0 and all(r.rewrites > 0 for r in out)


def test_rewrites_are_noticed_at_any_length(spark):
    def moving(messages):  # the system text stands before the last user turn
        system = "".join(x for r, x in messages if r == "system")
        last = max((i for i, (r, _) in enumerate(messages) if r == "user"), default=-1)
        return "".join(f"<{r}>{system * (i == last)}{x}\n" for i, (r, x) in enumerate(messages) if r != "system")

    def demanding(messages):
        if messages and messages[0][0] != "user":
            raise ValueError("a user turn comes first")
        return chat.plain_template(messages)

    talk = [("system", "Be kind. ")] + [(("user", "assistant")[i % 2], f"say {i}") for i in range(50)]
    rows = [(1, t, r, x) for t, (r, x) in enumerate(talk)]
    schema = "conv_id long, turn long, role string, text string"
    text, seen = "", 0
    for r in chat.format_conversations(spark.createDataFrame(rows, schema), moving).collect():
        text = text[:len(text) - r.rewrites] + r.piece
        whole = moving(talk[:r.number + 1])
        assert text == whole and (r.span_start, r.span_end) == (len(whole) - len(r.piece), len(whole))
        seen += r.role == "user" and r.rewrites > 0
    assert seen == 24
    short = spark.createDataFrame(rows[1:], schema)
    for context in (None, 1):
        out = chat.format_conversations(short, chat.plain_template, context=context).collect()
        assert "".join(r.piece for r in out) == chat.plain_template(talk[1:]) and not any(r.rewrites for r in out)
    out = chat.format_conversations(short, demanding).collect()
    assert "".join(r.piece for r in out) == chat.plain_template(talk[1:])


def test_chunks_repeated_in_different_places_are_no_passage(spark):
    c = substring_dedup.Chunking()
    data = prose(77, 70).encode()
    ends = substring_dedup.cut_points(data, c)
    # Every chunk stands elsewhere, in a window too short to be a repeat; the text as a whole stands nowhere.
    rows = [(1000, data.decode())]
    for i, end in enumerate(ends):
        begin = ends[i - 1] if i else 0
        spare = (95 - (end - begin)) // 2
        rows.append((i, prose(200 + i, 30) + " " + data[max(0, begin - spare):end + spare].decode("utf-8", "ignore") + " " + prose(600 + i, 30)))
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, rows)).collect()}
    assert all(r.n_repeated == r.n_dropped == 0 for r in out.values())


def test_dropped_bytes_stand_earlier_in_the_given_documents(spark):
    import pathlib

    path = "/root/testdata/sf0.001/documents.parquet"
    if not pathlib.Path(path).exists():
        pytest.skip("test tables not present")
    docs = spark.read.parquet(path).select("doc_id", "text")
    out = sorted(substring_dedup.dedup_substrings(docs).join(docs.withColumnRenamed("text", "whole"), "doc_id").collect(), key=lambda r: r.doc_id)
    first, everywhere = {}, collections.Counter()
    for r in out:
        data = (r.whole or "").encode()
        everywhere.update(data[i:i + 100] for i in range(len(data) - 99))
    dropped = passages = caught = 0
    for r in out:
        data = (r.whole or "").encode()
        covered, common = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        places = []
        for i in range(len(data) - 99):
            w = data[i:i + 100]
            covered[i:i + 100] |= w in first
            common[i:i + 100] |= everywhere[w] > 1
            places.append(first.setdefault(w, (r.doc_id, i)))
        for span in r.repeats:
            assert common[span["first"]:span["first"] + span["bytes"]].all()
        assert r.n_dropped <= covered.sum()
        dropped += r.n_dropped
        # Passages of over fifty words that stand as a whole in one earlier place.
        begin = 0
        for i in range(1, len(places) + 1):
            if i < len(places) and places[i][0] == places[i - 1][0] and places[i][1] - i == places[i - 1][1] - (i - 1):
                continue
            if places[begin] != (r.doc_id, begin) and len(data[begin:i + 99].split()) > 52:
                passages += 1
                caught += any(begin < s["first"] + s["bytes"] and s["first"] < i + 99 for s in r.repeats)
            begin = i
    assert dropped > 0 and passages > 5 and caught == passages


def test_rules_win_alike_on_both_sides_of_the_bound(spark, monkeypatch):
    rules = [("a.com/bc/", "allow"), ("x.a.com/b", "block"), ("b.org/", "block"), ("B.org/", "allow"), ("c.net", "block"),
             ("c.net", "allow"), ("İ.com/", "block"), ("d.de/x", "block"), (None, "block"), ("d.de/", "allow")]
    urls = ["http://x.a.com/bc/d", "http://a.com/bc/", "http://b.org/", "http://c.net/q", "http://İ.com/", "http://D.de/x", "http://d.de/y", None, "x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    judge = lambda: {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, html=None).collect()}
    compiled = judge()
    monkeypatch.setattr(url_filter, "COMPILED_RULES", 0)
    assert compiled == judge() == {0: ("x.a.com/b", "block"), 1: ("a.com/bc/", "allow"), 2: ("B.org/", "allow"), 3: ("c.net", "allow"),
                                   4: ("İ.com/", "block"), 5: ("d.de/x", "block"), 6: ("d.de/", "allow"), 7: (None, "allow"), 8: (None, "allow")}
    plenty = [*rules, *((f"z{i}.com/", "block") for i in range(600))]
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, plenty, html=None).collect()} == compiled


def test_links_resolve_as_in_a_browser(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d?q", "https://a.b", "http://a.b/c/d/", "http://a.b/?x=/y"]
    links = ["//bad.net/es/1", "/es/1", "es/1", "../x/./y", "?p=1", "http://o.org/z", "/a/b/..", "/a/../../b/?q=/../z", "./", "HTTP://U.org/Q"]
    rows = [(b, x, urljoin(b, x)) for b in bases for x in links]
    df = spark.createDataFrame(rows, "base string, link string, expected string")
    for r in df.select("*", url_filter.resolved("link", "base").alias("found")).collect():
        assert r.found.lower() == r.expected.lower(), r
    none = spark.createDataFrame([("http://a.b/", "mailto:x@y"), ("no url", "/x"), (None, "/x"), ("http://a.b/", None)], "base string, link string")
    assert {r.found for r in none.select(url_filter.resolved("link", "base").alias("found")).collect()} == {None}
    tags = ['<link rel="canonical" href="//bad.net/es/1">', "<link href='/es/1' rel='shortcut canonical'>", '<LINK REL = canonical HREF = "http://bad.net/es/2" >',
            '<link rel="alternate" href="http://bad.net/es/3">', '<meta http-equiv = "Refresh" content = "0; URL = http://bad.net/es/4">']
    pages = spark.createDataFrame([(i, f"http://{h}/p{i}", t) for i, (h, t) in enumerate(zip(["x.org", "bad.net", "y.org", "z.org", "w.org"], tags))],
                                  "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [("net/es/", "block")]).collect()}
    assert out == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "block"}


def test_likeness_equals_brute_force_and_heeds_order():
    def by_hand(a, b):
        pairs = [collections.Counter(), collections.Counter()]
        for text, into in zip((a, b), pairs):
            for line in text.split("\n"):
                row = ["^", *(re.findall("[^ ]* |[^ ]+", line) or [""]), "$"]
                into.update(zip(row, row[1:]))
        return 2 * (pairs[0] & pairs[1]).total() / (pairs[0].total() + pairs[1].total())

    rng = random.Random(7)
    texts = ["", "a", "one", "\n\n", "a b\n\na b"] + ["\n".join(prose(rng.randrange(9), rng.randrange(12)) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    for a in texts:
        for b in rng.sample(texts, 6):
            expected = 1.0 if a == b else by_hand(a, b)
            assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == pytest.approx(expected, abs=0.02)
    words = prose(3, 300).split()
    shuffled = rng.sample(words, len(words))
    assert merkle.likeness(merkle.fingerprint(" ".join(words)), merkle.fingerprint(" ".join(shuffled))) < 0.1
    long = prose(4, 2000)
    assert len(merkle.fingerprint(long)) < 0.65 * len(long)
    glued = "".join(prose(5, 2000).split())
    moved = glued[:500] + "inserted" + glued[500:]
    assert merkle.likeness(merkle.fingerprint(glued), merkle.fingerprint(moved)) > 0.95


def test_no_control_string_stays_as_it_is():
    strings = ["<|im_start|>", "<|eot_id|>", "<|reserved_special_token_0|>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
               "<｜begin▁of▁sentence｜>", "[TOOL_CALLS]", "[/INST]", "<s>", "</s>", "<bos>", "<eos>", "<|turn|>", "<|text|>", "<|end|>"]
    rng = random.Random(4)
    pieces = strings + ["<", "[", "\\", "|", "s>", "x", " ", "\n", "INST]", ">"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        masked = chat.escape(text)
        assert chat.unescape(masked) == text and not any(s in masked for s in strings), text
        assert chat.parse_turns(chat.plain_template([("user", text), (text, "x")])) == [("user", text), (text, "x")]


def test_conversation_ids_of_other_types(spark):
    rows = [(3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (None, 0, "user", None)]
    for kind in ("int", "string", "decimal(9,2)"):
        df = spark.createDataFrame(rows, "c long, turn long, role string, text string").selectExpr(f"CAST(c AS {kind}) AS conv_id", "turn", "role", "text")
        out = {r.conv_id is None: (r.n_turns, r.loss_chars) for r in chat.digest_conversations(chat.format_conversations(df)).collect()}
        assert out == {False: (2, 3), True: (1, 0)}


def test_winnowing_keeps_few_grams_of_every_window(spark):
    words = prose(21, 3000)
    df = spark.createDataFrame([(words,)], "text string").select(decontamination.words_of("text").alias("_w"))
    row = decontamination._hashed(df, 5).select("_g", decontamination._winnowed(5, 10).alias("kept")).first()
    kept = set(row.kept)
    assert 0.25 < len(kept) / 3000 < 0.32
    for i in range(len(row._g) - 5):
        window = row._g[i:i + 6]
        assert i + window.index(min(window)) in kept


def test_lines_of_documents_with_other_ids(spark):
    line = "a line that is long enough to be counted as one, surely"
    rows = [(f"k{i}", line + "\nown line of " + "x" * i) for i in range(7)] + [(None, line)]
    out = {r.name: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "name string, body string"), key="name", text="body").collect()}
    assert out == {**{f"k{i}": (2, 1) for i in range(6)}, "k6": (2, 0), None: (1, 1)}


def test_rows_that_share_an_id_go_and_stay_by_their_text(spark):
    a, b = prose(31, 60), prose(32, 60)
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (9, "alone " + prose(33, 50), "y"), (9, "alone " + prose(33, 50), "z"), (None, near, "x"),
            (4, None, "x"), (4, None, "x"), (8, "", "x"), (None, "unnamed " + prose(34, 50), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = near_dedup.keep_one_of_each(df, sketch=near_dedup.Sketch(words=5)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[7], rows[8], rows[9], rows[10]]))
    assert near_dedup.keep_one_of_each(df.limit(0)).count() == 0
