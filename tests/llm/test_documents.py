"""Near-duplicates, passages, leaks and surrogates against brute force, planted cases and odd input."""

import random
import re

import numpy as np
import pytest

from rainloom.llm import leaks, neardup, passages, pii
from rainloom.llm.queries import KEY, op4_pii_surrogates, op6_substring_dedup, op7_decontamination, op9_near_duplicates

COLS = "doc_id long, text string, root string, id string, class_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], COLS)


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


def grouped(rows, size, percent):
    """Brute force on word tuples: sets, links and components."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op9_near_duplicates(spark, sf_dir).collect())
    assert got == sorted(grouped(rows, 3, 85))
    five = neardup.group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # as in the pipeline
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in five.collect()) == sorted(grouped(rows, 5, 80))


def test_near_duplicates_large_group(spark):
    """A base with hundreds of edited copies whose similarities lie about the threshold, and documents that share half of their words."""
    rng = random.Random(3)
    base, rows = prose(rng, 150), []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    common = prose(rng, 80)
    rows += [(1000 + i, " ".join(common + prose(rng, 60))) for i in range(60)]
    rows += [(2000, "Two Words"), (2001, "two  words"), (2002, None), (2003, ""), (2004, " \n"), (2005, "one"), (2006, rows[0][1]), (2006, rows[1000 - 995][1])]
    out = neardup.group_documents(docs(spark, rows), shingle=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(grouped(rows, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert neardup.group_documents(docs(spark, [])).collect() == []


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64))
    for share in (0.3, 0.85):
        k = int(len(a) * share)
        b = np.concatenate([a[:k], np.unique(rng.integers(0, 2**63, len(a) - k, dtype=np.uint64))])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = neardup.superminhashes([a, b], 512)
        est = (x == y).mean()
        assert est == pytest.approx(j, abs=0.08)
    sets = [a[:5], a[5:6], a[:300], a[100:3000], a]
    h = neardup.superminhashes(sets, 64)
    assert np.isfinite(h).all()
    for block in (2, 64, 1 << 20):  # whatever is worked off together
        assert (neardup.superminhashes([s[::-1] for s in sets], 64, block=block) == h).all()


def test_near_duplicates_null_ids(spark):
    """Rows without an id are linked like others; ids that aren't null name classes and components; large ids stay exact."""
    rng = random.Random(8)
    base, far = prose(rng, 200), prose(rng, 200)
    near = [*base[:100], "changed", *base[101:]]
    big = (1 << 60) + 1
    rows = [(None, " ".join(base)), (5, " ".join(base)), (7, " ".join(near)), (None, " ".join(far)), (None, " ".join([*far[:50], "x", *far[51:]])), (big, "alone here"), (None, None)]
    out = neardup.group_documents(docs(spark, rows), shingle=3, percent=85).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.class_id, r.n_links, r.component_id, r.kept))
    assert by[5] == [(5, 1, 5, True)] and by[7] == [(7, 1, 5, False)] and by[big] == [(big, 0, big, True)]
    assert sorted(by[None], key=str) == sorted([(5, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(500 + rng.randrange(50), 500 + rng.randrange(50)) for _ in range(80)] + [(900, 900)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 900}


def test_packed_units_round_trip():
    rng = np.random.default_rng(5)
    n = 5000
    # few ids with several parts each, so that texts of one id meet within a row
    doc, part = rng.integers(0, 40, n), rng.integers(-3, 3, n).astype(np.int32)
    pos, bucket = rng.integers(0, 1 << 20, n).astype(np.int32), rng.integers(0, 7, n)
    for value in (rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(-5, 1 << 62, n)):
        rows = list(passages._packed(bucket, passages.UNIT, doc, part, pos, value).itertuples(index=False))
        assert sorted(r.bucket for r in rows) == list(range(7)) and sum(r.n for r in rows) == n
        got = sorted(zip(*(c.tolist() for c in passages._unpacked(rows)), strict=True))
        assert got == sorted(zip(doc.tolist(), part.tolist(), pos.tolist(), value.view(np.int64).tolist(), strict=True))
    none = np.empty(0, np.int64)
    assert not len(passages._packed(none, passages.HIT, none, none.astype(np.int32), none.astype(np.int32), none))


def test_passages(spark):
    rng = random.Random(7)
    sentence = lambda n: " ".join(prose(rng, n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    rows, want = [], {}
    for i in range(12):
        before, after = " ".join(prose(rng, 30)), " ".join(prose(rng, 25))
        text = f"{sentence(8)} {before} {passage} {after}" if i % 2 else f"{sentence(8)}\n{passage}\n{after}"
        rows.append((i, text))
        want[i] = text.index(passage)
    rows += [(50, " ".join(sentence(8) for _ in range(20))), (51, None), (52, ""), (53, "Short."), (54, rows[0][1])]
    got = {(r.doc_id, r.start): r for r in passages.repeats(docs(spark, rows)).collect()}
    assert {(i, s) for i, s in want.items() if i} <= got.keys()
    for i, s in want.items():
        if i:
            assert got[i, s].end == s + len(passage) and got[i, s].first_doc_id == 0
    assert {i for i, _ in got} == {*range(1, 12), 54}
    clean = {r.doc_id: r for r in passages.remove_repeats(docs(spark, rows)).collect()}
    assert clean[0].text == rows[0][1] and not clean[0].removed
    for i in range(1, 12):
        text = dict(rows)[i]
        assert clean[i].text == text[: want[i]] + text[want[i] + len(passage) :]
        assert [tuple(x) for x in clean[i].removed] == [(want[i], want[i] + len(passage))]
    assert clean[51].text is None
    assert passages.repeats(docs(spark, [])).collect() == []


def test_passages_anywhere(spark):
    """Every run of 51 words that an earlier document holds lies in removed stretches, also without sentences, capitals or line starts; nothing else goes."""
    rng = random.Random(11)
    shared = prose(rng, 51)
    rows = [(i, " ".join(prose(rng, 90 + i) + [w.upper() if i == 2 else w for w in shared] + prose(rng, 70 - i))) for i in range(6)]
    rows += [(9, " ".join(prose(rng, 100) + rows[0][1].split()[40:60])), (10, "。".join(prose(rng, 300)) + " " + " ".join(shared[:39]))]
    twice = prose(rng, 45)
    rows.append((11, " ".join(twice + prose(rng, 30) + twice + shared)))
    cut = {}
    for r in passages.repeats(docs(spark, rows)).collect():
        cut.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words, r.first_doc_id))
    seen, want = set(), {}
    for i, t in rows:
        w = t.lower().split()
        runs = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        want[i] = {k + j for k, run in enumerate(runs) if run in seen for j in range(51)}
        seen |= set(runs)
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        gone = {k for k, (a, b) in enumerate(spans) if any(s <= a and b <= e for s, e, *_ in cut.get(i, []))}
        assert want[i] <= gone
        if i < 11:
            assert want[i] == gone
    assert [(n, first) for *_, n, first in cut[11]] == [(96, 11)]
    assert cut.keys() == {1, 2, 3, 4, 5, 11}


def test_passages_lines(spark):
    """Whole equal lines of 16 words or more go, shorter ones stay; chunks of any size, null ids, repeated ids and a clashing column."""
    rng = random.Random(13)
    para, short = " ".join(prose(rng, 20)), " ".join(prose(rng, 12))
    long = prose(rng, 60)
    rows = [(i, f"{' '.join(prose(rng, 30))}\n{para.upper() if i == 3 else para}\n{short}\n{' '.join(long if i % 2 else prose(rng, 50))}") for i in range(8)]
    rows += [(None, rows[1][1] + " more"), (20, " ".join(prose(rng, 50))), (20, para), (21, "\n".join([para, " ".join(prose(rng, 40)), para]))]
    want = None
    for chunk in (50, 400, 1 << 20):
        got = {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in passages.repeats(docs(spark, rows), chunk=chunk).collect()}
        assert want is None or got == want
        want = got
    texts = dict(rows)
    for i in range(1, 8):
        cut = [texts[i][a:b].lower() for d, a, b, *_ in want if d == i]
        assert len(cut) == 1 and (cut[0] == para if i == 1 or i % 2 == 0 else cut[0] == f"{para}\n{short}\n{' '.join(long)}")
    assert {(d, f) for d, *_, f in want} == {*((i, 0) for i in range(1, 8)), (None, 1), (20, 0), (21, 0)}
    assert sum(d == 21 for d, *_ in want) == 2
    clash = docs(spark, rows).withColumnsRenamed({"root": "removed", "class_id": "part"})
    out = passages.remove_repeats(clash)
    assert out.columns == [*clash.columns, "removed_"]
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and para not in by[1].text and short in by[1].text and by[0].text == texts[0] and para not in by[None].text


def test_passages_not_stitched(spark):
    """Phrases of five documents, side by side in a sixth, stay; so do 39 words, and two halves of a passage in one row with a word changed between."""
    rng = random.Random(17)
    texts = [prose(rng, 80) for _ in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows.append((6, " ".join(w for t in texts[:5] for w in t[20:28])))
    rows.append((7, " ".join(texts[0][:39] + ["changed"] + texts[0][40:79])))
    rows.append((8, " ".join(w for t in texts for w in t[30:67])))
    rows.append((9, " ".join(prose(rng, 9) + texts[1][5:45] + texts[2][5:45])))
    got = passages.repeats(docs(spark, rows)).collect()
    assert [(r.doc_id, r.n_words, r.first_doc_id) for r in got] == [(9, 80, 1)]


@pytest.mark.parametrize("unit", [1, 2, 7, 8, 38, 40])
def test_passages_digests(unit):
    """Equal for equal windows and only for them, at any place of any text."""
    rng = random.Random(unit)
    kept = {}
    for n in (0, unit - 1, unit, 300):
        w = [rng.choice("abc") if unit < 8 else rng.choice("ab") for _ in range(n)]
        w += w[: n // 2]
        d = passages.digests(" ".join(w), unit).tolist()
        assert len(d) == max(0, len(w) - unit + 1)
        for b, x in enumerate(d):
            assert kept.setdefault(x, w[b : b + unit]) == w[b : b + unit]
    assert len({tuple(v) for v in kept.values()}) == len(kept)


def test_passages_brute(spark, sf_dir):
    """Exactly the words in repeated lines of 16 words, or in stretches of 40 whose windows of 38 words all came before; and every 40 words in a row of a stretch came before as one run."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen, forties, lines, want = set(), set(), set(), {}
    for i in sorted(rows):
        w = (rows[i] or "").lower().split()
        gone, run = set(), None
        for b in range(len(w) - 37):
            if tuple(w[b : b + 38]) in seen:
                if run is None or b + 37 > run[1]:
                    run = [b, b]
                run[1] = b + 38
                if run[1] - run[0] >= 40:
                    gone |= set(range(*run))
                    assert tuple(w[b - 2 : b + 38]) in forties
            seen.add(tuple(w[b : b + 38]))
            if b >= 2:
                forties.add(tuple(w[b - 2 : b + 38]))
        at = 0
        for line in (rows[i] or "").split("\n"):
            x = line.lower().split()
            if len(x) >= 16:
                if tuple(x) in lines:
                    gone |= set(range(at, at + len(x)))
                lines.add(tuple(x))
            at += len(x)
        if gone:
            want[i] = gone
    got = {}
    for r in op6_substring_dedup(spark, sf_dir).collect():
        spans = [m.span() for m in re.finditer(r"\S+", rows[r.doc_id])]
        own = {k for k, (a, b) in enumerate(spans) if r.start <= a and b <= r.end}
        assert len(own) == r.n_words and not own & got.setdefault(r.doc_id, set())
        got[r.doc_id] |= own
    assert got == want


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(1, 12))], [rng.choice("abcd") for _ in range(rng.randrange(0, 15))]
        assert leaks.lcs(a, b) == lcs_table(a, b)


def test_leaks_query(spark, sf_dir):
    """All pairs whose item stands in the text word for word are found; no pair far from that is."""
    texts = {r.doc_id: leaks.bare(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: leaks.bare(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = {i: " " + " ".join(w) + " " for i, w in texts.items()}
    want = {(d, i) for d, t in plain.items() for i, w in items.items() if " " + " ".join(w) + " " in t}
    got = {(r.doc_id, r.item_id): r for r in op7_decontamination(spark, sf_dir).collect()}
    assert want and want <= got.keys()
    for (d, i), r in got.items():
        assert r.common == pytest.approx(lcs_table(items[i], texts[d][r.start : r.end]) / len(items[i])) and r.common >= 0.5


def test_leaks_recall_and_many_items(spark):
    """Against every pair by brute force, over 2,000 items and paraphrases of all strengths: nothing else is found, and 0.9 or more of it is."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(4000)]
    say = lambda n: [vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n)]
    items = [say(rng.randrange(12, 60)) for _ in range(2000)]
    texts = []
    for i in range(120):
        w = items[rng.randrange(2000)]
        part = [x if rng.random() > (i % 6) / 10 else rng.choice(vocabulary) for x in w] if i % 7 else w[: max(13, len(w) * 3 // 5)]
        texts.append(say(rng.randrange(10, 90)) + part + say(rng.randrange(10, 90)))
    want = set()
    bags = [set(w) for w in items]
    for d, t in enumerate(texts):
        have = set(t)
        for k, w in enumerate(items):
            if len(bags[k] & have) < 0.4 * len(bags[k]):
                continue
            for at in [*range(0, max(1, len(t) - 31), 8)]:
                part = t[max(0, at - len(w)) : at + 32 + len(w)]
                common = leaks.lcs(w, part) / len(w)
                runs = {tuple(w[i : i + 13]) for i in range(len(w) - 12)} & {tuple(part[i : i + 13]) for i in range(len(part) - 12)}
                if common >= 0.75 or (common >= 0.5 and (runs or leaks.lcs(w[-8:], part) >= 0.8 * len(w[-8:]))):
                    want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()}
    assert got <= want and len(want) > 60
    assert len(got & want) >= 0.9 * len(want)


def test_leaks_paraphrase_and_odd(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    say = lambda n: [vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n)]
    items = [say(n) for n in (14, 30, 55, 80, 24)]
    rows = [(i, " ".join(say(rng.randrange(5, 400)))) for i in range(150)]
    planted = []
    for k, w in enumerate(items):
        changed = [x if j >= len(w) - 8 or j % 4 else "changed" for j, x in enumerate(w)]
        for d, part in ((1000 + k, w), (2000 + k, changed)):
            rows.append((d, " ".join(say(100) + part + say(57))))
            planted.append((d, k))
    rows += [(3000, None), (3001, ""), (3002, "--- !!"), (1000, dict(rows)[1000])]
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)] + [(77, None, "x"), (78, "", "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, rows), bench).collect()}
    assert got == set(planted)
    for held in (1, 1 << 26):  # each block in a pass of its own, or all in one
        assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, rows), bench, block=2, held=held).collect()} == set(planted)
    keyed = leaks.find_leaks(docs(spark, [(None, dict(rows)[1001]), (None, "nothing of it"), ((1 << 60) + 1, dict(rows)[1002])]), bench, keyed=True).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in keyed) == [(0, 1), ((1 << 60) + 1, 2)] and all(r.text_key for r in keyed)
    assert leaks.find_leaks(docs(spark, []), bench).collect() == []
    assert leaks.find_leaks(docs(spark, rows), bench.limit(0)).collect() == []


def mixed_texts(rng):
    """Short, empty, odd and long texts in any order."""
    odd = ["", "--- !!", "\u0130stanbul \u03a3\u039f\u03a6\u039f\u03a3 caf\u00e9's", "\u2003a\u00a0b\x1cc\n", "x" * 70_000, "_ab_ (c-d) ... e", "\U0001f600 smile", "w " * 40_000]
    texts = [" ".join(rng.choice(["the", "(Of)", "Storm,", "rain's", "--", f"n{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 200))) for _ in range(300)] + odd * 2
    rng.shuffle(texts)
    return texts


def test_words_of_many_texts_are_hashed_together(monkeypatch):
    """Groups give the hashes of each text by itself, and take few passes over arrays: a pass a text cost more than the work on it."""
    texts = [None, *mixed_texts(random.Random(21))]
    calls, one = [], leaks._hashes
    monkeypatch.setattr(leaks, "_hashes", lambda part: calls.append(len(part)) or one(part))
    for most in (1, 7, 64):
        calls.clear()
        groups = list(leaks.together(texts, most))
        assert most < 64 or len(calls) <= 30
        assert [t for g, _, _ in groups for t in g] == [t or "" for t in texts]
        assert all(len(g) <= most and (len(g) == 1 or sum(map(len, g)) <= leaks.PIECE) for g, _, _ in groups)
        for g, h, ends in groups:
            assert len(ends) == len(g) + 1 and ends[0] == 0 and ends[-1] == len(h)
            for k, t in enumerate(g):
                mine = h[ends[k] : ends[k + 1]]
                assert len(mine) == len(leaks.bare(t)) and (mine == leaks.word_hashes(t)).all()


def test_document_frequencies_against_brute_force(spark):
    texts = mixed_texts(random.Random(22))
    want, passages = {}, 0
    for t in texts:
        h = [int(x) & (1 << leaks.BITS) - 1 for x in leaks.word_hashes(t)]
        for at in range(0, len(h), 32):
            passages += 1
            for f in set(h[at : at + 32]):
                want[f] = want.get(f, 0) + 1
    df, n = leaks.document_frequencies(docs(spark, [*enumerate(texts), (-1, None)]).coalesce(2), 32)
    assert n == passages and {int(f): int(df[f]) for f in df.nonzero()[0]} == want


def test_leaks_beside_other_texts(spark):
    """What is found in a text doesn't depend on the texts beside it, and its stretch holds the item."""
    rng = random.Random(23)
    items = [[f"item{k}word{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate((14, 33, 60, 90))]
    texts, planted = mixed_texts(rng), set()
    for d in range(0, len(texts), 5):
        k = rng.randrange(len(items))
        texts[d] = " ".join([texts[d], *items[k], texts[(d + 1) % len(texts)][:3000]])
        planted.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = leaks.find_leaks(docs(spark, list(enumerate(texts))).coalesce(1), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= planted and len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        assert r.common == pytest.approx(leaks.lcs(items[r.item_id], leaks.bare(texts[r.doc_id])[r.start : r.end]) / len(items[r.item_id])) and r.cosine >= 0.3
    dealt = leaks.find_leaks(docs(spark, list(enumerate(texts))).repartition(40), bench).collect()
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in dealt} == {(r.doc_id, r.item_id, r.start, r.end) for r in got}


def test_kept_products_are_those_made_anew(monkeypatch):
    rng = np.random.default_rng(24)
    idf = rng.random(1 << leaks.BITS) + 0.1
    blocks = []
    for b in range(2):
        items = leaks.Items([(b * 10 + k, " ".join(f"w{x}" for x in rng.integers(0, 60, 30 + 9 * k)), None) for k in range(5)], idf, 32, 8)
        blocks.append(leaks.Block(items, rng.standard_normal((len(items.columns.idf), 6)).astype(np.float32)))
    kept = leaks._Search(blocks, idf)
    monkeypatch.setattr(leaks._Search, "KEPT", 0)
    anew = leaks._Search(blocks, idf)
    assert all(p is not None for p in kept.products) and anew.products == [None, None]
    own, queries = np.array([0, 3, 17, len(kept.columns.idf) - 1, -1]), np.array([1, 4])
    here = rng.random((len(kept.columns.idf) + 1, 9)) < 0.5
    for k in range(2):
        a, b = kept.gains(k, own, queries), anew.gains(k, own, queries)
        assert a.shape == (5, 2) and np.allclose(a, b, atol=1e-5) and not a[-1].any()
    want = [[sum(here[p, t] for p in places) for t in range(9)] for places in kept.places]
    assert (kept.shared(here) == np.array(want)).all()


PEOPLE = "Mr. John Smith wrote to Frau Anna Weber. Later Mr Smith met Сергей Иванов and Dr. Maria Lopez."


def test_surrogate_forms():
    for kind, text in (("email", "Ab.c9@mail5.example.com"), ("phone", "+1 (743) 555-3824"), ("card", "4785-3805 92391139"[:19]), ("ssn", "123-45-6789"), ("ip", "10.2.3.4")):
        value = pii.canonical(kind, text)
        new = pii.dressed(kind, pii.surrogate(KEY, kind, value), text)
        assert new != text
        if kind != "ip":
            assert [("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c) for c in new] == [("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c) for c in text]
        else:
            assert all(0 <= int(x) <= 255 for x in new.split("."))
    digits = re.sub(r"\D", "", pii.surrogate(KEY, "card", "4539578763621486"))
    assert pii.luhn(digits) and len(digits) == 16


def test_surrogates_names(spark):
    out = pii.replace_entities(docs(spark, [(1, PEOPLE), (2, "Smith and mr. SMITH; Mr. Smith"), (3, None), (4, ""), (5, "no names here"), (1, PEOPLE)]), KEY, marks=True).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[3].text is None and by[4].text == "" and by[5].text == "no names here" and by[5].n_entities == 0
    names = re.search(r"Mr\. (\w+) (\w+) wrote to Frau (\w+) (\w+)\. Later Mr (\w+) met (\w+) (\w+) and Dr\. (\w+) (\w+)\.", by[1].text).groups()
    assert names[1] == names[4] and names[1] != "Smith" and f"Mr. {names[1]}" in by[2].text
    assert pii.GENDER[names[0].lower()] == "m" and pii.GENDER[names[2].lower()] == "f" and pii.GENDER[names[5].lower()] == "m"
    assert re.fullmatch("[А-Яа-я]+", names[6]) and len(set(names)) == len(names) - 1


def test_surrogates_distinct(spark):
    """Distinct values keep distinct surrogates though names are few, in both ways of sending redraws."""
    first = [n for g in ("m", "f") for n in pii.NAMES[g, "LATIN"]]
    text = " ".join(f"{n} Meier{k}, {k}@x.de" if False else f"{n} Meier" for k, n in enumerate(first)) + " 1.1.1.1 1.1.1.2"
    one = pii.replace_entities(docs(spark, [(1, text)]), KEY).first().text
    two = pii.replace_entities(docs(spark, [(1, text)]), KEY, redraw_bound=0).first().text
    assert one == two
    new = re.findall(r"(\w+) (?=\w+)", one)
    given = [w for w in re.findall(r"[A-Z]\w+", one)][0::2]
    assert len(set(given)) == len(first) and not {g.lower() for g in given} & {f.lower() for f in first} and new


def test_surrogates_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen, back = {}, {}
    for r in op4_pii_surrogates(spark, sf_dir).collect():
        spans = pii.detect(texts[r.doc_id])
        assert r.n_entities == len(spans)
        if not spans:
            assert r.text == texts[r.doc_id]
            continue
        new = r.text
        shift = 0
        for a, b, kind in spans:
            old = texts[r.doc_id][a:b]
            if kind == "ip":
                found = re.match(r"[\d.]+", new[a + shift :])[0].rstrip(".")
                shift += len(found) - len(old)
            else:
                found = new[a + shift : b + shift]
            assert found != old
            assert seen.setdefault((kind, old), found) == found and back.setdefault((kind, found), old) == old


def test_surrogates_one_a_person(spark):
    """One surrogate a value in all texts, whatever stands before it, in both ways of sending; later mentions, double names, capitals; the gender that titles say."""
    rows = [(1, "Dr Jordan Smith came. Jordan Smith left. Smith said no, SMITH."), (2, "Mr Jordan Smith"), (3, "Mr Jordan Lee"), (4, "Mrs Robin O'Neill-Berg and Jean-Pierre Smith-Jones; O'Neill-Berg's, O’Neill-Berg"), (5, "DAVID MILLER met Mr Miller"), (6, "Jordan river, Smith, no names")]
    one, two = ({r.doc_id: r.text for r in pii.replace_entities(docs(spark, rows), KEY, redraw_bound=n).collect()} for n in (10_000, 0))
    assert one == two and one[6] == rows[5][1]
    given, last = re.match(r"Dr (\w+) (\w+) came", one[1]).groups()
    assert one[1] == f"Dr {given} {last} came. {given} {last} left. {last} said no, {last.upper()}." and one[2] == f"Mr {given} {last}" and one[3].startswith(f"Mr {given} ")
    assert not {given, last} & {"Jordan", "Smith"} and pii.GENDER.get(given.lower(), "m") == "m"
    m = re.fullmatch(r"Mrs (\w+) O'(\w+-\w+) and (\w+)-(\w+) (\w+)-(\w+); O'(\w+-\w+)'s, O’(\w+-\w+)", one[4])
    assert m and m[2] == m[7] == m[8] and pii.GENDER[m[1].lower()] == "f" and not {"Neill-Berg", "Jean", "Pierre", "Smith", "Jones"} & set(m.groups()) and m[5][0].isupper() and m[6][0].isupper()
    m = re.fullmatch(r"(\w+) (\w+) met Mr (\w+)", one[5])
    assert m[1].isupper() and m[2] == m[3].upper() and m[3] != "Miller"


def test_surrogates_numbers():
    """Account numbers, IPv6 addresses and national telephone forms; what only looks like them stays."""
    for kind, text in (("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ip6", "2001:db8::8a2e:370:7334"), ("ip6", "2001:0DB8:0000:0000:0000:8A2E:0370:7334"), ("phone", "020 7946 0958"), ("phone", "555.123.4567"), ("phone", "0171-123 4567")):
        assert pii.detect(f"see {text}, then") == [(4, 4 + len(text), kind)], text
        new = pii.dressed(kind, pii.surrogate(KEY, kind, pii.canonical(kind, text)), text)
        assert new != text and len(new) == len(text) and pii.detect(new) == [(0, len(new), kind)]
    short, full = ((t, pii.dressed("ip6", pii.surrogate(KEY, "ip6", pii.canonical("ip6", t)), t)) for t in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334"))
    assert pii.address(short[1]) == pii.address(full[1])
    for text in ("DE88 3704 0044 0532 0130 00", "12:30:45", "00:1A:2B:3C:4D:5E", "std::a::b", "dead::beef", "01-02-2024", "0.123.4567", "007 agents 1234", "AB12 is a room"):
        assert pii.detect(text) == [], text


def test_surrogates_empty(spark):
    assert pii.replace_entities(docs(spark, []), KEY, marks=True).collect() == []


def test_surrogates_never_run_out(spark):
    """1,000 addresses of one short form, which has 676 surrogates, and as many short telephone numbers."""
    mails = sorted({f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz0123456789abcd"})[:936]
    phones = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(900)]
    out = pii.replace_entities(docs(spark, [(i, x) for i, x in enumerate(mails + phones)]), KEY).collect()
    new = [r.text for r in sorted(out)]
    assert len(set(new)) == len(new) and not set(new) & set(mails + phones)


def test_surrogates_keep_scripts():
    for text, marks in (("Dr Παπαδόπουλος", "GREEK"), ("श्रीमती सुनीता शर्मा", "DEVANAGARI"), ("السيد محمد الهاشمي", "ARABIC"), ("Dr 王小明", "CJK"), ("господин Иванов", "CYRILLIC"), ("my name is Rajesh Kumar", "LATIN"), ("Priya Sharma <p@q.org>", "LATIN")):
        names = [(a, b, k) for a, b, k in pii.detect(text) if k != "email"]
        assert names and names[-1][1] >= len(text.split(" <")[0])
        for a, b, kind in names:
            for attempt in (0, 9, 40):
                new = pii.surrogate(KEY, kind, pii.canonical(kind, text[a:b]), attempt)
                assert new != text[a:b] and pii.script(new) == marks


def test_surrogates_against_plain_search(spark, sf_dir):
    """By another way than the operator's patterns: tokens with one @, dotted and dashed numbers. None is left, and what isn't marked stays as it was."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = 0
    for r in op4_pii_surrogates(spark, sf_dir).collect():
        old, new = texts[r.doc_id], r.text or ""
        sure = set()
        for token in old.split():
            t = token.strip(".,;:!?()<>\"'")
            name, _, host = t.partition("@")
            if name.isalnum() and host.isascii() and host.count(".") == 1 and host.replace(".", "").isalpha() and name.isascii() and len(host.split(".")[1]) > 1 and host[0] != ".":
                sure.add(t)
            p = t.split("-")
            if [len(x) for x in p] == [3, 2, 4] and all(x.isdecimal() for x in p):
                sure.add(t)
            p = t.split(".")
            if len(p) == 4 and all(x.isdecimal() and x.isascii() and int(x) < 256 and str(int(x)) == x for x in p):
                sure.add(t)
        seen += len(sure)
        assert not sure & {x.strip(".,;:!?()<>\"'") for x in new.split()}
        at = 0
        for span in filter(None, r.entities.split(",")):
            *_, a, b = span.split(":")
            between = old[at : int(a)]
            assert between in new
            new = new[new.index(between) + len(between) :] if between else new
            at = int(b)
        assert new.endswith(old[at:])
    assert seen


def test_word_counts_beyond_16_bits(spark):
    """An item that repeats a word 40,000 times doesn't wrap its counts."""
    item = "again " * 40_000 + " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(spark, [(9, "before it " + item), (10, "again and again")]), bench).collect()] == [(9, 1)]
