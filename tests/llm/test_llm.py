"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import chat, decontaminate, exactdup, htmltext, mixing, neardup, quality, substrings, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept string, rule string"


def documents(spark, rows):
    """rows: (doc_id, text[, source]); the columns keep_id, kept and rule clash with results' names."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, "x", "y") for r in rows], DOCS)


def words(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in r.integers(0, 5000, n))


@pytest.fixture(scope="module")
def corpus(spark):
    base = words(300, 1)
    near = base.split()
    near[10] = "changed"
    passage = words(80, 2)
    rows = [(1, base, "a"), (2, base + " ", "a"), (3, " ".join(near), "b"), (4, words(200, 3) + " " + passage, None), (5, passage + " " + words(90, 4), "b"), (6, "", "a"), (7, None, "c"), (8, "two words", "c"), (8, "two words", "c"), (9, "Two  words", "b"), (10, words(30000, 5), "a"), (None, "lonely text here", "b"), (11, "ab " * 700, "c")]
    return documents(spark, rows), rows


def test_exact_groups(spark, corpus):
    docs, rows = corpus
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = sorted(((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows), key=str)
    got = exactdup.exact_groups(docs, 9).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exactdup.exact_groups(docs.where("false")).count() == 0
    assert exactdup.keep_first(docs).columns == docs.columns


def test_near_groups(spark, corpus):
    docs, rows = corpus

    def shingles(t, n=3):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in neardup.near_groups(docs, 85, 3).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), root(i)) for i in sets}
    assert got[None].kept and got[None].component_id is None
    assert neardup.near_groups(docs.where("false")).count() == 0


def test_near_groups_of_a_chain_and_a_large_family(spark):
    """Links lead on where a bucket's leader isn't linked; most of the family is linked to some, not to all."""
    base = words(150, 9).split()
    rows, r = [], np.random.default_rng(4)
    for k in range(120):
        w = list(base)
        for p in r.choice(150, int(r.integers(0, 12)), replace=False):
            w[p] = f"edit{k}_{p}"
        rows.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {x.doc_id: x.component_id for x in neardup.near_groups(documents(spark, rows), 85, 3).collect()}
    assert got == label


def test_left_over_classes_are_settled_by_their_differences(spark):
    """A family around its leader: most are linked to it, some only to each other, some to none. No pair is lost, and
    classes that share no difference aren't compared."""
    r, base, rows = np.random.default_rng(12), words(200, 60).split(), []
    for k in range(150):
        w = list(base)
        for p in r.choice(200, int(r.integers(0, 4)), replace=False):
            w[p] = f"edit{k}_{p}"
        rows.append((k, " ".join(w)))
    far = [list(base) for _ in range(6)]
    for g, w in enumerate(far):
        for p in r.choice(200, 14, replace=False):
            w[p] = f"far{g}_{p}"
        for m in range(4):
            v = list(w)
            v[m] = f"more{g}_{m}"
            rows.append((1000 + 10 * g + m, " ".join(v)))
    docs = documents(spark, rows)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.doc_id: x.component_id for x in neardup.near_groups(docs, 85, 3).collect()} == label
    # All links of one leader's group, if nothing was linked before, but for those that its leader has.
    seen = []
    left_over = neardup._Linker.left_over
    try:
        neardup._Linker.left_over = lambda self, *a: (seen.append(left_over(self, *a).count()), left_over(self, *a))[1]
        neardup.near_groups(docs, 85, 3).collect()
    finally:
        neardup._Linker.left_over = left_over
    assert seen[0] < 300, seen


def test_stages_keep_one_row_of_each_group(spark):
    """Repeated rows, doc_ids that repeat or lack, and columns whose names clash, row by row."""
    rows = [(5, "x y z"), (5, "longer   copy"), (4, "longer copy"), (6, "longer    copy"), (6, "longer    copy"), (None, "x  y  z"), (None, "alone"), (None, "alone"), (7, None), (8, ""), (9, "p  q r"), (9, "p q  r")]
    clash = "doc_id long, text string, lang string, source string, _keep long, _id long, row_id string, row_text string, row_key string, kept boolean, digest string, repeat long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, "a", "b", "c", False, "d", 9) for i, t in rows], clash)
    got = exactdup.keep_first(docs)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # The longest original stays: "x  y  z" without doc_id, one of the two rows of 6, one of two texts of 9.
    assert [x for x in found if x[0] != 9] == sorted([(None, "x  y  z"), (6, "longer    copy"), (None, "alone"), (7, None)], key=str)
    assert sum(x[0] == 9 for x in found) == 1
    got = neardup.keep_representatives(docs)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # Fewer words than a shingle: one shingle each. Rows without doc_id link with nothing.
    assert [x for x in found if x[0] != 9] == sorted([(5, "x y z"), (4, "longer copy"), (None, "x  y  z"), (None, "alone"), (7, None), (8, "")], key=str)
    assert sum(x[0] == 9 for x in found) == 1
    # Rows of one doc_id in two sources are taken by their own source.
    rows = [(i, words(20, i), "a" if i % 3 else "b") for i in range(60)] + [(1, words(20, 1), None), (1, words(20, 1), "c"), (2, words(20, 2), "a"), (70, "", "a"), (71, None, "b")]
    docs = spark.createDataFrame([(*x, 5, 6, 7, "z") for x in rows], "doc_id long, text string, source string, _id long, _times long, repeat long, _row string")
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + (r.taken // r.size if r.size else 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "source", "_id", "_times", "_row", "repeat"]
    have = {}
    for r in mixed.collect():
        have[r.doc_id, r.source] = have.get((r.doc_id, r.source), 0) + 1
    assert have == {k: n for k, n in want.items() if n}
    for empty in (exactdup.keep_first(docs.where("false")), neardup.keep_representatives(docs.where("false")), mixing.mixed_documents(docs.where("false"))):
        assert empty.count() == 0


def brute_repeats(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_repeated_substrings(spark, corpus):
    docs, rows = corpus
    got = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute_repeats([r[:2] for r in rows], 400)
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_windows_behind_a_shared_passage_need_their_whole_second_name(spark):
    """Two windows with one first half whose second halves have names alike in their upper 32 bits don't repeat."""
    from lumenlake.llm.common import mixed, powers_for

    r = np.random.default_rng(11)
    passage = r.integers(97, 123, 350)
    tails = r.integers(97, 123, (400_000, 50))
    up = powers_for(200)[0]
    start = ((passage[200:].astype(np.uint64) + np.uint64(1)) * up[:150]).sum(dtype=np.uint64)
    sums = np.full(len(tails), start)
    for k in range(50):
        sums += (tails[:, k].astype(np.uint64) + np.uint64(1)) * up[150 + k]
    name = mixed(sums + np.uint64(200) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    order = np.argsort(name, kind="stable")
    same = np.flatnonzero(name[order][1:] == name[order][:-1])
    assert len(same)
    rows = []
    for p in same:
        a, b = ((passage.tolist() + tails[k].tolist()) for k in (order[p], order[p + 1]))
        rows += [(2 * len(rows), bytes(a).decode()), (2 * len(rows) + 1, bytes(b).decode())]
    got = [tuple(x) for x in substrings.remove_repeats(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 400)


def test_decontamination(spark, corpus):
    docs, rows = corpus
    items = [(1, " ".join(words(80, 2).split()[5:30])), (2, "Two, WORDS"), (3, None), (4, ""), (5, "absent thing"), (12, " ".join(words(80, 2).split()[20:60]))]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for i, t, _ in rows:
        w = token.findall((t or "").translate(lower))
        hit, found = set(), set()
        for item, x in items:
            v = token.findall((x or "").translate(lower))
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.leak_report(docs, table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.clean(docs, table)
    assert kept.count() == sum(not w[5] for w in want) and kept.columns == docs.columns
    assert decontaminate.clean(docs, table.where("false")).count() == len(rows)
    assert decontaminate.find_leaks(docs.where("false"), table).count() == 0


def test_decontamination_finds_longest_matches_in_any_number_of_passes(spark, corpus, monkeypatch):
    docs, rows = corpus
    base = words(80, 2).split()
    items = [(1, " ".join(base[5:30])), (2, " ".join(base[20:60] + ["other", *base[3:20]])), (3, "the end of it"), (4, " ".join(words(200, 3).split()[40:75])), (5, "Two, WORDS"), (6, " ".join(["again"] * 30))]
    more = documents(spark, [(50, "again " * 500), (51, " ".join(words(200, 3).split()[30:90] + base[:70])), (51, " ".join(base[:12])), (None, " ".join(base))])
    docs = docs.unionByName(more)
    table = spark.createDataFrame(items, "item_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = {str(i): token.findall(x.lower()) for i, x in items}
    one = decontaminate.find_leaks(docs, table).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    for r in one:
        if r.longest is not None:
            found = [t for i, t in texts if i == r.doc_id and token.findall(t.lower())[r.longest_at : r.longest_at + r.longest] == split[r.longest_item][r.longest_item_at : r.longest_item_at + r.longest]]
            assert found, r
    best = {}
    for i, t in texts:
        w = token.findall(t.lower())
        here = 0
        for v in split.values():
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while n < min(len(w) - a, len(v) - b) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= min(10, len(v)):
                        here = max(here, n)
            if len(w) > 20000:
                break
        best.setdefault(i, []).append(here)
    have = {}
    for r in one:
        have.setdefault(r.doc_id, []).append(r.longest or 0)
    assert {i: sorted(x) for i, x in have.items() if i != 10} == {i: sorted(x) for i, x in best.items() if i != 10}
    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", 1)
    many = decontaminate.find_leaks(docs, table, most_words=20).collect()
    assert len(list(decontaminate._passes(table, 10, 20))) > 3
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids), r.longest)
    assert sorted(map(key, many)) == sorted(map(key, one))
    kept = decontaminate.clean(docs, table, most_words=20)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, decontaminate.clean(docs, table).collect()))


def test_decontamination_counts_items_without_id(spark, corpus):
    docs, _ = corpus
    passage = " ".join(words(80, 2).split()[5:30])
    table = spark.createDataFrame([(None, passage), (None, "Two, WORDS"), (3, " ".join(words(80, 2).split()[5:20]))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.leak_report(docs, table).collect()}
    assert got[4] == got[5] == (25, 1, True) and got[8] == got[9] == (2, 0, True) and got[1] == (0, 0, False)
    assert {r.doc_id for r in decontaminate.clean(docs, table).collect()}.isdisjoint({4, 5, 8, 9})


def test_mixing(spark, corpus):
    docs, rows = corpus
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(g[0].target for g in by.values()) == pytest.approx(1.5 * total, rel=1e-6)
    for g in by.values():
        assert g[0].target <= 2 * g[0].source_size + 1e-6 and all(r.taken in (0, r.size, 2 * r.size) for r in g)
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r.size for r in g)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.where("false")).count() == 0


def test_urls(spark):
    urls = {"http://a.example.com/en/71?x": ("example.com/en/7", "allow"), "http://EXAMPLE.com/en/1": ("com/en/", "block"), "https://x.net/de/8": ("net/de/", "allow"), "https://b.example.net/de/81#t": ("example.net/de/8", "block"), "http://o.org/es": (None, "allow"), "ftp://o.org/es/": ("org/es/", "block"), "o.org/es/": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://notexample.com/de/": (None, "allow"), "http://": (None, "allow")}
    pages = spark.createDataFrame([(k, u, "h", "z") for k, u in enumerate(urls)] + [(0, next(iter(urls)), "h", "z")], "page_id long, url string, host string, verdict string")
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == len(urls) + 1
    keys = list(urls)
    for r in got:
        assert (r.rule, r.verdict) == urls[keys[r.page_id]], r
    assert urlfilter.judge_urls(pages.where("false")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    r = np.random.default_rng(3)
    universe = r.integers(-(2**63), 2**63 - 1, 20000)
    wanted = universe[:300].view(np.uint64)
    rows = spark.createDataFrame([(universe[k : k + 50].tolist(),) for k in range(0, 20000, 50)], "hashes array<long>")
    one, two = urlfilter.build_cascades(rows, [wanted, universe[5000:5100].view(np.uint64)])
    assert urlfilter.listed(one, universe.view(np.uint64)).tolist() == [True] * 300 + [False] * 19700
    assert np.flatnonzero(urlfilter.listed(two, universe.view(np.uint64))).tolist() == list(range(5000, 5100))


def test_urls_of_any_length(spark):
    """A very long host and path, empty parts and characters beyond ASCII."""
    urls = ["http://" + "a." * 3000 + "com/en/" + "x" * 100_000, "https://b.ORG/es/" + "ñ" * 5000 + "?q=1", "http://..com/en/", "://com/en/", "http:///en/", "x://com", "http://com/EN/", "http://example.com/en/7?://net/de/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("org/es/", "block"), 2: ("com/en/", "block"), 3: ("com/en/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.com/en/7", "allow")}


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><a href="/">Home</a> <a href="/b">More</a></nav>
<div class="ad">Buy now and save a lot of money today</div><article><h1>Head &amp; shoulders</h1><p>One <b>bold</b>word here.<br>Next&nbsp;line<p>Second <!-- hidden --> paragraph<div class="comments"><p>nice post indeed</p></div><form><p>Join us</p></form></article>
<aside>Related things</aside><footer>All rights</footer></body></html>"""


def test_html_judges_misleading_names_by_neighbours(spark):
    """Names that may mean either, and attributes that only mention hidden, don't take a paragraph from the article."""
    long = "a paragraph of the article with enough words to stand as text among others"
    page = f"""<body><nav><a href="/">Home</a></nav><article><h1>Head</h1><p>{long} one</p><div class="side note"><p>{long} two</p></div>
    <p title="a hidden gem" data-x='hidden'>{long} three</p><p class="share">Share <a href="/x">this</a></p><p>{long} four</p><p hidden>not shown at all in any browser window today</p>
    <p style="color:red; display: none">neither is this one shown in any browser window</p><div class="related"><a href="/a">one</a> <a href="/b">two</a></div><p>{long} five</p>
    <div id="comments"><p>{long} by a reader</p></div></article><footer>end</footer></body>"""
    text = htmltext.main_text(page)
    assert text == " ".join(["Head", *(f"{long} {n}" for n in ("one", "two", "three", "four", "five"))])
    found = {b[0]: b[5] for b in htmltext.blocks(page)}
    assert found[f"{long} two"] and not found[f"{long} one"]


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (4, "u", "<article><p>cut off here</p><p>and more</ar", "t"), (4, "u", "<p>" + "long plain text without an article " * 400, "t")], "page_id long, url string, html string, text string")
    got = sorted(htmltext.extract_text(pages).collect(), key=lambda r: (r.page_id, r.n_chars))
    assert got[0].text == "Head & shoulders One boldword here. Next line Second paragraph"
    assert [r.text for r in got[1:3]] == ["", ""] and got[3].text == "cut off here and more" and got[4].n_chars > 10000
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_text(pages.where("false")).count() == 0


def labelled(spark, n, bad):
    r, vocabulary = np.random.default_rng(8), ["the", "of", "and", *("word%d" % k for k in range(150))]
    docs, labels = [], []
    for k in range(n):
        w = list(r.choice(vocabulary, int(r.integers(20, 120))))
        label = k % 4 == 0
        docs.append((k, bad(w, r) if label else " ".join(w)))
        labels.append((k, 0 if label else 1, int(label)))
    return documents(spark, [*docs, (n, None), (n + 1, ""), (n + 2, "the " * 5000)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_toxicity(spark):
    def bad(w, r):
        for p in r.choice(len(w), 3, replace=False):
            w[p] = r.choice(["awful", "nasty", "vile"])
        return " ".join(w)

    docs, labels, truth = labelled(spark, 240, bad)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_models_are_kneser_ney(spark):
    """Counts and probabilities against a model of dictionaries, and P(w | v) adds up to 1 over the corpus's words."""
    from collections import Counter

    r = np.random.default_rng(21)
    texts = [(" ".join("word%d" % k for k in r.zipf(1.6, 40) % 60), int(r.random() < 0.4)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([y for _, y in texts], pa.int32())], ["text", "label"])
    pairs = pa.Table.from_batches(list(toxicity._count_pairs(iter([batch])))).to_pandas().groupby(["v", "w"]).sum().reset_index()
    spelt = pa.Table.from_batches(list(toxicity._count_words(iter([batch])))).to_pandas()
    names = lambda x: x.to_numpy(np.int64).view(np.uint64)
    known = toxicity.Vocabulary(names(pairs.v), names(pairs.w), [names(spelt[c]) for c in ("w", "w1", "w2")])
    word_counts = Counter(w for t, _ in texts for w in t.split())
    shared, total = toxicity._shared(toxicity.word_counts(spark.createDataFrame([(t,) for t, _ in texts], "text string")), known.levels)
    assert total == sum(word_counts.values()) and sorted(shared[0]) == sorted(word_counts.values())
    # Words that the sample hasn't count in the corpus's total alone.
    more = spark.createDataFrame([(t,) for t, _ in texts] + [("other words here",), ("other",), (None,)], "text string")
    same, larger = toxicity._shared(toxicity.word_counts(more), known.levels)
    assert larger == total + 4 and np.array_equal(same[0], shared[0])

    def name(w, n=99):
        data = np.frombuffer(w[:n].encode(), np.uint8)
        return toxicity._names(data, np.array([0, len(data)]))[0][0][0]

    for side, column in ((1, "toxic"), (0, "ordinary")):
        n = pairs[column].to_numpy()[known.order]
        c = Counter((v, w) for t, y in texts if y == side for v, w in zip([None, *t.split()], t.split()))
        for discounted in toxicity.DISCOUNTED:
            model = toxicity.KneserNey(known, n, shared, total, discounted)
            left = dict(zip(c, discounted(np.array(list(c.values()), float)))) if discounted is toxicity.strong else None
            if left is None:
                d = toxicity.discount(n.astype(float))
                left = {k: max(x - d, 0) for k, x in c.items()}
            after = Counter(w for _, w in c)
            levels, lower = [after, Counter(w[:6] for w in after), Counter({b: len({w[:6] for w in after if w[:4] == b}) for b in {w[:4] for w in after}})], {}
            prefix = lambda w, k: w[: (99, 6, 4)[k]]
            common = [word_counts, *(Counter() for _ in range(2))]
            for w, x in word_counts.items():
                common[1][w[:6]] += x
                common[2][w[:4]] += x
            of_name = [{int(name(b)): x for b, x in level.items()} for level in levels]
            own = [dict(zip(known.levels[k].tolist(), discounted(np.array([float(of_name[k].get(int(b), 0)) for b in known.levels[k]])))) for k in range(3)]

            def p(w, k=0):
                key, all_ = (prefix(w, k), k), sum(levels[k].values())
                if key not in lower:
                    rest = 1 - sum(own[k].values()) / all_
                    below = common[2][prefix(w, 2)] / total if k == 2 else p(w, k + 1) * common[k][prefix(w, k)] / common[k + 1][prefix(w, k + 1)]
                    lower[key] = own[k][int(name(prefix(w, k)))] / all_ + rest * below
                return lower[key]

            for v in [None, "word1", "word2", "word7"]:
                mass = sum(x for (a, _), x in c.items() if a == v)
                keep = sum(left[k] for k in c if k[0] == v)
                at = toxicity.place(known.contexts, np.array([toxicity.NONE if v is None else name(v)]))
                total_p = 0.0
                for w in word_counts:
                    want = (left.get((v, w), 0) / mass + (1 - keep / mass) * p(w)) if mass else p(w)
                    i = toxicity.place(known.levels[0], np.array([name(w)]))
                    j = toxicity.place(known.pairs, toxicity.pair_name(np.array([toxicity.NONE if v is None else name(v)]), np.array([name(w)])))
                    got = float(np.exp(model.log(np.append(n, 0)[j], at, model.p[0][i]))[0])
                    assert got == pytest.approx(want, rel=1e-4)
                    total_p += got
                assert total_p == pytest.approx(1, rel=1e-4)


def test_toxicity_edges(spark):
    """An empty table, rows and labels that repeat or lack, and one class alone."""
    def bad(w, r):
        for p in r.choice(len(w), 3, replace=False):
            w[p] = r.choice(["awful", "nasty", "vile"])
        return " ".join(w)

    docs, labels, truth = labelled(spark, 160, bad)
    extra = spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, None), (7, 1, 0), (7, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    again = docs.where("doc_id < 20").unionByName(documents(spark, [(7, "another text of one id " * 4), (None, "no id at all")]))
    model = toxicity.fit(docs.unionByName(again), labels.unionByName(extra))
    got = toxicity.score(docs.unionByName(again), model).collect()
    assert len(got) == 163 + 22 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for i, x in by.items() if i not in (7, None))
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs.where("false").unionByName(docs.limit(2)), labels.where("false")).collect()} == {0.0}
    # The bound holds for each class.
    rows, odds = toxicity.training_rows(docs, labels, 20)
    assert rows.count() <= 20 and max(r["count"] for r in rows.groupBy("label").count().collect()) <= 10 and sum(odds.values()) > 100


def test_toxicity_keeps_words_apart(spark):
    """A clean word whose hash begins like a toxic word's isn't taken for it."""
    from lumenlake.llm.common import word_hashes

    def hashes(w):
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        return word_hashes(data, np.array([0, len(data)]))[0]

    names = ["q%dz" % k for k in range(900_000)]
    slots = hashes(names) >> np.uint64(47)
    alike = {w: [names[k] for k in np.flatnonzero(slots == h >> np.uint64(47))] for w, h in zip(("awful", "nasty", "vile"), hashes(["awful", "nasty", "vile"]))}
    assert all(alike.values())

    def bad(w, r):
        for p in r.choice(len(w), 3, replace=False):
            w[p] = r.choice(["awful", "nasty", "vile"])
        return " ".join(w)

    docs, labels, truth = labelled(spark, 240, bad)
    clean = [r.text for r in docs.orderBy("doc_id").collect() if truth.get(r.doc_id) == 0][:30]
    more = [(10_000 + k, t + " " + " ".join(x[k % len(x)] for x in alike.values())) for k, t in enumerate(clean)]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs.unionByName(documents(spark, more)), labels).collect()}
    assert sum(got[i] for i, _ in more) <= 3
    # Every distinct word has a count of its own.
    many = documents(spark, [(k, " ".join(names[k * 30_000 : (k + 1) * 30_000])) for k in range(10)])
    assert toxicity.word_counts(many).count() == 300_000


def test_toxicity_hears_rare_pairs(spark):
    """Expressions of ordinary words, each seen less than 20 times in the toxic rows, are found."""
    r, docs, labels = np.random.default_rng(6), [], []
    for k in range(480):
        w, toxic = ["word%d" % x for x in r.integers(100, 250, 60)], k % 4 == 0
        for x, p in zip(r.choice(24, 4, replace=False), (3, 17, 31, 45)):
            w[p : p + 2] = ["word%d" % y for y in ((x, x + 50) if toxic else (x + 50, x))]
            # Both words also stand alone, so that each follows as many words in either class.
            w[p + 4], w[p + 7], w[p + 9], w[p + 11] = ("word%d" % y for y in (x, x + 50, x, x + 50))
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    got = toxicity.toxicity(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r.doc_id % 4 == 0, r.predicted) for r in got if r.held_out]
    assert np.mean([p for toxic, p in held if toxic]) > 0.8
    assert np.mean([p for toxic, p in held if not toxic]) < 0.1
    rare = np.array([1.0] * 30 + [2.0] * 10 + [9.0])
    assert (toxicity.strong(rare) == np.array([0.0] * 40 + [5.0])).all()
    assert toxicity.discount(rare) == 30 / 50 and (toxicity.usual(rare) > 0).all()


def test_quality(spark):
    docs, labels, truth = labelled(spark, 240, lambda w, r: " | ".join(x.upper() for x in w))
    network = quality.fit(docs, labels, steps=150)
    got = quality.score(docs, network).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(1 - truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert quality.keep_good(docs, None).count() == docs.count()


def test_quality_edges(spark):
    docs, labels, _ = labelled(spark, 120, lambda w, r: " | ".join(x.upper() for x in w))
    extra = documents(spark, [(3, "another text of one id"), (None, "no id"), (None, None)])
    rows = docs.unionByName(docs.where("doc_id < 9")).unionByName(extra)
    network = quality.fit(rows, labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")), steps=40)
    got = quality.score(rows, network).collect()
    assert len(got) == 123 + 9 + 3
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for i, x in by.items() if i not in (3, None))
    assert quality.score(rows.where("false"), network).count() == 0 and quality.keep_good(rows.where("false"), network).count() == 0
    assert {r.score for r in quality.score(rows, None).collect()} == {1.0} and quality.fit(rows, labels.where("false")) is None
    assert quality.keep_good(docs, network).columns == docs.columns


def test_quality_scores_are_those_of_the_plain_network():
    """The table form of scoring against convolution, ReLU and pooling written out byte by byte."""
    r = np.random.default_rng(4)
    network = quality.Network(3)
    network.p["bias"], network.p["out"] = r.normal(0, 0.2, quality.FILTERS).astype(np.float32), r.normal(0, 1, 2 * quality.FILTERS).astype(np.float32)
    for text in ("", "a", "short text", "x" * 600, "longer ünïcode text " * 40):
        raw = np.frombuffer(text.encode(), np.uint8)
        emb = np.vstack([network.p["embedding"][raw], np.zeros((quality.CHUNK + quality.WIDTH, quality.EMBEDDING), np.float32)])
        tops = []
        for start in range(0, max(1, len(raw)), quality.CHUNK):
            answers = [sum((emb[p + k] @ network.p["filters"][k] if p + k < len(raw) else 0) for k in range(quality.WIDTH)) + np.zeros(quality.FILTERS) for p in range(start, start + quality.CHUNK)]
            tops.append(np.maximum(np.max(answers, 0) + network.p["bias"], 0))
        vector = np.concatenate([np.max(tops, 0), np.mean(tops, 0)])
        want = 1 / (1 + np.exp(-(vector @ network.p["out"] + network.p["last"][0])))
        got = network.score(raw, np.array([0, len(raw)]))[0]
        assert got == pytest.approx(want, abs=1e-4)


def test_chunks_cover_every_byte():
    data = np.arange(600, dtype=np.int64).astype(np.uint8)
    codes, first = quality.chunks(data, np.array([0, 0, 251, 600]))
    assert first.tolist() == [0, 1, 3, 5] and (codes[0] == quality.PAD).all()
    assert codes[1, 0] == data[0] and codes[2, 0] == data[250] and codes[2, 1] == quality.PAD and codes[1, -5] == data[250]


def test_chat(spark):
    r = np.random.default_rng(2)
    rows = []
    for c in range(60):
        for t in range(int(r.integers(2, 9))):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[(t + (c % 3 == 0)) % 2]
            rows.append((c, t, role, words(8, c * 10 + t) + "\n" + words(5, c)))
    rows += [(99, 0, None, None), (100, 0, "user", ""), (5, 0, rows[[x[0] for x in rows].index(5)][2], rows[[x[0] for x in rows].index(5)][3])]
    table = spark.createDataFrame([(*x, "u") for x in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = chat.recover(table).collect()
    assert len(got) == len(rows)
    known = [x for x in got if x.role]
    assert np.mean([x.role == x.recovered for x in known]) > 0.95
    unseen = [x for x in known if not x.trained]
    assert 0.3 < len(unseen) / len(known) < 0.7 and np.mean([x.role == x.recovered for x in unseen]) > 0.95
    assert all(x.rendered == f"<|{x.recovered}|>\n{x.text}\n<|end|>" for x in got)
    model = chat.fit(table)
    plain = spark.createDataFrame([(1, "User: hello there\nmore\nAssistant: hi\n\nUser: bye?"), (2, None), (3, "")], "id long, transcript string")
    found = {x.id: [(t.role, t.text) for t in x.turns] for x in chat.parse_transcripts(plain, model).collect()}
    assert found == {1: [("user", "hello there\nmore"), ("assistant", "hi"), ("user", "bye?")], 2: [], 3: []}


def test_chat_recovers_what_the_parser_finds(spark):
    """A marker-like line inside a text opens a turn, and texts are those of the transcript without its markers."""
    rows = [(c, t, ("user", "assistant")[t % 2], "say %d %d" % (c, t)) for c in range(60) for t in range(6)]
    texts = ["\n one", "two\nUser: not a turn\nmore", "three\n\n"]
    rows += [(500, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    style = chat.style_of("500")
    transcript, _ = chat.write_transcript([(r, x) for c, _, r, x in rows if c == 500], style, {k for k in range(3) if chat.without_marker(k, style)})
    want = model.turns(transcript)
    got = [x for x in chat.recover(table, model).collect() if x.conv_id == 500]
    assert len(want) == 4 and sorted((x.recovered, x.text) for x in got) == sorted(want)
    assert sorted((x.turn is None, x.turn) for x in got) == [(False, 0), (False, 1), (False, 2), (True, None)]
    assert all(x.rendered == chat.render(x.recovered, x.text) for x in got)


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    r = np.random.default_rng(3)
    for trial in range(12):
        model = chat.RoleModel()
        model.begin, model.move, model.show = r.random(chat.N_STATES) + 0.01, r.random((chat.N_STATES, chat.N_STATES)) + 0.01, r.random((chat.N_STATES, chat.N_MARKS * 4)) + 0.01
        lines = [["User: hi?", "", "Assistant: yes", "more", "Tool: 3", "no marker?"][k] for k in r.integers(0, 6, 4)]
        seen, roles = chat.observe(lines), len(chat.ROLES)
        begin, move, show = (np.log(x / x.sum(-1, keepdims=True)) for x in (model.begin, model.move, model.show))

        def worth(path):
            total = begin[path[0]] + show[path[0], seen[0]]
            for a, b, o in zip(path, path[1:], seen[1:]):
                total += move[a, b] + show[b, o]
            return total

        # The first line begins a turn, and a turn's later lines keep its role.
        legal = [p for p in product(range(chat.N_STATES), repeat=4) if p[0] < roles and all(b < roles or a % roles == b % roles for a, b in zip(p, p[1:]))]
        assert worth(tuple(model.decode(lines))) == pytest.approx(max(map(worth, legal)))


def test_chat_segments_overlap(spark):
    """A conversation of many segments is read as one transcript would be; other roles, null places and crowds."""
    rows = [(c, t, ("user", "assistant")[t % 2], "say %d %d" % (c, t)) for c in range(40) for t in range(6)]
    r = np.random.default_rng(5)
    # The model is fitted on half of the conversations: some with tools are among them.
    rows += [(c, t, ("user", "assistant", "tool")[t % 3], "ask %d %d" % (c, t)) for c in range(910, 930) for t in range(6)]
    long = [(900, t, ("user", "assistant", "tool")[t % 3], "turn %d" % t + ("\nline two" if r.random() < 0.3 else "")) for t in range(200)]
    crowd = [(901, 0, "user", "text %d" % k) for k in range(600)]
    lost = [(None, 3, "user", "no conversation"), (902, None, "assistant", "no place"), (902, None, "assistant", "no place"), (903, 0, "narrator", "who says so")]
    table = spark.createDataFrame([*rows, *long, *crowd, *lost], "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    style = chat.style_of("900")
    whole, _ = chat.write_transcript([(role, x) for _, _, role, x in long], style, {k for k in range(200) if chat.without_marker(k, style)})
    got = chat.recover(table, model).collect()
    mine = sorted((x.turn, x.recovered, x.text) for x in got if x.conv_id == 900 and x.turn is not None)
    assert [m[1:] for m in mine] == model.turns(whole)
    assert sum(x.conv_id == 901 for x in got) >= 600 and sum(x.conv_id == 902 for x in got) == 2 and sum(x.conv_id is None for x in got) == 1
    assert {x.recovered for x in got if x.conv_id == 903} <= set(chat.ROLES)
    assert {x.recovered for x in got if x.role == "tool"} == {"tool"}
    empty = chat.recover(table.where("false"))
    assert empty.count() == 0 and not any(x.trained for x in got)


def brute_mix(rows):
    """(doc, times) of rows (doc_id, text, source): water filling by rounds, then the documents below a threshold."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sources)}
    total = {x: sum(n for n, r in zip(sizes, rows) if r[2] == x) for x in sources}
    target, open_, budget = {}, set(sources), 1.5 * sum(sizes)
    while open_:
        level = budget / sum(weight[x] for x in open_)
        full = {x for x in open_ if level * weight[x] > 2 * total[x]}
        if not full:
            target |= {x: level * weight[x] for x in open_}
            break
        for x in full:
            target[x], budget = 2.0 * total[x], budget - 2 * total[x]
        open_ -= full
    digest = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15]
    out = []
    for x in sources:
        mine = [(digest(r[0]), n, r) for n, r in zip(sizes, rows) if r[2] == x]
        whole = int(target[x] // total[x]) if total[x] else 0
        rest, below, chosen = target[x] - whole * total[x], 0, set()
        for h in sorted({m[0] for m in mine if m[1]}):
            n = sum(m[1] for m in mine if m[0] == h)
            if below + n > rest:
                if below + n - rest < rest - below:
                    chosen.add(h)
                break
            chosen.add(h)
            below += n
        out += [(r, whole + (h in chosen)) for h, n, r in mine if n]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, with null and empty texts, repeated rows and ids, ids and sources that
    lack, and columns whose names clash."""
    import corpus_pipeline

    r = np.random.default_rng(31)
    docs, labels, truth = labelled(spark, 100, lambda w, r: " | ".join(x.upper() for x in w))
    rows = [(x.doc_id, x.text, ("a", "b", None)[(x.doc_id or 0) % 3]) for x in docs.collect()]
    base = words(120, 70).split()
    for k in range(25):
        w = list(base)
        for p in r.choice(120, int(r.integers(0, 7)), replace=False):
            w[p] = f"edit{k}x{p}"
        rows.append((2000 + k, " ".join(w), "a"))
    leak = " ".join(words(60, 71).split()[:30])
    rows += [(3000 + k, words(80, 300 + k), "c") for k in range(20)] + [(3100, words(30, 72) + " " + leak, "b"), (3101, leak, None)]
    rows += [rows[3], rows[3], (3000, words(90, 73), "c"), (None, words(40, 74), "a"), (None, words(40, 74), "a"), (None, None, None), (3002, words(80, 300).replace(" ", "  ") + " ", "b"), (3200, "", "a"), (3201, "  \n ", "b")]
    schema = "doc_id long, text string, source string, row_id string, kept string, component string, _size long, digest string"
    table = spark.createDataFrame([(*x, "r", "k", "c", 5, "d") for x in rows], schema)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*table.columns, "repeat"]

    # Quality: the fitted network, a row at a time.
    network = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    raw = [np.frombuffer((t or "").encode(), np.uint8) for _, t, _ in rows]
    rows = [x for x, b in zip(rows, raw) if network.score(b, np.array([0, len(b)]))[0] >= 0.3]
    # Exact copies: the longest, then the smallest id; of rows alike one.
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for x in rows:
        key = (-len(x[1] or ""), x[0] is None, x[0] or 0)
        if norm(x[1]) not in best or key < best[norm(x[1])][0]:
            best[norm(x[1])] = key, x
    exact = [x for _, x in best.values()]
    # Near copies: rows without id, or without words, stand alone.
    sets = []
    for i, t, _ in exact:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and i is not None else set())
    group = list(range(len(exact)))
    for _ in exact:
        for a in range(len(exact)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    near = [x for k, x in enumerate(exact) if x[0] is None or not sets[k] or x[0] == min(exact[j][0] for j in range(len(exact)) if group[j] == group[k])]
    # The benchmark's windows of ten words.
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(token(leak)[k : k + 10]) for k in range(len(token(leak)) - 9)}
    clean = [x for x in near if not any(tuple(token(x[1])[k : k + 10]) in windows for k in range(len(token(x[1])) - 9))]
    want = sorted(((*x, n + 1) for x, times in brute_mix(clean) for n in range(times)), key=str)
    have = sorted(((x.doc_id, x.text, x.source, x.repeat) for x in got.collect()), key=str)
    assert len(near) < len(exact) < len(rows) and len(clean) < len(near)
    assert have == want


def test_pipeline_of_nothing(spark, tmp_path):
    """An empty table, and one without labels or items, whose documents all stay."""
    import corpus_pipeline

    docs = documents(spark, [(k, words(40, 400 + k), "ab"[k % 2]) for k in range(8)]).drop("keep_id", "kept", "rule")
    for name, rows in (("none", docs.where("false")), ("some", docs)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == [*docs.columns, "repeat"]
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, f"{tmp_path}/some")
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").select("doc_id").distinct().count() > 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark, 120, lambda w, r: " | ".join(x.upper() for x in w))
    clean = documents(spark, [(1000 + k, words(150, 50 + k)) for k in range(20)] + [(2000, words(150, 50)), (2001, words(150, 51) + " extra")])
    docs = docs.where("text is not null").unionByName(clean).drop("keep_id", "kept", "rule")
    leak = " ".join(words(150, 52).split()[:40])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    assert 2000 not in kept[1] and 1000 in kept[1] and 2001 not in kept[2] and 1001 in kept[2]
    assert 1002 not in kept[3] and kept[2] - kept[3] == {1002}
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in last.select("doc_id").collect()} <= kept[3]
    assert last.groupBy("doc_id").agg(F.max("repeat").alias("m")).where("m > 2").count() == 0


def test_a_benchmark_of_many_passes_holds_one_at_a_time(spark, monkeypatch):
    import os

    item = [words(40, 100 + k) for k in range(4)]
    docs = documents(spark, [(1, words(30, 1) + " " + item[0]), (2, item[1] + " " + item[3]), (3, words(60, 2)), (4, item[2][:100]), (None, item[2]), (None, item[2])])
    table = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(item)], "item_id string, text string")
    want = sorted(map(tuple, decontaminate.find_leaks(docs, table).collect()), key=str)
    passes, seen = decontaminate._passes, []

    def watched(*args):
        for sent, last in passes(*args):
            # What came before is gone when the next pass is made.
            assert not any(os.path.exists(path) for path in seen)
            seen.append(sent._path)
            yield sent, last

    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", 1)
    monkeypatch.setattr(decontaminate, "_passes", watched)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, table, most_words=20).collect()), key=str) == want
    assert len(seen) >= 3
    assert [r for r in want if r[0] is None][0][2] == 40


def test_many_rows_alike_tell_their_repeats_once(spark, monkeypatch):
    text = words(300, 7)
    rows = [(None, text)] * 600 + [(5, text)] * 200 + [(6, words(300, 8))]
    found, tables = substrings.repeated_spans(documents(spark, rows).repartition(3))
    per_key = found.distinct().groupBy("key").count().agg(F.max("count")).first()[0]
    for t in tables:
        t.delete()
    # How long the arrays are that the rows are joined with.
    lengths, plain = [], substrings.map_arrow

    def watched(df, function, schema):
        if {"spans", "digest"} <= set(df.columns):
            lengths.append(df.agg(F.max(F.size("spans"))).first()[0])
        return plain(df, function, schema)

    monkeypatch.setattr(substrings, "map_arrow", watched)
    got = [tuple(r) for r in substrings.remove_repeats(documents(spark, rows).repartition(3)).collect()]
    n = len(text.encode())
    assert sum(r[1:4] == (n, n, 1) for r in got) == 800 and [r[2] for r in got if r[0] == 6] == [0]
    assert len(lengths) == 1 and lengths[0] <= per_key
