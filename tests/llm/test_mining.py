"""Collocations, the Merkle manifest and SimHash against brute force, on small tables with nulls, ties and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenlake.llm import collocations, htmltext, merkle, simhash


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- collocations


def phrases_of(rows, least, longest, share, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    drop = {(g, p[i : i + k]) for (g, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * f[g, p[i : i + k]]}
    by = collections.defaultdict(list)
    for (g, p), a in found.items():
        if (g, p) not in drop:
            score, k = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
            by[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, r, p.decode(), -a, x, y, n[g], -s) for g, rows in by.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def random_rows(seed, n):
    r = np.random.default_rng(seed)
    marks = [" ", " ", "\t", "  ", ", ", ".", "\n", " É "]
    text = lambda: "".join("%s%s" % ("abcDé"[k], marks[m]) for k, m in zip(r.integers(0, 5, 60), r.integers(0, len(marks), 60)))
    return [(("en", "fr", None, "und")[k % 4], text()) for k in range(n)] + [("en", None), ("", ""), ("xx", "lonely")]


@pytest.mark.parametrize("given", [{"least": 2}, {"least": 3, "longest": 3, "share": 100}, {"least": 1, "top": 3, "longest": 5}, {"least": 4, "longest": 2}])
def test_collocations(spark, given):
    rows = random_rows(1, 60)
    docs = spark.createDataFrame([(g, t, "x", 1) for g, t in rows], "lang string, text string, phrase string, n long").repartition(3)
    got = collocations.collocations(docs, **given)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_of(rows, **{"least": 30, "longest": 4, "share": 80, "top": 2000} | given)


def test_collocations_of_small_shards_and_filters_that_let_all_through(spark, monkeypatch):
    rows = random_rows(2, 40)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "SHARD_BYTES", 200)
    monkeypatch.setattr(collocations.IdFilter, "probably", lambda self, column: np.ones(len(column), bool))
    assert sorted(map(tuple, collocations.collocations(docs, least=5).collect())) == phrases_of(rows, 5, 4, 80, 2000)
    assert collocations.collocations(docs.where("false")).count() == 0


def test_scores_pass_64_bits(spark):
    big = 4 * 10**14
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 3), ("en", "b", 1, big + 4)], "lang string, phrase string, length int, f long")
    row = collocations.scored(phrases).first()
    assert (row.a, row.l, row.r, row.score) == (big, big + 3, big + 4, 2000000 * big // (2 * big + 7))


def test_states_are_the_classes_of_equal_places(spark):
    import pyarrow as pa

    texts = ["a b c a b c", "b c, a b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    shard = collocations.Shard(data, np.array([0, len(texts[0]), len(data)]), pa.array(["en", "en"]), 3)
    names = shard.text.cast(pa.string()).to_pylist()
    places = collections.defaultdict(set)
    pieces = [(0, texts[0]), (6, "b c"), (8, "a b")]
    for start, piece in pieces:
        w = piece.split()
        for k in range(1, 4):
            for i in range(len(w) - k + 1):
                places[tuple(w[i : i + k])].add(start + i + k)
    want = collections.defaultdict(list)
    for p, ends in places.items():
        want[p[-1], frozenset(ends)].append(p)
    want = {(max(v, key=len), min(len(p) for p in v), len(ends)) for (_, ends), v in want.items()}
    got = set()
    for length, last, least, n in shard.states(3):
        for at, k, m in zip(last.tolist(), least.tolist(), n.tolist()):
            got.add((tuple(names[shard.word[at - j]] for j in range(length - 1, -1, -1)), k, m))
    assert got == want


# --- the Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree_of(nodes, arity):
    paths, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + arity, len(nodes))) for a in range(0, len(nodes), arity)]
        for run in runs:
            for k in run:
                for m in own[k]:
                    paths[m].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, own = [digest(*(nodes[k] for k in run)) for run in runs], [[m for k in run for m in own[k]] for run in runs]
    return nodes[0], paths


def manifest_of(rows, arity):
    by = collections.defaultdict(list)
    for row in rows:
        by[row["lang"]].append(row)
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append((own, *tree_of([leaf_of(r) for r in own], arity)))
    root, tops = tree_of([t[1] for t in trees], arity)
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for row, path in zip(own, paths):
            hurt = row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf_of(row | {"n_chars": row["n_chars"] + 1}) if hurt else leaf_of(row)
            for before, after in path + top:
                node = digest(before, node, after)
            out.append((row["doc_id"], leaf_of(row), subroot, root, digest(*(b + a for b, a in path + top)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("arity", "levels"), [(2, 2), (3, 1), (2, 8)])
def test_manifest(spark, arity, levels):
    rows = [(1, "a", None, 3, "x"), (1, "a", None, 3, "x"), (1, "a", None, 3, "y"), (None, "b", None, None, None), (7, None, "de", 2**63 - 1, "ä" * 10), (14, "s", "de", 9, ""), (3, "s", "fr", 1, "t" * 100_000), (5, "", "", 0, "-")]
    rows += [(k, "q", "en", k if k % 5 else None, f"t{k}") for k in range(37)]
    docs = spark.createDataFrame([(*r, "root", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place long").repartition(3)
    got = merkle.verify(merkle.manifest(docs, arity, levels), F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 0, false)"))
    want = manifest_of([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows], arity)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.tampered_manifest(spark.createDataFrame([(2, None, None, None, None)], schema)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == digest("1:2", "-", "-", "-", "-") and one.proof_sha256 == digest() and one.verified
    assert merkle.tampered_manifest(spark.createDataFrame([], schema)).count() == 0


# --- SimHash


def print_of(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + width]).encode(), 42) for k in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(prints, radius):
    """For each of some sorted fingerprints the place of the first one that links reach."""
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(prints)):
        for j in (k + 1 + np.flatnonzero(np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= radius)).tolist():
            a, b = sorted((root(j), root(k)))
            label[b] = a
    return [root(k) for k in range(len(prints))]


def test_simhash_groups(spark):
    r = np.random.default_rng(5)
    base = ["w%d" % k for k in r.integers(0, 900, 400)]
    texts = [" ".join(base), " ".join(base).upper() + "\n"]
    for k in range(40):
        other = list(base)
        for at in r.integers(0, 400, 1 + k % 8):
            other[at] = "edited%d" % at
        texts.append(" ".join(other))
    texts += ["", None, " \t ", "one", "one two three", "é " * 30, " ".join("v%d" % k for k in r.integers(0, 5000, 70_000))]
    texts += [" ".join("u%d" % k for k in r.integers(0, 50, 30)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[4]), (None, texts[5]), (None, "quite alone here")]
    docs = spark.createDataFrame([(*x, 9, "p") for x in rows], "doc_id long, text string, component_id long, print string").repartition(3)
    prints = [print_of(t) for _, t in rows]
    known = np.array(sorted(set(prints)), np.uint64)
    root = dict(zip(known.tolist(), roots_of(known, 4)))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    got = simhash.near_groups(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=str)
    assert simhash.near_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("radius", [4, 2])
@pytest.mark.parametrize(("split", "most"), [(20_000, 100_000), (20, 100_000), (20, 30)])
def test_links_of_families(spark, monkeypatch, radius, split, most):
    r = np.random.default_rng(3)
    prints = set(r.integers(0, 2**64, 2000, dtype=np.uint64).tolist())
    for b in r.integers(0, 2**63, 20, dtype=np.uint64).tolist():
        x = b
        for _ in range(60):
            for k in r.integers(0, 64, 3).tolist():
                x ^= 1 << k
            y = b
            for k in r.integers(0, 64, 2).tolist():
                y ^= 1 << k
            prints |= {x, y}
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long").repartition(3)
    place = {int(x): k for k, x in enumerate(prints.view(np.int64))}
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    monkeypatch.setattr(simhash, "MOST", most)
    for a, b in simhash.links(df, radius, split, most).collect():
        a, b = sorted((root(place[a]), root(place[b])))
        label[b] = a
    assert [root(k) for k in range(len(prints))] == roots_of(prints, radius)


def test_a_family_costs_a_comparison_each_and_not_its_pairs():
    r = np.random.default_rng(4)
    near = {0}
    while len(near) < 3000:
        near.add(sum(1 << int(k) for k in r.choice(64, 4, replace=False)))
    forest = simhash.Forest(np.array(sorted(near), np.uint64), np.array([0]), 4)
    assert (forest.components() == 0).all() and forest.steps < 3000


# --- blocks of web pages


def random_tree(r, depth):
    """(tag, attributes, children): elements and texts."""
    tags = ["div", "p", "article", "nav", "section", "span", "b", "a", "footer", "ul", "style", "button"]
    tag = tags[r.integers(0, len(tags))]
    attributes = ["", ' class="sidebar"', " class='note wide'", ' id="main-comments"', ' data-x="a>b"', ' role="banner"', ' style="display: none"'][r.integers(0, 7)]
    children = []
    for _ in range(r.integers(0, 5)):
        if depth and r.random() < 0.6:
            children.append(random_tree(r, depth - 1))
        else:
            children.append(["one two", " ", "x &amp; y", "é\n z", "&lt;b&gt;", "3"][r.integers(0, 6)])
    return tag, attributes, children


def markup(tree):
    if isinstance(tree, str):
        return tree
    tag, attributes, children = tree
    return f"<{tag}{attributes}>{'plain' if tag == 'style' else ''.join(map(markup, children))}</{tag}>"


def blocks_of(trees):
    """The flat blocks of trees, by walking them."""
    import html

    out, pieces = [], []

    def flush(flags):
        text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
        if text:
            out.append((text, len(text.split()), len(html.unescape("".join(t for t, link in pieces if link)).split()), *flags))
        pieces.clear()

    def walk(tree, flags, skipped, link):
        if isinstance(tree, str):
            if not skipped:
                pieces.append((tree, link))
            return link
        tag, attributes, children = tree
        block = tag in htmltext.BLOCK_TAGS or tag in htmltext.SKIPPED_TAGS
        if block:
            flush(flags)
        if tag == "style":
            flush(flags)
            return link
        inner = flags
        if block:
            never = tag in ("nav", "footer") or any(x in attributes for x in ("sidebar", "comments", "banner", "none")) and tag != "article"
            inner = (flags[0] or tag == "article", flags[1] or never, flags[2] or "note" in attributes and tag not in ("nav", "footer", "article"))
        link = link or tag == "a"
        for child in children:
            link = walk(child, inner, skipped or tag == "button", link)
        if block:
            flush(inner)
        return link and tag != "a"

    link = False
    for tree in trees:
        link = walk(tree, (False, False, False), False, link)
    flush((False, False, False))
    return out


def nested(trees, inside=()):
    """Whether an element stands in one that its start or end would close: links in links, paragraphs in paragraphs."""
    return any(not isinstance(t, str) and ((t[0] in ("a", "p") and t[0] in inside) or nested(t[2], (*inside, t[0]))) for t in trees)


def test_blocks_of_random_pages():
    r, seen = np.random.default_rng(11), 0
    while seen < 300:
        trees = [random_tree(r, 5) for _ in range(3)]
        if not nested(trees):
            assert htmltext.blocks("".join(map(markup, trees))) == blocks_of(trees)
            seen += 1


def test_deep_pages_take_time_by_their_length():
    import time

    n = 220_000
    page = "<div>" * n + "deep text" + "</div><p>" * n
    assert len(page) > 2_500_000
    began = time.process_time()
    assert [b[0] for b in htmltext.blocks(page)] == ["deep text"]
    first = time.process_time() - began
    crossed = "<div><ul>" * (n // 2) + "</div>" * n
    began = time.process_time()
    assert htmltext.blocks(crossed) == []
    assert first < 20 and time.process_time() - began < 20


def test_join_by_hot_and_rare_keys(spark):
    from lumenlake.llm.common import join_unique

    keys = [None if k % 3 == 0 else "hot" if k % 3 == 1 else f"rare{k % 1999}" for k in range(9000)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "id long, lang string").select("id", F.struct("lang").alias("key"))
    unique = spark.createDataFrame([(v, None if v is None else len(v)) for v in dict.fromkeys(keys) if v != "rare5"], "lang string, n long").select(F.struct("lang").alias("key"), "n")
    got = sorted((r.id, r.n) for r in join_unique(rows.repartition(3), unique, "key").collect())
    assert got == [(k, None if v is None else len(v)) for k, v in enumerate(keys) if v != "rare5"]
    assert join_unique(rows.where("false"), unique, "key").count() == 0
