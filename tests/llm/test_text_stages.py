"""Quality rules, line dedup, n-gram join, licenses and secrets beside brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import licenses, line_dedup, ngram_join, quality_crf, quality_rules, secrets
from pulsegrid.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------------------------------------ quality rules


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    rep = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), failed


def test_quality_rules_counts(table, awkward):
    rng = random.Random(1)
    more = [(100 + k, " ".join(rng.choice("ab cd ef gh ij kl".split()) + "." * rng.randint(0, 1) for _ in range(rng.randint(3, 300)))) for k in range(40)]
    rows = awkward + more
    assert [tuple(r)[:2] for r in quality_rules.score_documents(table([(None, "a b")])).collect()] == [(None, 2)]
    got = sorted(tuple(r)[:7] for r in quality_rules.score_documents(table(rows)).collect())
    assert got == sorted((i, *rule_counts(t)) for i, t in rows)


def vocabulary_of(n, length):
    """A text of n distinct words in which hardly any three follow one another twice."""
    rng = random.Random(3)
    seen, out = set(), ["v0", "v1"]
    while len(out) < length:
        fresh = [w for w in (f"v{k}" for k in range(n)) if (*out[-2:], w) not in seen]
        out.append(rng.choice(fresh or ["v0"]))
        seen.add(tuple(out[-3:]))
    return " ".join(out)


def test_quality_rules_verdict(table):
    words = [f"word{k}" for k in range(80)]
    rows = [
        (1, " ".join(words)), (2, " | ".join(words)), (3, " ".join(w.upper() + "ABC" for w in words)), (4, "!! ".join(words)),
        (5, " ".join(["same"] * 400)), (6, "few words"), (7, " ".join(random.Random(1).choice(words) for _ in range(30_000))), (8, vocabulary_of(8, 600)),
    ]
    kept = {r.doc_id: r.kept for r in quality_rules.score_documents(table(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False}
    docs = table(rows)
    left = quality_rules.filter_documents(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [1]
    # many words over a vocabulary of thousands are prose, however long
    long = " ".join(f"w{random.Random(k).randrange(3000)}" for k in range(60_000))
    assert [r.kept for r in quality_rules.score_documents(table([(1, long)])).collect()] == [True]
    assert quality_rules.filter_documents(table([])).count() == 0
    names = [r.name for r in quality_rules.plan_cascade(docs)]
    assert sorted(names) == sorted(r.name for r in quality_rules.RULES)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --------------------------------------------------------------------------------------------------- line dedup


def dedup_by_hand(rows, least=20, docs_least=3):
    key = lambda x: x.strip(SPACES).translate(AZ)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= least and len(held[key(x)]) >= docs_least and max(held[key(x)]) != i for x in lines]
        text = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(table, awkward):
    rng = random.Random(2)
    pool = ["A line that many documents share, %d" % k for k in range(12)] + ["short", "", " \t A LINE that many documents share, 3 "]
    rows = awkward + [(50 + k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for k in range(30)]
    rows += [(200, "the same long line of a text\n" * 3), (200, "the same long line of a text"), (201, "The same long line of a text"), (202, "the same long line of a text ")]
    assert rows_of(line_dedup.digests(table(rows))) == dedup_by_hand(rows)
    assert line_dedup.digests(table([])).count() == 0
    # rows without an id count for nothing and lose nothing
    line = "a line of which two rows have no id"
    few = [(None, line), (None, line), (1, line), (2, line)]
    assert {tuple(r)[1:3] for r in line_dedup.digests(table(few)).collect()} == {(1, 0)}
    more = line_dedup.digests(table([*few, (3, line + "\nx")])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in more) == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 0)]
    assert line_dedup.dedup_documents(table(few)).count() == 4
    docs = table(rows)
    out = line_dedup.dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.text is None or r.n_chars == len(r.text)
    assert [r.text for r in out.where("doc_id = 1").collect()] == [None]


# -------------------------------------------------------------------------------------------------- n-gram join


def sets_by_hand(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    return out


def components_by_hand(rows):
    sets = sets_by_hand(rows)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(rng, n, words, edits):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(own)


def test_ngram_join(table, awkward):
    rng = random.Random(3)
    texts = [*near_copies(rng, 60, 120, 4), *near_copies(rng, 25, 40, 2), *near_copies(rng, 10, 9, 1)]
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 60))) for _ in range(40)]
    rng.shuffle(texts)
    rows = awkward + [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    assert rows_of(ngram_join.link_documents(table(rows))) == components_by_hand(rows)
    assert ngram_join.link_documents(table([])).count() == 0
    assert rows_of(ngram_join.link_documents(table([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("cell_rows, block", [(4, 3), (30, 1000), (1000, 7)])
def test_ngram_join_of_large_groups_in_cells_and_blocks(table, monkeypatch, cell_rows, block):
    """The sizes of cells and blocks, and how many n-grams are known to be common, leave the result as it is."""
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "HEAVY", 5)
    rng = random.Random(4)
    texts = [*near_copies(rng, 80, 100, 6), *near_copies(rng, 60, 70, 3), *near_copies(rng, 40, 30, 2)]
    rows = list(enumerate(texts))
    assert rows_of(ngram_join.link_documents(table(rows))) == components_by_hand(rows)


def test_ngram_join_of_one_group_of_thousands(table):
    """Near copies with one or two words changed: links by the hundred thousand, no base text among them."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(64)]
    rows = []
    for k in range(5000):
        own = list(base)
        for at in rng.sample(range(64), 1 + (k % 3 == 0)):
            own[at] = f"e{rng.randint(0, 10**9)}"
        rows.append((k, " ".join(own)))
    got = rows_of(ngram_join.link_documents(table(rows)))
    assert got == components_by_incidence(rows)


def components_by_incidence(rows):
    """components_by_hand by one dense product."""
    sets = sets_by_hand(rows)
    code = {g: k for k, g in enumerate({g for _, s in sets for g in s})}
    inner = [g for g, n in collections.Counter(g for _, s in sets for g in s).items() if n > 1]
    code = {g: k for k, g in enumerate(inner)}
    x = np.zeros((len(sets), len(code)), np.float32)
    for k, (_, s) in enumerate(sets):
        x[k, [code[g] for g in s if g in code]] = 1
    size, parent = np.array([len(s) for _, s in sets]), {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(sets)):
        shared = x @ x[k]
        for j in np.flatnonzero(100 * shared >= 80 * (size + size[k] - shared)):
            a, b = find(sets[k][0]), find(sets[int(j)][0])
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_ngram_join_without_ids(table):
    """Rows with a null doc_id link, but never name a component."""
    same = "a b c d e f g h"
    rows = [(None, same), (7, same), (4, same + " i"), (None, "k l m n o p"), (None, None), (2, "q r"), (2**62 + 1, "k2 l m n o p")]
    got = ngram_join.link_documents(table(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 0, 0), (0, 2, 0), (0, 4, 4), (2, 1, 2), (4, 5, 4), (7, 4, 4), (2**62 + 1, 2, 2**62 + 1),
    ]
    left = ngram_join.keep_one(table(rows)).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 0, 0, 2, 4, 2**62 + 1]


def test_ngram_join_of_keys_that_clash(table, awkward):
    """Fingerprints of three bits: nearly all sets clash, and are told apart by the other fingerprint."""
    rng = random.Random(5)
    rows = list(awkward)
    for k in range(40):
        words = [f"w{rng.randint(0, 900)}" for _ in range(30)]
        rows += [(100 + 3 * k + j, " ".join(words + ["x"] * j)) for j in range(3)]
    narrow = ngram_join.Keys(bits=3)
    assert rows_of(ngram_join.link_documents(table(rows), keys_of=narrow)) == rows_of(ngram_join.link_documents(table(rows)))
    assert rows_of(ngram_join.link_documents(table(rows), keys_of=narrow)) == sorted(components_by_hand(rows))


def test_blocks_of_a_group(spark, monkeypatch):
    """A group of many blocks: links inside the largest component, beyond it, and between small ones."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 100)
    keys, sets = [], []
    for k in range(60):
        kind = k % 3 if k > 30 else 0
        own = base.copy()
        own[: 15 * kind] = rng.integers(0, 2**62, 15 * kind) if kind < 2 else 1000 + np.arange(30) + k // 6
        own[50 + k % 40] = k
        keys.append(k)
        sets.append(np.unique(own).tolist())
    sets_df = spark.createDataFrame(list(zip(keys, sets)), "key long, grams array<long>")
    groups = spark.createDataFrame([(k, k, 0) for k in keys], "key long, component long, candidate long")
    want = set()
    for a in keys:
        for b in keys[:a]:
            shared = len(set(sets[a]) & set(sets[b]))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                want.add((b, a))
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 5)
    got = {tuple(sorted(r)) for r in ngram_join.block_products(groups, sets_df, 80).collect()}
    parts = {n for _, n in least_reachable(want).items()}
    assert len(parts) > 1 and least_reachable(got) == least_reachable(want)


def test_sketches_never_differ_by_more_than_their_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 300, 700, 2500, 5000) for _ in range(4)]
    words, levels = ngram_join.folded(pa.array([ngram_join.sketch(s) for s in sets], pa.binary()))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            w = min(words[a], words[b])
            place, matrix = levels[w]
            bits = np.bitwise_count(matrix[place[a]] ^ matrix[place[b]]).sum()
            assert bits <= len(np.setxor1d(x, y))


def test_ngram_join_keeps_one(table):
    rows = [(5, "a b c d e f"), (3, "A B c d e f"), (9, "other words here now then"), (4, None), (6, None)]
    docs = table(rows)
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 9]


def least_reachable(edges):
    """node -> the smallest node of its component, by union-find."""
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def random_graph(rng, n, path):
    names = rng.sample(range(10 * n), n)
    return [(names[k - 1] if path else names[rng.randrange(k)], names[k]) for k in range(1, n)]


def test_connected_components_of_paths_and_trees(spark):
    rng = random.Random(5)
    graphs = [[(1, 3), (3, 4), (4, 5), (5, 2)]]  # after one round 3 still hangs on both 1 and 2
    graphs += [random_graph(rng, n, path) for n, path in ((8, True), (60, True), (60, False))]
    many, at = [], 0
    for k in range(150):
        many += [(a + at, b + at) for a, b in random_graph(rng, rng.randint(2, 10), k % 2 == 0)]
        at += 100
    for edges in [*graphs, many]:
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == least_reachable(edges)


# ----------------------------------------------------------------------------------------------------- licenses


def test_licenses(table, awkward):
    mit = licenses.NOTICES[0].text
    cut = " ".join(w for k, w in enumerate(mit.split()) if k not in (9, 25))
    rows = awkward + [
        (20, "Released Under the MIT\nLicense. Under the mit license, under the MIT license"), (21, "Apache License, Version 2.0; CC-BY-NC 4.0"),
        (22, "under the mit licenses"), (23, mit.upper()), (24, "before " + cut + " after"), (25, "cc by"), (26, "under the K mit license"), (27, " ".join(mit.split()[:12])),
    ]
    got = {r.doc_id: r for r in licenses.digests(table(rows)).collect()}
    phrases = [("mit", "under the mit license".split()), ("apache-2", "apache license version 2".split()), ("cc-by-nc", "cc by nc".split())]
    for i, t in rows:
        w = licenses.template_words((t or "").translate(AZ))
        at = [(k, x) for x, p in phrases for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        g = got[i]
        want = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    assert got[23].labels == "mit" and got[23].score == 1.0
    assert got[24].labels == "mit" and 0.7 < got[24].score < 1  # two words are left out
    assert got[27].labels == "" and got[7].score == 0
    assert licenses.digests(table([])).count() == 0
    assert licenses.digests(table([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (None, None)])).count() == 4


def spans_by_hand(words, template, k=3, gap=3, share=0.75, stretch=1.5):
    """(start, end, score) of the merged diagonals of a template that hold enough of it."""
    windows = collections.defaultdict(list)
    for p in range(len(template) - k + 1):
        windows[tuple(template[p : p + k])].append(p)
    seen = sorted((i - p, i, p) for i in range(len(words) - k + 1) for p in windows.get(tuple(words[i : i + k]), []))
    groups = []
    for d, i, p in seen:
        if not groups or d - groups[-1][-1][0] > gap:
            groups.append([])
        groups[-1].append((d, i, p))
    out = []
    for g in groups:
        first, last = min(i for _, i, _ in g), max(i for _, i, _ in g) + k - 1
        score = len({p for *_, p in g}) / (len(template) - k + 1)
        if score >= share and last - first + 1 <= stretch * len(template):
            out.append((first, last + 1, score))
    return out


def test_license_labels_by_hand(table):
    """The labels that the method adds: templates with words changed, put in, left out and said twice."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        t = rng.choice(licenses.NOTICES).text.split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 2)] = [["other"], [], t[max(0, at - 3) : at + 1]][rng.randrange(3)]
        rows.append((k, " ".join(["before"] * rng.randint(0, 5) + t * rng.randint(1, 2) + ["behind"] * rng.randint(0, 5))))
    rows.append((500, " ".join(licenses.NOTICES[2].text.split()[:6] * 9)))  # the same few windows again and again
    got = {r.doc_id: r for r in licenses.scan(table(rows)).collect()}
    for i, text in rows:
        w = licenses.template_words(text)
        want = sorted((x.label, *s) for x in licenses.NOTICES for s in spans_by_hand(w, licenses.template_words(x.text)))
        assert sorted((f.label, f.start, f.end, f.score) for f in got[i].findings if not f.phrase) == want


# ------------------------------------------------------------------------------------------------------ secrets


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_by_hand(t):
    t = t or ""
    found = [(m.start(), m.end(), "assign", 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", 2) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return [f"{k}:{a}:{b}" for a, b, k, _ in sorted(found, key=lambda x: (x[0], x[3]))]


def secret_rows():
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for k in range(160):
        words = " ".join(draw("abcdefghijklmnop", rng.randint(2, 9)) for _ in range(30))
        extra = ["", f'Token="{draw(mixed, 20)}"', f"api_key : {draw(low, 40)}", "AKIA" + draw("ABCDEFGHIJ0123456789", 16), f"secret = {draw(low, 5)}", "order-2024-" + draw("0123456789", 8)][k % 6]
        rows.append((100 + k, f"é {words} {extra} {words}"))
    return rows


def test_secrets_base_and_model(table, awkward):
    rows = awkward + secret_rows() + [(None, "password=abcdefg1"), (7000, "tokentoken=abcdefg PASSWORD='a.b-c/d=' passwd: 12345"), (7001, "K token=K" + "a" * 30)]
    docs = table(rows)
    net = secrets.fit(docs)
    got = {}
    for r in secrets.scan(docs, net, fitted=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = base_by_hand(t)
        for g in got[i]:
            assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in secrets.KINDS)
            assert set(want) <= set(filter(None, g.spans.split(",")))
    assert secrets.scan(table([])).count() == 0


def test_secrets_the_network_adds(table):
    """Keys of kinds that no pattern knows, planted in plain texts: found by the network alone, words left alone."""
    net = secrets.fit(table(secret_rows()))
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    heads = ["the access_key: ", "pwd=", 'bearer = "', "client_id = "]
    keys = [draw(letters, n) for letters in (upper + low + digits, upper + low, upper + digits) for n in (20, 26, 32, 40) for _ in range(8)]
    texts = [f"plain words é before {heads[k % 4]}{key} and behind" for k, key in enumerate(keys)]
    found = list(secrets.scan_texts(pa.array(texts), net))
    hits = [any(kind == "model" and t[a:b].endswith(key) for a, b, kind, _ in f) for t, f, key in zip(texts, found, keys)]
    assert np.mean(hits) >= 0.9
    plain = ["plain words without anything in them at all", "the year 2024-05-17 and order 20240517 of it", "some-long-hyphenated-run-of-words here", "iPhone McDonald"]
    assert not any(secrets.scan_texts(pa.array(plain * 3), net))
    assert net.recall >= 0.9 and net.precision > 0.8


def test_secrets_are_learned_from_all_documents(table, monkeypatch):
    """Every candidate of every document counts, none is left out by a sample; more shards learn as well as one."""
    rows = secret_rows()
    many = "\n".join(f"secret = {zlib.crc32(b'%d' % k):08x}{k:08x}" for k in range(1700))  # over 4,000 positives
    rows += [(5000, many)]
    want = [0, 0, 0]
    for i, text in rows:
        found = secrets.labelled(text, np.random.default_rng([7, zlib.crc32(text.encode())]))
        want[secrets.part_of(i)] += sum(w is not None for _, w in found)
    net = secrets.fit(table(rows))
    assert net.learned == tuple(want) and sum(want) > 8000
    monkeypatch.setattr(secrets, "SHARD", 100)
    net = secrets.fit(table(secret_rows()))
    again = secrets.fit(table(secret_rows()[::-1]).repartition(5))
    assert net.recall >= 0.9 and net.precision > 0.8
    assert (net.kernel == again.kernel).all() and (net.scale == again.scale).all() and net.threshold == again.threshold


def test_secrets_candidates():
    text = "short1 Abcdefgh abcdefgh abcDefgh 12345678 abcdefghijklmnopqrstuvwxyzab a1b2c3d4 ABCDEFGH x=abcdefgh1"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = secrets.candidates(data, np.array([0, len(data)]))
    assert [text[a:b] for a, b in zip(starts, ends)] == ["abcDefgh", "12345678", "abcdefghijklmnopqrstuvwxyzab", "a1b2c3d4", "x=abcdefgh1"]


def test_secrets_threshold_keeps_recall_of_hard_positives():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, secrets._CLASSES, (900, 72)), (rng.random(900) < 0.1).astype(float)  # nothing to learn
    part = rng.integers(0, 3, 900)
    for missed in (0, 5):
        net = secrets.train(x, y, part, missed)
        good = net.scores(x[part == secrets.THRESHOLD])[y[part == secrets.THRESHOLD] == 1]
        assert len(good) and (good >= net.threshold).mean() >= secrets.RECALL
        assert net.recall == pytest.approx((good >= net.threshold).sum() / (len(good) + missed))


def test_secrets_behind_a_long_prefix():
    class DigitRuns:
        """Sees a key where 16 digits of a stretch follow one another."""

        threshold = 0.5

        def scores(self, x):
            inside = x[:, secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] == secrets._CLASS[ord("0")]
            return np.lib.stride_tricks.sliding_window_view(inside, 16, axis=1).all(2).any(1).astype(float)

    key = "8391047562018374"
    texts = ["com/" + "services/" * k + key + "/" + "tail-" * j for k in (0, 5, 9, 200) for j in (0, 1, 30)]
    texts += ["1" * 15 + "/" + "services/" * 20, "short-1234567890"]
    found = list(secrets.scan_texts(pa.array(["see " + t for t in texts]), DigitRuns()))
    want = [[(4, 4 + len(t), "model", 1.0)] if key in t else [] for t in texts]
    assert found == want


def test_secrets_are_masked(table):
    docs = table([(1, None), (2, "é token=abcdef0123 end"), (3, "nothing here"), *secret_rows()])
    out = secrets.mask_documents(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and got[1].text is None and got[3].text == "nothing here"
    assert got[2].text == "é [secret] end" and got[2].n_chars == len(got[2].text)
    assert not any(base_by_hand(r.text) for r in got.values())


# --------------------------------------------------------------------------------------------------- classifier


def test_quality_crf(table, awkward, spark):
    rng = random.Random(7)
    good = lambda: "\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(2, 7) for _ in range(9)) + "." for _ in range(rng.randint(1, 12)))
    bad = lambda: "\n".join(" ".join("ABC" * 2 + "###" for _ in range(9)) for _ in range(rng.randint(1, 12)))
    rows = [(1000 + k, good() if k % 4 else bad()) for k in range(400)]
    labels = spark.createDataFrame([(1000 + k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_crf.score_documents(table(rows + awkward + [(None, "no id")]), labels).collect()
    assert [0 <= r.score <= 1 and r.held_out is None for r in got if r.doc_id is None] == [True]
    got = [r for r in got if r.doc_id is not None]
    assert len(got) == len(rows) + len(awkward) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 1000]
    assert len(held) > 40 and np.mean([r.predicted == ((r.doc_id - 1000) % 4 > 0) for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    none = quality_crf.score_documents(table(rows[:5]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_crf.score_documents(table([]), labels).count() == 0


def test_crf_scores_by_hand(table, spark):
    """Scores of documents: marginals by enumeration of all labellings, weighted by lengths, calibrated."""
    rng = random.Random(17)
    field = quality_crf.Field(np.random.default_rng(1).normal(size=quality_crf.N_FEATURES), np.array([[0.4, -0.2], [0.1, 0.6]]), np.array([0.2, -0.1]), (1.7, -0.3))
    texts = ["\n".join("".join(rng.choice("ab C1#!.") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 7))) for _ in range(30)]
    block = next(quality_crf.blocks(pa.array(texts)))
    got = quality_crf.quality(field, block)
    doc, x, size = quality_crf.line_features(block)
    for d, text in enumerate(texts):
        own, length = x[doc == d] @ field.weights, [len(line) for line in text.split("\n")]
        assert size[doc == d].tolist() == length
        total, ones = 0.0, np.zeros(len(own))
        for code in range(2 ** len(own)):
            y = np.array([(code >> k) & 1 for k in range(len(own))])
            s = np.exp(field.first[y[0]] + own @ y + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
            total, ones = total + s, ones + s * y
        w = np.array(length) + 1e-6
        p = (ones / total * w).sum() / w.sum()
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(1.7 * np.log(p / (1 - p)) - 0.3))))


def test_crf_sample_is_of_whole_documents(table, spark):
    rows = [(k, "line of words\n" * (k % 7)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = quality_crf.id_text(table(rows))
    got = [r.doc_id for r in quality_crf.training_sample(docs, labels, "quality", 30, 50).collect()]
    assert len(got) < 30 and sum(k % 7 + 1 for k in got) <= 50


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(8)
    field = quality_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    doc, x = np.array([0, 0, 0, 1, 1, 2]), rng.normal(size=(6, 3))
    got = quality_crf.marginals(field, doc, x)
    for d in range(3):
        own = x[doc == d] @ field.weights
        total, ones = 0.0, np.zeros(len(own))
        for code in range(2 ** len(own)):
            y = [(code >> k) & 1 for k in range(len(own))]
            s = field.first[y[0]] + sum(own[k] * y[k] for k in range(len(own))) + sum(field.transitions[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            ones += np.exp(s) * np.array(y)
        assert np.allclose(got[doc == d], ones / total)


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_quality_rules"])
def test_oracles(spark, name):
    from compare import normal
    from pulsegrid.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert normal(queries.QUERIES[name](spark, sf).toPandas()) == normal(con.execute(queries.ORACLE_SQL[name]).df())


def test_licenses_without_a_broadcast(table, awkward, monkeypatch):
    """A template table that is too large to be sent to every task, and many rows without any window."""
    rows = awkward + [(k, None) for k in range(200, 260)] + [(300 + k, "so " * k + "under the MIT License, cc by-nc") for k in range(9)]
    want = rows_of(licenses.digests(table(rows)))
    monkeypatch.setattr(licenses, "BROADCAST_WINDOWS", 0)
    assert rows_of(licenses.digests(table(rows))) == want
    assert sum(r[2] for r in want) == 18
