"""Periodic runs, lexical search and sanitising beside brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np

from pulsegrid.llm import lexical, periodic, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------------- periodic runs


def brute_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    exponent = None if top[1] is None else 1000 * top[1] // top[2]
    return doc_id, len(runs), *top, exponent, *(hashlib.sha256(x.encode()).hexdigest() for x in (shown, kept))


def periodic_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        out = []
        while len(out) < rng.randint(1, 250):
            letters = "abcdefghij"[: rng.randint(1, 10)]
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            out += unit * rng.randint(1, 12)
            out += unit[: rng.randint(0, len(unit))]
        yield " ".join(out)


def test_periodic_runs_beside_brute_force(table, awkward):
    rows = awkward + [(None, "x y " * 9)] + [(100 + k, t) for k, t in enumerate(periodic_texts(5, 400))]
    rows += [(600 + k, " ".join("ab"[(k >> j) & 1] for j in range(10))) for k in range(1024)]
    got = rows_of(periodic.digests(table(rows)))
    assert got == sorted((brute_digest(*r) for r in rows), key=repr)
    assert periodic.digests(table([])).collect() == []


def test_runs_at_the_border_of_a_block():
    rng = random.Random(8)
    for _ in range(300):
        docs = [t.split() for t in periodic_texts(rng.random(), 3)]
        seen = {}
        ids = [np.array([seen.setdefault(w, len(seen)) for w in d]) for d in docs]
        offsets = np.cumsum([0, *map(len, docs)])
        got = periodic.find_runs(np.concatenate(ids).astype(np.uint64), offsets, lambda d: ids[d])
        assert got == [brute_runs(d) for d in docs]


def test_long_texts_of_few_words_take_little_time(table):
    rng = random.Random(2)
    one, two = "same " * 400_000, " ".join(rng.choice("ab") for _ in range(400_000))
    many = " ".join(f"w{k}" for k in range(60_000)) + " "
    began = time.time()
    got = {r["doc_id"]: r for r in periodic.scan(table([(1, one), (2, two), (3, many * 5)])).collect()}
    assert time.time() - began < 60
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 400_000, 1)] and got[1]["collapsed_text"] == "same"
    assert [tuple(r) for r in got[3]["runs"]] == [(0, 300_000, 60_000)] and got[3]["collapsed_text"] == many.strip()
    words = two.split()
    for r in got[2]["runs"]:
        s, length, q = r
        assert words[s : s + length - q] == words[s + q : s + length]


# ------------------------------------------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=10):
    docs = [(i, collections.Counter(TERM.findall(t.translate(AZ)))) for i, t in docs if i is not None and t]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    held = collections.Counter(t for _, c, _ in docs for t in c)
    first = {}
    for i, text in sorted((i, t) for i, t in items if i is not None and t is not None):
        first.setdefault(i, text)
    out = []
    for item, text in first.items():
        scores = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = 0
            for t in set(TERM.findall(text.translate(AZ))) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def test_search_beside_brute_force(table, awkward, spark):
    rng = random.Random(4)
    vocabulary = [f"T{k}é" if k % 7 == 0 else f"t{k}" for k in range(300)]

    def text(most):
        return " ,".join(vocabulary[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(0, most)))

    rows = awkward + [(None, "t1 t2")] + [(1000 - k, text(120)) for k in range(900)]
    rows += [(k, rows[-1 - k % 50][1]) for k in range(2000, 2300)]  # ties of equal texts, in any order of ids
    items = [(k, text(30)) for k in range(60)] + [(60, None), (61, ""), (62, "nothing here"), (None, "t1"), (5, "zz"), (63, "one ONE Two")]
    asked = table(items).withColumnRenamed("doc_id", "item_id")
    want = brute_search(rows, items)
    for docs in (table(rows), table(rows).repartition(7)):
        assert sorted(map(tuple, lexical.search(docs, asked).collect())) == want
        assert sorted(map(tuple, lexical.search(docs, asked, shard_postings=700).collect())) == want
    assert lexical.search(table([]), asked).collect() == []
    assert lexical.search(table(rows), asked.limit(0)).collect() == []


def test_items_in_groups_and_sql(table, tmp_path):
    import duckdb

    rng = random.Random(6)
    words = [f"w{k}" for k in range(90)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(6))) for k in range(30)]
    asked = table(items).withColumnRenamed("doc_id", "item_id")
    groups = list(lexical.item_groups(asked, "item_id", 500))
    assert len(groups) > 3 and sorted(i for g in groups for i in g.ids) == list(range(30))
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    got = sorted(tuple(r) for r in lexical.search(table(rows), asked).collect())
    assert got == sorted(con.execute(lexical.ORACLE_SQL).fetchall()) == brute_search(rows, items)


def least_error(impacts, price, most):
    best = [0.0]
    for i in range(1, len(impacts) + 1):
        best.append(min(best[j] + price + (i - j) * max(impacts[j:i]) for j in range(max(0, i - most), i)))
    return best[-1]


def test_block_borders_have_the_least_error():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 40, 200, 200])
    impacts = rng.integers(0, 50, (5, 200))
    ends = lexical.block_ends(impacts * (np.arange(200) < sizes[:, None]), np.full(5, 90.0), sizes)
    for row, cut, n in zip(impacts, ends, sizes):
        at = np.flatnonzero(cut) + 1
        assert at[-1] == n and not cut[n:].any()
        error = sum(90.0 + (b - a) * row[a:b].max() for a, b in zip([0, *at[:-1]], at))
        assert error == least_error(row[:n].tolist(), 90.0, lexical.MOST_BLOCK)


def test_skipping_reads_few_postings():
    rng = np.random.default_rng(1)
    n = 20_000
    doc = np.concatenate([np.arange(n), rng.choice(n, 200, False)])
    term = np.repeat([0, 1], [n, 200])
    impact = np.concatenate([rng.integers(1, 100, n), rng.integers(5000, 9000, 200)])
    shard = lexical.Shard(np.arange(n), doc, term, impact)
    seen = []
    plain = shard.may_be_pivots

    def counted(*args):
        seen.append(len((found := plain(*args))[0]))
        return found

    shard.may_be_pivots = counted
    score = np.bincount(doc, impact, n).astype(int)
    want = sorted((-s, i) for i, s in enumerate(score.tolist()))[:10]
    assert shard.search(np.array([0, 1]), [], 10) == want
    assert sum(seen) < n / 10


# --------------------------------------------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            right = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)
            if right[kind]:
                out.append((kind, *m.span()))
    return out


def brute_spans(rows):
    """(doc_id, [(kind, start, end, instead)]) by the formulas, over all documents at once."""
    texts = [t or "" for _, t in rows]
    base = [brute_base(t) for t in texts]
    near = []
    for text, found in zip(texts, base):
        free = [m for m in TERM.finditer(text) if not any(m.start() < b and a < m.end() for _, a, b in found)]
        own = set()
        for kind, a, b in found:
            value = text[a:b].translate(AZ) if kind < 2 else re.sub("[^0-9]", "", text[a:b])
            before, behind = [m for m in free if m.start() < a][-pii.REACH :], [m for m in free if m.start() >= b][: pii.REACH]
            own |= {((kind, value), m[0].translate(AZ), *m.span()) for m in before + behind}
        near.append(own)
    held, both, named = collections.Counter(), collections.Counter(), collections.Counter()
    for text, own in zip(texts, near):
        words = {w.translate(AZ) for w in TERM.findall(text)}
        held.update(words | {w[: pii.PREFIX] + "*" for w in words})
        both.update({(c, x) for c, t, _, _ in own for x in (t, t[: pii.PREFIX] + "*")})
        named.update({c for c, _, _, _ in own})
    n = len(rows)

    def tells(c, x):
        if both[c, x] < pii.SUPPORT:
            return False
        bits = math.log2(n / named[c])
        return bits >= pii.LEAST_BITS and math.log2(n * both[c, x] / (named[c] * held[x])) >= pii.DISCLOSURE * bits

    out = []
    for (i, _), found, own in zip(rows, base, near):
        terms = {}
        for c, t, a, b in own:
            if tells(c, t):
                removed = len(t) <= pii.PREFIX or tells(c, t[: pii.PREFIX] + "*")
                terms[a, b] = "" if removed or terms.get((a, b)) == "" else t[: pii.PREFIX] + "*"
        spans = [(k, a, b, f"[{pii.KINDS[k]}]") for k, a, b in found] + [(4, a, b, x) for (a, b), x in terms.items()]
        out.append((i, sorted(spans)))
    return out


def personal_texts(seed, count):
    rng = random.Random(seed)
    letters = "ab.@+-_% 0123456789()1.2.@é\n"
    for _ in range(count):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
    for _ in range(count):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 19)))
        last = next(c for c in "0123456789" if luhn(digits + c))
        yield f"x {' '.join(digits)}{last} y {digits}-{last} +{digits[:3]} ({digits[3:6]}) {digits[6:11]}. 1.2.3.{digits[:3]} 0001.2.3.4.5.6.7.8"


def test_base_findings_beside_plain_patterns():
    for text in personal_texts(3, 3000):
        assert pii.base_spans(text) == brute_base(text), text


def surrounded(rng):
    """Documents of common words; some name entities beside words that hardly stand elsewhere."""
    common = [f"word{k}" for k in range(60)]
    for k in range(400):
        words = [rng.choice(common) for _ in range(30)]
        if k % 10 == 0:
            who = rng.randint(0, 4)
            told = [f"alias{who}", f"Zürich{who}", f"word{who}", f"qx{who}"]
            words[12:12] = [told[rng.randint(0, 3)], f"person{who}@mail.example.com", told[rng.randint(0, 3)]]
        if k % 97 == 0:
            words.append(f"alias{k % 5}")
        if k % 3:
            words.insert(rng.randint(0, 20), "everybody@example.org")
        yield " ".join(words)


def test_terms_beside_brute_force(table, awkward):
    rows = awkward + [(None, "mail a.b@c.de now"), (20, "x" * 3000 + "@" + "y.z" * 50)]
    rows += [(100 + k, t) for k, t in enumerate(surrounded(random.Random(1)))]
    rows += [(700 + k, t) for k, t in enumerate(personal_texts(9, 40))]
    want = brute_spans(rows)
    assert any(s[0] == 4 and s[3] for _, own in want for s in own) and any(s[0] == 4 and not s[3] for _, own in want for s in own)
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.scan(table(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = collections.Counter((r["doc_id"], r["text"]) for r in pii.sanitise(table(rows)).collect())
    by_spans = collections.Counter()
    for (i, text), (_, own) in zip(rows, want):
        out, at = "", 0
        for _, a, b, instead in sorted(own, key=lambda s: (s[1], -s[2])):
            out += (text[at:a] + instead) if a >= at else ""
            at = max(at, b)
        by_spans[i, out + (text or "")[at:]] += 1
    assert texts == by_spans
    digest = {r["doc_id"]: r for r in pii.digests(table(rows)).collect() if r["doc_id"] is not None}
    for i, own in want:
        if i is not None and i != 10:
            shown = [",".join(f"{(*pii.KINDS, 'term')[k]}:{a}:{b}" for k, a, b, _ in own if k < most) for most in (4, 5)]
            assert [digest[i][f"n_{name}"] for name in pii.KINDS] == [sum(s[0] == k for s in own) for k in range(4)]
            assert digest[i]["base_sha256"] == hashlib.sha256(shown[0].encode()).hexdigest() and digest[i]["spans"] == shown[1]
    assert pii.scan(table([])).collect() == []


def test_documents_without_personal_data_stay(table):
    rows = [(k, f"alias{k % 3} writes a{k} to nobody") for k in range(50)]
    rows += [(100 + k, f"alias1 is me{k % 3}@example.com today") for k in range(30)]
    assert all(not r["spans"] for r in pii.scan(table(rows)).collect() if r["doc_id"] < 100)


def test_long_lists_take_little_time(table):
    many = " ".join(f"user{k}@mail{k % 7}.example.com tel +1 555 {k:07d}" for k in range(20_000))
    odd = ["1" * 2_000_000, "a" * 2_000_000, "1." * 1_000_000, "+1 " * 700_000, "@" * 1_000_000, "a@" * 500_000, "+1" + " " * 2_000_000]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digests(table([(1, many), *((2 + k, t) for k, t in enumerate(odd))])).collect()}
    assert got[1]["n_email"] == got[1]["n_phone"] == 20_000
    assert time.time() - began < 90
