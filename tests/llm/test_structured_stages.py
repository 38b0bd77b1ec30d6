"""Tokenizers, packing, archives, neighbours and the pipeline beside brute force and the public libraries."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import sentencepiece as sp
from tokenizers import Tokenizer

from pulsegrid.llm import neighbours, packing, quality_rules, warc
from pulsegrid.llm import sentencepiece as pieces
from pulsegrid.llm.common import materialize, shared_path

ODD = [
    "", "a", "  two  spaces ", " \n\n x", "▁x y", "日本語 テキスト 🎉 ok", "x" * 70, "\x00\x01", "é é É Ë ß ÿ ª µ", "é ö", "   " * 7,
    "don't can't we'll 12345 3.14", "http://a.b/c?d=e&f=g", "<|endoftext|> a<|startoftext|>b", " nbsp em\x1cfs", "İstanbul K ſ", "…—“q”",
]


# ------------------------------------------------------------------------------------------------ sentencepiece


def test_pair_merges_equal_the_library(spark, table, awkward):
    library = sp.SentencePieceProcessor(model_file=pieces.model_path())
    rows = awkward + list(enumerate(ODD, 100))
    docs = table(rows)
    encoded = pieces.encode_documents(docs, merged=True)
    got = sorted((r.doc_id, list(r.ids)) for r in encoded.collect())
    assert got == sorted((i, library.encode(t or "")) for i, t in rows)
    back = sorted((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect())
    assert back == sorted((i, library.decode(library.encode(t or ""))) for i, t in rows)
    digests = {r.doc_id: r for r in pieces.digests(docs).collect()}
    for i, t in rows:
        ids = library.encode(t or "")
        assert digests[i].merged_n_ids == len(ids) and digests[i].merged_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert pieces.digests(table([])).count() == 0


def test_viterbi_by_enumeration(table, awkward):
    """The query's ids have the best total score of all segmentations, and decode to the text again."""
    encoder = pieces.Encoder(pieces.model_path())
    scores, byte_score = encoder.scores, encoder.unknown

    def best(text):
        """Best total score over all segmentations."""
        total = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 24), end):
                s = scores.get(text[start:end])
                if s is None and end - start == 1:
                    s = byte_score
                if s is not None:
                    total[end] = max(total[end], total[start] + s)
        return total[-1]

    rows = [(i, t) for i, t in awkward + list(enumerate(ODD, 100)) if len(t or "") < 3000]
    rows += [(200, "the international Thlyatat. qzxv"), (None, "no id"), (201, "a" * 40)]
    digests = pieces.digests(table(rows)).collect()
    ids = {(r.doc_id, tuple(r.ids)) for r in pieces.encode_documents(table(rows)).collect()}
    for r in digests:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        own = next(x for i, x in ids if i == r.doc_id)
        assert r.n_ids == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(text.replace(pieces.MARK, " ").encode()).hexdigest()
        marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
        total, k = 0.0, 0
        while k < len(own):
            if encoder.pieces[own[k]][2] == pieces.BYTE:
                lead = int(encoder.pieces[own[k]][0][3:5], 16)
                k += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                total += byte_score
            else:
                total += encoder.pieces[own[k]][1]
                k += 1
        assert total == pytest.approx(best(marked))


# ------------------------------------------------------------------------------------------------------ packing


def check_packing(rows, got, capacity):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[i, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(table, awkward, capacity):
    rows = awkward + list(enumerate(ODD, 100)) + [(1000 + k, "word " * (k % 50)) for k in range(300)]
    rows += [(None, "no id"), (None, None), (2**62 + 1, "an id beyond the doubles"), (1, "y " * 5000)]
    docs = table(rows).repartition(9)
    got = packing.pack_documents(docs, capacity=capacity).collect()
    n, tokens = check_packing(rows, got, capacity)
    assert n <= 1.05 * -(-tokens // capacity) + 2
    assert packing.pack_documents(table([])).count() == 0


@pytest.mark.parametrize("group_pieces", [40_000, 4096, 200])
def test_packing_of_long_pieces_apart_from_short_ones(spark, group_pieces):
    """One partition has only pieces of 2,100 to 3,999 tokens, the other only the ones that fill them up."""
    n = 9000
    rows = spark.range(0, 2 * n, 1, 2).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "id AS ids_crc32",
        f"IF(id < {n}, 2100 + id * 7 % 1900, 1996 - id % {n} * 7 % 1900) AS length",
    )
    got = packing.pack(rows, group_pieces=group_pieces).collect()
    assert sorted(r.doc_id for r in got) == list(range(2 * n))
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY
    assert len(used) <= 1.05 * n, len(used)


def test_best_fit():
    assert packing.best_fit([5, 4, 3, 2, 1], 8) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 8) == []


# --------------------------------------------------------------------------------------------------------- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, record_type string, refers_to int")


@pytest.mark.parametrize("split", [1, 300, warc.SPLIT_BYTES])
def test_warc_round_trip(spark, split):
    big = "".join(chr(97 + k * k % 26) for k in range(200_000))
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u\r\nx", None), (4, "", ""), (5, "é", "ünï 日本"), (6, "b", big), (9, "c", "same"),
            (7, "t", "a\r\n\r\nb\r\n\r\n"), (8, "d", big + "x"), (8, "d2", "same"), (None, "n", "same"), (None, "o", "of no id"),
            (None, "p", "of no id"), (2**62 + 1, "q", "large id")]
    if split == 1:
        rows = [r for r in rows if r[0] not in (6, 8)]
    holder = {}
    for i, _, h in rows:
        holder[h or ""] = max(holder.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        payload, by = (h or "").encode(), holder[h or ""]
        kind = ("response", None) if by in (i, -1) else ("revisit", by)
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), *kind))
    want.sort(key=str)
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages(spark, rows), split).collect()), key=str)
    assert got == want


def test_warc_payloads_and_false_magic(spark, tmp_path):
    members = [warc.gzip_member(warc.record(k, "u", bytes(range(256)) * k, warc.base32_sha1(bytes(range(256)) * k), None)) for k in range(6)]
    fake = warc.MAGIC + b"\x00" * 50  # magic without a member behind it
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + fake.join(members))
    size = path.stat().st_size
    for split in (7, 100, size):
        starts = [at for lo in range(0, size, split) for at, _ in warc.members(str(path), lo, lo + split, strict=False)]
        assert len(starts) == 6 and sorted(starts) == starts
    df = spark.createDataFrame([(str(path), size)], "path string, bytes long")
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(df, 100, strict=False).collect()}
    assert got == {k: bytes(range(256)) * k for k in range(6)}


def test_warc_damage_is_an_error(tmp_path):
    """Cut short, bytes changed or lost: no split reads a damaged archive as a shorter one."""
    members = [warc.gzip_member(warc.record(k, "u", b"text %d " % k * 50, "x", None)) for k in range(5)]
    whole = b"".join(members)
    at = sum(map(len, members[:2]))
    path = tmp_path / "y.warc.gz"
    flipped = bytearray(whole)
    flipped[at + len(members[2]) // 2] ^= 0x55
    no_magic = bytearray(whole)
    no_magic[at] = 0
    for data in (whole[:-9], bytes(flipped), bytes(no_magic), whole[:at] + whole[at + 5 :], b"x" + whole):
        path.write_bytes(data)
        for split in (60, 100, 10_000):
            with pytest.raises(ValueError):
                for lo in range(0, len(data), split):
                    list(warc.members(str(path), lo, lo + split))
    path.write_bytes(whole)
    for split in (1, 60, 10_000):
        assert sum(len(list(warc.members(str(path), lo, lo + split))) for lo in range(0, len(whole), split)) == 5


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


# --------------------------------------------------------------------------------------------------- neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def nearest_by_hand(rows, k, every):
    good = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] if r[1] and None not in r[1] else [])):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for i, q in good.items():
        if i % every == 0:
            found = sorted((-math.fsum((q * v).tolist()), j) for j, v in good.items() if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_neighbours_recall_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 16))
    rows = [(k, (centres[k % 8] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(3000 + k, rows[5][1]) for k in range(60)]  # many equal vectors
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [None] + [1.0] * 15), (4060, [float("nan")] * 16), (4080, [float("inf")] * 16), (20, rows[20][1])]
    want = nearest_by_hand(rows, 20, 20)
    vs = neighbours.usable(vectors(spark, rows), "vec_id", "embedding")
    got = sorted(tuple(r) for r in neighbours.nearest(vs, vs.where("vec_id % 20 = 0"), block_vectors=512, block_queries=64).collect())
    assert len(got) == len(want)
    a, b = {(q, v) for q, _, v, _ in got}, {(q, v) for q, _, v, _ in want}
    assert len(a & b) >= 0.95 * len(b)
    exact = dict.fromkeys(want)
    same = [g for g in got if g in exact]
    assert len(same) >= 0.9 * len(want)
    by = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and i < 4000}
    assert all(s == math.fsum((by[q] * by[v]).tolist()) for q, _, v, s in got)


def test_neighbours_in_many_blocks(spark):
    """Recall over a few hundred blocks, and how few points are verified for it."""
    rng = np.random.default_rng(10)
    centres = 3 * rng.normal(size=(400, 16))
    x = (centres[rng.integers(0, 400, 100_000)] + 0.5 * rng.normal(size=(100_000, 16))).astype(np.float32)
    import pyarrow as pa

    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    vs = neighbours.usable(table, "vec_id", "embedding")
    got = neighbours.nearest(vs, vs.where("vec_id % 500 = 0"), 20, block_vectors=512).toPandas()
    x = x.astype(float)
    hit = 0
    for q in range(0, len(x), 500):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(set(np.argpartition(-scores, 20)[:20].tolist()) & set(got.vec_id[got.query_id == q].tolist()))
    assert len(got) == 200 * 20 and hit / len(got) >= 0.9


def test_neighbours_verify_few_points_of_tight_groups():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 8192)] + 0.05 * rng.normal(size=(8192, 16))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    longest = (x**2).sum(1).max()
    leaf = neighbours.leaves_of(neighbours.projected(x, longest))
    q, v, s, seen = neighbours.search(np.arange(8192), x, leaf, np.arange(200), x[:200], np.full(200, -np.inf), longest)
    hit = 0
    for k in range(200):
        scores = x @ x[k]
        scores[k] = -np.inf
        hit += len(set(np.argpartition(-scores, 20)[:20].tolist()) & set(v[q == k].tolist()))
    assert hit / 4000 >= 0.9 and seen < 0.25 * 200 * 8192, seen / 200 / 8192


def test_neighbours_planes():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(20_000, 8))
    for blocks in (1, 2, 7, 40):
        counts = np.bincount(neighbours.Splits(points[:5000], blocks).of(points), minlength=blocks)
        assert len(counts) == blocks and counts.max() < 1.5 * 20_000 / blocks
    assert set(neighbours.Splits(np.zeros((0, 8)), 5).of(points)) == {0}
    leaf = neighbours.leaves_of(points)
    assert np.bincount(leaf).max() <= neighbours.LEAF and leaf.min() == 0


def test_neighbours_of_few(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0, 3.0]), (20, [3.0, 1.0]), (40, [1.0])]
    got = sorted(tuple(r) for r in neighbours.search_table(vectors(spark, rows)).collect())
    assert got == nearest_by_hand(rows, 20, 20)
    assert neighbours.search_table(vectors(spark, [])).count() == 0


def test_chi_square():
    # the median of a chi-square variable with 8 degrees of freedom
    assert neighbours.chi_square_cdf(np.array([7.344121]), 8)[0] == pytest.approx(0.5, abs=1e-6)


# ----------------------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, table, tmp_path):
    import corpus_pipeline as cp

    words = lambda s: " ".join(f"{s}{k}" for k in range(60))
    line = "this line is found in many documents"
    rows = [(1, words("a") + "\n" + line), (2, words("a") + " end\n" + line), (3, words("b") + "\n" + line), (4, "too short"),
            (5, words("c") + " token = abcdef012345"), (6, " | ".join(f"x{k}" for k in range(60)))]
    docs = table(rows).drop("score", "n_words", "component_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
        path = shared_path(spark, "test")
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen.append({r.doc_id for r in now.collect()})
    assert seen == [{1, 2, 3, 5}, {1, 2, 3, 5}, {1, 3, 5}, {1, 3, 5}, {1, 3, 5}]
    whole = cp.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.length, r.ids_crc32) for r in now.collect())
    # what is packed are the texts that the stages left
    rules = {r.name for r in quality_rules.RULES}
    texts = {1: words("a") + "", 3: words("b") + "\n" + line, 5: words("c") + " [secret]"}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert rules and {r.doc_id: r.length for r in now.collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_neighbours_ties_of_distinct_vectors(spark):
    """Of distinct vectors with equal scores those with the smallest ids, whatever rounding says."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(k == j) for j in range(300)]) for k in range(300)]
    assert sorted(tuple(r) for r in neighbours.search_table(vectors(spark, rows)).collect()) == nearest_by_hand(rows, 20, 20)
    # the same products added up in another order
    base = rng.normal(size=12)
    rows = [(k, rng.permutation(base).tolist()) for k in range(400)] + [(400, [1.0] * 12)]
    vs = neighbours.usable(vectors(spark, rows), "vec_id", "embedding")
    asked = neighbours.usable(vectors(spark, rows[-1:]), "vec_id", "embedding")
    got = sorted(tuple(r) for r in neighbours.nearest(vs, asked, confidence=1.0, block_vectors=64).collect())
    assert [g[2] for g in got] == list(range(20)) and len({g[3] for g in got}) == 1


def test_the_closest_is_kept_where_products_round(monkeypatch):
    """Every row within rounding of the last score is compared exactly."""
    q = np.array([1.0, 1e-9, -1.0])
    x = np.array([[1.0, 1e-8 * k, 1.0] for k in range(200)])
    leaf = neighbours.leaves_of(neighbours.projected(x, 4.0))
    _, v, s, _ = neighbours.search(np.arange(200), x, leaf, np.array([-1]), q[None], np.array([-np.inf]), 4.0, 20, 1.0)
    want = sorted((-math.fsum((q * r).tolist()), i) for i, r in enumerate(x))[:20]
    assert v.tolist() == [i for _, i in want] and s.tolist() == [-a for a, _ in want]


def test_warc_records_of_others(spark, tmp_path):
    """A crawler's archive: records of all kinds, without this module's headers, some without digests."""

    def foreign(kind, block, **more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2024-05-01T10:00:00Z"]
        head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()] + [f"Content-Length: {len(block)}"]
        return warc.gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<html>\xff\r\n\r\ntwo</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 99\r\n\r\n"
    parts = [
        foreign("warcinfo", b"software: crawler/1.0\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n", WARC_Target_URI="<http://a.example/>", Content_Type="application/http; msgtype=request"),
        foreign("response", http + body, WARC_Target_URI="http://a.example/", Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{warc.base32_sha1(body)}"),
        foreign("response", http + body, WARC_Target_URI="http://b.example/", WARC_Payload_Digest="sha1:WRONG"),
        foreign("revisit", http, WARC_Target_URI="http://c.example/", WARC_Refers_To="<urn:uuid:response>", WARC_Payload_Digest="md5:abc"),
        foreign("metadata", b"fetchTimeMs: 3\r\n", WARC_Concurrent_To="<urn:uuid:response>,\r\n <urn:uuid:request>"),
        foreign("resource", b"", Content_Type="text/plain"),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(parts))
    archives = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    for split in (64, 500, 1 << 20):
        got = warc.read_archives(archives, split).orderBy("offset").collect()
        assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource"]
    assert all(r.page_id is None and r.refers_to is None and r.date == "2024-05-01T10:00:00Z" for r in got)
    assert [r.payload_bytes for r in got] == [23, 0, len(body), len(body), 99, 16, 0]
    assert [r.digest_ok for r in got] == [None, None, True, False, None, None, None]
    assert got[1].url == "http://a.example/" and got[2].payload == body and got[4].payload is None and got[4].refers_to_id == "<urn:uuid:response>"
    assert got[4].payload_digest == "md5:abc" and got[2].payload_digest == warc.base32_sha1(body)
    assert got[5].headers["warc-concurrent-to"] == "<urn:uuid:response>, <urn:uuid:request>" and got[0].url is None


def test_pipeline_of_awkward_documents(spark, table, awkward, tmp_path):
    """Columns with clashing names, null ids, empty and long texts, repeated rows; then an empty table."""
    import corpus_pipeline as cp

    long = " ".join(f"word{k}" for k in range(60_000))
    prose = " ".join(f"p{k}" for k in range(80))
    rows = awkward + [(None, prose), (None, None), (500, long), (501, prose + " token=abcdef012345"), (501, prose + " token=abcdef012345")]
    for k, own in enumerate((rows, [])):
        docs = table(own)
        folder = tmp_path / str(k)
        folder.mkdir()
        docs.write.parquet(str(folder / "documents.parquet"))
        now = spark.read.parquet(str(folder / "documents.parquet"))
        for n, (_, stage) in enumerate(cp.STAGES[:-1]):
            now = stage(spark, now, str(folder))
            assert now.columns == docs.columns
            now = materialize(now, "test")
        got = cp.run(spark, str(folder)).collect()
        if not own:
            assert got == [] and now.count() == 0
            continue
        texts = [r.text for r in now.collect()]
        # the row without an id stays beside its near copy, of the others one is kept
        assert long in texts and sorted(t for t in texts if t.startswith("p0 ")) == [prose, prose + " [secret]", prose + " [secret]"]
        assert sum(r.length for r in got if r.doc_id == 500) > 60_000
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in held.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
