"""A text longer than a block of bytes, through every operator on documents."""

import random
import re
import zlib

import numpy as np
import pytest

from pulsegrid.llm import licenses, line_dedup, ngram_join, packing, quality_crf, quality_rules, secrets, sentencepiece
from pulsegrid.llm.common import BLOCK_BYTES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(22_000)]
    lines[21_000] += " token = abcdef0123456789 under the mit license"
    text = "\n".join(lines) + "\na line of which three documents have a copy"
    assert len(text) > 1.2 * BLOCK_BYTES
    return text


def test_operators_take_long_texts_whole(spark, table, long_text):
    copy = "a line of which three documents have a copy"
    docs = table([(1, long_text), (2, long_text + " more"), (3, copy), (4, copy), (5, None)]).repartition(2)
    words = WORD.findall(long_text)
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    n = len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert linked[1] == (n, 1) and linked[2][1] == 1 and linked[5] == (0, 5)
    found = {r.doc_id: r for r in secrets.scan(docs, None, fitted=True).collect()}
    at = long_text.index("token = ")
    assert found[1].n_assign == 1 and f"assign:{at}:{at + 24}" in found[1].spans
    marked = {r.doc_id: r for r in licenses.digests(docs).collect()}
    assert marked[1].n_words == len(re.findall("[a-z0-9]+", long_text)) and marked[1].labels == "mit" and marked[1].n_base == 1
    lines = {r.doc_id: r for r in line_dedup.digests(docs).collect()}
    assert lines[1].n_lines == 22_001 and lines[1].n_dropped == 1 and lines[4].n_dropped == 0 and lines[3].n_dropped == 1
    counts = {r.doc_id: r for r in quality_rules.score_documents(docs).collect()}
    assert counts[1].n_words == len(words) and counts[1].word_chars == sum(map(len, words)) and counts[1].kept
    field = quality_crf.Field(np.ones(quality_crf.N_FEATURES) / 9, np.zeros((2, 2)), np.zeros(2))
    block = next(quality_crf.blocks(docs.where("doc_id = 1").toArrow().column("text")))
    assert 0 < quality_crf.quality(field, block)[0] < 1 and len(quality_crf.line_features(block)[0]) == 22_001
    ids = {r.doc_id: r for r in sentencepiece.digests(docs).collect()}
    assert ids[1].n_ids > len(words) and ids[5].n_ids == 0
    packed = packing.pack_documents(docs).where("doc_id = 1").collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path()).encode(long_text, add_special_tokens=False).ids + [1]
    assert sum(r.length for r in packed) == len(whole) and {r.length for r in packed if r.piece < len(packed) - 1} == {packing.CAPACITY}
    last = max(packed, key=lambda r: r.piece)
    assert last.ids_crc32 == zlib.crc32(np.array(whole[last.start :], "<u4").tobytes())


def test_secrets_of_a_text_with_many_findings_take_little_time():
    import time

    import numpy as np
    import pyarrow as pa

    from pulsegrid.llm import secrets

    def text(n):
        return " ".join(f"mid{k} für {k * 7919 % 10**9:09d}{k:015x}" + " and" * (k % 3) for k in range(n))

    took = []
    for n in (2_000, 10_000):
        began = time.process_time()
        out = secrets.labelled(text(n), np.random.default_rng(1))
        took.append(time.process_time() - began)
        # every finding once in the text, twice elsewhere
        assert sum(y for y, w in out if w is not None) >= 3 * n
    assert took[1] < 12 * took[0]
    data = text(10_000) + " token=Ab1" * 20_000
    began = time.process_time()
    (found,) = secrets.scan_texts(pa.array([data]), None)
    assert len(found) == 10_000 and time.process_time() - began < 20


def test_spans_that_touch():
    import numpy as np

    from pulsegrid.llm import secrets

    rng = np.random.default_rng(3)
    for _ in range(200):
        others = np.sort(rng.integers(0, 60, (rng.integers(0, 8), 2)), 1)
        starts, ends = np.sort(rng.integers(0, 60, (9, 2)), 1).T
        want = [any(s < y and x < e for x, y in others) for s, e in zip(starts, ends)]
        assert secrets.Touching(others).of(starts, ends).tolist() == want
