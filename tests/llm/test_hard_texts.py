"""Texts made to cost much or to collide: long words, one-word texts, templates, Thue-Morse words."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from dossierflow.llm import arrow_text, minhash_dedup, secret_scan, substring_dedup

NAME = re.compile(r"(?i)\b[\w.-]*(?:" + "|".join(secret_scan.NAMES) + r")[\w.-]*[\"']?\s*$")
VALUE = re.compile(r"^[\"'(\[{<]*(?:([\w.-]+)[\"']?\s*[:=]+\s*[\"']?)?(.*?)[\"')\]}>,;.!?]*$")


def test_plain_scans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        word = "".join(rng.choice("aK7_.-=:\"'([{<)]}>,;!?é/ ") for _ in range(rng.randrange(14))).strip()
        assert secret_scan.value_span(word) == VALUE.match(word).span(2), word
        before = "".join(rng.choice(["token", "pwd", "x", "-", ".", " ", '"', "'", "=", "é", "7"]) for _ in range(rng.randrange(7)))
        assert secret_scan.named(before) == bool(NAME.search(before)), before


def test_long_words_cost_their_length():
    began = time.process_time()
    for word in ("a-" * 250_000, "1" + "." * 500_000 + "x", '"' * 500_000, "token=" * 80_000, "a" * 1_000_000):
        rows = list(secret_scan.candidates(pa.array([word + " password=hunter2hunter2 " + word])))
        kinds = {secret_scan.kind_of(v, b) for _, _, v, b, _ in rows}
        assert any(v == "hunter2hunter2" for _, _, v, _, _ in rows) and kinds
    assert time.process_time() - began < 60


def thue_morse():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(*words):
    data, offsets = arrow_text.buffers(pa.array([" ".join(words)]))
    starts, ends, _ = arrow_text.words(data, offsets)
    return arrow_text.strong_word_hashes(data, starts, ends)


def test_words_that_collide_in_a_polynomial():
    one, other = thue_morse()
    assert len(set(hashes(one, other, one, "ab", "ba", "a", "b", "aa").tolist())) == 7
    data, offsets = arrow_text.buffers(pa.array(["AbC abc"]))
    starts, ends, _ = arrow_text.words(data, offsets)
    assert len(set(arrow_text.strong_word_hashes(data, starts, ends, True).tolist())) == 1


def test_such_documents_are_not_linked_or_cut(spark):
    one, other = thue_morse()
    docs = spark.createDataFrame([(1, one), (2, other), (3, " ".join([one] * 40)), (4, " ".join([other] * 40))], "doc_id long, text string")
    assert all(r.kept for r in minhash_dedup.near_duplicates(docs).collect())
    rows = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(34)) + " " + one), (2, " ".join(f"w{k}" for k in range(34)) + " " + other)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.remove_repeats(rows).collect()} == {0}


def test_registers_of_short_sets_are_full_and_fair():
    rng = np.random.default_rng(2)
    for n, both in ((1, 1), (3, 2), (8, 7), (40, 30)):
        base = rng.integers(0, 2**63, (300, 2 * n - both), dtype=np.uint64)
        a, b = (minhash_dedup.registers(np.sort(m, axis=1).ravel(), np.repeat(np.arange(300), n), 300) for m in (base[:, :n], base[:, n - both :]))
        assert abs((a == b).mean() - both / (2 * n - both)) < 0.02
    assert (minhash_dedup.registers(np.zeros(0, np.uint64), np.zeros(0, np.int64), 2) == 0).all()


def test_short_texts_and_templates(spark):
    rng = random.Random(1)
    words = [(k, f"w{rng.randrange(12_000)}") for k in range(20_000)]
    # Templates of 13 words that differ in one: six or seven of nine shingles are common, below the threshold; every tenth is a near copy of the one before.
    templates = [(100_000 + k, " ".join(["please", "send", "the", "order", f"n{k}", "to", "our", "shop", "by", "noon", "or", "call", "us"])) for k in range(2_500)]
    copies = [(200_000 + k, templates[k * 10][1] + " thanks") for k in range(250)]
    began = time.time()
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame([*words, *templates, *copies], "doc_id long, text string").repartition(8)).collect()}
    assert time.time() - began < 240
    first = {}
    for k, w in words:
        first.setdefault(w, k)
    assert all(got[k] == first[w] for k, w in words)
    assert all(got[k] == k for k, _ in templates) and all(got[200_000 + k] == 100_000 + 10 * k for k in range(250))
