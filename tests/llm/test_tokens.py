"""Byte-level BPE and token files against the tokenizer libraries."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import LONG, TEXTS, documents, empty_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.llm import bpe_tree, pretokens, token_output
from strandmill.llm.pretokens import ranks, split

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", "s", "t", "re", "ll", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "²", "!", "é", "日本", "́", "-", "don't", "x'll", "''s", " 's", "😀", "\x1c", "_", " ", "<|endoftext|>"]
texts = st.lists(st.one_of(st.text(max_size=20), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(bpe_tree.vocabulary()), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts)
def test_split_is_the_pattern(some):
    some = [t.encode("utf-8", "ignore").decode() for t in some]
    pattern = regex.compile(public_tokenizers.PATTERN)
    want = [m.encode() for k, t in enumerate(some) for m in (pattern.findall(t) + ["\n"] * (k + 1 < len(some)))]
    assert split(some)[0].to_pylist() == want


TREES = {leaf: bpe_tree.TreeEncoder(bpe_tree.vocabulary(), leaf, 1) for leaf in (1, 3, 8)}


@settings(max_examples=200, deadline=None)
@given(texts, st.sampled_from(sorted(TREES)))
def test_tree_is_the_library(library, some, leaf):
    some = [t.encode("utf-8", "ignore").decode() for t in some]
    got = TREES[leaf].encode(some)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in some]
    assert [TREES[leaf].decode(x) for x in got] == [t.encode() for t in some]


def test_joins_may_be_grouped_in_any_way(library):
    tree, text = TREES[3], "".join(random.Random(4).choice(PIECES) for _ in range(200))
    parts = [(text[i : i + 9], *tree.batch([text[i : i + 9]])) for i in range(0, len(text), 9)]
    left = parts[0]
    for p in parts[1:]:
        left = tree.join(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = tree.join(p, right)
    assert left[1].tolist() == right[1].tolist() == library.encode_ordinary(text)


def test_one_giant_word(library):
    text = "ab" * 30_000 + "c"
    assert bpe_tree.TreeEncoder(bpe_tree.vocabulary()).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_column(spark, library):
    docs = odd_documents(spark)
    rows = bpe_tree.encode_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.bpe.ids == ids and r.bpe.n_tokens == len(ids)
        assert r.bpe.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.bpe.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe_tree.encode_documents(docs, with_ids=False).filter("bpe.ids IS NOT NULL").count() == 0
    assert bpe_tree.encode_documents(empty_documents(spark)).count() == 0


def token_rows(docs):
    manifest, folder = token_output.write_tokens(docs)
    return token_output.read_tokens(token_output.placed(manifest), folder).collect(), manifest, folder


def test_token_files(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_output.vocabulary())
    assert own.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = documents(spark, [*TEXTS, "a <|endoftext|> b"], [9 * i % 31 for i in range(len(TEXTS) + 1)])
    rows, manifest, _ = token_rows(docs)
    at = 0
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*own.encode(by_id[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert sum(m.tokens for m in manifest.collect()) == at


def test_token_files_edges(spark):
    docs = odd_documents(spark)
    rows, _, _ = token_rows(docs)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert token_rows(empty_documents(spark))[0] == []


def test_random_access_and_checks(spark):
    _, manifest, folder = token_rows(documents(spark, TEXTS))
    system, root = token_output.split_uri(folder)
    name = next(x.path for x in system.get_file_info(token_output.fs.FileSelector(root)) if x.path.endswith(".dict"))
    words = system.open_input_stream(name).read()
    encode = token_output.encoder(token_output.vocabulary())
    want = [encode([t or ""])[0].tolist() + [0] for t in TEXTS]
    got = {}
    for m in manifest.collect():
        tokens = token_output.TokenFile(m.file, words)
        for k in reversed(range(len(tokens))):
            got[int(tokens.index["doc_id"][k])] = tokens.ids(k).tolist()
    assert [got[i] for i in range(len(TEXTS))] == want
    with pytest.raises(ValueError, match="dictionary"):
        token_output.TokenFile(manifest.first().file, words + b"x")


def test_narrow_ids_are_refused():
    assert token_output.serialised(np.array([65535], np.uint32), 0, 2) == b"\xff\xff\0\0"
    with pytest.raises(ValueError, match="bytes"):
        token_output.serialised(np.array([70000], np.uint32), None, 2)
    assert token_output.id_width(token_output.vocabulary()) == 2


def test_samples_come_from_the_whole_text():
    ids = np.arange(100_000)
    found = token_output.sampled(ids)
    assert len(found) == token_output.SAMPLE_PIECES and found[0][0] == 0 and found[-1][-1] == 99_999
    assert np.concatenate(token_output.sampled(ids[:1000])).tolist() == list(range(1000)) and token_output.sampled(ids[:0]) == []


def test_the_cache_is_bounded(monkeypatch):
    from strandmill.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHED", 1000)
    encode = pretokens.BatchEncoder(lambda new: [list(m) for m in new])
    for k in range(50):
        text = f"{'x' * 300} word{k} other{k}"
        assert bytes(encode([text])[0].astype(np.uint8)) == text.encode()
        assert encode.held < 2000 and len(encode.known) < 9 and all(len(m) <= pretokens.LONG for m in encode.known)


def by_bytes(matches):
    rows = [list(m) for m in matches.to_pylist()]
    order = np.arange(len(rows))[::-1]
    return order, np.array([x for i in order for x in rows[i]], np.uint32), np.array([len(rows[i]) for i in order], np.int64)


def test_the_cache_of_large_batches_is_bounded(monkeypatch):
    from strandmill.llm import pretokens

    monkeypatch.setattr(pretokens, "KEPT", 1000)
    monkeypatch.setattr(pretokens, "PIECE", 64)
    encode = pretokens.BlockEncoder(by_bytes)
    for k in range(50):
        texts = [f"{'x' * 300} word{k} other{k}", "", f"again word{k} \u00fcber{k}", "y" * 40, " "]
        assert [bytes(x.astype(np.uint8)) for x in encode(texts)] == [t.encode() for t in texts]
        assert encode.held() < 3000 and all(len(m) <= pretokens.LONG for m in encode.keys.to_pylist())
    assert encode([]) == [] and [len(x) for x in encode([""])] == [0] and [len(x) for x in encode(["", "z" * 70, "", "z" * 70])] == [0, 70, 0, 70]


@pytest.mark.parametrize("joined", [1, 2, 1000])
def test_joined_matches_have_their_own_ids(monkeypatch, joined):
    monkeypatch.setattr(token_output, "JOINED", joined)
    tokenizer = token_output.load(token_output.vocabulary())
    matches = [" a", "a", " 12", " !", " ", "\n\n", "'s", " \u00fcber", " \u00a0x", "  ", " \u4e2d\u6587", "x" * 500, " " + "z" * 500, " \u0661"]
    for some in (matches, matches[:1], matches[1:2], []):
        order, ids, sizes = token_output.match_encoder(tokenizer)(pa.array([m.encode() for m in some], pa.binary()))
        assert sorted(order.tolist()) == list(range(len(some)))
        ends = np.cumsum(sizes)
        for i, end, n in zip(order, ends, sizes, strict=True):
            assert ids[end - n : end].tolist() == tokenizer.encode(some[i], add_special_tokens=False).ids


def test_wide_ids(spark):
    manifest, folder = token_output.write_tokens(documents(spark, [LONG, "x"]), width=4)
    rows = token_output.read_tokens(token_output.placed(manifest), folder).collect()
    assert len(rows) == 2


def test_cuts_come_from_the_whole_text(spark):
    long = "".join(f"{i:06d} " for i in range(20_000))
    rows = spark.createDataFrame([("short",), ("",), (long,)], "text string").select(token_output.cut(F.col("text")).alias("cuts")).collect()
    assert [r.cuts for r in rows[:2]] == [["short"], [""]]
    own = rows[2].cuts
    assert len(own) == token_output.SAMPLE_PIECES and all(len(c) == token_output.PIECE_CHARS and c in long for c in own)
    assert long.startswith(own[0]) and long.endswith(own[-1])


def test_class_table_takes_little_memory():
    """Workers of one machine make it at the same time, when a stage begins."""
    pretokens.classes()  # what is loaded once counts not
    tracemalloc.start()
    own = pretokens.classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (own == pretokens.classes()).all() and peak < 40e6, peak
