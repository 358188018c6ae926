"""Tokenising and packing against the libraries and against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm import sentencepiece_fst as fst


def odd_texts(seed, n=1500):
    r = random.Random(seed)
    alpha = "aabcdeeé ▁\n\t  日本😀the ingonß.,,123<s>\x00　ÀÿĀ\x85\xa0'sɐЖ"
    return ["".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "▁", "x" * 3000, " " * 300, "a" + " " * 40 + "b", "<|endoftext|>", "a<|endoftext|>b", "it's we'll"]


def test_encoder_gives_the_library_ids(spark, sf):
    path = packing.vocabulary_path()
    encode, library = packing.Encoder(path), Tokenizer.from_file(path)
    texts = odd_texts(1) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        near = not any(b >= 0xC9 for b in t.encode())
        assert encode(t, near).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_transducer_gives_the_library_ids(spark, sf):
    t, library = fst.Transducer(fst.model_path()), sentencepiece.SentencePieceProcessor(model_file=fst.model_path())
    texts = odd_texts(2) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for x, want in zip(texts, library.encode(texts, num_threads=1), strict=True):
        ids = np.frombuffer(t.encode(x), "<i4")
        assert ids.tolist() == want, x
        assert t.decode(ids) == library.decode(want)


def test_unigram_weights_take_the_least_path():
    t = fst.Transducer(fst.model_path())
    t.unigram = True
    t.piece = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -3.0, 1), ("ab", -4.0, 1), ("b", -2.5, 1), ("▁a", -2.0, 1)]
    t.id = {p: i for i, (p, _, k) in enumerate(t.piece) if k == 1}
    t.score = [s for _, s, _ in t.piece]
    t.trie = fst.trie(t.id)
    t.penalty, t.byte, t.unknown = 20.0, {}, 0
    assert t.compose("▁ab") == [5, 4]  # 4.5, against 5 for ▁ + ab
    assert t.compose("▁?") == [1, 0]


def test_sentencepiece_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a  b", 5), (3, "x y", 6), (3, "x y", 6)], "doc_id long, text string, ids int")
    rows = fst.encode(df)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].ids == got[2].ids == [] and got[1].n_ids == 0 and all(r.round_trip for r in got.values())
    assert {r.doc_id: r.text for r in fst.decode(rows).collect()} == {1: "", 2: "", None: "a  b", 3: "x y"}
    assert fst.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_a_packing(seed):
    r = np.random.default_rng(seed)
    capacity = [2048, 64, 10, 2048][seed]
    sizes = np.clip(r.lognormal(np.log(capacity / 4), 1.0, 3000).astype(int), 1, capacity)
    counts = collections.Counter(sizes.tolist())
    runs, bins = packing.plan(counts, capacity)
    placed, seen = collections.defaultdict(list), collections.Counter()
    for length, first, b, offset, each in runs:
        following = [x[1] for x in runs if x[0] == length and x[1] > first]
        for k in range(first, min([*following, counts[length]])):
            placed[b + (k - first) // each].append((offset + (k - first) % each * length, length))
            seen[length] += 1
    assert seen == counts and len(placed) == bins
    for items in placed.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))]
        assert sum(n for _, n in items) <= capacity
        assert sum(n > capacity // 3 for _, n in items) <= 2
    assert bins <= 1.03 * max(np.ceil(sizes.sum() / capacity), (sizes > capacity / 2).sum()) + 1


def test_packing_rows(spark, sf):
    library = Tokenizer.from_file(packing.vocabulary_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (901, ""), (None, "a b")], "doc_id long, text string"))
    rows = packing.pack(docs.repartition(3), with_ids=True).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for d in docs.collect():
        if d.doc_id == 901:
            continue
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == ids
        assert [r.start for r in mine] == [sum(m.length for m in mine[:i]) for i in range(len(mine))]
        assert all(r.length == 2048 for r in mine[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    assert len(by_doc[901]) == 2
    for items in by_bin.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_ignores_other_columns_and_takes_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 8999 + "word", 5, 6, "x")] * 2 + [(1, "", 5, 6, "x")], "doc_id long, text string, part int, r long, ids string")
    rows = packing.pack(df).collect()
    assert sum(r.length for r in rows) == 2 * 9001 + 1 and {r.doc_id for r in rows} == {1} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def spliced(tmp_path, spec):
    """The model file with another normaliser."""
    with open(fst.model_path(), "rb") as f:
        whole, out, i = f.read(), b"", 0
    varint = lambda n: bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
    while i < len(whole):
        key, at = fst._varint(whole, i)
        n, at = fst._varint(whole, at)
        out += whole[i : at + n] if key >> 3 != 3 else varint(key) + varint(len(spec)) + spec
        i = at + n
    path = tmp_path / "m.model"
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisers_give_the_library_ids(tmp_path, rule):
    path = spliced(tmp_path, sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    t, library = fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["  Ａｂ  ﬁ ½ ① ", "ＡＢＣ\t x​\n\ny", "é 가 ㌀ ǅ", "   ", "A  B", "　a　", "İß ſ"]
    for x in odd_texts(4) + more:
        assert np.frombuffer(t.encode(x), "<i4").tolist() == library.encode(x), x


def test_other_models_are_refused(tmp_path):
    t = tmp_path / "x.model"
    t.write_bytes(b"\x0a\x05\x0a\x01a\x18\x04")  # a user-defined piece
    with pytest.raises(ValueError, match="user-defined"):
        fst.Transducer(str(t))


def test_long_texts_without_blanks_take_linear_time():
    import time

    t = fst.Transducer(fst.model_path())
    library = sentencepiece.SentencePieceProcessor(model_file=fst.model_path())
    r = random.Random(4)
    short = "".join(r.choice("abcdefgh日本") for _ in range(20_000))
    assert np.frombuffer(t.encode(short), "<i4").tolist() == library.encode(short)
    start = time.time()
    t.encode("".join(r.choice("abcdefgh日本") for _ in range(1_000_000)))
    assert time.time() - start < 30
